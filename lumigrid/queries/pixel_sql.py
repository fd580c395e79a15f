"""SQL for the pixel operators, written from their published formulas and apart from the plans they test.

An entry is a list of definitions ``name = expression``, one on a line; each may use those above it and the
input's columns: r, g, b (or l, a, b in Lab), x, y, and for blends a0-a2 below, b0-b2 above and m.
Nothing here is rendered from a plan.
"""

from __future__ import annotations


def select(entry: str, source: str, keys: list[str], out: list[str]) -> str:
    """One SELECT a definition, nested, so that any engine reads it."""
    sql = source
    for line in filter(str.strip, entry.splitlines()):
        name, _, expression = line.strip().partition(" = ")
        sql = f"(SELECT *, {expression} AS {name} FROM {sql})"
    return f"SELECT {', '.join(keys)}, {', '.join(out)} FROM {sql}"


def each(template: str, names: str = "r g b", out: str = "o0 o1 o2") -> str:
    return "\n".join(f"{o} = {template.replace('$', n)}" for n, o in zip(names.split(), out.split(), strict=True))


def rows(*weights: str, names: str = "r g b", out: str = "o0 o1 o2") -> str:
    """A matrix, a row of three numbers for every output."""
    return "\n".join(f"{o} = " + " + ".join(f"({w}) * {n}" for w, n in zip(row.split(), names.split(), strict=True)) for row, o in zip(weights, out.split(), strict=True))


_EXTREMES = """
hi = greatest(r, greatest(g, b))
lo = least(r, least(g, b))
"""
_LAB_OF_XYZ = """
fx = CASE WHEN X / 0.9642 > 216.0 / 24389.0 THEN sign(X) * pow(abs(X) / 0.9642, 1.0 / 3.0) ELSE (24389.0 / 27.0 * X / 0.9642 + 16.0) / 116.0 END
fy = CASE WHEN Y > 216.0 / 24389.0 THEN sign(Y) * pow(abs(Y), 1.0 / 3.0) ELSE (24389.0 / 27.0 * Y + 16.0) / 116.0 END
fz = CASE WHEN Z / 0.8249 > 216.0 / 24389.0 THEN sign(Z) * pow(abs(Z) / 0.8249, 1.0 / 3.0) ELSE (24389.0 / 27.0 * Z / 0.8249 + 16.0) / 116.0 END
o0 = 116.0 * fy - 16.0
o1 = 500.0 * (fx - fy)
o2 = 200.0 * (fy - fz)
""".replace("X", "xx").replace("Y", "yy").replace("Z", "zz")
_XYZ_OF_LAB = """
fy = (l + 16.0) / 116.0
fx = fy + a / 500.0
fz = fy - b / 200.0
xx = 0.9642 * CASE WHEN fx > 6.0 / 29.0 THEN fx * fx * fx ELSE (116.0 * fx - 16.0) * 27.0 / 24389.0 END
yy = CASE WHEN fy > 6.0 / 29.0 THEN fy * fy * fy ELSE (116.0 * fy - 16.0) * 27.0 / 24389.0 END
zz = 0.8249 * CASE WHEN fz > 6.0 / 29.0 THEN fz * fz * fz ELSE (116.0 * fz - 16.0) * 27.0 / 24389.0 END
"""
# Rows of the colour matrices.
TO_XYZ = ("0.4360747 0.3850649 0.1430804", "0.2225045 0.7168786 0.0606169", "0.0139322 0.0971045 0.7141733")
TO_SRGB = ("3.1338561 -1.6168667 -0.4906146", "-0.9787684 1.9161415 0.0334540", "0.0719453 -0.2289914 1.4052427")
_SRGB_CURVE = "CASE WHEN $ <= 0.0031308 THEN 12.92 * $ ELSE 1.055 * pow($, 1.0 / 2.4) - 0.055 END"
_BYTE = f"CASE WHEN $ <= 0 THEN 0.0 WHEN $ >= 1 THEN 255.0 ELSE floor(0.5 + 255.0 * ({_SRGB_CURVE})) END"
_HUE = """
span = hi - lo
turn = CASE WHEN span = 0 THEN 0.0 WHEN hi = r THEN (g - b) / span WHEN hi = g THEN 2.0 + (b - r) / span ELSE 4.0 + (r - g) / span END
hue = CASE WHEN turn < 0 THEN turn / 6.0 + 1.0 ELSE turn / 6.0 END
"""


def _wheel(h: str, low: str, high: str) -> str:
    """The value at a hue on the ramp low, up, high, down; the hue first brought into [0, 1)."""
    t = f"({h} - floor({h}))"
    return f"CASE WHEN {t} < 1.0 / 6 THEN {low} + ({high} - {low}) * 6.0 * {t} WHEN {t} < 0.5 THEN {high} WHEN {t} < 2.0 / 3 THEN {low} + ({high} - {low}) * (4.0 - 6.0 * {t}) ELSE {low} END"


def _rgb_of_hsl(h: str, s: str, l: str, out: str) -> str:
    a, b, c = out.split()
    return f"""
{a}hi = CASE WHEN {l} < 0.5 THEN {l} * (1.0 + {s}) ELSE {l} + {s} - {l} * {s} END
{a}lo = 2.0 * {l} - {a}hi
{a} = {_wheel(f'({h} + 1.0 / 3)', a + 'lo', a + 'hi')}
{b} = {_wheel(f'({h})', a + 'lo', a + 'hi')}
{c} = {_wheel(f'({h} - 1.0 / 3)', a + 'lo', a + 'hi')}
"""


POINT: dict[str, str] = {
    "exposure": each("($ - 0.002) / (pow(2.0, -0.7) - 0.002)"),
    "temperature": "o0 = r * 2.0\no1 = g\no2 = b * 1.5",
    "highlights_clip": each("CASE WHEN $ > 0.9 THEN 0.9 ELSE $ END"),
    "invert": "o0 = greatest(0.0, least(1.0, 0.9 - r))\no1 = greatest(0.0, least(1.0, 0.8 - g))\no2 = greatest(0.0, least(1.0, 0.7 - b))",
    "channelmixer": rows("0.9 0.1 0.0", "0.05 0.9 0.05", "0.0 0.2 0.8", out="m0 m1 m2") + "\n" + each("CASE WHEN $ < 0 THEN 0.0 ELSE $ END", "m0 m1 m2"),
    "primaries": rows("1.05 -0.03 -0.02", "-0.04 1.08 -0.04", "0.0 -0.06 1.06"),
    "velvia": _EXTREMES + """
plum = (hi + lo) / 2.0
psat = CASE WHEN plum <= 0.5 THEN (hi - lo) / (0.00001 + hi + lo) ELSE (hi - lo) / (0.00001 + greatest(0.0, 2.0 - hi - lo)) END
weight = greatest(0.0, least(1.0, ((1.0 - 1.5 * psat) + (1.0 + abs(plum - 0.5) * 2.0) * (1.0 - 0.7)) / (1.0 + (1.0 - 0.7))))
o0 = greatest(0.0, least(1.0, r + 0.4 * weight * (r - 0.5 * (g + b))))
o1 = greatest(0.0, least(1.0, g + 0.4 * weight * (g - 0.5 * (b + r))))
o2 = greatest(0.0, least(1.0, b + 0.4 * weight * (b - 0.5 * (r + g))))
""",
    "splittoning": _EXTREMES + """
lum = (hi + lo) / 2.0
darkness = greatest(0.0, least(1.0, (0.5 - 0.15 - lum) * 2.0))
light = greatest(0.0, least(1.0, (lum - 0.5 - 0.15) * 2.0))
""" + _rgb_of_hsl("0.6", "0.5", "lum", "s0 s1 s2") + _rgb_of_hsl("0.1", "0.5", "lum", "h0 h1 h2") + "\n".join(f"o{i} = CASE WHEN lum < 0.35 THEN greatest(0.0, least(1.0, {c} * (1.0 - darkness) + s{i} * darkness)) WHEN lum > 0.65 THEN greatest(0.0, least(1.0, {c} * (1.0 - light) + h{i} * light)) ELSE {c} END" for i, c in enumerate("rgb")),
    "graduatednd": """
hardness = 1.0 / (sqrt(40.0 * 40.0 + 50.0 * 50.0) / 40.0) / (1.0 - (0.5 + 30.0 / 100.0 * 0.9 / 2.0)) * 0.5
base = sin(radians(-20.0)) * -1.0 + cos(radians(-20.0)) - 1.0 + 50.0 / 100.0 * 2.0
length = (base - y * cos(radians(-20.0)) / 40.0) * hardness + x * sin(radians(-20.0)) / 50.0 * hardness
dense = pow(2.0, 1.0 * greatest(0.0, least(1.0, 0.5 + length)))
""" + each("greatest(0.0, $ / dense)"),
    "graduatednd_light": """
hardness = 1.0 / (sqrt(40.0 * 40.0 + 50.0 * 50.0) / 40.0) / (1.0 - (0.5 + 60.0 / 100.0 * 0.9 / 2.0)) * 0.5
base = sin(radians(-70.0)) * -1.0 + cos(radians(-70.0)) - 1.0 + 40.0 / 100.0 * 2.0
length = (base - y * cos(radians(-70.0)) / 40.0) * hardness + x * sin(radians(-70.0)) / 50.0 * hardness
dense = pow(2.0, 0.8 * greatest(0.0, least(1.0, 0.5 - length)))
o0 = greatest(0.0, r * (0.2 + 0.8 * dense))
o1 = greatest(0.0, g * (0.1 + 0.9 * dense))
o2 = greatest(0.0, b * dense)
""",
    "profile_gamma_log": each("greatest((log2(greatest($ / 0.18, 1.0 / 65536)) + 5.0) / 10.0, 1.0 / 65536)"),
    "rgblevels": each("CASE WHEN $ <= 0.02 THEN 0.0 ELSE pow(($ - 0.02) / (0.9 - 0.02), 1.0 / (log10((0.45 - 0.02) / (0.9 - 0.02)) / log10(0.5))) END"),
    "colorcontrast": "o0 = l\no1 = greatest(-128.0, least(128.0, a * 1.3))\no2 = greatest(-128.0, least(128.0, b * 0.8 + 2.0))",
    "colorcorrection": "o0 = l\no1 = 1.2 * (a + l * (3.0 + 1.0) / 100.0 - 1.0)\no2 = 1.2 * (b + l * (-2.0 - 4.0) / 100.0 + 4.0)",
    "colorize": "o0 = 50.0 - 0.6 * 100.0 / 2.0 + l * 0.6\no1 = 10.0\no2 = 20.0",
    "vibrance": "weight = sqrt(a * a + b * b) / 256.0\no0 = l * (1.0 - 0.5 * weight * 0.25)\no1 = a * (1.0 + 0.5 * weight)\no2 = b * (1.0 + 0.5 * weight)",
    "relight": """
place = l / 100.0 * 2.0 - 1.0
bell = exp(-(place - (0.2 * 2.0 - 1.0)) * (place - (0.2 * 2.0 - 1.0)) / ((4.0 / 10.0 / 2.0) * (4.0 / 10.0 / 2.0)))
o0 = 100.0 * greatest(0.0, least(1.0, l / 100.0 * pow(2.0, 0.33 * greatest(0.0, least(1.0, bell)))))
o1 = a
o2 = b
""",
    "levels": """
lout = CASE WHEN l / 100.0 <= 0.05 THEN 0.0 ELSE 100.0 * pow((l / 100.0 - 0.05) / (0.95 - 0.05), 1.0 / (log10((0.4 - 0.05) / (0.95 - 0.05)) / log10(0.5))) END
o0 = lout
o1 = a * lout / greatest(l, 0.01)
o2 = b * lout / greatest(l, 0.01)
""",
    "globaltonemap_reinhard": "o0 = 100.0 * (l / 100.0) / (1.0 + l / 100.0)\no1 = a\no2 = b",
    "globaltonemap_drago": "o0 = 100.0 * (100.0 * 0.01 / log10(greatest(0.0001, 100.0 / 100.0) + 1.0)) * ln(greatest(0.0001, l / 100.0 + 1.0)) / ln(greatest(0.0001, 2.0 + pow(l / 100.0 / 1.0, ln(0.85) / ln(0.5)) * 8.0))\no1 = a\no2 = b",
    "rawprepare": "o0 = CASE WHEN CAST(y AS BIGINT) % 2 = 0 AND CAST(x AS BIGINT) % 2 = 0 THEN (r - 0.01) / (0.95 - 0.01) WHEN CAST(y AS BIGINT) % 2 = 0 THEN (r - 0.02) / (0.95 - 0.02) WHEN CAST(x AS BIGINT) % 2 = 0 THEN (r - 0.03) / (0.95 - 0.03) ELSE (r - 0.04) / (0.95 - 0.04) END\no1 = g\no2 = b",
    "temperature_mosaic": "o0 = r * CASE CAST(y AS BIGINT) % 2 + CAST(x AS BIGINT) % 2 WHEN 0 THEN 2.0 WHEN 2 THEN 1.5 ELSE 1.0 END\no1 = g\no2 = b",
    "posterize": each("round(greatest(0.0, least(1.0, $)) * 7.0) / 7.0"),
    "overexposed": "o0 = r\no1 = g\no2 = b\nmark = CASE WHEN r >= 0.98 OR g >= 0.98 OR b >= 0.98 THEN 'over' WHEN r <= pow(2.0, -12.69) OR g <= pow(2.0, -12.69) OR b <= pow(2.0, -12.69) THEN 'under' ELSE '' END",
    "rawoverexposed": "o0 = r\no1 = g\no2 = b\nmark = (r >= 0.98)",
    "mask_manager": "o0 = r\no1 = g\no2 = b",
    "useless": each("CASE WHEN (CAST(x AS BIGINT) // 8 + CAST(y AS BIGINT) // 8) % 2 = 0 THEN $ * 0.5 ELSE $ END"),
    "gamma": each(_BYTE),
    "colorin": rows(*TO_XYZ, out="xx yy zz") + _LAB_OF_XYZ,
    "colorout": _XYZ_OF_LAB + rows(*TO_SRGB, names="xx yy zz", out="t0 t1 t2") + "\n" + each("CASE WHEN $ <= 0.0031308 THEN 12.92 * $ ELSE 1.055 * pow(greatest($, 0.0031308), 1.0 / 2.4) - 0.055 END", "t0 t1 t2"),
}

COLOR: dict[str, str] = {
    "xyz_to_lab": "xx = r\nyy = g\nzz = b" + _LAB_OF_XYZ,
    "lab_to_xyz": _XYZ_OF_LAB + "o0 = xx\no1 = yy\no2 = zz",
    "srgb_to_linear": each("CASE WHEN $ <= 0.04045 THEN $ / 12.92 ELSE pow(($ + 0.055) / 1.055, 2.4) END"),
    "linear_to_srgb": each("CASE WHEN $ <= 0.0031308 THEN 12.92 * $ ELSE 1.055 * pow(greatest($, 0.0031308), 1.0 / 2.4) - 0.055 END"),
    "rgb_to_xyz": rows(*TO_XYZ),
    "xyz_to_rgb": rows(*TO_SRGB),
    "rgb_to_lab": rows(*TO_XYZ, out="xx yy zz") + _LAB_OF_XYZ,
    "lab_to_rgb": _XYZ_OF_LAB + rows(*TO_SRGB, names="xx yy zz"),
    "xyz_to_prophoto": rows("1.3459433 -0.2556075 -0.0511118", "-0.5445989 1.5081673 0.0205351", "0.0 0.0 1.2118128"),
    "prophoto_to_xyz": rows("0.7976749 0.1351917 0.0313534", "0.2880402 0.7118741 0.0000857", "0.0 0.0 0.8252100"),
    "d50_to_d65": rows("0.9555766 -0.0230393 0.0631636", "-0.0282895 1.0099416 0.0210077", "0.0122982 -0.0204830 1.3299098"),
    "d65_to_d50": rows("1.0478112 0.0228866 -0.0501270", "0.0295424 0.9904844 -0.0170491", "-0.0092345 0.0150436 0.7521316"),
    "rgb_to_ycbcr": rows("0.299 0.587 0.114", "-0.168736 -0.331264 0.5", "0.5 -0.418688 -0.081312"),
    "ycbcr_to_rgb": rows("1.0 0.0 1.402", "1.0 -0.344136 -0.714136", "1.0 1.772 0.0"),
    "xyz_to_xyy": "o0 = CASE WHEN r + g + b = 0 THEN 0.0 ELSE r / (r + g + b) END\no1 = CASE WHEN r + g + b = 0 THEN 0.0 ELSE g / (r + g + b) END\no2 = g",
    "xyy_to_xyz": "o0 = CASE WHEN g = 0 THEN 0.0 ELSE b * r / g END\no1 = b\no2 = CASE WHEN g = 0 THEN 0.0 ELSE b * (1.0 - r - g) / g END",
    "xyy_to_uvy": "o0 = 4.0 * r / (-2.0 * r + 12.0 * g + 3.0)\no1 = 9.0 * g / (-2.0 * r + 12.0 * g + 3.0)\no2 = b",
    "uvy_to_xyy": "o0 = 9.0 * r / (6.0 * r - 16.0 * g + 12.0)\no1 = 4.0 * g / (6.0 * r - 16.0 * g + 12.0)\no2 = b",
    "to_polar": "angle = degrees(atan2(b, a)) / 360.0\no0 = l\no1 = pow(a * a + b * b, 0.5)\no2 = CASE WHEN angle < 0 THEN 1.0 + angle ELSE angle END",
    "from_polar": "o0 = l\no1 = a * cos(radians(360.0 * b))\no2 = a * sin(radians(360.0 * b))",
    "rgb_to_hsl": _EXTREMES + _HUE + "o0 = hue\no1 = CASE WHEN span = 0 THEN 0.0 WHEN (hi + lo) / 2.0 < 0.5 THEN span / (hi + lo) ELSE span / (2.0 - hi - lo) END\no2 = (hi + lo) / 2.0",
    "hsl_to_rgb": _rgb_of_hsl("r", "g", "b", "o0 o1 o2"),
    "rgb_to_hsv": _EXTREMES + _HUE + "o0 = hue\no1 = CASE WHEN hi = 0 THEN 0.0 ELSE span / hi END\no2 = hi",
    "hsv_to_rgb": "low = b - b * g\n" + "\n".join(f"o{i} = {_wheel(f'(r + {shift})', 'low', 'b')}" for i, shift in enumerate(("1.0 / 3", "0.0", "2.0 / 3"))),
    "xyz_to_jzazbz": """
xp = 1.15 * r - (1.15 - 1.0) * b
yp = 0.66 * g - (0.66 - 1.0) * r
""" + rows("0.41478972 0.579999 0.0146480", "-0.2015100 1.120649 0.0531008", "-0.0166008 0.264800 0.6684799", names="xp yp b", out="m0 m1 m2") + "\n" + each("pow(greatest($, 0.0) / 10000.0, 0.1593017578125)", "m0 m1 m2", "q0 q1 q2") + "\n" + each("pow((0.8359375 + 18.8515625 * $) / (1.0 + 18.6875 * $), 134.034375)", "q0 q1 q2", "p0 p1 p2") + """
iz = 0.5 * p0 + 0.5 * p1
o0 = greatest(0.0, (1.0 - 0.56) * iz / (1.0 - 0.56 * iz) - 1.6295499532821566e-11)
o1 = 3.524 * p0 - 4.066708 * p1 + 0.542708 * p2
o2 = 0.199076 * p0 + 1.096799 * p1 - 1.295875 * p2
""",
    "display_byte": each(_BYTE),
}

DELTA_E = "delta_e = sqrt(pow(l - 50.0, 2) + pow(a - 10.0, 2) + pow(b + 5.0, 2))"


def _mixed(formula: str, weight: str = "m", bounded: bool = False) -> str:
    """Each channel: what lies below, and the mode's value by the mask."""
    lines = []
    for i in range(3):
        e = f"a{i} + ({formula.replace('$a', f'a{i}').replace('$b', f'b{i}')} - a{i}) * {weight}"
        lines.append(f"o{i} = " + (f"greatest(0.0, least(1.0, {e}))" if bounded else e))
    return "\n".join(lines)


_K = "pow(2.0, 0.3)"
_SIZES = "na = greatest(0.000000000001, sqrt(a0 * a0 + a1 * a1 + a2 * a2))\nnb = greatest(0.000000000001, sqrt(b0 * b0 + b1 * b1 + b2 * b2))\n"
SCENE: dict[str, str] = {
    "normal": _mixed("$b"), "multiply": _mixed(f"({_K} * $b * $a)"), "add": _mixed(f"($a + $b * {_K})"), "subtract": _mixed(f"(CASE WHEN $a > {_K} * $b THEN $a - {_K} * $b ELSE 0.0 END)"),
    "subtract_inverse": _mixed(f"(CASE WHEN $b > {_K} * $a THEN $b - {_K} * $a ELSE 0.0 END)"), "difference": _mixed("(greatest($a, $b) - least($a, $b))"), "divide": _mixed(f"($a / greatest(0.000001, $b * {_K}))"),
    "divide_inverse": _mixed(f"($b / greatest(0.000001, $a * {_K}))"), "average": _mixed("(0.5 * $a + 0.5 * $b)"), "geometric_mean": _mixed("(sqrt(greatest(0.0, $a * $b)))"),
    "harmonic_mean": _mixed("(2.0 * $a * $b / (greatest(0.0000005, $a) + greatest(0.0000005, $b)))"), "lightness": _SIZES + _mixed("($a * nb / na)"), "chromaticity": _SIZES + _mixed("($b * na / nb)"),
    "red": "o0 = a0 + (b0 - a0) * m\no1 = a1\no2 = a2", "green": "o0 = a0\no1 = a1 + (b1 - a1) * m\no2 = a2", "blue": "o0 = a0\no1 = a1\no2 = a2 + (b2 - a2) * m",
    "reverse": "\n".join(f"o{i} = a{i} + (b{i} / greatest(0.000001, a{i} * {_K}) - a{i}) * m" for i in range(3)),
}

#: Display modes on values in [0, 1]: a below, b above.
_DISPLAY = {
    "normal": "$b", "lighten": "(CASE WHEN $b > $a THEN $b ELSE $a END)", "darken": "(CASE WHEN $b < $a THEN $b ELSE $a END)", "multiply": "($b * $a)", "average": "(0.5 * ($b + $a))", "add": "($b + $a)", "subtract": "($b + $a - 1.0)",
    "difference": "(greatest($a, $b) - least($a, $b))", "screen": "($a + $b - $a * $b)",
    "overlay": "(CASE WHEN $a <= 0.5 THEN 2.0 * $a * $b ELSE 1.0 - (2.0 - 2.0 * $a) * (1.0 - $b) END)",
    "softlight": "(CASE WHEN $b <= 0.5 THEN $a * ($b + 0.5) ELSE 1.0 - (1.0 - $a) * (1.5 - $b) END)",
    "hardlight": "(CASE WHEN $b <= 0.5 THEN 2.0 * $a * $b ELSE 1.0 - (2.0 - 2.0 * $a) * (1.0 - $b) END)",
    "vividlight": "(CASE WHEN $b <= 0 THEN 0.0 WHEN $b <= 0.5 THEN 1.0 - (1.0 - $a) / (2.0 * $b) WHEN $b < 1 THEN $a / (2.0 - 2.0 * $b) ELSE 1.0 END)",
    "linearlight": "($a + 2.0 * $b - 1.0)", "pinlight": "(CASE WHEN $b <= 0.5 THEN least($a, 2.0 * $b) ELSE greatest($a, 2.0 * $b - 1.0) END)",
}
DISPLAY = {k: _mixed(v, "m * m" if k in ("overlay", "softlight", "hardlight", "vividlight", "linearlight", "pinlight") else "m", True) for k, v in _DISPLAY.items()}


def _parts(v: str) -> str:
    """Hue, saturation and lightness of a0-a2 or b0-b2 in {v}h, {v}s, {v}l."""
    return f"""
{v}hi = greatest({v}0, greatest({v}1, {v}2))
{v}lo = least({v}0, least({v}1, {v}2))
{v}d = {v}hi - {v}lo
{v}turn = CASE WHEN {v}d = 0 THEN 0.0 WHEN {v}hi = {v}0 THEN ({v}1 - {v}2) / {v}d WHEN {v}hi = {v}1 THEN 2.0 + ({v}2 - {v}0) / {v}d ELSE 4.0 + ({v}0 - {v}1) / {v}d END
{v}h = CASE WHEN {v}turn < 0 THEN {v}turn / 6.0 + 1.0 ELSE {v}turn / 6.0 END
{v}l = ({v}hi + {v}lo) / 2.0
{v}s = CASE WHEN {v}d = 0 THEN 0.0 WHEN {v}l < 0.5 THEN {v}d / ({v}hi + {v}lo) ELSE {v}d / (2.0 - {v}hi - {v}lo) END
"""


def _hsl(h: str, s: str, l: str) -> str:
    arc = "arc = CASE WHEN bh - ah > 0.5 THEN bh - ah - 1.0 WHEN bh - ah < -0.5 THEN bh - ah + 1.0 ELSE bh - ah END"
    return _parts("a") + _parts("b") + f"{arc}\nh = {h}\ns = {s}\nlightness = {l}" + _rgb_of_hsl("h", "s", "lightness", "t0 t1 t2") + each("greatest(0.0, least(1.0, $))", "t0 t1 t2")


DISPLAY |= {
    "hsl_lightness": _hsl("ah", "as_", "al + (bl - al) * m"), "hsl_chromaticity": _hsl("ah", "as_ + (bs - as_) * m", "al"),
    "hue": _hsl("ah + arc * m", "as_", "al"), "color": _hsl("ah + arc * m", "as_ + (bs - as_) * m", "al"),
}
DISPLAY = {k: v.replace("\nas = ", "\nas_ = ") for k, v in DISPLAY.items()}  # "as" is a keyword

LAB = {
    "lab_lightness": "o0 = a0 + (b0 - a0) * m\no1 = a1\no2 = a2", "lab_l": "o0 = a0 + (b0 - a0) * m\no1 = a1\no2 = a2", "lab_a": "o0 = a0\no1 = a1 + (b1 - a1) * m\no2 = a2",
    "lab_b": "o0 = a0\no1 = a1\no2 = a2 + (b2 - a2) * m", "lab_color": "o0 = a0\no1 = a1 + (b1 - a1) * m\no2 = a2 + (b2 - a2) * m",
}
RAW = {"screen": "o0 = a0 + (a0 + b0 - a0 * b0 - a0) * m"}

_CIRCLE = "ramp = greatest(0.0, least(1.0, (30.0 * 30.0 - (x - 50.0) * (x - 50.0) - (y - 40.0) * (y - 40.0)) / (30.0 * 30.0 - 20.0 * 20.0)))\nround_ = ramp * ramp"
_LINE = "line = greatest(0.0, least(1.0, 0.5 - ((x - 50.0) * sin(radians(30.0)) + (y - 40.0) * cos(radians(30.0))) / (2.0 * 12.0)))"
_S = "s = 0.8 * round_"
MASK = {
    "circle": _CIRCLE + "\nm_ = round_",
    "ellipse": """
along = ((x - 50.0) * cos(radians(25.0)) + (y - 40.0) * sin(radians(25.0))) / 30.0
across = ((y - 40.0) * cos(radians(25.0)) - (x - 50.0) * sin(radians(25.0))) / 15.0
ramp = greatest(0.0, least(1.0, (1.4 * 1.4 - along * along - across * across) / (1.4 * 1.4 - 1.0)))
m_ = ramp * ramp
""",
    "gradient": _LINE + "\nm_ = line",
    "parametric": """
first = CASE WHEN r <= 0.1 OR r >= 0.9 THEN 0.0 WHEN r < 0.3 THEN (r - 0.1) / (0.3 - 0.1) WHEN r <= 0.6 THEN 1.0 ELSE 1.0 - (r - 0.6) / (0.9 - 0.6) END
second = CASE WHEN b <= 0.0 OR b >= 0.7 THEN 0.0 WHEN b < 0.2 THEN b / 0.2 WHEN b <= 0.5 THEN 1.0 ELSE 1.0 - (b - 0.5) / (0.7 - 0.5) END
m_ = first * (1.0 - second)
""",
    "union": f"{_CIRCLE}\n{_LINE}\n{_S}\nm_ = CASE WHEN s > line THEN s ELSE line END",
    "intersection": f"{_CIRCLE}\n{_LINE}\n{_S}\nm_ = CASE WHEN s < line THEN s ELSE line END",
    "difference": f"{_CIRCLE}\n{_LINE}\ns = 0.8 * (1.0 - round_)\nm_ = line * (1.0 - CASE WHEN line > 0 THEN s ELSE 0.0 END)",
    "sum": f"{_CIRCLE}\n{_LINE}\n{_S}\nm_ = least(1.0, line + s)",
    "exclusion": f"{_CIRCLE}\n{_LINE}\n{_S}\nm_ = CASE WHEN line > 0 AND s > 0 THEN greatest((1.0 - line) * s, line * (1.0 - s)) ELSE greatest(line, s) END",
}

_SIGMOID = """
average = greatest(0.0, (v0 + v1 + v2) / 3.0)
lowest = least(v0, least(v1, v2))
keep = CASE WHEN lowest < 0 THEN average / (average - lowest) ELSE 1.0 END
n0 = greatest(0.0, average + keep * (v0 - average))
n1 = greatest(0.0, average + keep * (v1 - average))
n2 = greatest(0.0, average + keep * (v2 - average))
fog = 0.1845 * pow((1.0 / 0.1845 - 1.0) / (1.0 / 0.0001 - 1.0), 1.0 / 1.5)
paper = pow(fog + 0.1845, 1.5) * (1.0 / 0.1845 - 1.0)
"""
POINT["sigmoid"] = "v0 = r\nv1 = g\nv2 = b" + _SIGMOID + each("1.0 * pow(fog + $, 1.5) / (paper + pow(fog + $, 1.5))", "n0 n1 n2")
CHAIN = (
    each("($ - 0.001) / (pow(2.0, -0.5) - 0.001)", out="e0 e1 e2") + "\n" + rows("0.9 0.1 0.0", "0.05 0.9 0.05", "0.0 0.2 0.8", names="e0 e1 e2", out="x0 x1 x2") + "\n" + each("greatest($, 0.0)", "x0 x1 x2", "w0 w1 w2") + """
hi = greatest(w0, greatest(w1, w2))
lo = least(w0, least(w1, w2))
plum = (hi + lo) / 2.0
psat = CASE WHEN plum <= 0.5 THEN (hi - lo) / (0.00001 + hi + lo) ELSE (hi - lo) / (0.00001 + greatest(0.0, 2.0 - hi - lo)) END
weight = 0.4 * greatest(0.0, least(1.0, ((1.0 - 1.5 * psat) + (1.0 + abs(plum - 0.5) * 2.0) * 0.3) / 1.3))
v0 = greatest(0.0, least(1.0, w0 + weight * (w0 - 0.5 * (w1 + w2))))
v1 = greatest(0.0, least(1.0, w1 + weight * (w1 - 0.5 * (w2 + w0))))
v2 = greatest(0.0, least(1.0, w2 + weight * (w2 - 0.5 * (w0 + w1))))
""" + _SIGMOID + each("pow(fog + $, 1.5) / (paper + pow(fog + $, 1.5))", "n0 n1 n2", "d0 d1 d2") + "\n" + each("CASE WHEN $ <= 0.0031308 THEN 12.92 * $ ELSE 1.055 * pow(greatest($, 0.0031308), 1.0 / 2.4) - 0.055 END", "d0 d1 d2")
)


def _hermite(t: str, nodes: list[tuple[str, str]], slopes: list[str], cases: list[str]) -> str:
    """A curve through nodes by the four Hermite polynomials; slopes as numbers worked out by hand."""
    for (x0, y0), (x1, y1), m0, m1 in zip(nodes, nodes[1:], slopes, slopes[1:]):
        h, u = f"({x1} - {x0})", f"(({t} - {x0}) / ({x1} - {x0}))"
        cases.append(f"WHEN {t} <= {x1} THEN (2 * pow({u}, 3) - 3 * pow({u}, 2) + 1) * {y0} + (pow({u}, 3) - 2 * pow({u}, 2) + {u}) * {h} * {m0} + (3 * pow({u}, 2) - 2 * pow({u}, 3)) * {y1} + (pow({u}, 3) - pow({u}, 2)) * {h} * {m1}")
    return f"greatest(0.0, least(1.0, CASE WHEN {t} <= {nodes[0][0]} THEN {nodes[0][1]} {' '.join(cases)} ELSE {nodes[-1][1]} END))"


def _tail(t: str, curve, last: str = "1.0") -> str:
    """The curve, and beyond its last node the power law with the mean exponent of three places before it."""
    y = curve(last)
    exponent = "(" + " + ".join(f"ln(({curve(f'{k} * {last}')}) / ({y})) / ln({k})" for k in ("0.7", "0.8", "0.9")) + ") / 3.0"
    return f"CASE WHEN {t} < {last} THEN {curve(t)} ELSE ({y}) * pow({t} / {last}, {exponent}) END"


# Monotone curves: secants, their means inside, the outer ones at the ends (no piece here would overshoot, so none is cut).
_RGB_CURVE = lambda t: _hermite(t, [("0.0", "0.0"), ("0.3", "0.2"), ("0.7", "0.8"), ("1.0", "1.0")], ["(0.2 / 0.3)", "((0.2 / 0.3 + 1.5) / 2)", "((1.5 + 0.2 / 0.3) / 2)", "(0.2 / 0.3)"], [])
_TONE = lambda t: _hermite(t, [("0.0", "0.0"), ("0.25", "0.18"), ("0.5", "0.5"), ("0.75", "0.82"), ("1.0", "1.0")], ["0.72", "1.0", "1.28", "1.0", "0.72"], [])
_BASE = lambda t: _hermite(t, [("0.0", "0.0"), ("0.1", "0.04"), ("0.3", "0.3"), ("0.7", "0.85"), ("1.0", "1.0")], ["0.4", "0.85", "1.3375", "0.9375", "0.5"], [])
POINT["rgbcurve"] = each(_tail("$", _RGB_CURVE))
POINT["rgbcurve_norm"] = "size = 0.2225045 * r + 0.7168786 * g + 0.0606169 * b\nbent = " + _tail("size", _RGB_CURVE) + "\n" + each("$ * bent / size")
POINT["basecurve"] = each(_tail("$", _BASE))
POINT["tonecurve"] = "v = l / 100.0\nbent = 100.0 * (" + _tail("v", _TONE) + ")\no0 = bent\no1 = CASE WHEN v > 0.01 THEN a * bent / l ELSE a * 100.0 * " + _TONE("0.01") + " END\no2 = CASE WHEN v > 0.01 THEN b * bent / l ELSE b * 100.0 * " + _TONE("0.01") + " END"
# A natural cubic spline through (0, 0), (0.5, 0.7), (1, 1): the middle second derivative is 6 * (0.3 / 0.5 - 0.7 / 0.5) / (2 * (0.5 + 0.5)) = -2.4, the outer ones 0.
_SPLINE = lambda t: f"greatest(0.0, least(1.0, CASE WHEN {t} <= 0 THEN 0.0 WHEN {t} <= 0.5 THEN {t} * (0.7 / 0.5 + 2.4 * 0.5 / 6.0) - 2.4 / (6.0 * 0.5) * pow({t}, 3) WHEN {t} <= 1.0 THEN 0.7 + ({t} - 0.5) * (0.3 / 0.5 + 2.0 * 2.4 * 0.5 / 6.0) - 1.2 * pow({t} - 0.5, 2) + 2.4 / (6.0 * 0.5) * pow({t} - 0.5, 3) ELSE 1.0 END))"
POINT["rgbcurve_cubic"] = each(_tail("$", _SPLINE))
# Catmull-Rom through (0, 0), (0.4, 0.3), (1, 1): the inner tangent is the secant of its neighbours, 1.
POINT["basecurve_catmull_rom"] = each(_tail("$", lambda t: _hermite(t, [("0.0", "0.0"), ("0.4", "0.3"), ("1.0", "1.0")], ["0.75", "1.0", "(0.7 / 0.6)"], [])))
POINT["colisa"] = """
k = 20.0 * 0.3 * 0.3
v = l / 100.0
v07 = 0.5 * (sqrt(1.0 + k) * (2 * 0.7 - 1) / sqrt(1.0 + k * pow(2 * 0.7 - 1, 2)) + 1.0)
v08 = 0.5 * (sqrt(1.0 + k) * (2 * 0.8 - 1) / sqrt(1.0 + k * pow(2 * 0.8 - 1, 2)) + 1.0)
v09 = 0.5 * (sqrt(1.0 + k) * (2 * 0.9 - 1) / sqrt(1.0 + k * pow(2 * 0.9 - 1, 2)) + 1.0)
power = (ln(v07) / ln(0.7) + ln(v08) / ln(0.8) + ln(v09) / ln(0.9)) / 3.0
bent = CASE WHEN v < 1 THEN 0.5 * (sqrt(1.0 + k) * (2 * v - 1) / sqrt(1.0 + k * pow(2 * v - 1, 2)) + 1.0) ELSE pow(v, power) END
o0 = 100.0 * pow(greatest(bent, 0.0), 1.0 / 1.4)
o1 = a * 1.1
o2 = b * 1.1
"""
POINT["negadoctor"] = "\n".join(
    f"d{i} = -log10({base} / greatest({c}, pow(2.0, -32))) * {high} / 2.046 + {high} * -0.05 * {low}\nw{i} = pow(greatest(-(0.9245 * pow(10.0, d{i}) - 0.9245 * (1.0 + 0.0755)), 0.0), 4.0)\no{i} = CASE WHEN w{i} > 0.75 THEN 0.75 + (1.0 - exp(-(w{i} - 0.75) / 0.25)) * 0.25 ELSE w{i} END"
    for i, (c, base, high, low) in enumerate((("r", "1.0", "1.0", "1.0"), ("g", "0.45", "1.1", "0.95"), ("b", "0.25", "0.9", "1.05")))
)
POINT["globaltonemap_filmic"] = "v = greatest(0.0, l / 100.0 - 0.004)\no0 = 100.0 * ((v * (6.2 * v + 0.5)) / (v * (6.2 * v + 1.7) + 0.06))\no1 = a\no2 = b"
_PRO = rows("1.3459433 -0.2556075 -0.0511118", "-0.5445989 1.5081673 0.0205351", "0.0 0.0 1.2118128", names="xx yy zz", out="p0 p1 p2")
_FROM_PRO = rows("0.7976749 0.1351917 0.0313534", "0.2880402 0.7118741 0.0000857", "0.0 0.0 0.8252100", names="u0 u1 u2", out="xx2 yy2 zz2") + "\n" + _LAB_OF_XYZ.replace("xx", "xx2").replace("yy", "yy2").replace("zz", "zz2").replace("fx =", "gx =").replace("fy =", "gy =").replace("fz =", "gz =").replace("fx", "gx").replace("fy", "gy").replace("fz", "gz")
_IN = _XYZ_OF_LAB + _PRO + "\n" + each("yy + 1.1 * ($ - yy)", "p0 p1 p2", "q0 q1 q2") + "\n"
_OUT = "\nluma = 0.2880402 * t0 + 0.7118741 * t1 + 0.0000857 * t2\n" + each("luma + 0.9 * ($ - luma)", "t0 t1 t2", "s0 s1 s2") + "\n" + each("0.18 * pow(greatest($, 0.0) / 0.18, 1.0 / 1.2)", "s0 s1 s2", "u0 u1 u2") + "\n" + _FROM_PRO
POINT["colorbalance"] = _IN + "\n".join(f"t{i} = pow(greatest(q{i} * {gain} + {lift}, 0.0), {power})" for i, (gain, lift, power) in enumerate((("1.1 * 1.0", "(1.0 + 1.02 - 2.0)", "(2.0 - 1.0) * (2.0 - 0.95)"), ("1.1 * 0.9", "(1.0 + 0.98 - 2.0)", "(2.0 - 1.0) * (2.0 - 1.05)"), ("1.1 * 1.2", "(1.0 + 1.03 - 2.0)", "(2.0 - 1.0) * (2.0 - 0.9)")))) + _OUT
POINT["colorbalance_lgg"] = _IN + "\n".join(f"t{i} = pow(greatest(((pow(greatest(q{i}, 0.0), 1.0 / 2.2) - 1.0) * (2.0 - {lift}) + 1.0) * 1.1 * {gain}, 0.0), 2.2 / {gamma})" for i, (lift, gamma, gain) in enumerate((("1.02", "0.95", "1.0"), ("0.98", "1.05", "0.9"), ("1.03", "0.9", "1.2")))) + _OUT
POINT["basicadj"] = each("($ - 0.01) / (pow(2.0, -0.3) - 0.01)", out="e0 e1 e2") + """
lum = 0.2225045 * e0 + 0.7168786 * e1 + 0.0606169 * e2
reach = 1.0 - (10.0 / 100.0 / 8.0 + 0.1)
over = CASE WHEN lum + reach - 1.0 = 0 THEN 0.000001 ELSE lum + (reach - 1.0) END
ratio = CASE WHEN lum > 0 THEN ln(1.0 + greatest(over / reach * 0.4, -0.999999)) * (reach / (over * 0.4)) ELSE 1.0 END
""" + each("$ * ratio", "e0 e1 e2", "f0 f1 f2") + "\n" + each("CASE WHEN $ > 0 THEN pow($, 1.0 / 1.2) ELSE $ END", "f0 f1 f2", "g0 g1 g2") + "\n" + each("CASE WHEN $ > 0 THEN 0.1842 * pow($ / 0.1842, 1.2) ELSE $ END", "g0 g1 g2", "h0 h1 h2") + """
mean = (h0 + h1 + h2) / 3.0
apart = sqrt(pow(h0 - mean, 2) + pow(h1 - mean, 2) + pow(h2 - mean, 2))
vib = 0.2 / 1.4 * (1.0 - pow(apart, 0.2 / 1.4))
""" + each("mean + (1.1 + vib) * ($ - mean)", "h0 h1 h2")  # fmt: skip


DISPLAY["coloradjust"] = _hsl("ah + arc * m", "as_ + (bs - as_) * m", "bl").replace("\nas = ", "\nas_ = ")
_VALUES = "".join(f"""
{v}hi = greatest({v}0, greatest({v}1, {v}2))
{v}d = {v}hi - least({v}0, least({v}1, {v}2))
{v}turn = CASE WHEN {v}d = 0 THEN 0.0 WHEN {v}hi = {v}0 THEN ({v}1 - {v}2) / {v}d WHEN {v}hi = {v}1 THEN 2.0 + ({v}2 - {v}0) / {v}d ELSE 4.0 + ({v}0 - {v}1) / {v}d END
{v}h = CASE WHEN {v}turn < 0 THEN {v}turn / 6.0 + 1.0 ELSE {v}turn / 6.0 END
{v}sat = CASE WHEN {v}hi = 0 THEN 0.0 ELSE {v}d / {v}hi END
""" for v in "ab")


def _of_hsv(h: str, s: str, v: str) -> str:
    return f"hue = {h}\nsat = {s}\ntop = {v}\nlow = top - top * sat\n" + "\n".join(f"o{i} = {_wheel(f'(hue + {shift})', 'low', 'top')}" for i, shift in enumerate(("1.0 / 3", "0.0", "2.0 / 3")))


DISPLAY["hsv_value"] = _VALUES + _of_hsv("ah", "asat", "ahi + (bhi - ahi) * m")
DISPLAY["hsv_color"] = _VALUES + """
vx = asat * cos(radians(360.0 * ah)) * (1.0 - m) + bsat * cos(radians(360.0 * bh)) * m
vy = asat * sin(radians(360.0 * ah)) * (1.0 - m) + bsat * sin(radians(360.0 * bh)) * m
""" + _of_hsv("CASE WHEN atan2(vy, vx) < 0 THEN degrees(atan2(vy, vx)) / 360.0 + 1.0 ELSE degrees(atan2(vy, vx)) / 360.0 END", "sqrt(vx * vx + vy * vy)", "ahi")
DISPLAY |= {k: SCENE[k] for k in ("red", "green", "blue")}
RAW = {k: v.splitlines()[0] for k, v in DISPLAY.items() if k in _DISPLAY} | {"normal_unbounded": "o0 = a0 + (b0 - a0) * m"}

# Masks: a circle drawn, ranges of the first and third channel (the third turned round), opacity 0.913702.
_FIRST, _THIRD = MASK["parametric"].strip().splitlines()[:2]
_SHAPES = f"{_CIRCLE}\n{_FIRST}\n{_THIRD}\n"
MASK_MODES = {
    "uniform": "m_ = 0.913702", "drawn": _SHAPES + "m_ = 0.913702 * round_", "drawn_inverse": _SHAPES + "m_ = 0.913702 * (1.0 - round_)", "ranges": _SHAPES + "m_ = 0.913702 * first * (1.0 - second)",
    "both": _SHAPES + "m_ = 0.913702 * round_ * first * (1.0 - second)", "both_inverse": _SHAPES + "m_ = 0.913702 * (1.0 - round_ * first * (1.0 - second))",
    "inclusive": _SHAPES + "m_ = 0.913702 * (1.0 - (1.0 - round_) * (1.0 - first) * second)", "inclusive_inverse": _SHAPES + "m_ = 0.913702 * (1.0 - round_) * (1.0 - first) * second",
    "raster": "m_ = 0.913702 * (x % 10) / 10.0", "raster_inverse": "m_ = 0.913702 * (1.0 - (x % 10) / 10.0)",
}
