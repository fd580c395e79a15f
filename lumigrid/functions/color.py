"""Colour spaces as expression plans over the columns c0, c1 and c2.

The formulas are the published ones (CIE, sRGB, HSL, HSV, Jzazbz); white is D50 unless said.
"""

from __future__ import annotations

from ..plans.layers import Plan, matrix, num

# Matrices and constants of the colour spaces.
EPSILON, KAPPA = 216.0 / 24389.0, 24389.0 / 27.0
D50 = (0.9642, 1.0, 0.8249)
SRGB_TO_XYZ_D50 = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))
XYZ_D50_TO_SRGB = ((3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289914, 1.4052427))
PROPHOTO_TO_XYZ = ((0.7976749, 0.1351917, 0.0313534), (0.2880402, 0.7118741, 0.0000857), (0.0, 0.0, 0.8252100))
XYZ_TO_PROPHOTO = ((1.3459433, -0.2556075, -0.0511118), (-0.5445989, 1.5081673, 0.0205351), (0.0, 0.0, 1.2118128))
D50_TO_D65 = ((0.9555766, -0.0230393, 0.0631636), (-0.0282895, 1.0099416, 0.0210077), (0.0122982, -0.0204830, 1.3299098))
D65_TO_D50 = ((1.0478112, 0.0228866, -0.0501270), (0.0295424, 0.9904844, -0.0170491), (-0.0092345, 0.0150436, 0.7521316))
YCBCR = ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312))
JZ_LMS = ((0.41478972, 0.579999, 0.0146480), (-0.2015100, 1.120649, 0.0531008), (-0.0166008, 0.264800, 0.6684799))
JZ_IZAZBZ = ((0.5, 0.5, 0.0), (3.524000, -4.066708, 0.542708), (0.199076, 1.096799, -1.295875))
PI = 3.141592653589793


def xyz_to_lab(p: Plan = Plan()) -> Plan:
    f = lambda x, w: f"CASE WHEN {x} / {num(w)} > {num(EPSILON)} THEN cbrt({x} / {num(w)}) ELSE ({num(KAPPA)} * {x} / {num(w)} + 16) / 116 END"
    p = p.let(**{f"f{i}": f(f"c{i}", D50[i]) for i in range(3)})
    return p.let(c0="116 * f1 - 16", c1="500 * (f0 - f1)", c2="200 * (f1 - f2)")


def lab_to_xyz(p: Plan = Plan()) -> Plan:
    p = p.let(f1="(c0 + 16) / 116").let(f0="c1 / 500 + f1", f2="f1 - c2 / 200")
    g = lambda x, w: f"{num(w)} * CASE WHEN {x} > {num(EPSILON ** (1 / 3))} THEN {x} * {x} * {x} ELSE (116 * {x} - 16) / {num(KAPPA)} END"
    return p.let(**{f"c{i}": g(f"f{i}", D50[i]) for i in range(3)})


def srgb_to_linear(p: Plan = Plan()) -> Plan:
    return p.let(**{c: f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE power(({c} + 0.055) / 1.055, 2.4) END" for c in ("c0", "c1", "c2")})


def linear_to_srgb(p: Plan = Plan()) -> Plan:
    return p.let(**{c: f"CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * power(greatest({c}, {num(0.0031308)}), {num(1 / 2.4)}) - 0.055 END" for c in ("c0", "c1", "c2")})


def rgb_to_xyz(p: Plan = Plan()) -> Plan:
    return matrix(p, SRGB_TO_XYZ_D50)


def xyz_to_rgb(p: Plan = Plan()) -> Plan:
    return matrix(p, XYZ_D50_TO_SRGB)


def rgb_to_lab(p: Plan = Plan()) -> Plan:
    return xyz_to_lab(rgb_to_xyz(p))


def lab_to_rgb(p: Plan = Plan()) -> Plan:
    return xyz_to_rgb(lab_to_xyz(p))


def xyz_to_prophoto(p: Plan = Plan()) -> Plan:
    return matrix(p, XYZ_TO_PROPHOTO)


def prophoto_to_xyz(p: Plan = Plan()) -> Plan:
    return matrix(p, PROPHOTO_TO_XYZ)


def d50_to_d65(p: Plan = Plan()) -> Plan:
    return matrix(p, D50_TO_D65)


def d65_to_d50(p: Plan = Plan()) -> Plan:
    return matrix(p, D65_TO_D50)


def rgb_to_ycbcr(p: Plan = Plan()) -> Plan:
    return matrix(p, YCBCR)


def ycbcr_to_rgb(p: Plan = Plan()) -> Plan:
    return p.let(c0="c0 + 1.402 * c2", c1="c0 - 0.344136 * c1 - 0.714136 * c2", c2="c0 + 1.772 * c1")


def xyz_to_xyy(p: Plan = Plan()) -> Plan:
    return p.let(t="c0 + c1 + c2").let(c0="CASE WHEN t = 0 THEN 0 ELSE c0 / t END", c1="CASE WHEN t = 0 THEN 0 ELSE c1 / t END", c2="c1")


def xyy_to_xyz(p: Plan = Plan()) -> Plan:
    return p.let(c0="CASE WHEN c1 = 0 THEN 0 ELSE c0 * c2 / c1 END", c1="c2", c2="CASE WHEN c1 = 0 THEN 0 ELSE (1 - c0 - c1) * c2 / c1 END")


def xyy_to_uvy(p: Plan = Plan()) -> Plan:
    return p.let(t="-2 * c0 + 12 * c1 + 3").let(c0="4 * c0 / t", c1="9 * c1 / t")


def uvy_to_xyy(p: Plan = Plan()) -> Plan:
    return p.let(t="6 * c0 - 16 * c1 + 12").let(c0="9 * c0 / t", c1="4 * c1 / t")


def to_polar(p: Plan = Plan()) -> Plan:
    """Lab to LCh, Luv to Lch, Jzazbz to JzCzhz: chroma and hue, a turn being 1."""
    return p.let(h=f"atan2(c2, c1) / {num(2 * PI)}").let(c1="sqrt(c1 * c1 + c2 * c2)", c2="CASE WHEN h < 0 THEN h + 1 ELSE h END")


def from_polar(p: Plan = Plan()) -> Plan:
    return p.let(c1=f"c1 * cos({num(2 * PI)} * c2)", c2=f"c1 * sin({num(2 * PI)} * c2)")


_HUE = "CASE WHEN d = 0 THEN CAST(0 AS DOUBLE) WHEN mx = c0 THEN (c1 - c2) / d / 6 + CASE WHEN c1 < c2 THEN 1 ELSE 0 END WHEN mx = c1 THEN (c2 - c0) / d / 6 + {0} ELSE (c0 - c1) / d / 6 + {1} END".format(num(1 / 3), num(2 / 3))


def _extremes(p: Plan) -> Plan:
    return p.let(mx="greatest(c0, c1, c2)", mn="least(c0, c1, c2)").let(d="mx - mn")


def rgb_to_hsl(p: Plan = Plan()) -> Plan:
    p = _extremes(p).let(l="(mx + mn) / 2", h=_HUE)
    return p.let(c0="h", c1="CASE WHEN d = 0 THEN CAST(0 AS DOUBLE) WHEN l < 0.5 THEN d / (mx + mn) ELSE d / (2 - mx - mn) END", c2="l")


def _sector(h: str, m: str, v: str) -> str:
    """Piecewise linear ramp around the hue circle."""
    return f"CASE WHEN {h} * 6 < 1 THEN {m} + ({v} - {m}) * 6 * {h} WHEN {h} * 2 < 1 THEN {v} WHEN {h} * 3 < 2 THEN {m} + ({v} - {m}) * ({num(2 / 3)} - {h}) * 6 ELSE {m} END"


def hsl_to_rgb(p: Plan = Plan()) -> Plan:
    p = p.let(v="CASE WHEN c2 < 0.5 THEN c2 * (1 + c1) ELSE c1 + c2 - c1 * c2 END", hr=f"c0 + {num(1 / 3)}", hb=f"c0 - {num(1 / 3)}")
    p = p.let(m="2 * c2 - v", hr="hr - floor(hr)", hg="c0 - floor(c0)", hb="hb - floor(hb)")
    return p.let(c0=_sector("hr", "m", "v"), c1=_sector("hg", "m", "v"), c2=_sector("hb", "m", "v"))


def rgb_to_hsv(p: Plan = Plan()) -> Plan:
    p = _extremes(p).let(h=_HUE)
    return p.let(c0="h", c1="CASE WHEN mx = 0 THEN CAST(0 AS DOUBLE) ELSE d / mx END", c2="mx")


def hsv_to_rgb(p: Plan = Plan()) -> Plan:
    k = lambda n: f"c2 - c2 * c1 * greatest(CAST(0 AS DOUBLE), least(least(k{n}, 4 - k{n}), CAST(1 AS DOUBLE)))"
    p = p.let(**{f"k{n}": f"({n} + 6 * c0) - 6 * floor(({n} + 6 * c0) / 6)" for n in (5, 3, 1)})
    return p.let(c0=k(5), c1=k(3), c2=k(1))


_PQ = (0.1593017578125, 134.034375, 0.8359375, 18.8515625, 18.6875)


def xyz_to_jzazbz(p: Plan = Plan()) -> Plan:
    """From absolute XYZ at D65."""
    n, q, c1, c2, c3 = _PQ
    p = p.let(c0="1.15 * c0 - 0.15 * c2", c1="0.66 * c1 + 0.34 * c0")
    p = matrix(p, JZ_LMS)
    p = p.let(**{c: f"power(greatest({c}, {num(0.0)}) / 10000, {num(n)})" for c in ("c0", "c1", "c2")})
    p = p.let(**{c: f"power(({num(c1)} + {num(c2)} * {c}) / (1 + {num(c3)} * {c}), {num(q)})" for c in ("c0", "c1", "c2")})
    return matrix(p, JZ_IZAZBZ).let(c0="greatest(0.44 * c0 / (1 - 0.56 * c0) - 1.6295499532821566e-11, CAST(0 AS DOUBLE))")


def display_byte(p: Plan = Plan()) -> Plan:
    """Linear light to 8-bit display values."""
    return p.let(**{c: f"CASE WHEN {c} <= 0 THEN CAST(0 AS DOUBLE) WHEN {c} >= 1 THEN CAST(255 AS DOUBLE) ELSE CAST(floor(255 * (CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * power({c}, {num(1 / 2.4)}) - 0.055 END) + 0.5) AS DOUBLE) END" for c in ("c0", "c1", "c2")})


def delta_e_76(p: Plan, other: tuple[str, str, str], out: str = "delta_e") -> Plan:
    return p.let(**{out: "sqrt(" + " + ".join(f"(c{i} - {o}) * (c{i} - {o})" for i, o in enumerate(other)) + ")"})


SPACES = {f.__name__: f for f in (xyz_to_lab, lab_to_xyz, srgb_to_linear, linear_to_srgb, rgb_to_xyz, xyz_to_rgb, rgb_to_lab, lab_to_rgb, xyz_to_prophoto, prophoto_to_xyz, d50_to_d65, d65_to_d50, rgb_to_ycbcr, ycbcr_to_rgb, xyz_to_xyy, xyy_to_xyz, xyy_to_uvy, uvy_to_xyy, to_polar, from_polar, rgb_to_hsl, hsl_to_rgb, rgb_to_hsv, hsv_to_rgb, xyz_to_jzazbz, display_byte)}
