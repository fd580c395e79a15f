"""Blend modes and masks as expression plans.

Below lies a (columns a0, a1, a2), above b (b0, b1, b2); m is the mask times the opacity. The
result is in c0, c1, c2.
"""

from __future__ import annotations

from ..functions import color
from ..plans.layers import Plan, clamp, num

_I = range(3)
_NORM = {v: f"greatest(sqrt({v}0 * {v}0 + {v}1 * {v}1 + {v}2 * {v}2), 1e-12)" for v in "ab"}


def _scene(p: str) -> dict[str, str]:
    """Formulas for scene-referred light; p is the blend parameter's factor."""
    return {
        "normal": "$b", "multiply": f"$a * $b * {p}", "add": f"$a + {p} * $b", "subtract": f"greatest($a - {p} * $b, {num(0.0)})",
        "subtract_inverse": f"greatest($b - {p} * $a, {num(0.0)})", "difference": "abs($a - $b)", "divide": f"$a / greatest({p} * $b, {num(1e-6)})",
        "divide_inverse": f"$b / greatest({p} * $a, {num(1e-6)})", "average": "($a + $b) / 2", "geometric_mean": f"sqrt(greatest($a * $b, {num(0.0)}))",
        "harmonic_mean": f"2 * $a * $b / (greatest($a, {num(5e-7)}) + greatest($b, {num(5e-7)}))",
        "lightness": f"$a * {_NORM['b']} / {_NORM['a']}", "chromaticity": f"$b * {_NORM['a']} / {_NORM['b']}",
    }


#: Formulas for display values in [0, 1]; those in SQUARED weigh by the mask's square.
DISPLAY = {
    "normal": "$b", "lighten": "greatest($a, $b)", "darken": "least($a, $b)", "multiply": "$a * $b", "average": "($a + $b) / 2", "add": "$a + $b", "subtract": "$a + $b - 1",
    "difference": "abs($a - $b)", "screen": "1 - (1 - $a) * (1 - $b)",
    "overlay": "CASE WHEN $a > 0.5 THEN 1 - (1 - 2 * ($a - 0.5)) * (1 - $b) ELSE 2 * $a * $b END",
    "softlight": "CASE WHEN $b > 0.5 THEN 1 - (1 - $a) * (1 - ($b - 0.5)) ELSE $a * ($b + 0.5) END",
    "hardlight": "CASE WHEN $b > 0.5 THEN 1 - (1 - 2 * ($a - 0.5)) * (1 - $b) ELSE 2 * $a * $b END",
    "vividlight": "CASE WHEN $b > 0.5 THEN CASE WHEN $b >= 1 THEN 1 ELSE $a / (2 * (1 - $b)) END ELSE CASE WHEN $b <= 0 THEN 0 ELSE 1 - (1 - $a) / (2 * $b) END END",
    "linearlight": "$a + 2 * $b - 1", "pinlight": "CASE WHEN $b > 0.5 THEN greatest($a, 2 * ($b - 0.5)) ELSE least($a, 2 * $b) END",
}
SQUARED = frozenset("overlay softlight hardlight vividlight linearlight pinlight".split())
#: Modes that exchange parts of a hue, saturation and lightness (or value) triple.
HSL_MODES = {"hsl_lightness": (0, 0, 1), "hsl_chromaticity": (0, 1, 0), "hue": (1, 0, 0), "color": (1, 1, 0), "coloradjust": (1, 1, 0)}
HSV_MODES = ("hsv_value", "hsv_color")
SCENE = tuple(_scene("1"))
LAB_MODES = ("lab_lightness", "lab_color", "lab_l", "lab_a", "lab_b")
CHANNELS = {"red": 0, "green": 1, "blue": 2}


def scene(p: Plan, mode: str, parameter: float = 0.0, reverse: bool = False) -> Plan:
    """Scene-referred RGB modes; ``reverse`` exchanges below and above."""
    if mode in CHANNELS:
        return _single(p, CHANNELS[mode])
    formula = _scene(num(2.0**parameter))[mode]
    a, b = ("b", "a") if reverse else ("a", "b")
    fill = lambda i: formula.replace("$a", f"{a}{i}").replace("$b", f"{b}{i}") if not reverse or mode not in ("lightness", "chromaticity") else formula.replace("$a", f"b{i}").replace("$b", f"a{i}")
    return p.let(**{f"c{i}": f"a{i} * (1 - m) + ({fill(i)}) * m" for i in _I})


def display(p: Plan, mode: str, bounded: bool = True) -> Plan:
    """Display-referred RGB modes. On one channel (c0) they are the raw modes; only "normal" has an unbounded form."""
    if mode in CHANNELS:
        return _single(p, CHANNELS[mode])
    if mode in HSL_MODES:
        return _hsl(p, HSL_MODES[mode], above=mode == "coloradjust")
    if mode in HSV_MODES:
        return _hsv(p, mode)
    weight = "m * m" if mode in SQUARED else "m"
    out = {}
    for i in _I:
        below, above = (clamp(f"{v}{i}") if mode in SQUARED or mode == "screen" else f"{v}{i}" for v in "ab")
        mixed = f"{below} * (1 - {weight}) + ({DISPLAY[mode].replace('$a', below).replace('$b', above)}) * {weight}"
        out[f"c{i}"] = clamp(mixed) if bounded else mixed
    return p.let(**out)


def _single(p: Plan, channel: int) -> Plan:
    return p.let(**{f"c{i}": f"a{i} * (1 - m) + b{i} * m" if i == channel else f"a{i}" for i in _I})


def _hsl(p: Plan, take: tuple[int, int, int], above: bool = False) -> Plan:
    """Mix chosen parts; hue moves along the shorter arc. Lightness that is not mixed is that below, or that above."""
    for v in "ab":
        p = color.rgb_to_hsl(p.let(**{f"c{i}": f"{v}{i}" for i in _I})).let(**{f"{v}h": "c0", f"{v}sat": "c1", f"{v}l": "c2"})
    p = p.let(dh="bh - ah").let(dh="CASE WHEN dh > 0.5 THEN dh - 1 WHEN dh < -0.5 THEN dh + 1 ELSE dh END")
    p = p.let(c0="ah + m * dh - floor(ah + m * dh)" if take[0] else "ah", c1="asat * (1 - m) + bsat * m" if take[1] else "asat", c2="al * (1 - m) + bl * m" if take[2] else "bl" if above else "al")
    p = color.hsl_to_rgb(p)
    return p.let(**{f"c{i}": clamp(f"c{i}") for i in _I})


def _hsv(p: Plan, mode: str) -> Plan:
    """The value mixed, or hue and saturation as one vector; nothing is clamped."""
    for v in "ab":
        p = color.rgb_to_hsv(p.let(**{f"c{i}": f"{v}{i}" for i in _I})).let(**{f"{v}h": "c0", f"{v}sat": "c1", f"{v}v": "c2"})
    if mode == "hsv_value":
        return color.hsv_to_rgb(p.let(c0="ah", c1="asat", c2="av * (1 - m) + bv * m"))
    turn = num(2 * color.PI)
    p = p.let(**{k: f"asat * {f}({turn} * ah) * (1 - m) + bsat * {f}({turn} * bh) * m" for k, f in (("vx", "cos"), ("vy", "sin"))})
    p = p.let(hue=f"atan2(vy, vx) / {turn}")
    return color.hsv_to_rgb(p.let(c0="CASE WHEN hue < 0 THEN hue + 1 ELSE hue END", c1="sqrt(vx * vx + vy * vy)", c2="av"))


def lab(p: Plan, mode: str) -> Plan:
    """Lab modes that exchange channels."""
    take = {"lab_lightness": (1, 0, 0), "lab_l": (1, 0, 0), "lab_color": (0, 1, 1), "lab_a": (0, 1, 0), "lab_b": (0, 0, 1)}[mode]
    return p.let(**{f"c{i}": f"a{i} * (1 - m) + b{i} * m" if take[i] else f"a{i}" for i in _I})


# --- masks


def circle(cx: float, cy: float, radius: float, border: float, out: str = "m") -> Plan:
    """One inside, zero outside, a squared ramp over the border."""
    d2 = f"(power(x - {num(cx)}, 2) + power(y - {num(cy)}, 2))"
    total = (radius + border) ** 2
    t = clamp(f"({num(total)} - {d2}) / {num(total - radius**2)}")
    return Plan().let(**{out: f"{t} * {t}"})


def ellipse(cx: float, cy: float, a: float, b: float, rotation: float, border: float, out: str = "m") -> Plan:
    """Like a circle, along turned axes; the border is a share of them."""
    import math

    c, s = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    u, v = f"((x - {num(cx)}) * {num(c)} + (y - {num(cy)}) * {num(s)})", f"((y - {num(cy)}) * {num(c)} - (x - {num(cx)}) * {num(s)})"
    d2 = f"(power({u} / {num(a)}, 2) + power({v} / {num(b)}, 2))"
    total = (1 + border) ** 2
    t = clamp(f"({num(total)} - {d2}) / {num(total - 1)}")
    return Plan().let(**{out: f"{t} * {t}"})


def gradient(cx: float, cy: float, rotation: float, extent: float, out: str = "m") -> Plan:
    import math

    c, s = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    return Plan().let(**{out: clamp(f"0.5 - ((x - {num(cx)}) * {num(s)} + (y - {num(cy)}) * {num(c)}) / {num(2 * extent)}")})


def _off(a: tuple[float, float], b: tuple[float, float]) -> str:
    """The distance from a pixel to a line's nearest place."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = clamp(f"((x - {num(a[0])}) * {num(dx)} + (y - {num(a[1])}) * {num(dy)}) / {num(max(dx * dx + dy * dy, 1e-12))}")
    return f"sqrt(power(x - {num(a[0])} - {t} * {num(dx)}, 2) + power(y - {num(a[1])} - {t} * {num(dy)}, 2))"


def path(points, feather: float, out: str = "m") -> Plan:
    """A closed path: one inside (even-odd), a squared ramp over ``feather`` pixels outside. Points are straight between."""
    edges = list(zip(points, [*points[1:], points[0]], strict=True))
    crossed = " + ".join(f"CASE WHEN ({num(a[1])} > y) <> ({num(b[1])} > y) AND x < {num(a[0])} + (y - {num(a[1])}) * {num((b[0] - a[0]) / (b[1] - a[1]))} THEN 1 ELSE 0 END" for a, b in edges if a[1] != b[1]) or "0"
    ramp = f"power({clamp(f'1 - near / {num(feather)}')}, 2)" if feather > 0 else num(0.0)
    near = f"least({', '.join(_off(a, b) for a, b in edges)})"
    return Plan().let(near=near, crossed=crossed).let(**{out: f"CASE WHEN crossed % 2 = 1 THEN {num(1.0)} ELSE {ramp} END"})


def brush(points, radius: float, hardness: float, out: str = "m") -> Plan:
    """A stroke: one up to the hard part of its radius, a ramp to its edge."""
    lines = list(zip(points, points[1:], strict=False)) or [(points[0], points[0])]
    ways = [_off(a, b) for a, b in lines]
    near = f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]
    return Plan().let(near=near).let(**{out: clamp(f"({num(radius)} - near) / {num(max(radius * (1 - hardness), 1e-9))}")})


#: How a group takes in another mask: d so far, s the new one (opacity and inversion applied).
COMBINE = {
    "union": "greatest(d, s)", "intersection": "least(d, s)", "difference": "CASE WHEN d > 0 AND s > 0 THEN d * (1 - s) ELSE d END", "sum": "least(CAST(1 AS DOUBLE), d + s)",
    "exclusion": "CASE WHEN d > 0 AND s > 0 THEN greatest((1 - d) * s, d * (1 - s)) ELSE greatest(d, s) END",
}


def combine(p: Plan, how: str, mask: str, opacity: float = 1.0, inverted: bool = False) -> Plan:
    """Column d takes in column ``mask``."""
    s = f"{num(opacity)} * (1 - {mask})" if inverted else f"{num(opacity)} * {mask}"
    return p.let(s=s).let(d=COMBINE[how])


def _trapezoid(c: str, a: float, b: float, d: float, e: float) -> str:
    return f"CASE WHEN {c} >= {num(b)} AND {c} <= {num(d)} THEN {num(1.0)} WHEN {c} > {num(a)} AND {c} < {num(b)} THEN ({c} - {num(a)}) / {num(max(b - a, 1e-9))} WHEN {c} > {num(d)} AND {c} < {num(e)} THEN 1 - ({c} - {num(d)}) / {num(max(e - d, 1e-9))} ELSE {num(0.0)} END"


def parametric(p: Plan, ranges: dict[str, tuple[float, float, float, float]], inverted=frozenset(), out: str = "m") -> Plan:
    """Product over channels of trapezoids (zero, one, one, zero)."""
    parts = [f"(1 - ({_trapezoid(c, *r)}))" if c in inverted else f"({_trapezoid(c, *r)})" for c, r in ranges.items()]
    return p.let(**{out: " * ".join(parts) or num(1.0)})


def mask(p: Plan, opacity: float = 1.0, drawn: str | None = None, ranges: dict | None = None, inverted=frozenset(), raster: str | None = None, inclusive: bool = False, inverse: bool = False, out: str = "m") -> Plan:
    """A stage's mask: uniform, from a column with a drawn one, from channel ranges, from both, or a column with another stage's raster mask.

    Exclusive masks multiply, inclusive ones unite; ``inverse`` turns the result round.
    """
    if raster is not None:
        return p.let(**{out: f"{num(opacity)} * {f'(1 - {raster})' if inverse else raster}"})
    if drawn is None and not ranges:
        return p.let(**{out: num(opacity)})
    shape = drawn or num(0.0 if inclusive else 1.0)
    if not ranges:
        return p.let(**{out: f"{num(opacity)} * {f'(1 - {shape})' if inverse else shape}"})
    flipped = frozenset(ranges) - frozenset(inverted) if inclusive else inverted
    p = parametric(p, ranges, flipped, "within")
    whole = f"(1 - (1 - {shape}) * within)" if inclusive else f"({shape} * within)"
    return p.let(**{out: f"{num(opacity)} * {f'(1 - {whole})' if inverse else whole}"})
