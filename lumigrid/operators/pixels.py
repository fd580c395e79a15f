"""Pointwise pixel operators: parameters in, an expression plan over c0, c1, c2 (and x, y) out.

A pixel is a row; RGB lies in [0, 1], Lab has L in [0, 100]. Each operator works in the space
its spec names. They fuse: a chain of them is one selection.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from ..functions import color, curves
from ..plans.layers import Plan, clamp, matrix, num

C = ("c0", "c1", "c2")


def each(p: Plan, template: str, names=C) -> Plan:
    return p.let(**{c: template.replace("$", c) for c in names})


def exposure(p: Plan, black: float = 0.0, ev: float = 0.0) -> Plan:
    return each(p, f"($ - {num(black)}) * {num(1.0 / (2.0**-ev - black))}")


def rawprepare(p: Plan, black=(0.0, 0.0, 0.0, 0.0), white: float = 1.0) -> Plan:
    """A Bayer mosaic in c0: black level by place in the 2x2 cell."""
    levels = f"CASE (y % 2) * 2 + x % 2 WHEN 0 THEN {num(black[0])} WHEN 1 THEN {num(black[1])} WHEN 2 THEN {num(black[2])} ELSE {num(black[3])} END"
    return p.let(bl=levels).let(c0=f"(c0 - bl) / ({num(white)} - bl)")


def temperature(p: Plan, red: float = 2.0, green: float = 1.0, blue: float = 1.5) -> Plan:
    return p.let(c0=f"c0 * {num(red)}", c1=f"c1 * {num(green)}", c2=f"c2 * {num(blue)}")


def temperature_mosaic(p: Plan, red: float = 2.0, green: float = 1.0, blue: float = 1.5) -> Plan:
    """RGGB: red at even places, blue at odd ones."""
    return p.let(c0=f"c0 * CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN {num(red)} WHEN y % 2 = 1 AND x % 2 = 1 THEN {num(blue)} ELSE {num(green)} END")


def highlights_clip(p: Plan, clip: float = 1.0) -> Plan:
    return each(p, f"least($, {num(clip)})")


def invert(p: Plan, film=(0.9, 0.8, 0.7), maximum: float = 1.0) -> Plan:
    return p.let(**{c: clamp(f"{num(f * maximum)} - {c}") for c, f in zip(C, film, strict=True)})


def channelmixer(p: Plan, m=((0.9, 0.1, 0.0), (0.05, 0.9, 0.05), (0.0, 0.2, 0.8))) -> Plan:
    return each(matrix(p, m), f"greatest($, {num(0.0)})")


def primaries(p: Plan, m=((1.05, -0.03, -0.02), (-0.04, 1.08, -0.04), (0.0, -0.06, 1.06))) -> Plan:
    return matrix(p, m)


def colorcontrast(p: Plan, a_steepness: float = 1.3, a_offset: float = 0.0, b_steepness: float = 0.8, b_offset: float = 2.0, bounded: bool = True) -> Plan:
    a, b = f"c1 * {num(a_steepness)} + {num(a_offset)}", f"c2 * {num(b_steepness)} + {num(b_offset)}"
    return p.let(c1=clamp(a, -128, 128) if bounded else a, c2=clamp(b, -128, 128) if bounded else b)


def colorcorrection(p: Plan, saturation: float = 1.2, high=(3.0, -2.0), low=(-1.0, 4.0)) -> Plan:
    a, b = (h - l for h, l in zip(high, low, strict=True))
    return p.let(c1=f"{num(saturation)} * (c1 + c0 * {num(a / 100)} + {num(low[0])})", c2=f"{num(saturation)} * (c2 + c0 * {num(b / 100)} + {num(low[1])})")


def colorize(p: Plan, lightness: float = 50.0, a: float = 10.0, b: float = 20.0, mix: float = 0.6) -> Plan:
    return p.let(c0=f"{num(lightness - mix * 50)} + c0 * {num(mix)}", c1=num(a), c2=num(b))


def vibrance(p: Plan, amount: float = 25.0) -> Plan:
    """Chroma by its own size, lightness down a little; amount in percent."""
    p = p.let(sw=f"sqrt(c1 * c1 + c2 * c2) / 256 * {num(amount / 100)}")
    return p.let(c0="c0 * (1 - 0.25 * sw)", c1="c1 * (1 + sw)", c2="c2 * (1 + sw)")


def velvia(p: Plan, strength: float = 25.0, bias: float = 1.0) -> Plan:
    """More saturation where there is little; strength in percent."""
    p = p.let(mx="greatest(c0, c1, c2)", mn="least(c0, c1, c2)")
    p = p.let(lum="(mx + mn) / 2", sat=f"CASE WHEN mx + mn <= 1 THEN (mx - mn) / (1e-5 + mx + mn) ELSE (mx - mn) / (1e-5 + greatest({num(0.0)}, 2 - mx - mn)) END")
    p = p.let(w=f"{num(strength / 100)} * " + clamp(f"(1 - 1.5 * sat + (1 + abs(lum - 0.5) * 2) * {num(1 - bias)}) / {num(2 - bias)}"))
    return p.let(**{c: clamp(f"{c} + w * ({c} - 0.5 * ({C[(i + 1) % 3]} + {C[(i + 2) % 3]}))") for i, c in enumerate(C)})


def relight(p: Plan, ev: float = 0.33, center: float = 0.2, width: float = 4.0) -> Plan:
    c = width / 10 / 2
    p = p.let(g=f"exp(-power(c0 / 100 * 2 - 1 - {num(2 * center - 1)}, 2) / {num(c * c)})")
    return p.let(c0="100 * " + clamp(f"c0 / 100 * power({num(2.0)}, {num(ev)} * {clamp('g')})"))


def levels(p: Plan, black: float = 0.05, grey: float = 0.5, white: float = 0.95) -> Plan:
    """Lightness between black and white, grey to the middle by a power; a and b follow L."""
    gamma = math.log10((grey - black) / (white - black)) / math.log10(0.5)
    p = p.let(l=f"CASE WHEN c0 / 100 <= {num(black)} THEN {num(0.0)} ELSE 100 * power((c0 / 100 - {num(black)}) / {num(white - black)}, {num(1 / gamma)}) END")
    return p.let(k="l / greatest(c0, 0.01)").let(c0="l", c1="c1 * k", c2="c2 * k")


def rgblevels(p: Plan, black: float = 0.02, grey: float = 0.45, white: float = 0.9) -> Plan:
    gamma = math.log10((grey - black) / (white - black)) / math.log10(0.5)
    return each(p, f"CASE WHEN $ <= {num(black)} THEN {num(0.0)} ELSE power(($ - {num(black)}) / {num(white - black)}, {num(1 / gamma)}) END")


def saturate(p: Plan, factor: float = 1.2) -> Plan:
    return p.let(c1=f"c1 * {num(factor)}", c2=f"c2 * {num(factor)}")


def colisa(p: Plan, contrast: float = 0.3, brightness: float = 0.2, saturation: float = 0.1) -> Plan:
    """Contrast around the middle (a line, or from plain contrast on a sigmoid), brightness as a gamma, saturation as a factor; power laws beyond white."""
    if contrast <= 0:
        bend, bent = lambda v: 0.5 + (contrast + 1) * (v - 0.5), f"0.5 + {num(contrast + 1)} * (l0 - 0.5)"
    else:
        k = 20 * contrast**2
        bend = lambda v: 0.5 * (math.sqrt(1 + k) * (2 * v - 1) / math.sqrt(1 + k * (2 * v - 1) ** 2) + 1)
        bent = f"0.5 * ({num(math.sqrt(1 + k))} * (2 * l0 - 1) / sqrt(1 + {num(k)} * power(2 * l0 - 1, 2)) + 1)"
    gamma = 1 / (1 + 2 * brightness) if brightness >= 0 else 1 - 2 * brightness
    x1, y1, g = curves.beyond(bend, 1.0)
    p = p.let(l0=f"greatest(c0 / 100, {num(0.0)})").let(l0=f"CASE WHEN l0 < {num(x1)} THEN {bent} ELSE {num(y1)} * power(l0, {num(g)}) END")
    return saturate(p.let(c0=f"100 * power(greatest(l0, {num(0.0)}), {num(gamma)})"), saturation + 1)


def lowlight(p: Plan, blueness: float = 0.2, mix: float = 0.5) -> Plan:
    """Rod vision: lightness from a scotopic estimate, mixed in with a bluish white."""
    p = p.let(l0="c0")
    p = color.lab_to_xyz(p).let(v=clamp("0.5 * c1 * (1.33 * (1 + (c1 + c2) / greatest(c0, 0.01)) - 1.68)"))
    w = [n * k for n, k in zip(color.D50, (1 - 0.2 * blueness, 1 - 0.1 * blueness, 1 + blueness), strict=True)]
    p = p.let(**{c: f"{num(1 - mix)} * {c} + {num(mix * x)} * v" for c, x in zip(C, w, strict=True)})
    return color.xyz_to_lab(p)


def monochrome(p: Plan, a: float = 10.0, b: float = -5.0, size: float = 2.0) -> Plan:
    """Colour filter: lightness by nearness to a colour."""
    return p.let(c0="100 * " + clamp(f"exp(-(power(c1 - {num(a)}, 2) + power(c2 - {num(b)}, 2)) / {num(2 * (size * 128) ** 2)})"), c1=num(0.0), c2=num(0.0))


def _hsl(h: float, s: float) -> list[str]:
    """RGB of a fixed hue and saturation at the lightness in column lum."""
    v = f"CASE WHEN lum < 0.5 THEN lum * {num(1 + s)} ELSE {num(s)} + lum - {num(s)} * lum END"
    ramp = lambda t: 6 * t if t * 6 < 1 else 1.0 if t * 2 < 1 else (2 / 3 - t) * 6 if t * 3 < 2 else 0.0
    return [f"(2 * lum - ({v})) + 2 * (({v}) - lum) * {num(ramp((h + d) % 1.0))}" for d in (1 / 3, 0.0, -1 / 3)]


def splittoning(p: Plan, shadows=(0.6, 0.5), highlights=(0.1, 0.5), balance: float = 0.5, compress: float = 33.0) -> Plan:
    band = compress / 110 / 2
    p = p.let(mx="greatest(c0, c1, c2)", mn="least(c0, c1, c2)").let(lum="(mx + mn) / 2")
    p = p.let(ra=f"CASE WHEN lum < {num(balance - band)} THEN {clamp(f'({num(balance - band)} - lum) * 2')} WHEN lum > {num(balance + band)} THEN {clamp(f'(lum - {num(balance + band)}) * 2')} ELSE {num(0.0)} END", dark=f"lum < {num(balance - band)}")
    return p.let(**{c: f"CASE WHEN ra = 0 THEN {c} ELSE {clamp(f'{c} * (1 - ra) + ra * CASE WHEN dark THEN {s} ELSE {h} END')} END" for c, s, h in zip(C, _hsl(*shadows), _hsl(*highlights), strict=True)})


def graduatednd(p: Plan, width: int = 100, height: int = 80, density: float = 1.0, hardness: float = 30.0, rotation: float = 20.0, offset: float = 50.0, tint=(0.0, 0.0, 0.0)) -> Plan:
    """A darkening (or, below zero, brightening) gradient across a line."""
    v = math.radians(-rotation)
    hw, hh = width / 2, height / 2
    radius = math.hypot(hh, hw) / hh
    hard = 0.5 / radius / (1 - (0.5 + hardness / 100 * 0.9 / 2))
    length = f"({num(math.sin(v))} * (x / {num(hw)} - 1) - {num(math.cos(v))} * (y / {num(hh)} - 1) - 1 + {num(offset / 50)}) * {num(hard)}"
    sign, way = ("/", "+") if density > 0 else ("*", "-")
    p = p.let(g=f"power({num(2.0)}, {num(abs(density))} * {clamp(f'0.5 {way} {length}')})")
    return p.let(**{c: f"greatest({num(0.0)}, {c} {sign} ({num(t)} + {num(1 - t)} * g))" for c, t in zip(C, tint, strict=True)})


def vignette(p: Plan, width: int = 100, height: int = 80, scale: float = 60.0, falloff: float = 50.0, brightness: float = -0.5, saturation: float = -0.5, shape: float = 1.0) -> Plan:
    fall = max(falloff, 100 / min(width, height)) / 100
    px, py = f"abs(x * {num(2 / width)} - 1)", f"abs(y * {num(2 / height)} - 1)"
    p = p.let(len=f"power(power({px}, {num(2 / shape)}) + power({py}, {num(2 / shape)}), {num(shape / 2)})")
    p = p.let(t=clamp(f"(len - {num(scale / 100)}) / {num(fall)}")).let(w=f"CASE WHEN len < {num(scale / 100)} THEN {num(0.0)} WHEN t >= 1 THEN {num(1.0)} ELSE 0.5 - cos({num(math.pi)} * t) / 2 END")
    lit = f"1 + w * {num(brightness)}" if brightness < 0 else None
    p = each(p, f"$ * ({lit})" if lit else f"$ + w * {num(brightness)}")
    p = p.let(mv="(c0 + c1 + c2) / 3")
    return each(p, f"greatest({num(0.0)}, $ - (mv - $) * w * {num(saturation)})")


def profile_gamma_log(p: Plan, grey: float = 18.0, shadows: float = -5.0, dynamic_range: float = 10.0) -> Plan:
    noise = 2.0**-16
    return each(p, f"greatest((log2(greatest($ / {num(grey / 100)}, {num(noise)})) - {num(shadows)}) / {num(dynamic_range)}, {num(noise)})")


def globaltonemap_reinhard(p: Plan) -> Plan:
    return p.let(c0="100 * (c0 / 100) / (1 + c0 / 100)")


def globaltonemap_filmic(p: Plan) -> Plan:
    return p.let(l0=f"greatest(c0 / 100 - 0.004, {num(0.0)})").let(c0="100 * (l0 * (6.2 * l0 + 0.5)) / (l0 * (6.2 * l0 + 1.7) + 0.06)")


def globaltonemap_drago(p: Plan, maximum: float = 100.0, bias: float = 0.85, max_light: float = 100.0) -> Plan:
    """The image's largest lightness comes from an aggregate beforehand."""
    top = max(maximum / 100, 1e-4)
    return p.let(lw="c0 / 100").let(c0=f"{num(100 * max_light * 0.01 / math.log10(top + 1))} * ln(greatest({num(1e-4)}, lw + 1)) / ln(greatest({num(1e-4)}, 2 + power(lw / {num(top)}, {num(math.log(bias) / math.log(0.5))}) * 8))")


def zonesystem(p: Plan, zones=(0.0, 0.1, 0.3, 0.55, 0.8, 1.0)) -> Plan:
    """Lightness by straight lines between zones, colours in proportion."""
    n = len(zones) - 1
    cases = " ".join(f"WHEN z = {i} THEN {num(100 * zones[i])} + (c0 * {num(n / 100)} - {i}) * {num(100 * (zones[i + 1] - zones[i]))}" for i in range(n))
    p = p.let(z=f"CAST(floor({clamp(f'c0 * {num(n / 100)}', 0, n - 1e-9)}) AS INT)").let(l=f"CASE {cases} END")
    return p.let(k="CASE WHEN c0 > 0 THEN l / c0 ELSE 0 END").let(c0="l", c1="c1 * k", c2="c2 * k")


def sigmoid(p: Plan, contrast: float = 1.5, white: float = 1.0, black: float = 0.0001, grey: float = 0.1845) -> Plan:
    """Log-logistic tone curve through middle grey, channel by channel; negative values first move towards the mean."""
    p = p.let(mean="greatest((c0 + c1 + c2) / 3, CAST(0 AS DOUBLE))", mn="least(c0, c1, c2)")
    p = p.let(s="CASE WHEN mn < 0 THEN -mean / (mn - mean) ELSE CAST(1 AS DOUBLE) END")
    p = each(p, "mean + s * ($ - mean)")
    fog = grey * ((white / grey - 1) / (white / black - 1)) ** (1 / contrast) if black > 0 else 0.0
    paper = (fog + grey) ** contrast * (white / grey - 1)
    return each(p, f"{num(white)} * power({num(fog)} + greatest($, {num(0.0)}), {num(contrast)}) / ({num(paper)} + power({num(fog)} + greatest($, {num(0.0)}), {num(contrast)}))")


def filmic_log(p: Plan, grey: float = 18.45, black: float = -8.0, white: float = 4.0) -> Plan:
    """Scene light to a place on the dynamic range, by the largest channel, colours in proportion."""
    p = p.let(n="greatest(c0, c1, c2, CAST(1.52587890625e-05 AS DOUBLE))").let(t=clamp(f"(log2(n / {num(grey / 100)}) - {num(black)}) / {num(white - black)}"))
    return each(p, "$ / n * t")


#: Sizes of a colour: what a curve acts on if the channels' ratios are to stay.
NORMS = {
    "luminance": " + ".join(f"{num(w)} * c{i}" for i, w in enumerate(color.SRGB_TO_XYZ_D50[1])), "max": "greatest(c0, c1, c2)", "average": "(c0 + c1 + c2) / 3", "sum": "c0 + c1 + c2",
    "norm": "sqrt(c0 * c0 + c1 * c1 + c2 * c2)", "power": "(c0 * c0 * c0 + c1 * c1 * c1 + c2 * c2 * c2) / greatest(c0 * c0 + c1 * c1 + c2 * c2, CAST(1e-12 AS DOUBLE))",
}


def _curved(p: Plan, curve, preserve: str | None) -> Plan:
    """Channels through ``curve`` (a function from column to expression), or scaled as their norm is."""
    if preserve is None:
        return p.let(**{c: curve(c) for c in C})
    p = p.let(size=NORMS[preserve]).let(ratio=f"CASE WHEN size > 0 THEN ({curve('size')}) / size ELSE {num(1.0)} END")
    return each(p, "$ * ratio")


def basecurve(p: Plan, nodes=((0.0, 0.0), (0.1, 0.04), (0.3, 0.3), (0.7, 0.85), (1.0, 1.0)), kind: str = curves.MONOTONE, preserve: str | None = None) -> Plan:
    """A camera's curve, bounded to [0, 1] up to white and a power law beyond."""
    return _curved(p, lambda c: curves.unbounded(nodes, c, kind), preserve)


def rgbcurve(p: Plan, nodes=((0.0, 0.0), (0.3, 0.2), (0.7, 0.8), (1.0, 1.0)), green=None, blue=None, kind: str = curves.MONOTONE, preserve: str | None = None) -> Plan:
    """One curve for all channels (or for their norm), or one for each."""
    if green is None and blue is None:
        return _curved(p, lambda c: curves.unbounded(nodes, c, kind), preserve)
    return p.let(**{c: curves.unbounded(n or nodes, c, kind) for c, n in zip(C, (nodes, green, blue), strict=True)})


def tonecurve(p: Plan, nodes=((0.0, 0.0), (0.25, 0.18), (0.5, 0.5), (0.75, 0.82), (1.0, 1.0)), a_nodes=None, b_nodes=None, scale: str = "automatic", kind: str = curves.MONOTONE) -> Plan:
    """Lightness through a curve. ``scale``: a and b follow L (automatic), have curves of their own (manual), or the curve acts on X, Y and Z (xyz)."""
    if scale == "xyz":
        grey = lambda v: f"CASE WHEN {v} > {num(color.EPSILON)} THEN 1.16 * cbrt({v}) - 0.16 ELSE {num(color.KAPPA / 100)} * {v} END"
        back = lambda v: f"CASE WHEN {v} > 0.08 THEN power(({v} + 0.16) / 1.16, 3) ELSE {v} / {num(color.KAPPA / 100)} END"

        def shape(v: float) -> float:
            l = 1.16 * v ** (1 / 3) - 0.16 if v > color.EPSILON else color.KAPPA / 100 * v
            l = float(curves.evaluate(nodes, l, kind))
            return ((l + 0.16) / 1.16) ** 3 if l > 0.08 else l / (color.KAPPA / 100)

        x1, y1, g = curves.beyond(shape, nodes[-1][0])
        p = color.lab_to_xyz(p).let(**{f"g{i}": grey(c) for i, c in enumerate(C)})
        p = p.let(**{f"g{i}": curves.expression(nodes, f"g{i}", kind) for i in range(3)})
        return color.xyz_to_lab(p.let(**{c: f"CASE WHEN {c} < {num(x1)} THEN {back(f'g{i}')} ELSE {num(y1)} * power({c} / {num(x1)}, {num(g)}) END" for i, c in enumerate(C)}))
    p = p.let(l0="c0 / 100").let(c0=f"100 * ({curves.unbounded(nodes, 'l0', kind)})")
    if scale == "manual":
        side = lambda c, n: f"256 * {curves.expression(n, f'(({c} + 128) / 256)', kind)} - 128"
        straight = ((0.0, 0.0), (1.0, 1.0))
        return p.let(c1=side("c1", a_nodes or straight), c2=side("c2", b_nodes or straight))
    dark = num(100 * float(curves.evaluate(nodes, 0.01, kind)))
    return p.let(k=f"CASE WHEN l0 > 0.01 THEN c0 / (100 * l0) ELSE {dark} END").let(c1="c1 * k", c2="c2 * k")


def colorbalance(p: Plan, lift=(1.0, 1.02, 0.98, 1.03), gamma=(1.0, 0.95, 1.05, 0.9), gain=(1.1, 1.0, 0.9, 1.2), mode: str = "slope_offset_power", saturation: float = 1.1, saturation_out: float = 0.9, contrast: float = 1.2, grey: float = 18.0) -> Plan:
    """Lift, gamma, gain (each a factor, then red, green and blue) as three kinds: legacy on coded sRGB, lift_gamma_gain and slope_offset_power on linear ProPhoto."""
    off = 1e6
    of = lambda v: [v[0] * w for w in v[1:]]
    if mode == "legacy":
        p = color.linear_to_srgb(color.lab_to_rgb(p))
        p = p.let(**{c: f"power(greatest((({c} - 1) * {num(2 - l)} + 1) * {num(n)}, {num(0.0)}), {num(1 / g if g else off)})" for c, l, g, n in zip(C, of(lift), of(gamma), of(gain), strict=True)})
        return color.rgb_to_lab(color.srgb_to_linear(p))
    p = color.lab_to_xyz(p).let(luma="c1")
    p = color.xyz_to_prophoto(p)
    if abs(saturation - 1) > 1e-6:
        p = each(p, f"luma + {num(saturation)} * ($ - luma)")
    if mode == "lift_gamma_gain":
        p = each(p, f"power(greatest($, {num(0.0)}), {num(1 / 2.2)})")
        p = p.let(**{c: f"power(greatest((({c} - 1) * {num(2 - l)} + 1) * {num(n)}, {num(0.0)}), {num(2.2 / g if g else 2.2 * off)})" for c, l, g, n in zip(C, of(lift), of(gamma), of(gain), strict=True)})
    else:
        p = p.let(**{c: f"power(greatest({c} * {num(n)} + {num(l + lift[0] - 2)}, {num(0.0)}), {num((2 - g) * (2 - gamma[0]))})" for c, l, g, n in zip(C, lift[1:], gamma[1:], of(gain), strict=True)})
    if abs(saturation_out - 1) > 1e-6:
        p = p.let(luma=" + ".join(f"{num(w)} * {c}" for c, w in zip(C, color.PROPHOTO_TO_XYZ[1], strict=True)))
        p = each(p, f"luma + {num(saturation_out)} * ($ - luma)")
    if abs(contrast - 1) > 1e-6:
        p = each(p, f"power(greatest($, {num(0.0)}) / {num(grey / 100)}, {num(1 / contrast if contrast else off)}) * {num(grey / 100)}")
    return color.xyz_to_lab(color.prophoto_to_xyz(p))


def basicadj(p: Plan, black: float = 0.01, ev: float = 0.3, compression: float = 40.0, threshold: float = 10.0, brightness: float = 0.1, contrast: float = 0.2, preserve: str | None = None, saturation: float = 0.1, vibrance: float = 0.2, middle: float = 18.42) -> Plan:
    """Exposure, highlight compression, brightness as a gamma, contrast around grey, saturation and vibrance."""
    p = exposure(p, black, ev)
    if compression > 0:
        k, reach = compression / 100, 1 - (threshold / 100 / 8 + 0.1)
        p = p.let(lum=NORMS["luminance"]).let(v=f"CASE WHEN lum + {num(reach - 1)} = 0 THEN {num(1e-6)} ELSE lum + {num(reach - 1)} END")
        p = p.let(ratio=f"CASE WHEN lum > 0 THEN ln(1 + greatest(v / {num(reach)} * {num(k)}, {num(-0.999999)})) * {num(reach / k)} / v ELSE {num(1.0)} END")
        p = each(p, "$ * ratio")
    if brightness:
        gamma = 1 / (1 + 2 * brightness) if brightness >= 0 else 1 - 2 * brightness
        p = each(p, f"CASE WHEN $ > 0 THEN power($, {num(gamma)}) ELSE $ END")
    if contrast:
        m = num(middle / 100)
        bent = lambda c: f"CASE WHEN {c} > 0 THEN power({c} / {m}, {num(contrast + 1)}) * {m} ELSE {c} END"
        p = _curved(p, bent, preserve)
    if saturation or vibrance:
        w = vibrance / 1.4
        p = p.let(mean="(c0 + c1 + c2) / 3").let(apart="sqrt(power(mean - c0, 2) + power(mean - c1, 2) + power(mean - c2, 2))")
        p = each(p.let(factor=f"{num(saturation + 1)} + {num(w)} * (1 - power(apart, {num(abs(w))}))"), "mean + factor * ($ - mean)")
    return p


def colorzones(p: Plan, lightness=(0.0, 0.1, -0.1, 0.0), chroma=(0.2, 0.0, -0.2, 0.2)) -> Plan:
    """Lightness and chroma by hue: straight lines between values that stand evenly round the circle."""
    p = color.to_polar(p)
    n = len(lightness)
    at = lambda v: "CASE CAST(floor(c2 * {0}) AS INT) ".format(n) + " ".join(f"WHEN {i} THEN {num(v[i])} + (c2 * {n} - {i}) * {num(v[(i + 1) % n] - v[i])}" for i in range(n)) + f" ELSE {num(v[0])} END"
    return color.from_polar(p.let(c0=f"c0 * power({num(2.0)}, 4 * ({at(lightness)}))", c1=f"c1 * (1 + {at(chroma)})"))


def colorchecker(p: Plan, sources=((20.0, 0.0, 0.0), (80.0, 0.0, 0.0), (50.0, 40.0, 20.0)), weights=((0.1, 0.0, 0.0), (-0.1, 0.0, 0.0), (0.0, 0.05, 0.0))) -> Plan:
    """Radial mapping: each patch pulls by r^2 ln r^2 of its distance."""
    for i, s in enumerate(sources):
        p = p.let(**{f"q{i}": " + ".join(f"power(c{j} - {num(s[j])}, 2)" for j in range(3))})
    for i in range(len(sources)):
        p = p.let(**{f"q{i}": f"CASE WHEN q{i} > 1e-8 THEN 0.001 * q{i} * ln(q{i}) ELSE {num(0.0)} END"})
    return p.let(**{c: c + "".join(f" + {num(weights[i][j])} * q{i}" for i in range(len(sources))) for j, c in enumerate(C)})


def lut3d(p: Plan, size: int = 2, table=None) -> Plan:
    """Trilinear lookup in a cube of 2 x 2 x 2 colours (red fastest)."""
    table = table or [(r * 0.9 + 0.05, g * 0.95, b**2 * 0.8 + 0.1) for b in (0, 1) for g in (0, 1) for r in (0, 1)]
    weight = lambda i: " * ".join(clamp(c) if i >> k & 1 else f"(1 - {clamp(c)})" for k, c in enumerate(C))
    return p.let(**{c: " + ".join(f"{weight(i)} * {num(table[i][j])}" for i in range(8)) for j, c in enumerate(C)})


def negadoctor(p: Plan, dmin=(1.0, 0.45, 0.25), dmax: float = 2.046, offset: float = -0.05, high=(1.0, 1.1, 0.9), low=(1.0, 0.95, 1.05), black: float = 0.0755, ev: float = 0.9245, gamma: float = 4.0, soft: float = 0.75) -> Plan:
    """A negative's density against its film base, corrected in highlights and shadows, then a print with a soft shoulder."""
    p = p.let(**{c: f"{num(h / dmax)} * log10(greatest({c}, {num(2.0**-32)}) / {num(d)}) + {num(h * offset * l)}" for c, d, h, l in zip(C, dmin, high, low, strict=True)})
    p = each(p, f"power(greatest({num(ev * (1 + black))} - {num(ev)} * power({num(10.0)}, $), {num(0.0)}), {num(gamma)})")
    return each(p, f"CASE WHEN $ > {num(soft)} THEN {num(soft)} + (1 - exp(-($ - {num(soft)}) / {num(1 - soft)})) * {num(1 - soft)} ELSE $ END")


def agx_log(p: Plan, black: float = -10.0, white: float = 6.5, power: float = 1.2) -> Plan:
    p = matrix(p, ((0.856627, 0.095121, 0.048252), (0.137319, 0.761242, 0.101439), (0.111898, 0.076799, 0.811302)))
    p = each(p, clamp(f"(log2(greatest($, {num(1e-10)}) / 0.18) - {num(black)}) / {num(white - black)}"))
    return each(p, f"power($, {num(power)}) / (power($, {num(power)}) + power(1 - $, {num(power)}))")


def colorin(p: Plan, m=color.SRGB_TO_XYZ_D50) -> Plan:
    return color.xyz_to_lab(matrix(p, m))


def colorout(p: Plan, m=color.XYZ_D50_TO_SRGB) -> Plan:
    return color.linear_to_srgb(matrix(color.lab_to_xyz(p), m))


def channelmixerrgb(p: Plan, adaptation=(1.05, 1.0, 0.92), mix=((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.05, 0.0, 0.95))) -> Plan:
    """Bradford-like adaptation by a diagonal in XYZ, then a mix."""
    p = color.rgb_to_xyz(p)
    p = p.let(**{c: f"{c} * {num(k)}" for c, k in zip(C, adaptation, strict=True)})
    return each(matrix(color.xyz_to_rgb(p), mix), f"greatest($, {num(0.0)})")


def colorbalancergb(p: Plan, shadows=(0.0, 0.01, 0.02), mid=(1.0, 0.98, 1.02), highlights=(1.05, 1.0, 0.97), pivot: float = 0.1845) -> Plan:
    """Offsets in the shadows, powers in the middle, factors in the highlights, by smooth luminance masks."""
    p = p.let(lum=f"power(greatest(0.2126 * c0 + 0.7152 * c1 + 0.0722 * c2, {num(0.0)}), {num(0.4101205819200422)})")
    p = p.let(hi="lum * lum / (lum * lum + 0.25)", lo="0.25 / (lum * lum + 0.25)")
    return p.let(**{c: f"power(greatest(({c} + lo * {num(s)}) * (1 - hi + hi * {num(h)}), {num(0.0)}) / {num(pivot)}, {num(1 / m)}) * {num(pivot)}" for c, s, m, h in zip(C, shadows, mid, highlights, strict=True)})


def grain(p: Plan, strength: float = 10.0, scale: float = 4.0) -> Plan:
    """Value noise by place: the same for a place whatever the tile."""
    h = lambda dx, dy: f"((sin((floor(x / {num(scale)}) + {dx}) * 12.9898 + (floor(y / {num(scale)}) + {dy}) * 78.233) * 43758.5453) - floor(sin((floor(x / {num(scale)}) + {dx}) * 12.9898 + (floor(y / {num(scale)}) + {dy}) * 78.233) * 43758.5453))"
    p = p.let(u=f"x / {num(scale)} - floor(x / {num(scale)})", v=f"y / {num(scale)} - floor(y / {num(scale)})", n00=h(0, 0), n10=h(1, 0), n01=h(0, 1), n11=h(1, 1))
    return p.let(c0=f"c0 + {num(strength)} * ((n00 * (1 - u) + n10 * u) * (1 - v) + (n01 * (1 - u) + n11 * u) * v - 0.5)")


def posterize(p: Plan, steps: int = 8) -> Plan:
    return each(p, f"floor({clamp('$')} * {num(steps - 1)} + 0.5) / {num(steps - 1)}")


def overexposed(p: Plan, lower_ev: float = -12.69, upper: float = 98.0) -> Plan:
    return p.let(mark=f"CASE WHEN greatest(c0, c1, c2) >= {num(upper / 100)} THEN 'over' WHEN least(c0, c1, c2) <= {num(2.0**lower_ev)} THEN 'under' ELSE '' END")


def rawoverexposed(p: Plan, clip: float = 0.98) -> Plan:
    return p.let(mark=f"c0 >= {num(clip)}")


def mask_manager(p: Plan) -> Plan:
    return p


def useless(p: Plan, checker: int = 8, factor: float = 0.5) -> Plan:
    return each(p, f"CASE WHEN (CAST(floor(x / {num(float(checker))}) AS INT) + CAST(floor(y / {num(float(checker))}) AS INT)) % 2 = 0 THEN $ * {num(factor)} ELSE $ END")


def gamma(p: Plan) -> Plan:
    return color.display_byte(p)


@dataclass(frozen=True)
class PointOp:
    name: str
    make: Callable[..., Plan]
    space: str  # RGB, LAB or RAW


def _ops(space: str, *makes) -> list[PointOp]:
    return [PointOp(m.__name__, m, space) for m in makes]


POINT_OPS = {o.name: o for o in _ops("RGB", exposure, temperature, highlights_clip, invert, channelmixer, primaries, velvia, splittoning, graduatednd, vignette, profile_gamma_log, sigmoid, filmic_log, basecurve, rgbcurve, rgblevels, basicadj, lut3d, negadoctor, agx_log, colorin, channelmixerrgb, colorbalancergb, posterize, overexposed, mask_manager, useless, gamma) + _ops("LAB", colorcontrast, colorcorrection, colorize, vibrance, relight, levels, colisa, lowlight, monochrome, globaltonemap_reinhard, globaltonemap_filmic, globaltonemap_drago, zonesystem, tonecurve, colorbalance, colorzones, colorchecker, colorout, grain) + _ops("RAW", rawprepare, temperature_mosaic, rawoverexposed)}
