"""Neighbourhood kernels on single images (height x width [x channels]) in numpy.

Each is a pure function of an array; ``KERNELS`` says how far it looks (its halo), so that tiles
with that much border give the same values as the whole image. Edges repeat the outermost pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

import numpy as np


def pad(a: np.ndarray, r: int) -> np.ndarray:
    return np.pad(a, ((r, r), (r, r)) + ((0, 0),) * (a.ndim - 2), mode="edge")


def convolve(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Separable: the same odd kernel down and across."""
    r = len(weights) // 2
    p = pad(a, r)
    rows = sum(w * p[i : i + a.shape[0]] for i, w in enumerate(weights))
    return sum(w * rows[:, i : i + a.shape[1]] for i, w in enumerate(weights))


def window(a: np.ndarray, r: int) -> np.ndarray:
    """All (2r+1)^2 shifted copies, first axis."""
    p = pad(a, r)
    return np.stack([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1)])


def gaussian_weights(sigma: float, r: int) -> np.ndarray:
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / max(sigma, 1e-6)) ** 2)
    return w / w.sum()


def gaussian(a, sigma: float = 2.0, radius: int = 6):
    return convolve(a, gaussian_weights(sigma, radius))


def box_mean(a, radius: int = 3):
    return convolve(a, np.full(2 * radius + 1, 1 / (2 * radius + 1)))


def box_min(a, radius: int = 3):
    p = pad(a, radius)
    rows = np.minimum.reduce([p[i : i + a.shape[0]] for i in range(2 * radius + 1)])
    return np.minimum.reduce([rows[:, i : i + a.shape[1]] for i in range(2 * radius + 1)])


def box_max(a, radius: int = 3):
    return -box_min(-a, radius)


def median(a, radius: int = 1):
    return np.median(window(a, radius), axis=0)


BOXES = 8  # a box mean so often is nearly a Gaussian


def box_blur(a, radius: int, rounds: int = BOXES):
    """Box means across and down, over and over; at an edge the mean is over what is there."""
    for _ in range(rounds):
        for axis in (1, 0):
            n = a.shape[axis]
            sums = np.cumsum(np.concatenate([np.zeros_like(np.take(a, [0], axis)), a], axis), axis)
            low, high = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius + 1, n)
            count = (high - low).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
            a = (np.take(sums, high, axis) - np.take(sums, low, axis)) / count
    return a


def _on_lightness(function):
    """An operator of L: a and b stay. A single channel is taken for L."""

    @wraps(function)
    def run(a, **params):
        if a.ndim == 2:
            return function(a, **params)
        return np.concatenate([function(a[..., 0], **params)[..., None], a[..., 1:]], axis=-1)

    return run


@_on_lightness
def sharpen(a, radius: float = 2.0, amount: float = 0.5, threshold: float = 0.5):
    """Unsharp mask on L with a threshold on the difference; the outermost pixels, where the mask is not whole, stay."""
    r = math.ceil(radius)
    if r == 0 or min(a.shape) < 2 * r + 1:
        return a
    d = a - convolve(a, gaussian_weights(radius / 2.5, r))
    out = a + amount * np.sign(d) * np.maximum(np.abs(d) - threshold, 0)
    whole = np.zeros(a.shape, bool)
    whole[r:-r, r:-r] = True
    return np.where(whole, out, a)


def _bloom_radius(size: float = 2.0, **_) -> int:
    return min(256, int(256 * min(100.0, size + 1) / 100))


@_on_lightness
def bloom(a, size: float = 0.0, threshold: float = 90.0, strength: float = 25.0):
    """Light above a threshold spreads, and lies over the image as on a screen."""
    v = a * 2 ** (min(100.0, strength + 1) / 100)
    glow = box_blur(np.where(v > threshold, v, 0.0), _bloom_radius(size))
    return 100 - (100 - a) * (100 - glow) / 100


def _highpass_radius(sharpness: float = 12.0, **_) -> int:
    return min(16, math.ceil(int(16 * min(100.0, sharpness + 1) / 100)))


def highpass(a, sharpness: float = 12.0, contrast: float = 50.0):
    """L against its inverted surroundings, around middle grey; without colour."""
    l = a if a.ndim == 2 else a[..., 0]
    blurred = box_blur(100 - np.clip(l, 0, 100), _highpass_radius(sharpness))
    out = np.clip((blurred + l - 100) * (contrast / 100 * 7.5 * 0.5) + 50, 0, 100)
    return out if a.ndim == 2 else np.stack([out, np.zeros_like(l), np.zeros_like(l)], axis=-1)


def soften(a, brightness: float = 0.33, amount: float = 50.0, saturation: float = 100.0, radius: int = 1):
    """A brighter, blurred copy over the image (Orton's way). With colours, saturation and brightness act on hue, saturation and lightness."""
    if a.ndim == 2:
        over = np.clip(a * 2**brightness, 0, 1)
    else:
        h, s, l = _hsl(a)
        over = _rgb(h, np.clip(s * saturation / 100, 0, 1), np.clip(l * 2**brightness, 0, 1))
    return a + amount / 100 * (box_blur(over, radius) - a)


def _hsl(a):
    hi, lo = a.max(axis=-1), a.min(axis=-1)
    d, l = hi - lo, (hi + lo) / 2
    r, g, b = np.moveaxis(a, -1, 0)
    safe = np.where(d == 0, 1, d)
    h = np.where(hi == r, (g - b) / safe, np.where(hi == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) / 6 % 1
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(d == 0, 0, d / np.where(l < 0.5, hi + lo, 2 - hi - lo))
    return np.where(d == 0, 0, h), s, l


def _rgb(h, s, l):
    top = np.where(l < 0.5, l * (1 + s), l + s - l * s)
    low = 2 * l - top
    ramp = lambda t: low + (top - low) * np.clip(np.where(t % 1 < 0.5, 6 * (t % 1), 4 - 6 * (t % 1)), 0, 1)
    return np.stack([ramp(h + 1 / 3), ramp(h), ramp(h - 1 / 3)], axis=-1)


def lowpass(a, sigma: float = 3.0, contrast: float = 1.0, brightness: float = 0.0, radius: int = 9):
    return np.clip((gaussian(a, sigma, radius) - 0.5) * contrast + 0.5 + brightness, 0, 1)


def shadows_highlights(a, shadows: float = 0.5, highlights: float = -0.5, sigma: float = 4.0, radius: int = 12):
    """Lift where the surroundings are dark, lower where they are bright."""
    base = gaussian(a, sigma, radius)
    dark, light = np.clip(1 - 2 * base, 0, 1), np.clip(2 * base - 1, 0, 1)
    return np.clip(a + shadows * dark * a * (1 - a) + highlights * light * a * (1 - a), 0, 1)


def local_contrast(a, detail: float = 0.5, sigma: float = 4.0, radius: int = 12):
    return a + detail * (a - gaussian(a, sigma, radius))


def bilateral(a, sigma_s: float = 1.5, sigma_r: float = 0.1, radius: int = 3):
    shifts = window(a, radius)
    k = np.arange(-radius, radius + 1)
    space = np.exp(-(k[:, None] ** 2 + k[None] ** 2) / (2 * sigma_s**2)).reshape((-1,) + (1,) * a.ndim)
    w = space * np.exp(-((shifts - a) ** 2) / (2 * sigma_r**2))
    return (w * shifts).sum(axis=0) / w.sum(axis=0)


def guided(a, radius: int = 3, eps: float = 0.01):
    """Guided by itself: edges above sqrt(eps) stay."""
    mean = box_mean(a, radius)
    var = box_mean(a * a, radius) - mean * mean
    k = var / (var + eps)
    return box_mean(k, radius) * a + box_mean(mean - k * mean, radius)


def nlmeans(a, strength: float = 0.1, search: int = 2, patch: int = 1):
    p, out, total = pad(a, search), np.zeros_like(a), np.zeros_like(a)
    for dy in range(2 * search + 1):
        for dx in range(2 * search + 1):
            other = p[dy : dy + a.shape[0], dx : dx + a.shape[1]]
            w = np.exp(-box_mean((other - a) ** 2, patch) / strength**2)
            out, total = out + w * other, total + w
    return out / total


_SPLINE = np.array([1, 4, 6, 4, 1]) / 16


def atrous(a, levels: int = 3, boosts=(1.2, 1.1, 1.0), threshold: float = 0.0):
    """Wavelets with holes: details of each scale are thresholded and weighted, then added to the rest."""
    rest, out = a, np.zeros_like(a)
    for i in range(levels):
        w = np.zeros(4 * 2**i + 1)
        w[:: 2**i] = _SPLINE
        smooth = convolve(rest, w)
        d = rest - smooth
        out, rest = out + boosts[min(i, len(boosts) - 1)] * np.sign(d) * np.maximum(np.abs(d) - threshold, 0), smooth
    return out + rest


def raw_denoise(a, threshold: float = 0.02, levels: int = 3):
    return atrous(a, levels, (1.0,), threshold)


def profiled_denoise(a, gain: float = 0.01, offset: float = 0.0001, strength: float = 1.0, levels: int = 3):
    """Noise is made even by a square root, shrunk, and brought back."""
    z = 2 * np.sqrt(np.maximum(a * gain + offset, 0)) / gain
    z = atrous(z, levels, (1.0,), strength)
    return (np.maximum(z * gain / 2, 0) ** 2 - offset) / gain


def defringe(a, threshold: float = 0.1, radius: int = 4):
    base = gaussian(a, 1.5, radius)
    return np.where(np.abs(a - base) > threshold, base, a)


def hot_pixels(a, threshold: float = 0.05, strength: float = 0.75, neighbours: int = 3):
    """On a mosaic: a value far above enough of its four like-coloured neighbours becomes their largest."""
    p = pad(a, 2)
    h, w = a.shape[:2]
    near = np.stack([p[0:h, 2 : w + 2], p[4 : h + 4, 2 : w + 2], p[2 : h + 2, 0:w], p[2 : h + 2, 4 : w + 4]])
    bad = (a > threshold) & ((near < a * strength).sum(axis=0) >= neighbours)
    return np.where(bad, near.max(axis=0), a)


def clahe(a, radius: int = 6, slope: float = 1.25, bins: int = 64):
    """Each value's rank in its surroundings, the histogram's steepness bounded."""
    shifts = np.clip((window(a, radius) * bins).astype(int), 0, bins - 1)
    own = np.clip((a * bins).astype(int), 0, bins - 1)
    n = len(shifts)
    limit = max(1.0, slope * n / bins)
    counts = np.stack([np.minimum((shifts == b).sum(axis=0), limit) for b in range(bins)])
    spare = (n - counts.sum(axis=0)) / bins
    ranks = np.cumsum(counts + spare, axis=0) / n
    return np.take_along_axis(ranks, own[None], axis=0)[0]


def haze_removal(a, strength: float = 0.8, radius: int = 4, air: float = 1.0):
    dark = box_min(a, radius)
    through = np.clip(guided(1 - strength * dark / air, radius, 0.001), 0.1, 1)
    return (a - air) / through + air


def scharr(a):
    p = pad(a, 1)
    gx = 47 / 255 * (p[:-2, 2:] - p[:-2, :-2] + p[2:, 2:] - p[2:, :-2]) + 162 / 255 * (p[1:-1, 2:] - p[1:-1, :-2])
    gy = 47 / 255 * (p[2:, :-2] - p[:-2, :-2] + p[2:, 2:] - p[:-2, 2:]) + 162 / 255 * (p[2:, 1:-1] - p[:-2, 1:-1])
    return np.sqrt(gx * gx + gy * gy)


def detail_mask(a, threshold: float = 0.1):
    return 1 / (1 + np.exp(-16 * (gaussian(scharr(a), 1.0, 3) / max(threshold, 1e-6) - 1)))


def diffuse(a, rounds: int = 4, rate: float = 0.2, edge: float = 0.1):
    """Anisotropic diffusion: flow is weak across strong gradients."""
    for _ in range(rounds):
        p = pad(a, 1)
        flows = [p[:-2, 1:-1] - a, p[2:, 1:-1] - a, p[1:-1, :-2] - a, p[1:-1, 2:] - a]
        a = a + rate * sum(f * np.exp(-((f / edge) ** 2)) for f in flows)
    return a


def tone_equalizer(a, gains=(-0.5, -0.3, -0.1, 0.0, 0.1, 0.2, 0.1, 0.0, -0.1), radius: int = 4):
    """Exposure by the surroundings' brightness: nine bands a stop apart, blended by Gaussians."""
    ev = np.log2(np.maximum(guided(a, radius, 0.01), 2.0**-16))
    bands = np.arange(-8, 1)[(...,) + (None,) * a.ndim]
    w = np.exp(-((ev - bands) ** 2) / 2)
    g = np.array(gains)[(...,) + (None,) * a.ndim]
    return a * 2 ** ((w * g).sum(axis=0) / w.sum(axis=0))


def tonemap_bilateral(a, contrast: float = 2.5, radius: int = 3):
    """Compress the base layer's logarithm, keep the details'."""
    z = np.log10(np.maximum(a, 1e-4))
    base = bilateral(z, 1.5, 0.4, radius)
    return 10 ** (base / contrast + z - base)


def censorize(a, sigma: float = 1.0, block: int = 4, radius: int = 3):
    """Blur, then whole blocks take their first value (tiles must be aligned to blocks)."""
    b = gaussian(a, sigma, radius)
    return b[np.arange(a.shape[0]) // block * block][:, np.arange(a.shape[1]) // block * block]


def green_equilibrate(a, threshold: float = 0.01):
    """Local average (RGGB): greens of blue rows are scaled by the ratio of the four diagonal greens' mean to their own four's, where both fours are even. The outer two pixels stay."""
    h, w = a.shape[:2]
    p = np.pad(a, 2, constant_values=np.nan)  # no comparison holds beyond the image
    at = lambda dy, dx: p[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w]
    other = np.stack([at(-1, -1), at(-1, 1), at(1, -1), at(1, 1)])
    same = np.stack([at(-2, 0), at(2, 0), at(0, -2), at(0, 2)])
    uneven = lambda v: sum(np.abs(v[i] - v[j]) for i in range(4) for j in range(i)) / 6
    m1, m2 = other.mean(axis=0), same.mean(axis=0)
    y, x = np.indices((h, w))
    with np.errstate(divide="ignore", invalid="ignore"):
        even = (m1 > 0) & (m2 > 0) & (m1 / m2 < 2) & (a < 0.95) & (uneven(other) < threshold) & (uneven(same) < threshold)
        return np.where((y % 2 == 1) & (x % 2 == 0) & even, np.maximum(a * m1 / m2, 0), a)


def demosaic(a):
    """RGGB mosaic to RGB by gradients: green along the smoother direction, colours by differences to green. Tiles start at even places."""
    h, w = a.shape
    p = pad_mosaic(a, 4)
    y, x = np.indices(p.shape)
    r, b = (y % 2 == 0) & (x % 2 == 0), (y % 2 == 1) & (x % 2 == 1)
    s = lambda dy, dx: np.roll(p, (dy, dx), (0, 1))
    gh = np.abs(s(0, 1) - s(0, -1)) + np.abs(2 * p - s(0, 2) - s(0, -2))
    gv = np.abs(s(1, 0) - s(-1, 0)) + np.abs(2 * p - s(2, 0) - s(-2, 0))
    across = (s(0, 1) + s(0, -1)) / 2 + (2 * p - s(0, 2) - s(0, -2)) / 4
    down = (s(1, 0) + s(-1, 0)) / 2 + (2 * p - s(2, 0) - s(-2, 0)) / 4
    green = np.where(r | b, np.where(gh < gv, across, np.where(gv < gh, down, (across + down) / 2)), p)
    out = [None, green, None]
    for c, place in ((0, r), (2, b)):
        d = np.where(place, p - green, 0.0)
        k = place.astype(float)
        box = lambda v: sum(np.roll(v, (i, j), (0, 1)) * wy * wx for i, wy in ((-1, 0.5), (0, 1), (1, 0.5)) for j, wx in ((-1, 0.5), (0, 1), (1, 0.5)))
        out[c] = green + box(d) / np.maximum(box(k), 1e-9)
    return np.maximum(np.stack(out, axis=-1)[4 : 4 + h, 4 : 4 + w], 0)


def pad_mosaic(a: np.ndarray, r: int) -> np.ndarray:
    """Reflection keeps every place's colour."""
    return np.pad(a, r, mode="reflect")


def color_smoothing(rgb, passes: int = 1):
    for _ in range(passes):
        for c in (0, 2):
            rgb = rgb.copy()
            rgb[..., c] = rgb[..., 1] + median(rgb[..., c] - rgb[..., 1])
    return rgb


def distance_transform(mask):
    """Euclidean distance of each inside pixel to the nearest outside one (two exact passes of parabolas)."""
    far = float(sum(mask.shape)) ** 2
    f = np.where(mask > 0.5, far, 0.0)
    for axis in (0, 1):
        n = f.shape[axis]
        k = np.arange(n)
        cost = (k[:, None] - k[None]) ** 2
        f = np.stack([np.min(np.moveaxis(f, axis, -1) + cost[i], axis=-1) for i in range(n)], axis=axis)
    return np.sqrt(f)


def floyd_steinberg(a, levels: int = 2):
    """Error diffusion, row after row: sequential, so an image is one piece."""
    a = a.astype(float).copy()
    h, w = a.shape
    for y in range(h):
        for x in range(w):
            old = a[y, x]
            new = min(max(round(old * (levels - 1)), 0), levels - 1) / (levels - 1)
            a[y, x], e = new, old - new
            for dy, dx, k in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                if y + dy < h and 0 <= x + dx < w:
                    a[y + dy, x + dx] += e * k / 16
    return a


def heal(a, mask, source, rounds: int = 200):
    """Inside the mask, the source's details on the surroundings' colour: the difference is made harmonic."""
    d = a - source
    inside = mask > 0.5
    for _ in range(rounds):
        p = pad(d, 1)
        d = np.where(inside, (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4, d)
    return np.where(inside, source + d, a)


# --- resampling and geometry (whole images)

_FILTERS = {"bilinear": (1, lambda t: np.maximum(1 - np.abs(t), 0)), "bicubic": (2, lambda t: np.where(np.abs(t) < 1, 1.5 * np.abs(t) ** 3 - 2.5 * t**2 + 1, np.where(np.abs(t) < 2, -0.5 * np.abs(t) ** 3 + 2.5 * t**2 - 4 * np.abs(t) + 2, 0))), "lanczos2": (2, lambda t: np.where(np.abs(t) < 2, np.sinc(t) * np.sinc(t / 2), 0)), "lanczos3": (3, lambda t: np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0))}


def sample(a, y, x, method: str = "bilinear"):
    """Values at fractional places; edges repeat."""
    r, f = _FILTERS[method]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    out, total = 0.0, 0.0
    more = (...,) + (None,) * (a.ndim - 2)
    for dy in range(1 - r, r + 1):
        for dx in range(1 - r, r + 1):
            w = f(y - y0 - dy) * f(x - x0 - dx)
            total = total + w
            out = out + w[more] * a[np.clip(y0 + dy, 0, a.shape[0] - 1), np.clip(x0 + dx, 0, a.shape[1] - 1)]
    return out / np.where(total == 0, 1, total)[more]


@dataclass(frozen=True)
class Warp:
    """An operator that reads each output place from another one: ``source`` says which, ``size`` how large the output is.

    ``before`` filters the input and looks ``margin`` pixels around; ``after`` sees the output and its places.
    ``reach`` is that of the sampling filter. Parameters go to all of them.
    """

    name: str
    source: Callable
    size: Callable = lambda h, w, **_: (h, w)
    before: Callable = lambda a, **_: a
    margin: Callable = lambda **_: 0
    after: Callable = lambda out, y, x, h, w, **_: out
    method: Callable = lambda method="bilinear", **_: method
    reach: int = 3

    def __call__(self, a: np.ndarray, **params) -> np.ndarray:
        """On a whole image."""
        h, w = a.shape[:2]
        y, x = np.indices(self.size(h, w, **params)).astype(float)
        out = sample(self.before(a, **params), *self.source(y, x, h, w, **params), self.method(**params))
        return self.after(out, y, x, h, w, **params)


def _scaled(h, w, scale=0.5, **_):
    return max(1, math.floor(h * scale)), max(1, math.floor(w * scale))


resample = Warp(
    "resample",
    lambda y, x, h, w, scale=0.5, **_: ((y + 0.5) / scale - 0.5, (x + 0.5) / scale - 0.5),
    _scaled,
    lambda a, scale=0.5, **_: gaussian(a, 0.5 / scale, math.ceil(1.5 / scale)) if scale < 1 else a,
    lambda scale=0.5, **_: math.ceil(1.5 / scale) if scale < 1 else 0,
    method=lambda method="lanczos3", **_: method,
)


def _homography(y, x, h, w, matrix=((1, 0, 0), (0, 1, 0), (0, 0, 1)), **_):
    """Each output place (x, y, 1) reads from matrix times it."""
    m = np.asarray(matrix, float)
    z = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    return (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / z, (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / z


def _turned(y, x, h, w, degrees=10.0, **_):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    cy, cx = (h - 1) / 2, (w - 1) / 2
    return cy - s * (x - cx) + c * (y - cy), cx + c * (x - cx) + s * (y - cy)


homography, rotate = Warp("homography", _homography), Warp("rotate", _turned)


def _radius2(y, x, h, w):
    u, v = (x - (w - 1) / 2) / (w / 2), (y - (h - 1) / 2) / (w / 2)
    return u, v, u * u + v * v


def _distorted(y, x, h, w, k1=0.05, k2=0.0, **_):
    u, v, r2 = _radius2(y, x, h, w)
    d = 1 + k1 * r2 + k2 * r2 * r2
    return v * d * w / 2 + (h - 1) / 2, u * d * w / 2 + (w - 1) / 2


#: Radial distortion and falloff towards the corners.
lens = Warp("lens", _distorted, after=lambda out, y, x, h, w, vignetting=0.1, **_: out * (1 + vignetting * _radius2(y, x, h, w)[2])[(...,) + (None,) * (out.ndim - 2)])


def _pulled(y, x, h, w, cx=16.0, cy=12.0, radius=8.0, dx=3.0, dy=0.0, **_):
    t = np.clip(1 - ((x - cx) ** 2 + (y - cy) ** 2) / radius**2, 0, 1) ** 2
    return y - t * dy, x - t * dx


#: Pull a neighbourhood along a vector, most at its centre.
liquify = Warp("liquify", _pulled)


def _spot(y, x, h, w, cx=16.0, cy=12.0, radius=8.0, dx=4.0, dy=0.0, **_):
    inside = (x - cx) ** 2 + (y - cy) ** 2 <= radius**2
    return np.where(inside, np.clip(y + dy, 0, h - 1), y), np.where(inside, np.clip(x + dx, 0, w - 1), x)


#: A circle copied from elsewhere; its source lies off by (dx, dy).
spot = Warp("spot", _spot)


def clone(a, mask, dx: int = 4, dy: int = 0):
    y, x = np.indices(a.shape[:2])
    source = a[np.clip(y + dy, 0, a.shape[0] - 1), np.clip(x + dx, 0, a.shape[1] - 1)]
    m = mask[(...,) + (None,) * (a.ndim - 2)]
    return a * (1 - m) + source * m


def rasterize_path(points, height: int, width: int, feather: float = 0.0):
    """A closed path of (x, y) as a mask; with a feathered outside."""
    y, x = np.indices((height, width)) + 0.5
    inside = np.zeros((height, width), bool)
    near = np.full((height, width), np.inf)
    for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]]):
        cross = (y0 > y) != (y1 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= cross & (x < (x1 - x0) * (y - y0) / (y1 - y0 if y1 != y0 else 1.0) + x0)
        t = np.clip(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / max((x1 - x0) ** 2 + (y1 - y0) ** 2, 1e-12), 0, 1)
        near = np.minimum(near, np.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)))
    return np.where(inside, 1.0, np.clip(1 - near / feather, 0, 1) ** 2 if feather > 0 else 0.0)


def rasterize_brush(points, height: int, width: int, radius: float = 3.0, hardness: float = 0.5):
    """A stroke along points: full inside the hard part, falling to the radius."""
    y, x = np.indices((height, width)) + 0.5
    near = np.full((height, width), np.inf)
    for (x0, y0), (x1, y1) in zip(points, points[1:] or points):
        t = np.clip(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / max((x1 - x0) ** 2 + (y1 - y0) ** 2, 1e-12), 0, 1)
        near = np.minimum(near, np.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)))
    return np.clip((radius - near) / max(radius * (1 - hardness), 1e-9), 0, 1)


@dataclass(frozen=True)
class Kernel:
    """``space`` is what it works in; ``reach`` gives the halo for parameters that widen it."""

    name: str
    run: Callable
    halo: int
    space: str = "RGB"
    reach: Callable[..., int] | None = None

    def around(self, params: dict) -> int:
        """The halo, even, so that mosaics keep their phase."""
        halo = self.reach(**params) if self.reach else self.halo
        return halo + halo % 2


KERNELS = {k.name: k for k in (Kernel("gaussian", gaussian, 6), Kernel("box_mean", box_mean, 3), Kernel("box_min", box_min, 3), Kernel("box_max", box_max, 3), Kernel("median", median, 1), Kernel("sharpen", sharpen, 2, "LAB", lambda radius=2.0, **_: math.ceil(radius)), Kernel("bloom", bloom, 16, "LAB", lambda size=0.0, **_: BOXES * _bloom_radius(size)), Kernel("highpass", highpass, 16, "LAB", lambda sharpness=12.0, **_: BOXES * _highpass_radius(sharpness)), Kernel("lowpass", lowpass, 9), Kernel("soften", soften, 8, "RGB", lambda radius=1, **_: BOXES * radius), Kernel("shadhi", shadows_highlights, 12), Kernel("bilat", local_contrast, 12), Kernel("bilateral", bilateral, 3), Kernel("guided", guided, 6), Kernel("nlmeans", nlmeans, 4), Kernel("atrous", atrous, 14), Kernel("equalizer", atrous, 14), Kernel("rawdenoise", raw_denoise, 14), Kernel("denoiseprofile", profiled_denoise, 14), Kernel("defringe", defringe, 4), Kernel("hotpixels", hot_pixels, 2), Kernel("clahe", clahe, 6), Kernel("hazeremoval", haze_removal, 12), Kernel("scharr", scharr, 1), Kernel("detail_mask", detail_mask, 4), Kernel("diffuse", diffuse, 4), Kernel("toneequal", tone_equalizer, 8), Kernel("tonemap", tonemap_bilateral, 3), Kernel("censorize", censorize, 8), Kernel("green_equilibrate", green_equilibrate, 2), Kernel("demosaic", demosaic, 8), Kernel("color_smoothing", color_smoothing, 2))}
WARPS = {w.name: w for w in (resample, homography, rotate, lens, liquify, spot)}
WHOLE = {f.__name__: f for f in (floyd_steinberg, distance_transform)}
