"""Edit pipelines: an ordered list of operators with parameters, rendered as one plan per stage.

Neighbouring pointwise operators fuse into one selection; colour space conversions stand only
where spaces differ; operators that need neighbours run on tiles with a halo. Disabled operators
leave no node in the plan.
"""

from __future__ import annotations

import copy
import inspect
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..operators import kernels, pixels, tiles
from .layers import Plan, clamp, num

# The canonical orders of operators, first to last.
ORDERS = {
    "legacy": "rawprepare invert temperature rasterfile highlights cacorrect hotpixels rawdenoise demosaic mask_manager denoiseprofile tonemap exposure spots retouch lens cacorrectrgb ashift liquify rotatepixels scalepixels flip enlargecanvas clipping toneequal crop overlay graduatednd basecurve bilateral profile_gamma hazeremoval colorin channelmixerrgb diffuse censorize negadoctor blurs basicadj primaries colorreconstruct colorchecker defringe equalizer vibrance colorbalance colorequal colorbalancergb colorize colortransfer colormapping bloom nlmeans globaltonemap shadhi atrous bilat colorzones lowlight monochrome sigmoid agx filmic filmicrgb colisa zonesystem tonecurve levels rgblevels rgbcurve relight colorcorrection sharpen lowpass highpass grain lut3d colorcontrast colorout channelmixer soften vignette splittoning velvia clahe finalscale overexposed rawoverexposed dither borders watermark gamma".split(),
    "v3.0 RAW": "rawprepare invert temperature rasterfile highlights cacorrect hotpixels rawdenoise demosaic denoiseprofile bilateral rotatepixels scalepixels lens cacorrectrgb hazeremoval ashift flip enlargecanvas overlay clipping liquify spots retouch exposure mask_manager tonemap toneequal crop graduatednd profile_gamma equalizer colorin channelmixerrgb diffuse censorize negadoctor blurs primaries nlmeans colorchecker defringe atrous lowpass highpass sharpen colortransfer colormapping channelmixer basicadj colorbalance colorequal colorbalancergb rgbcurve rgblevels basecurve filmic sigmoid agx filmicrgb lut3d colisa tonecurve levels shadhi zonesystem globaltonemap relight bilat colorcorrection colorcontrast velvia vibrance colorzones bloom colorize lowlight monochrome grain soften splittoning vignette colorreconstruct colorout clahe finalscale overexposed rawoverexposed dither borders watermark gamma".split(),
}


def _moved(order: list[str], name: str, after: str) -> list[str]:
    rest = [o for o in order if o != name]
    at = rest.index(after) + 1
    return rest[:at] + [name] + rest[at:]


# Files that are not raw are in a display space from the start; of the two tone mappers the older order has the newer one first.
ORDERS["v3.0 JPEG"] = _moved(_moved(ORDERS["v3.0 RAW"], "colorin", "demosaic"), "sigmoid", "agx")
ORDERS["v5.0 RAW"] = _moved(ORDERS["v3.0 RAW"], "finalscale", "colorreconstruct")
ORDERS["v5.0 JPEG"] = _moved(ORDERS["v5.0 RAW"], "colorin", "demosaic")
#: Operator of the orders -> pointwise operator that renders it, where the names differ.
POINTWISE = {"highlights": "highlights_clip", "globaltonemap": "globaltonemap_reinhard", "filmic": "filmic_log", "filmicrgb": "filmic_log", "agx": "agx_log", "profile_gamma": "profile_gamma_log", "dither": "posterize"}
DEFAULT_ON = ("rawprepare", "demosaic", "colorin", "exposure", "colorout")


@dataclass(frozen=True)
class Param:
    kind: type
    low: float
    high: float


def _p(kind, low, high):
    return Param(kind, low, high)


#: Parameters that have bounds; others take any number their operator accepts.
PARAMS: dict[str, dict[str, Param]] = {
    "exposure": {"black": _p(float, -1, 1), "exposure": _p(float, -18, 18), "mode": _p(int, 0, 1), "deflicker_percentile": _p(float, 0, 100), "deflicker_target_level": _p(float, -18, 18)},
    "temperature": {"red": _p(float, 0, 8), "green": _p(float, 0, 8), "blue": _p(float, 0, 8)},
    "rawprepare": {"left": _p(int, 0, 65535), "top": _p(int, 0, 65535), "right": _p(int, 0, 65535), "bottom": _p(int, 0, 65535), "raw_white_point": _p(int, 0, 65535)},
    "sharpen": {"radius": _p(float, 0, 99), "amount": _p(float, 0, 2), "threshold": _p(float, 0, 100)},
    "velvia": {"strength": _p(float, 0, 100), "bias": _p(float, 0, 1)},
}
RENAMED = {("exposure", "exposure"): "ev"}


class PipelineError(ValueError):
    pass


@dataclass
class Stage:
    name: str
    enabled: bool = False
    params: dict[str, float] = field(default_factory=dict)
    instance: int = 0


@dataclass
class Pipeline:
    """Stages in an order. Methods that change it return self."""

    stages: list[Stage] = field(default_factory=list)
    order: str = "v5.0 RAW"
    source: dict = field(default_factory=dict)
    custom_order: list[str] = field(default_factory=list)

    @classmethod
    def create(cls, order: str = "v5.0 RAW", defaults: tuple[str, ...] = DEFAULT_ON) -> Pipeline:
        return cls([Stage(n, n in defaults) for n in ORDERS[order]], order)

    def stage(self, name: str, instance: int = 0) -> Stage:
        for s in self.stages:
            if s.name == name and s.instance == instance:
                return s
        raise PipelineError(f"no module {name}")

    def set_param(self, name: str, param: str, value: float) -> Pipeline:
        spec = PARAMS.get(name, {}).get(param)
        if spec is not None:
            if not spec.low <= value <= spec.high:
                raise PipelineError(f"{name}.{param} must lie in [{spec.low}, {spec.high}]")
            if spec.kind is int and value != int(value):
                raise PipelineError(f"{name}.{param} is a whole number")
        self.stage(name).params[param] = value
        return self

    def get_param(self, name: str, param: str) -> float:
        try:
            return self.stage(name).params[param]
        except KeyError as e:
            raise PipelineError(f"{name}.{param} is not set") from e

    def enable(self, name: str, on: bool = True) -> Pipeline:
        self.stage(name).enabled = on
        return self

    def is_enabled(self, name: str) -> bool:
        return self.stage(name).enabled

    def add_instance(self, name: str) -> Pipeline:
        """Another instance right after the last one of its name."""
        last = max(i for i, s in enumerate(self.stages) if s.name == name)
        self.stages.insert(last + 1, Stage(name, True, copy.deepcopy(self.stages[last].params), self.stages[last].instance + 1))
        return self

    def can_move(self, name: str, before: str) -> bool:
        """Raw operators stay before demosaicing and all others after it; colour input and output keep their sides."""
        names = [s.name for s in self.stages if s.name != name]
        at, pivot = names.index(before), names.index("demosaic") if "demosaic" in names else -1
        fixed = {"rawprepare", "demosaic", "colorin", "colorout", "gamma"}
        return name not in fixed and ((self._raw(name) and at <= pivot) or (not self._raw(name) and at > pivot))

    def _raw(self, name: str) -> bool:
        order = ORDERS[self.order]
        return name in order and order.index(name) < order.index("demosaic")

    def move_before(self, name: str, before: str) -> Pipeline:
        if not self.can_move(name, before):
            raise PipelineError(f"{name} can't stand before {before}")
        s = self.stage(name)
        self.stages.remove(s)
        self.stages.insert(self.stages.index(self.stage(before)), s)
        self.custom_order = [x.name for x in self.stages]
        return self

    # --- documents

    def to_json(self) -> str:
        modules = {s.name: {"enabled": s.enabled, "version": 1, "params": s.params} for s in self.stages if s.enabled or s.params}
        return json.dumps({"version": "1.0", "generator": "lumigrid", "source": self.source, "settings": {"iop_order": self.order, "color_workflow": "scene-referred"}, "modules": modules, "custom_order": self.custom_order, "masks": {}}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        """Unknown modules and keys are passed over; a missing or later major version is refused."""
        try:
            doc = json.loads(text)
            major = int(str(doc["version"]).split(".")[0])
        except (ValueError, KeyError, TypeError) as e:
            raise PipelineError(f"not a history document: {e}") from e
        if major > 1:
            raise PipelineError("a later version of the format")
        order = (doc.get("settings") or {}).get("iop_order", "v5.0 RAW")
        out = cls.create(order if order in ORDERS else "v5.0 RAW", ())
        known = {s.name for s in out.stages}
        for name, m in (doc.get("modules") or {}).items():
            if name in known:
                out.enable(name, bool(m.get("enabled", True))).stage(name).params.update(m.get("params") or {})
        if custom := [n for n in doc.get("custom_order") or [] if n in known]:
            place = {n: i for i, n in enumerate(custom)}
            out.stages.sort(key=lambda s: place.get(s.name, len(place)))
            out.custom_order = custom
        out.source = doc.get("source") or {}
        return out

    # --- rendering

    def render(self, image: DataFrame, height: int, width: int, scale: float = 1.0, region: tuple[int, int, int, int] | None = None, tile: int = tiles.TILE) -> DataFrame:
        """Pixels (img_id, y, x, c0, c1, c2) through all enabled stages, then resampled to floor(size * scale).

        ``image`` has c0, c1 and c2, or c0 alone if it is a raw mosaic (RGGB); stages of the raw part do
        nothing on other images. A region (x, y, width, height) is a window of floor(width * scale) by
        floor(height * scale) at (x, y) of the scaled image; as long as no stage moves pixels about, only
        the tiles that the window and the halos of all stages touch are read. An enabled stage that has
        no implementation raises.
        """
        if scale <= 0:
            raise PipelineError("scale must be positive")
        on = [s for s in self.stages if s.enabled]
        for s in on:
            if _kind(s.name) is None:
                raise PipelineError(f"{s.name} can't be rendered")
        window = None
        if region:
            window = (region[0], region[1], math.floor(region[2] * scale), math.floor(region[3] * scale))
        out_h, out_w = math.floor(height * scale), math.floor(width * scale)
        if min(window[2:] if window else (out_h, out_w)) <= 0:
            raise PipelineError("nothing to render")
        work = _Canvas(image, height, width, tile, "c1" not in image.columns)
        if window and all(_kind(s.name) in ("point", "kernel", "color", "none", "demosaic") for s in on):
            work.keep(window, scale, sum(map(_halo, on)))
        for s in on:
            getattr(work, "do_" + _kind(s.name))(s)
        if scale != 1:
            work.warp("resample", scale=scale)
        out = work.finish()
        if window:
            x, y, w, h = window
            out = tiles.crop(out, y, y + h, x, x + w)
        return out

    def export(self, image: DataFrame, height: int, width: int, **options) -> DataFrame:
        """Rendered pixels as 8-bit display values; linear light gets the display's curve first, if no stage gave it."""
        out = self.render(image, height, width, **options)
        if any(s.enabled and s.name == "gamma" for s in self.stages):
            return out
        if self.coded():
            return pixels.each(Plan(), f"floor(255 * {clamp('$')} + 0.5)").apply(out)
        return color.display_byte().apply(out)

    def coded(self) -> bool:
        """Whether the result is in display coding already."""
        return any(s.enabled and s.name in ("colorout", "gamma") for s in self.stages)


#: Stages that move pixels -> the warp that does it.
MOVING = {"rotatepixels": "rotate", "scalepixels": "resample", "ashift": "homography", "lens": "lens", "liquify": "liquify", "retouch": "spot", "spots": "spot"}
_RAW_ONLY = ("rawprepare", "demosaic", "hotpixels", "rawdenoise")
_C = ["c0", "c1", "c2"]


def _kind(name: str) -> str | None:
    """How a stage is rendered; None if it can't be."""
    if name in ("colorin", "colorout", "gamma"):
        return "color"
    if name in ("rawprepare", "demosaic", "crop", "flip", "borders", "clipping"):
        return name
    if name in ("mask_manager", "finalscale"):  # masks act through blends; the output's scale is the renderer's
        return "none"
    if name == "enlargecanvas":
        return "borders"
    if name in MOVING:
        return "warp"
    if POINTWISE.get(name, name) in pixels.POINT_OPS:
        return "point"
    return "kernel" if name in kernels.KERNELS else None


def _halo(s: Stage) -> int:
    kernel = kernels.KERNELS.get(s.name) if _kind(s.name) in ("kernel", "demosaic") else None
    return kernel.around(_taken(s, _parameters(kernel.run))) if kernel else 0


def _parameters(function) -> tuple[str, ...]:
    return tuple(inspect.signature(function).parameters)


class _Canvas:
    """An image on its way through the stages: its pixels, size, and the point operators that wait to be applied together."""

    def __init__(self, df: DataFrame, height: int, width: int, tile: int, raw: bool):
        self.df, self.height, self.width, self.tile, self.raw = df, height, width, tile, raw
        self.plan, self.space = Plan(), "RGB"

    @property
    def channels(self) -> list[str]:
        return _C[:1] if self.raw else _C

    def settle(self) -> DataFrame:
        self.df, self.plan = self.plan.apply(self.df).select("img_id", "y", "x", *self.channels), Plan()
        return self.df

    def keep(self, window, scale: float, halo: int) -> None:
        """Only the tiles that a window of the scaled image needs."""
        x, y, w, h = window
        halo += math.ceil(1.5 / scale) + 4 if scale != 1 else 0
        low = lambda v: (math.floor(v / scale) - halo) // self.tile * self.tile
        high = lambda v: -(-(math.ceil(v / scale) + halo) // self.tile) * self.tile - 1
        self.df = self.df.where(F.col("x").between(low(x), high(x + w)) & F.col("y").between(low(y), high(y + h)))

    def into(self, space: str) -> None:
        """Convert to what an operator works in. Display values are taken as they are."""
        if space != self.space and {space, self.space} == {"RGB", "LAB"}:
            self.plan, self.space = (color.rgb_to_lab if space == "LAB" else color.lab_to_rgb)(self.plan), space

    def tiled(self, run, *args, **params) -> None:
        """Through tiles and back."""
        names = self.channels
        t = tiles.from_pixels(self.settle(), self.height, self.width, names, self.tile)
        self.df = tiles.to_pixels(run(t, *args, self.tile, **params), self.tile, _C if args[0] == "demosaic" else names)

    def warp(self, name: str, **params) -> None:
        self.tiled(tiles.run_warp, name, **params)
        self.height, self.width = kernels.WARPS[name].size(self.height, self.width, **params)

    def finish(self) -> DataFrame:
        self.into("RGB")
        df = self.settle()
        return df if not self.raw else df.select("img_id", "y", "x", "c0", F.col("c0").alias("c1"), F.col("c0").alias("c2"))

    # --- stages

    def do_none(self, s: Stage) -> None:
        pass

    def do_point(self, s: Stage) -> None:
        if self.raw and s.name in ("temperature", "highlights", "exposure"):
            make = {"temperature": pixels.temperature_mosaic, "highlights": lambda p, clip=1.0: p.let(c0=f"least(c0, {num(clip)})"), "exposure": lambda p, **k: p.let(c0=pixels.exposure(Plan(), **k).layers[0][0][1])}[s.name]
            params = _taken(s, ("red", "green", "blue", "clip", "black", "ev"))
            self.plan = make(self.plan, **params)
            return
        op = pixels.POINT_OPS[POINTWISE.get(s.name, s.name)]
        if self.raw:
            raise PipelineError(f"{s.name} needs colours, and the mosaic is not demosaiced yet")
        self.into(op.space)
        self.plan = op.make(self.plan, **_taken(s, _parameters(op.make)))

    def do_kernel(self, s: Stage) -> None:
        if s.name in _RAW_ONLY and not self.raw:
            return
        kernel = kernels.KERNELS[s.name]
        if not self.raw:
            self.into(kernel.space)
        self.tiled(tiles.run_kernel, s.name, **_taken(s, _parameters(kernel.run)))

    def do_color(self, s: Stage) -> None:
        if self.raw:
            raise PipelineError(f"{s.name} needs colours, and the mosaic is not demosaiced yet")
        if s.name == "colorin":
            self.into("LAB")
        elif s.name == "colorout":
            self.into("LAB")
            self.plan, self.space = pixels.colorout(self.plan), "DISPLAY"
        else:
            self.into("RGB")
            self.plan, self.space = pixels.each(self.plan, f"floor(255 * {clamp('$')} + 0.5)"), "DISPLAY"

    def do_rawprepare(self, s: Stage) -> None:
        if not self.raw:
            return
        p = s.params
        cut = [int(p.get(k, 0)) for k in ("left", "top", "right", "bottom")]
        self.plan = pixels.rawprepare(self.plan, [p.get(f"raw_black_level_separate_{i}", 0.0) for i in range(4)], p.get("raw_white_point", 1.0))
        if any(cut):
            left, top, right, bottom = cut
            self.df = tiles.crop(self.settle(), top, self.height - bottom, left, self.width - right)
            self.height, self.width = self.height - top - bottom, self.width - left - right

    def do_demosaic(self, s: Stage) -> None:
        if self.raw:
            self.tiled(tiles.run_kernel, "demosaic")
            self.raw = False

    def do_crop(self, s: Stage) -> None:
        """Edges as shares of the size: cx, cy, cw, ch."""
        p = s.params
        x0, y0 = math.floor(p.get("cx", 0.0) * self.width), math.floor(p.get("cy", 0.0) * self.height)
        x1, y1 = math.floor(p.get("cw", 1.0) * self.width), math.floor(p.get("ch", 1.0) * self.height)
        if not (0 <= x0 < x1 <= self.width and 0 <= y0 < y1 <= self.height):
            raise PipelineError("nothing is left of the image")
        self.df = tiles.crop(self.settle(), y0, y1, x0, x1)
        self.height, self.width = y1 - y0, x1 - x0

    def do_clipping(self, s: Stage) -> None:
        if s.params.get("angle"):
            self.warp("rotate", degrees=s.params["angle"])
        self.do_crop(s)

    def do_flip(self, s: Stage) -> None:
        """Orientation bits: 1 turns rows over, 2 columns, 4 exchanges both."""
        o = int(s.params.get("orientation", 0))
        self.df = tiles.flip(self.settle(), self.height, self.width, bool(o & 1), bool(o & 2), bool(o & 4)).select("img_id", "y", "x", *self.channels)
        if o & 4:
            self.height, self.width = self.width, self.height

    def do_borders(self, s: Stage) -> None:
        size = int(s.params.get("size", 0))
        self.df = tiles.borders(self.settle(), self.height, self.width, size, s.params.get("color", 1.0), self.channels)
        self.height, self.width = self.height + 2 * size, self.width + 2 * size

    def do_warp(self, s: Stage) -> None:
        params = {k: v for k, v in s.params.items() if k in ("scale", "degrees", "k1", "k2", "vignetting", "cx", "cy", "radius", "dx", "dy", "matrix")}
        if s.name == "rotatepixels":
            params = {"degrees": s.params.get("angle", 0.0)}
        elif s.name == "scalepixels":
            params = {"scale": s.params.get("scale", 1.0)}
        self.warp(MOVING[s.name], **params)


def _taken(s: Stage, names) -> dict[str, float]:
    """The stage's parameters that its operator has, by the operator's names."""
    named = {RENAMED.get((s.name, k), k): v for k, v in s.params.items()}
    return {k: v for k, v in named.items() if k in names}
