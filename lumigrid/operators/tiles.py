"""Images as tiles, and kernels and warps over them.

A tile is a row (img_id, ty, tx, height, width, data): the image's size, and the tile's values row
by row, a pixel's channels together. A kernel's halo comes from the eight tiles around; a warp's
output tile from the input tiles that its pixels come from. Each tile sends only the strips that
others need, once for all channels, so no task holds more than a few tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import KERNELS, WARPS, WHOLE, sample

TILE = 64
SCHEMA = "img_id long, ty int, tx int, height int, width int, data array<double>"
_STRIPS = "img_id long, ty int, tx int, height int, width int, y0 int, y1 int, x0 int, x1 int, data array<double>"
_COLUMNS = ["img_id", "ty", "tx", "height", "width", "y0", "y1", "x0", "x1", "data"]


def _names(channels) -> list[str]:
    return [channels] if isinstance(channels, str) else list(channels)


def from_pixels(pixels: DataFrame, height: int, width: int, channels="c0", tile: int = TILE) -> DataFrame:
    """Tiles from rows (img_id, y, x, channels); a tile's pixels are gathered in one group of bounded size."""
    names = _names(channels)
    values = F.array(*(F.col(c).cast("double") for c in names))
    rows = pixels.select("img_id", F.expr(f"cast(y div {tile} as int)").alias("ty"), F.expr(f"cast(x div {tile} as int)").alias("tx"), F.struct("y", "x", values.alias("v")).alias("p"))
    grouped = rows.groupBy("img_id", "ty", "tx").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return grouped.select("img_id", "ty", "tx", F.lit(height).alias("height"), F.lit(width).alias("width"), F.flatten(F.transform("ps", lambda p: p["v"])).alias("data"))


def to_pixels(tiles: DataFrame, tile: int = TILE, channels="c0") -> DataFrame:
    names = _names(channels)
    n = len(names)
    w = F.least(F.lit(tile), F.col("width") - F.col("tx") * tile)
    every = F.transform(F.sequence(F.lit(0), (F.size("data") / n - 1).cast("int")), lambda i: F.struct(i.alias("i"), *(F.get("data", i * n + k).alias(c) for k, c in enumerate(names))))
    rows = tiles.select("img_id", "ty", "tx", w.alias("w"), F.inline(every))
    return rows.select("img_id", (F.col("ty") * tile + F.expr("cast(i div w as int)")).alias("y"), (F.col("tx") * tile + F.col("i") % F.col("w")).cast("int").alias("x"), *names)


def _box(ty, tx, h, w, tile, halo=0):
    return max(0, ty * tile - halo), min(h, (ty + 1) * tile + halo), max(0, tx * tile - halo), min(w, (tx + 1) * tile + halo)


def _pixels(data, y0, y1, x0, x1) -> np.ndarray:
    """A strip or tile as height x width (x channels, if several)."""
    a = np.asarray(data)
    n = len(a) // max(1, (y1 - y0) * (x1 - x0))
    return a.reshape((y1 - y0, x1 - x0) if n == 1 else (y1 - y0, x1 - x0, n))


def _exchange(tiles: DataFrame, tile: int, targets, make) -> DataFrame:
    """``targets(h, w)`` gives (ty, tx, box) of every output tile; ``make(f, block, box)`` its values, from the block that its box covers."""

    def strips(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                y0, y1, x0, x1 = _box(r.ty, r.tx, r.height, r.width, tile)
                a = _pixels(r.data, y0, y1, x0, x1)
                for ty, tx, b in targets(r.height, r.width, r.ty, r.tx):
                    c = max(y0, b[0]), min(y1, b[1]), max(x0, b[2]), min(x1, b[3])
                    if c[0] < c[1] and c[2] < c[3]:
                        out.append((r.img_id, ty, tx, r.height, r.width, *c, a[c[0] - y0 : c[1] - y0, c[2] - x0 : c[3] - x0].ravel()))
            yield pd.DataFrame(out, columns=_COLUMNS)

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        first = f.iloc[0]
        h, w, ty, tx = int(first.height), int(first.width), int(first.ty), int(first.tx)
        b = targets(h, w, ty, tx, (ty, tx))[0][2]
        block = None
        for r in f.itertuples(index=False):
            a = _pixels(r.data, r.y0, r.y1, r.x0, r.x1)
            if block is None:
                block = np.zeros((b[1] - b[0], b[3] - b[2], *a.shape[2:]))
            block[r.y0 - b[0] : r.y1 - b[0], r.x0 - b[2] : r.x1 - b[2]] = a
        out, h, w = make(block, b, h, w, ty, tx)
        return pd.DataFrame([(first.img_id, ty, tx, h, w, out.reshape(-1))], columns=["img_id", "ty", "tx", "height", "width", "data"])

    return tiles.mapInPandas(strips, _STRIPS).groupBy("img_id", "ty", "tx").applyInPandas(whole, SCHEMA)


def run_kernel(tiles: DataFrame, name: str, tile: int = TILE, **params) -> DataFrame:
    """A kernel over all tiles, all channels at once. Its halo must not be wider than a tile."""
    kernel = KERNELS[name]
    halo = kernel.around(params)
    if halo > tile:
        raise ValueError("the halo is wider than a tile")

    def targets(h, w, ty, tx, only=None):
        around = [only] if only else [(ty + dy, tx + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        return [(y, x, _box(y, x, h, w, tile, halo)) for y, x in around if 0 <= y * tile < h and 0 <= x * tile < w]

    def make(block, b, h, w, ty, tx):
        c = _box(ty, tx, h, w, tile)
        out = kernel.run(block, **params)
        return out[c[0] - b[0] : c[1] - b[0], c[2] - b[2] : c[3] - b[2]], h, w

    return _exchange(tiles, tile, targets, make)


def run_warp(tiles: DataFrame, name: str, tile: int = TILE, **params) -> DataFrame:
    """An operator whose output pixels come from other places: each output tile is made from the box of input that it reads."""
    warp = WARPS[name]
    margin = warp.reach + warp.margin(**params)

    known: dict[tuple[int, int], dict] = {}  # by size, in each task

    def boxes(h: int, w: int) -> dict:
        if (h, w) in known:
            return known[h, w]
        if len(known) > 64:
            known.clear()
        h2, w2 = warp.size(h, w, **params)
        found = {}
        for ty in range(math.ceil(h2 / tile)):
            for tx in range(math.ceil(w2 / tile)):
                y, x = _grid(_box(ty, tx, h2, w2, tile))
                sy, sx = warp.source(y, x, h, w, **params)
                ys = [np.clip(np.floor(v) + d, 0, n - 1) for v, d, n in ((sy.min(), -margin, h), (sy.max(), margin + 1, h), (sx.min(), -margin, w), (sx.max(), margin + 1, w))]
                found[ty, tx] = int(ys[0]), int(ys[1]) + 1, int(ys[2]), int(ys[3]) + 1
        known[h, w] = found
        return found

    def targets(h, w, ty, tx, only=None):
        every = boxes(int(h), int(w))
        return [(*k, every[k]) for k in ([only] if only else every)]

    def make(block, b, h, w, ty, tx):
        h2, w2 = warp.size(h, w, **params)
        y, x = _grid(_box(ty, tx, h2, w2, tile))
        sy, sx = warp.source(y, x, h, w, **params)
        out = sample(warp.before(block, **params), sy - b[0], sx - b[2], warp.method(**params))
        return warp.after(out, y, x, h, w, **params), h2, w2

    return _exchange(tiles, tile, targets, make)


def _grid(box):
    return np.meshgrid(np.arange(box[0], box[1], dtype=float), np.arange(box[2], box[3], dtype=float), indexing="ij")


def run_whole(tiles: DataFrame, name: str, tile: int = TILE, **params) -> DataFrame:
    """Operators in which every pixel may depend on every other: one group per image, its tiles put together and cut again."""
    function = WHOLE[name]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        h, w = int(f.height.iloc[0]), int(f.width.iloc[0])
        a = np.zeros((h, w))
        for r in f.itertuples(index=False):
            y0, y1, x0, x1 = _box(r.ty, r.tx, h, w, tile)
            a[y0:y1, x0:x1] = _pixels(r.data, y0, y1, x0, x1)
        out = function(a, **params)
        rows = []
        for ty in range(math.ceil(h / tile)):
            for tx in range(math.ceil(w / tile)):
                y0, y1, x0, x1 = _box(ty, tx, h, w, tile)
                rows.append((f.img_id.iloc[0], ty, tx, h, w, out[y0:y1, x0:x1].ravel()))
        return pd.DataFrame(rows, columns=["img_id", "ty", "tx", "height", "width", "data"])

    return tiles.groupBy("img_id").applyInPandas(run, SCHEMA)


def region(tiles: DataFrame, y0: int, y1: int, x0: int, x1: int, tile: int = TILE, halo: int = 0) -> DataFrame:
    """Only the tiles that a region (with a halo) touches: a filter on the keys, so it prunes the scan."""
    return tiles.where(F.col("ty").between(max(0, y0 - halo) // tile, (y1 - 1 + halo) // tile) & F.col("tx").between(max(0, x0 - halo) // tile, (x1 - 1 + halo) // tile))


# --- geometry on pixel rows: no gathering needed


def crop(pixels: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    return pixels.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)).withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)


def flip(pixels: DataFrame, height: int, width: int, vertical: bool = False, horizontal: bool = False, transpose: bool = False) -> DataFrame:
    y = F.lit(height - 1) - F.col("y") if vertical else F.col("y")
    x = F.lit(width - 1) - F.col("x") if horizontal else F.col("x")
    y, x = (x, y) if transpose else (y, x)
    return pixels.withColumn("_y", y).withColumn("_x", x).drop("y", "x").withColumnsRenamed({"_y": "y", "_x": "x"})


def borders(pixels: DataFrame, height: int, width: int, size: int, color: float = 1.0, channels=("c0",)) -> DataFrame:
    """The image moved in by ``size``, and frame pixels of one colour for every image."""
    moved = pixels.withColumn("y", F.col("y") + size).withColumn("x", F.col("x") + size)
    frame = pixels.select("img_id").distinct().select("img_id", F.explode(F.sequence(F.lit(0), F.lit(height + 2 * size - 1))).alias("y")).select("img_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width + 2 * size - 1))).alias("x"))
    frame = frame.where(~(F.col("y").between(size, size + height - 1) & F.col("x").between(size, size + width - 1)))
    return moved.select("img_id", "y", "x", *channels).unionByName(frame.select("img_id", "y", "x", *(F.lit(color).cast("double").alias(c) for c in channels)))


def composite(below: DataFrame, above: DataFrame, opacity: float = 1.0, channels=("c0",)) -> DataFrame:
    """Another image (img_id, y, x, channels, alpha) over this one, place by place.

    Pixels that are made from few rows look small to the planner, so the join must be told not to broadcast them.
    """
    a = above.select("img_id", "y", "x", *(F.col(c).alias(f"_{c}") for c in channels), (F.col("alpha") * opacity).alias("_alpha"))
    alpha = F.coalesce(F.col("_alpha"), F.lit(0.0))
    return below.join(a.hint("merge"), ["img_id", "y", "x"], "left").select("img_id", "y", "x", *(F.when(alpha > 0, F.col(c) * (1 - alpha) + F.col(f"_{c}") * alpha).otherwise(F.col(c)).alias(c) for c in channels))
