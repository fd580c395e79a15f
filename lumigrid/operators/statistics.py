"""Whole-image statistics: histograms, picker boxes, percentiles, block averages, palettes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(pixels: DataFrame, channels: list[str], bins: int = 256, keys: list[str] | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(keys, channel, bin, n): bin = trunc((bins - 1) v), clamped, with v from 0 to 1 over the channel's range. One pass: pixels are unpivoted inside the partial aggregate."""
    keys, ranges = keys or [], ranges or {}
    scaled = {c: (F.col(c) - ranges[c][0]) / (ranges[c][1] - ranges[c][0]) if c in ranges else F.col(c) for c in channels}
    value = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), scaled[c].alias("v")) for c in channels))).alias("s")
    rows = pixels.select(*keys, value).select(*keys, "s.channel", F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.col("s.v") * (bins - 1)).cast("int"))).alias("bin"))
    return rows.groupBy(*keys, "channel", "bin").agg(F.count(F.lit(1)).alias("n"))


#: Ranges of the channels in spaces other than RGB.
LAB_RANGES = {"c0": (0.0, 100.0), "c1": (-128.0, 128.0), "c2": (-128.0, 128.0)}
LCH_RANGES = {"c0": (0.0, 100.0), "c1": (0.0, 128.0 * 2**0.5), "c2": (0.0, 1.0)}


def picker(pixels: DataFrame, channels: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """(channel, mean, low, high, n) inside x0, y0, x1, y1 (the far edges excluded)."""
    x0, y0, x1, y1 = box
    inside = pixels.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    row = inside.agg(*(f(c).alias(f"{n}_{c}") for c in channels for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max), ("n", F.count))))
    parts = [row.select(F.lit(c).alias("channel"), *(F.col(f"{n}_{c}").alias(n) for n in ("mean", "low", "high", "n"))) for c in channels]
    return reduce(DataFrame.unionAll, parts)


def deflicker_ev(pixels: DataFrame, channel: str = "c0", percentile: float = 50.0, target_ev: float = -4.0, keys: list[str] | None = None, levels: int = 16_384) -> DataFrame:
    """(keys, ev): the stops that bring a percentile of each image's values (in [0, 1], counted in ``levels``) to a level below white."""
    from pyspark.sql import Window

    keys = keys or []
    level = F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor(F.col(channel) * levels).cast("int")))
    counts = pixels.groupBy(*keys, level.alias("_level")).agg(F.count(F.lit(1)).alias("_n"))  # at most ``levels`` rows an image
    over = Window.partitionBy(*keys)
    so_far = F.sum("_n").over(over.orderBy("_level").rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.select(*keys, "_level", so_far.alias("_below"), F.sum("_n").over(over).alias("_all")).where(F.col("_below") >= F.col("_all") * percentile / 100)
    first = F.min("_level")
    agg = (F.lit(target_ev) + F.log2(F.lit(float(levels))) - F.log2(F.greatest(first, F.lit(1)))).alias("ev")
    return reached.groupBy(*keys).agg(agg) if keys else reached.agg(agg)


def block_average(pixels: DataFrame, factor: int, channels: list[str], keys: list[str] | None = None) -> DataFrame:
    """Downscaling by whole blocks."""
    keys = keys or []
    return pixels.groupBy(*keys, F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y")).agg(*(F.avg(c).alias(c) for c in channels))


def merge_exposures(shots: DataFrame, channel: str = "c0", saturation: float = 0.98) -> DataFrame:
    """One value per place from bracketed shots (x, y, exposure, c0): a mean of radiances, weighted by how far a value is from black and white."""
    v = F.col(channel)
    weight = F.when(v >= saturation, F.lit(1e-6)).otherwise(F.greatest(F.lit(1e-6), 1 - F.pow(2 * v - 1, 4)))
    return shots.withColumn("_w", weight).groupBy("x", "y").agg((F.sum(F.col("_w") * v / F.col("exposure")) / F.sum("_w")).alias(channel))


def palette(pixels: DataFrame, channels: list[str], k: int = 3, seed: int = 1):
    """Cluster centres of colours, distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=channels, outputCol="_v").transform(pixels)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).clusterCenters()


def interpolate_profiles(images: DataFrame, profiles: DataFrame, values: list[str]) -> DataFrame:
    """Noise profiles by ISO: between the two around an image's, on a line; beyond the ends, the end."""
    from pyspark.sql import Window

    p = profiles.select(F.col("iso").alias("_iso"), F.struct("iso", *values).alias("_p"), F.lit(None).cast("long").alias("id"), F.lit(0).alias("_k"))
    q = images.select(F.col("iso").alias("_iso"), F.lit(None).cast(dict(p.dtypes)["_p"]).alias("_p"), "id", F.lit(1).alias("_k"))
    # ISO values are few, so images meet profiles through their distinct values
    isos = q.select("_iso", "_p", F.lit(None).cast("long").alias("id"), "_k").distinct()
    w = Window.orderBy("_iso", "_k")
    a = F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first("_p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = p.unionByName(isos).withColumn("a", F.coalesce(a, b)).withColumn("b", F.coalesce(b, a)).where("_k = 1")
    t = F.when(F.col("a.iso") == F.col("b.iso"), 0.0).otherwise((F.col("_iso") - F.col("a.iso")) / (F.col("b.iso") - F.col("a.iso")))
    out = both.select(F.col("_iso").alias("iso"), *((F.col(f"a.{v}") * (1 - t) + F.col(f"b.{v}") * t).alias(v) for v in values))
    return images.join(out, "iso", "left")
