"""Density clustering on a grid, for points on a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialize


def grid_dbscan(points: DataFrame, eps: float, least: int = 2, x: str = "longitude", y: str = "latitude", share: float = 0.66) -> DataFrame:
    """points with ``cluster`` (null: noise).

    Points fall into cells of ``share`` x eps. A cell is core if it holds ``least`` - 1 points or more,
    or it and its eight neighbours hold ``least`` or more. Core cells that touch share a cluster
    (named by its smallest cell); other cells next to a core join it. What travels between rounds is
    cells, not points.
    """
    size = eps * share
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_cx", cell(x)).withColumn("_cy", cell(y))
    counts = rows.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("n"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("d")
    spread = lambda df, *keep: df.select((F.col("_cx") + F.col("d.dx")).alias("_cx"), (F.col("_cy") + F.col("d.dy")).alias("_cy"), *keep)
    sums = spread(counts.select("*", around), "n").groupBy("_cx", "_cy").agg(F.sum("n").alias("near"))
    core = counts.join(sums, ["_cx", "_cy"]).where((F.col("n") >= least - 1) | (F.col("near") >= least)).select("_cx", "_cy")
    key = F.struct("_cx", "_cy")
    labels = materialize(core.withColumn("label", key), "cells")
    while True:  # a label only ever falls, so it ends
        pushed = spread(labels.select("*", around), "label").groupBy("_cx", "_cy").agg(F.min("label").alias("best"))
        step = labels.join(pushed, ["_cx", "_cy"]).select("_cx", "_cy", F.least("label", "best").alias("label"), (F.col("best") < F.col("label")).alias("moved"))
        # jump: a label's own cell may know a smaller one
        ahead = step.select(F.col("_cx").alias("lx"), F.col("_cy").alias("ly"), F.col("label").alias("far"))
        step = step.join(ahead, (F.col("label._cx") == F.col("lx")) & (F.col("label._cy") == F.col("ly"))).select("_cx", "_cy", F.least("label", "far").alias("label"), "moved")
        step = materialize(step, "cells")
        moved = step.where("moved").limit(1).count()
        labels = step.drop("moved")
        if not moved:
            break
    reach = spread(labels.select("_cx", "_cy", "label", around), "label").groupBy("_cx", "_cy").agg(F.min("label").alias("label"))
    own = labels.withColumnRenamed("label", "own")
    return rows.join(reach, ["_cx", "_cy"], "left").join(own, ["_cx", "_cy"], "left").withColumn("cluster", F.concat_ws(":", F.coalesce("own", "label")["_cx"], F.coalesce("own", "label")["_cy"])).withColumn("cluster", F.when(F.col("cluster") != "", F.col("cluster"))).drop("_cx", "_cy", "own", "label")
