"""Connected components as a dataflow: alternating star contractions over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A key with more rows than HUB_ROWS, and than one in HUBS of all rows, is a hub; there are fewer than HUBS of them.
HUB_ROWS, HUBS = 1_000, 10_000


def hub_join(rows: DataFrame, one: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``one``, which has a row for every key and in ``count`` how many of the ``total`` rows hold it.

    Rows of hubs stay where they are and meet their hub's row by broadcast (of HUBS rows at most); the others shuffle.
    """
    bound = max(HUB_ROWS, total // HUBS)
    more = [c for c in one.columns if c != key]
    tagged = rows.join(F.broadcast(one.filter(F.col(count) > bound).withColumn("lg_hub", F.lit(True))), key, "left")
    rest = tagged.filter("lg_hub is null").drop("lg_hub", *more).join(one.filter(F.col(count) <= bound), key)
    return tagged.filter("lg_hub").drop("lg_hub").unionByName(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node sends its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("lg_n")).select("u", F.least("u", "m").alias("m"), "lg_n")
    return hub_join(both.filter("v > u"), least, "u", "lg_n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node sends its smaller neighbours, and itself, to the smallest of them. Edges point from large to small."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("lg_n"))
    moved = hub_join(edges, least, "u", "lg_n", total).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node with a link (a, b); comp is the component's smallest node.

    It ends when every node points straight at a node that points nowhere, which takes a number
    of rounds that grows with the logarithm of the longest path. Null ends of links are not nodes;
    links of a node with itself and repeated links change nothing.
    """
    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while total := 2 * edges.count():
        edges = materialize(_small_star(materialize(_large_star(edges, total), "stars"), total), "stars")
        tops = edges.select(F.col("v").alias("u")).distinct()
        crossed = edges.groupBy("u").count().filter("count > 1").limit(1).count()
        if not crossed and not edges.join(tops, "u", "left_semi").limit(1).count():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
