"""Queries for documents and pipelines: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.pipeline import Pipeline
from ..sources import sidecars
from .raster_queries import H, TILE, W, images


def source_history_json(spark, folder):
    """History documents written from orders and parsed again."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    module = F.struct((F.col("o_orderkey") % 2 == 0).alias("enabled"), F.lit(6).alias("version"), F.create_map(F.lit("exposure"), (F.col("o_orderkey") % 7).cast("double")).alias("params"))
    docs = orders.select("o_orderkey", sidecars.write_history(F.create_map(F.lit("exposure"), module)).alias("d"))
    return sidecars.history_entries(docs, "o_orderkey", "d").select("o_orderkey", "operation", "enabled", F.col("params")["exposure"].alias("ev"))


def source_gpx(spark, folder):
    """Tracks written as GPX, one per user, and parsed again."""
    e = spark.read.parquet(f"{folder}/events.parquet").select("user_id", F.date_trunc("second", "ts").alias("t"), (F.col("event_id") % 90).alias("lat"))
    point = F.concat(F.lit('<trkpt lat="'), F.col("lat"), F.lit('" lon="1.5"><time>'), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time></trkpt>"))
    files = e.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.concat(F.lit("<gpx>"), F.array_join(F.collect_list(point), ""), F.lit("</gpx>")).cast("binary").alias("content"))
    return sidecars.gpx_points(files).select("path", "t", "lat", "lon")


def pipeline_render(spark, folder):
    """An edit over all images: exposure, sharpening on tiles, velvia, a region at full size."""
    pipe = Pipeline.create(defaults=("exposure", "sharpen", "velvia")).set_param("exposure", "exposure", 0.5)
    px = images(spark, folder).withColumn("c1", F.col("c0") * 0.5).withColumn("c2", 1 - F.col("c0"))
    return pipe.render(px, H, W, region=(8, 4, 20, 16), tile=TILE).select("img_id", "y", "x", *(F.round(c, 6).alias(c) for c in ("c0", "c1", "c2")))


QUERIES = {f.__name__: f for f in (source_history_json, source_gpx, pipeline_render)}
ORACLE_SQL = {
    "source_history_json": "SELECT o_orderkey, 'exposure' AS operation, o_orderkey % 2 = 0 AS enabled, CAST(o_orderkey % 7 AS DOUBLE) AS ev FROM orders",
    "source_gpx": "SELECT CAST(user_id AS STRING) AS path, epoch_us(date_trunc('second', ts)) AS t, CAST(event_id % 90 AS DOUBLE) AS lat, CAST(1.5 AS DOUBLE) AS lon FROM events",
}
