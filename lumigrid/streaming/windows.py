"""Windows over event streams: the same functions serve tables and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """Streams need timestamps with a zone, and a watermark to bound their state."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str, late: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums per window; on a stream ``late`` bounds the state by a watermark."""
    return _timed(events, late).groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    return _timed(events, late).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Runs of a user's events with gaps up to ``gap_seconds``."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.expr("timestampdiff(MICROSECOND, _before, ts)") > gap_seconds * 1_000_000
    rows = events.withColumn("_before", F.lag("ts").over(w)).withColumn("_fresh", F.when(F.col("_before").isNull() | gap, 1).otherwise(0))
    rows = rows.withColumn("_session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "_session").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count(F.lit(1)).alias("n")).drop("_session")


def stream_of(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", most_files: int = 64) -> DataFrame:
    """Files that appear in a folder, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most_files).parquet(folder)


def watch_folder(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("nef", "cr2", "jpg", "png", "pfm", "ppm")) -> DataFrame:
    """New image files as rows (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update"):
    """Process what is there in micro-batches, exactly once per batch number, and stop."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


class Events:
    """Named events with listeners, called in order of registration. NAMES are those that the engine fires; scripts may add their own."""

    NAMES = ("selection-changed", "collection-changed", "pipe-complete")

    def __init__(self):
        self.listeners: dict[str, dict[str, Callable]] = {n: {} for n in self.NAMES}

    def register(self, name: str, key: str, listener: Callable) -> None:
        self.listeners.setdefault(name, {})[key] = listener

    def query(self, name: str, key: str) -> bool:
        return key in self.listeners.get(name, {})

    def destroy(self, name: str, key: str) -> None:
        self.listeners.get(name, {}).pop(key, None)

    def fire(self, name: str, *args) -> list:
        return [f(name, *args) for f in list(self.listeners.get(name, {}).values())]
