"""A global row number that scales: no single task ever sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import materialize


def global_rank(df: DataFrame, order: list[Column], name: str = "rowid") -> DataFrame:
    """Rows with their place from 1 in a total order.

    The range sort is one exchange; each part numbers its own rows, and the parts' counts (one row
    per part) give what comes before. Parts are written before they are counted: computed anew, a
    range sort samples other bounds, and counts would be of other parts.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    rows = materialize(sorted_.withColumn("_local", local), "ranked")
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")  # a row per partition
