"""Row numbers where a group, or the whole table, is too large for one task to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import Scratch


def group_rank(df: DataFrame, group: list[str], bucket: Column, order: list, name: str = "pos") -> DataFrame:
    """``name``: 1, 2, ... within ``group`` in ``order``. ``bucket`` must not decrease along the order; it cuts a large
    group into parts that are sorted apart, and counts of the parts give where each begins."""
    cut = df.withColumn("_b", bucket)
    before = cut.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select(*group, "_b", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order))
    return cut.withColumn("_i", inside).join(before, [*group, "_b"]).withColumn(name, F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")


def global_rank(df: DataFrame, order: list, name: str = "idx", scratch: Scratch | None = None) -> DataFrame:
    """``name``: 1, 2, ... over the whole table in ``order``. The table is cut into ranges of even size, written once so
    that the cuts stay as they are, and numbered range by range; only a row a range meets in one place."""
    scratch = scratch or Scratch(df.sparkSession)
    parts = scratch.write(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()))
    sizes = parts.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return parts.withColumn("_i", inside).join(before, "_b").withColumn(name, F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")
