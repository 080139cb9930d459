"""The N highest-scoring items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

try:  # the bounded-heap aggregate is not part of the public API
    from pyspark.sql.internal import InternalFunction

    HEAP = hasattr(InternalFunction, "collect_top_k")
except ImportError:
    HEAP = False


def top_n(df: DataFrame, groups: list[str], score: str, ident: str, n: int) -> DataFrame:
    """``groups``, ``ident``, ``score`` and ``rank`` (1 is best) of the ``n`` best rows of each group, by ``score``
    descending and then ``ident`` descending, so the result never depends on the order of the rows.

    Rows with a null in any of these columns are left out. Rows that repeat the same (group, score, ident) fill several
    places, as ``ident`` is meant to be unique: remove repeats first (``first_deliveries``). Smaller groups come whole;
    an empty table gives no rows; other columns are not read.

    The aggregate keeps a heap of ``n`` items a group, filled before the shuffle and merged after it: of a group with a
    large part of the log each task sends ``n`` items. Where Spark lacks that aggregate, a ranking window does it, which
    Spark limits to ``n`` rows a group before the shuffle too.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(*groups, F.struct(F.col(score).alias("score"), F.col(ident).alias("ident")).alias("item"))
    for g in groups:
        rows = rows.filter(F.col(g).isNotNull())
    rows = rows.filter(F.col("item.score").isNotNull() & F.col("item.ident").isNotNull())
    if not HEAP:
        best = Window.partitionBy(*groups).orderBy(F.desc("item"))
        ranked = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
        return ranked.select(*groups, F.col("item.ident").alias(ident), F.col("item.score").alias(score), "rank")
    kept = rows.groupBy(*groups).agg(InternalFunction.collect_top_k(F.col("item"), n, False).alias("items"))
    return kept.select(*groups, F.posexplode("items").alias("pos", "item")).select(
        *groups, F.col("item.ident").alias(ident), F.col("item.score").alias(score), (F.col("pos") + 1).alias("rank"))


def first_deliveries(df: DataFrame, ident: str, order: str, keep: list[str]) -> DataFrame:
    """One row an ``ident``: its row with the lowest ``order``. A null ``ident`` names no item and is left out."""
    row = F.struct(F.col(order).alias(order), *[F.col(c).alias(c) for c in keep])
    first = df.filter(F.col(ident).isNotNull()).groupBy(ident).agg(F.min(row).alias("r"))
    return first.select(ident, f"r.{order}", *[f"r.{c}" for c in keep])
