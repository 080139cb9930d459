"""Per-key results where a handful of keys hold most of the rows.

Exact selection over mergeable histograms. Rows collapse to counts of (key, value) before any shuffle; that table is
spread by key *and* value, so a hot key is spread too. A key of few different values is ranked as it is. For the others
a histogram of the widest bins is made and refined: a rank picks one bin by cumulative counts, only the children of the
picked bins are counted next, until bins hold single values. A bin has at most 4096 children, so no task and no driver
ever sees the values of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import Scratch

BITS = 12
#: a key of more different values than a bin has children is refined
FEW = 1 << BITS


def _levels(lo: int | None, hi: int | None) -> int:
    """Levels above the single values until the whole range is no more bins than a bin has children."""
    if lo is None or hi is None:
        return 0
    n = 0
    while (hi >> (BITS * n)) - (lo >> (BITS * n)) >= 1 << BITS:
        n += 1
    return n


def key_quantiles(df: DataFrame, key: str, value: str, permille: list[int], min_share: float = 0.0) -> DataFrame:
    """One row a key: ``key``, ``n_rows`` (as stored), ``n_values`` (not null) and ``q<permille>`` for each wanted
    quantile, the smallest value whose rank reaches ``ceil(n_values * permille / 1000)`` (the discrete rule).

    Of the result, keys below ``min_share`` of all rows are left out. Null keys give no row but count as rows; a key with
    null values only has null quantiles; an empty table gives no row. Repeated rows count as often as they are stored.
    ``value`` is cast to BIGINT. Other columns are never read, so their names may clash with anything.
    """
    scratch = Scratch(df.sparkSession)
    bins = df.select(F.col(key).alias("key"), F.col(value).cast("bigint").alias("bin")).groupBy("key", "bin").agg(F.count(F.lit(1)).alias("c"))
    counts = scratch.write(bins)  # read once for each level, so written once
    valued = F.col("bin").isNotNull()
    root = scratch.write(counts.groupBy("key").agg(
        F.sum("c").alias("n_rows"), F.sum(F.when(valued, F.col("c")).otherwise(0)).alias("n_values"), F.count("bin").alias("n_bins"), F.min("bin").alias("lo"), F.max("bin").alias("hi")))
    many = F.col("key").isNotNull() & (F.col("n_bins") > FEW)
    total, n_hot, lo, hi = root.agg(F.sum("n_rows"), F.count_if(many), F.min(F.when(many, F.col("lo"))), F.max(F.when(many, F.col("hi")))).first()
    kept = root.filter(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(min_share * (total or 0)))).select("key", "n_rows", "n_values")
    if not permille:
        return kept
    counts, hot = counts.filter(F.col("key").isNotNull() & valued), root.filter(many)
    if not n_hot:
        return kept.join(_few(counts, permille), "key", "left")
    refined = _refined(counts.join(hot.select("key"), "key", "left_semi"), hot, permille, _levels(lo, hi), scratch)
    values = refined.groupBy("key").agg(*[F.max(F.when(F.col("p") == p, F.col("parent"))).alias(f"q{p}") for p in permille])
    return kept.join(_few(counts.join(hot.select("key"), "key", "left_anti"), permille).unionByName(values), "key", "left")


def _rank(n, p: int):
    """Rank sought, from 1, of ``n`` values."""
    return F.greatest(F.ceil(n * p / F.lit(1000)).cast("bigint"), F.lit(1))


def _few(counts: DataFrame, permille: list[int]) -> DataFrame:
    """Quantiles of keys of at most ``FEW`` different values: such a key is one sort of no more rows than that."""
    whole = Window.partitionBy("key")
    ranked = counts.withColumn("n", F.sum("c").over(whole)).withColumn("upto", F.sum("c").over(whole.orderBy("bin")))
    return ranked.groupBy("key").agg(*[F.min(F.when(F.col("upto") >= _rank(F.col("n"), p), F.col("bin"))).alias(f"q{p}") for p in permille])


def _refined(counts: DataFrame, hot: DataFrame, permille: list[int], height: int, scratch: Scratch) -> DataFrame:
    """(key, p, parent): the value of each rank sought, resolved from the widest bins down."""
    ranks = F.array(*[F.struct(F.lit(p).alias("p"), (_rank(F.col("n_values"), p) - 1).alias("rank")) for p in permille])
    state = hot.select("key", F.explode(ranks).alias("r")).select("key", "r.p", "r.rank", F.lit(None).cast("bigint").alias("parent"))
    for level in range(height, -1, -1):
        bins = counts.select("key", F.shiftright("bin", BITS * level).alias("bin"), "c")
        if level < height:  # children of picked bins only, before anything is shuffled
            path = state.select("key", "parent").distinct()
            bins = bins.withColumn("parent", F.shiftright("bin", BITS)).join(path, ["key", "parent"], "left_semi")
        bins = bins.groupBy("key", "bin").agg(F.sum("c").alias("c")).withColumn("above", F.shiftright("bin", BITS))
        on = (F.col("s.key") == F.col("b.key")) & (F.lit(True) if level == height else F.col("s.parent") == F.col("b.above"))
        w = Window.partitionBy("key", "p").orderBy("bin")  # at most 4096 bins
        seen = state.alias("s").join(bins.alias("b"), on).select("s.key", "p", "rank", "bin", "c").withColumn("upto", F.sum("c").over(w))
        state = scratch.write(seen.filter("upto > rank and upto - c <= rank").select(
            "key", "p", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), F.col("bin").alias("parent")))
    return state
