"""Near-duplicate texts: MinHash banding, shuffle on band hashes, exact verification on the full token sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.components import connected_components
from quern.session import Scratch

WORD = r"([\p{L}\p{N}]+)"
SKETCH_BITS = 128
#: a pair may fall so many standard deviations short in the sketch; one at the threshold does so by chance in this share
DEVIATIONS, SKETCH_LOSS = 3.2, 0.0007
#: band rows a task joins, on average
ROWS_A_TASK = 500_000


def words(text: Column) -> Column:
    """The maximal runs of letters and digits of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def _let(value: Column, body) -> Column:
    """``body`` of a value computed once a row (inside a lambda a plain expression is computed at every element)."""
    return F.transform(F.array(value), body)[0]


def word_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(words(text)))


def shingle_set(text: Column, k: int = 5) -> Column:
    """Sorted distinct 64-bit hashes of the runs of ``k`` words; a shorter text is one shingle of all its words."""
    def body(h: Column) -> Column:
        run = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])  # noqa: E731  (beyond the end: null, which adds nothing)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), run)
        return F.when(F.size(h) > 0, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<bigint>"))

    # words are hashed once, then runs of their hashes
    return _let(F.transform(words(text), lambda w: F.xxhash64(w)), body)


def choose_bands(threshold: float, recall: float, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the most selective bands, at most ``most``, of which a pair at the threshold itself shares one
    with probability ``recall``; pairs above the threshold are found with a higher one."""
    for rows in range(40, 0, -1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def _sketch_floor(threshold: float) -> int:
    """Equal bits of two one-bit sketches below which a pair is less similar than the threshold, but for the share
    ``SKETCH_LOSS`` of pairs right at it."""
    p = (1 + threshold) / 2
    return math.floor(SKETCH_BITS * p - DEVIATIONS * math.sqrt(SKETCH_BITS * p * (1 - p)))


def _signer(bands: int, rows: int, least: int = 1, seed: int = 20240229):
    rng = np.random.default_rng(seed)
    n = max(bands * rows, SKETCH_BITS)
    a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, n, dtype=np.uint64)

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def sign(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = mix(flat.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        keys = np.empty((len(starts), bands), np.uint64)
        sketch, acc = np.zeros((SKETCH_BITS // 64, len(starts)), np.uint64), None
        for i in range(n):
            low = np.minimum.reduceat((x * a[i] + b[i]) >> np.uint64(32), starts)
            if i < SKETCH_BITS:
                sketch[i // 64] |= (mix(low + a[i]) & np.uint64(1)) << np.uint64(i % 64)
            if i < bands * rows:
                acc = low + np.uint64(i // rows) if i % rows == 0 else mix(acc ^ (low * a[i % rows]))
                if i % rows == rows - 1:
                    keys[:, i // rows] = mix(acc + np.uint64(i))
        return keys.view(np.int64), sketch.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):  # small enough for the processor's cache
                    part = batch.slice(at, 1000)
                    part = part.filter(pa.compute.greater_equal(pa.compute.fill_null(pa.compute.list_value_length(part.column("tokens")), 0), max(1, least)))
                    if not part.num_rows:
                        continue
                    lists = part.column("tokens")
                    sizes = np.diff(lists.offsets.to_numpy())
                    flat = lists.flatten().to_numpy(zero_copy_only=False)
                    keys, sketch = sign(flat, np.r_[0, np.cumsum(sizes)[:-1]])
                    kept = [n for n in part.schema.names if n != "tokens"]
                    yield pa.RecordBatch.from_arrays([
                        *[part.column(n) for n in kept], pa.array(sketch[0]), pa.array(sketch[1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))], [*kept, "s1", "s2", "keys"])

    return run


class NearDuplicates:
    """Texts whose token sets have a Jaccard similarity of at least ``threshold``.

    ``docs`` has an ``id``; ``tokens`` is an expression over its columns, a sorted array of distinct strings or 64-bit
    hashes. Null ids, null arrays and those of fewer than ``least`` tokens have no partners and are left out. Other
    columns are not read. Rows with one id and equal tokens count once. Documents with
    equal token sets form one class, whatever their number; only classes are signed, banded and compared, so copies
    cost nothing beyond the first shuffle. A band shared by many classes is joined by a sort-merge join that AQE can
    split, not gathered. Every candidate pair is verified on the full token sets; no cap is set anywhere. Precision is
    exact. ``recall`` is that of banding and sketch together for a pair exactly at the threshold, and higher above it;
    ``sketch=False`` verifies every pair that shares a band instead.
    """

    def __init__(self, docs: DataFrame, tokens: Column, threshold: float, recall: float = 0.95, least: int = 1, keep_sets: bool = True, scratch: Scratch | None = None,
                 most: int = 64, sketch: bool = True):
        """``most``: bands at most; more of them have more rows each, so that fewer unlike texts meet. ``keep_sets``: write the token sets of all documents once (short texts), or write the signatures only and
        make the sets of candidates again from ``docs`` (long texts, whose sets are larger than signatures)."""
        self.scratch = scratch or Scratch(docs.sparkSession)
        self.threshold, self.least, self.keep_sets, self.tokens = threshold, least, keep_sets, tokens
        self.bands, self.rows = choose_bands(threshold, recall / (1 - SKETCH_LOSS) if sketch else recall, most)
        self.sketch = sketch
        self.raw = docs.filter(F.col("id").isNotNull())
        if keep_sets:
            # sizes are asked of the written sets: asked before, Spark would make each set twice, to test and to keep it
            self.docs = self.scratch.write(self._identified(self.raw)).filter(F.size("tokens") >= least)
            self.classes = self.scratch.write(self.docs.groupBy("cid", "cid2").agg(F.first("tokens").alias("tokens")))
            self.signed = self._sign(self.classes.select("cid", "tokens"))
        else:
            self.docs = self.scratch.write(self._sign(self._identified(self.raw)))
            self.signed = self.docs.groupBy("cid", "cid2").agg(F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("keys").alias("keys"))
        self.members = self.docs.select("id", "cid", "cid2").distinct()

    def _identified(self, docs: DataFrame) -> DataFrame:
        return docs.select("id", self.tokens.alias("tokens")).select("id", F.xxhash64("tokens").alias("cid"), F.xxhash64(F.lit(7), "tokens").alias("cid2"), "tokens")

    def _sign(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c != "tokens"]
        schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept) + ", s1 bigint, s2 bigint, keys array<bigint>"
        return df.select(*kept, F.transform("tokens", lambda t: F.hash(t)).alias("tokens")).mapInArrow(_signer(self.bands, self.rows, self.least), schema)

    def candidates(self) -> DataFrame:
        """Distinct (a, b), a < b, of class ids that share a band and whose sketches do not rule them out; written. The tasks
        of the join grow in number with its rows."""
        spark = self.signed.sparkSession
        keyed = self.signed.select("cid", "s1", "s2", F.explode("keys").alias("key"))
        a, b = keyed.alias("a"), keyed.alias("b")
        meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.cid") < F.col("b.cid"))
        if self.sketch:
            apart = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))
            meet &= apart <= SKETCH_BITS - _sketch_floor(self.threshold)
        pairs = a.join(b.hint("merge"), meet).select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b")).distinct()
        before = spark.conf.get("spark.sql.shuffle.partitions")
        rows = (self.classes if self.keep_sets else self.docs).count() * self.bands
        spark.conf.set("spark.sql.shuffle.partitions", str(max(int(before), -(-rows // ROWS_A_TASK))))
        try:
            return self.scratch.write(pairs)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    def _sets(self, candidates: DataFrame) -> DataFrame:
        """(cid, cid2, tokens) of the classes of the candidates: of each the document with the smallest id."""
        need = candidates.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        first = self.members.join(need, "cid", "left_semi").groupBy("cid", "cid2").agg(F.min("id").alias("id")).select("id").distinct()
        again = self._identified(self.raw.join(first, "id", "left_semi"))
        return self.scratch.write(again.groupBy("cid", "cid2").agg(F.first("tokens").alias("tokens")))

    def class_pairs(self) -> DataFrame:
        """Verified (a, a2, b, b2, common, total): pairs of classes at or above the threshold."""
        candidates = self.candidates()
        sets = self.classes if self.keep_sets else self._sets(candidates)
        side = lambda x: sets.select(F.col("cid").alias(x), F.col("cid2").alias(f"{x}2"), F.col("tokens").alias(f"t{x}"))
        # sizes alone rule out many candidates before the second set is fetched
        first = candidates.join(side("a"), "a")
        both = first.join(side("b"), "b")
        share = F.lit(self.threshold)
        both = both.filter(F.least(F.size("ta"), F.size("tb")) >= share * F.greatest(F.size("ta"), F.size("tb")) - F.lit(1e-9))
        checked = both.withColumn("common", F.size(F.array_intersect("ta", "tb"))).withColumn("total", F.size("ta") + F.size("tb") - F.col("common"))
        return checked.filter(F.col("common") >= share * F.col("total") - F.lit(1e-9)).select("a", "a2", "b", "b2", "common", "total")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: every pair of documents, copies written out."""
        m = self.members
        ma = m.select(F.col("id").alias("x"), F.col("cid").alias("a"), F.col("cid2").alias("a2"))
        mb = m.select(F.col("id").alias("y"), F.col("cid").alias("b"), F.col("cid2").alias("b2"))
        across = self.class_pairs().join(ma, ["a", "a2"]).join(mb, ["b", "b2"]).select("x", "y")
        within = ma.join(mb, (F.col("a") == F.col("b")) & (F.col("a2") == F.col("b2")) & (F.col("x") < F.col("y"))).select("x", "y")
        return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """One row a document that has a partner: ``id``, ``class_id``, ``group_id`` (the smallest class id linked with
        it, over any number of steps) and ``links``, the number of other documents at or above the threshold."""
        pairs = self.scratch.write(self.class_pairs())
        size = self.members.groupBy("cid", "cid2").agg(F.count(F.lit(1)).alias("n"))
        parts = connected_components(pairs.select("a", "b"), self.scratch)
        ends = pairs.select(F.col("a").alias("cid"), F.col("a2").alias("cid2"), F.col("b").alias("o"), F.col("b2").alias("o2")).unionByName(
            pairs.select(F.col("b").alias("cid"), F.col("b2").alias("cid2"), F.col("a").alias("o"), F.col("a2").alias("o2")))
        others = size.select(F.col("cid").alias("o"), F.col("cid2").alias("o2"), F.col("n").alias("on"))
        linked = ends.join(others, ["o", "o2"]).groupBy("cid", "cid2").agg(F.sum("on").alias("across"))
        per_class = size.join(linked, ["cid", "cid2"], "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left").select(
            "cid", "cid2", F.coalesce("component", "cid").alias("group_id"), (F.col("n") - 1 + F.coalesce("across", F.lit(0))).alias("links")).filter("links > 0")
        return self.members.join(per_class, ["cid", "cid2"]).select("id", F.col("cid").alias("class_id"), "group_id", "links")
