"""What changed between full snapshots of a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_A_BUCKET = 200_000


def _differences(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys added, removed and changed from a to b, each (sorted keys, hash, hash)."""
    def where(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(y, x)
        inside = at < len(y)
        inside[inside] = y[at[inside]] == x[inside]
        return at, inside

    at, inside = where(b[0], a[0])
    _, kept = where(a[0], b[0])
    own, other = np.flatnonzero(inside), at[inside]
    differs = (b[1][own] != a[1][other]) | (b[2][own] != a[2][other])
    return b[0][~inside], a[0][~kept], b[0][own[differs]]


def _newest(version: str, payload: Column) -> list[Column]:
    """What orders the rows of a key in a snapshot: the version, null lowest, then two hashes of the record. The largest
    counts, in the changes and in their details alike."""
    return [
        F.col(version).isNotNull().alias("has"), F.coalesce(F.col(version).cast("bigint"), F.lit(0)).alias("v"),
        F.xxhash64(payload, F.lit(1)).alias("h1"), F.xxhash64(F.lit("salt"), payload).alias("h2"),
    ]


def snapshot_changes(df: DataFrame, snapshot: str, key: str, version: str, content: list) -> DataFrame:
    """``(snapshot_no INT, key BIGINT, change STRING)``: what each snapshot added, removed or changed against the one
    before it.

    ``content`` are the expressions whose values make up a record; null is a value of its own. Of several rows of a key
    in a snapshot the one with the largest ``version`` counts, null lowest (equal versions: the larger row hash, so the
    choice never depends on order). Null keys and null snapshots are left out. A snapshot number with no rows at all is
    no snapshot: the next is compared with the last that has rows. Empty table: no rows. Repeated rows change nothing.

    Each row becomes a key and a 128-bit row hash; the newest row of a key is found by a mergeable maximum, so a key
    that is repeated without end still reaches the shuffle once a task. The compact rows are bucketed by key hash and
    every bucket, sized by the row count, is compared as sorted numpy arrays with ``searchsorted``.
    """
    payload = F.struct(*content)
    compact = df.filter(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(
        F.col(snapshot).cast("int").alias("s"), F.col(key).cast("bigint").alias("k"),
        F.struct(*_newest(version, payload)).alias("r"),
    )
    numbers = compact.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()
    order = sorted(r["s"] for r in numbers)
    buckets = max(1, -(-sum(r["n"] for r in numbers) // ROWS_A_BUCKET))
    newest = compact.groupBy("s", "k").agg(F.max("r").alias("r")).select(
        F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int").alias("bucket"), "s", "k", F.col("r.h1").alias("h1"), F.col("r.h2").alias("h2"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        s, k, h1, h2 = (pdf[c].to_numpy() for c in ("s", "k", "h1", "h2"))
        ranked = np.lexsort((k, s))
        s, k, h1, h2 = s[ranked], k[ranked], h1[ranked], h2[ranked]
        cut = {n: slice(np.searchsorted(s, n, "left"), np.searchsorted(s, n, "right")) for n in order}
        part = lambda n: (k[cut[n]], h1[cut[n]], h2[cut[n]])
        out = []
        for before, after in zip(order, order[1:]):
            for name, keys in zip(("added", "removed", "changed"), _differences(part(before), part(after))):
                out.append(pd.DataFrame({"snapshot_no": np.full(len(keys), after, "int32"), "key": keys, "change": name}))
        return pd.concat(out) if out else pd.DataFrame({"snapshot_no": pd.Series(dtype="int32"), "key": pd.Series(dtype="int64"), "change": pd.Series(dtype=str)})

    return newest.groupBy("bucket").applyInPandas(compare, "snapshot_no int, key bigint, change string")


def follows_content() -> list:
    """A Profile's record: ``kind3createdat`` (null is a value) and the set of ``follows`` (null is the empty set)."""
    uids = F.array_sort(F.array_distinct(F.filter(F.coalesce("follows", F.array().cast("array<bigint>")), lambda x: x.isNotNull())))
    # the marks keep a null from hashing like a missing field
    return [F.col("kind3createdat").isNull(), F.coalesce("kind3createdat", F.lit(0)), F.size(uids), uids]


def profile_change_details(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """Full values for the differing keys only: old and new ``kind3createdat`` and the sizes of what entered and left
    ``follows``. One row a change; sides that do not exist are null, a missing side of follows is the empty set."""
    numbers = sorted(r[0] for r in snapshots.select("snapshot_no").filter("snapshot_no is not null").distinct().collect())
    before = F.create_map(*[F.lit(x) for pair in zip(numbers[1:], numbers) for x in pair]) if len(numbers) > 1 else F.create_map(F.lit(-1), F.lit(-1))
    ask = changes.select("snapshot_no", F.col("key").alias("uid"), "change", before[F.col("snapshot_no")].alias("prior"))
    wanted = ask.select("uid", F.explode(F.array("snapshot_no", "prior")).alias("snapshot_no")).distinct()
    uids = F.array_sort(F.array_distinct(F.filter(F.coalesce("follows", F.array().cast("array<bigint>")), lambda x: x.isNotNull())))
    values = (
        snapshots.select("snapshot_no", "uid", "kind3createdat", "follows").join(wanted, ["snapshot_no", "uid"], "left_semi")
        .groupBy("snapshot_no", "uid")
        .agg(F.max(F.struct(*_newest("kind3createdat", F.struct(*follows_content())), uids.alias("f"))).alias("r"))
        .select("snapshot_no", "uid", F.when(F.col("r.has"), F.col("r.v")).alias("v"), F.col("r.f").alias("f"))
    )
    new = values.select("snapshot_no", "uid", F.col("v").alias("new_kind3"), F.col("f").alias("new_f"))
    old = values.select(F.col("snapshot_no").alias("prior"), "uid", F.col("v").alias("old_kind3"), F.col("f").alias("old_f"))
    none = F.array().cast("array<bigint>")
    n, o = F.coalesce("new_f", none), F.coalesce("old_f", none)
    return ask.join(new, ["snapshot_no", "uid"], "left").join(old, ["prior", "uid"], "left").select(
        "snapshot_no", "uid", "change", "old_kind3", "new_kind3",
        F.size(F.array_except(n, o)).cast("bigint").alias("follows_in"), F.size(F.array_except(o, n)).cast("bigint").alias("follows_out"))
