"""Membership gate: allow-list, admission, routing, rescue of held-back events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 262_144
ADMITTED_KINDS = [0, 1, 3]


def well_formed(key: Column) -> Column:
    return F.lower(key).rlike("^[0-9a-f]{64}$")


def admission(min_fields: bool = True) -> Column:
    """'keep', or the first reason against an event: missing fields, kind, size in bytes."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (F.when(empty("id") | empty("pubkey"), "missing fields").when(F.col("kind").isNull() | ~F.col("kind").isin(ADMITTED_KINDS), "kind")
            .when(F.octet_length(F.coalesce("content", F.lit(""))) > MOST_BYTES, "size").otherwise("keep"))


def members(events: DataFrame, allowed: DataFrame, accept: bool = True) -> DataFrame:
    """Events whose author is (or is not) on the list; keys compare in lower case, malformed ones never match. The list
    side is broadcast by Spark only while its measured size allows it."""
    keys = allowed.select(F.lower("pubkey").alias("_k")).filter(well_formed(F.col("_k"))).distinct()
    return events.join(keys, F.lower(events["pubkey"]) == F.col("_k"), "left_semi" if accept else "left_anti")


def bulk_check(keys: DataFrame, allowed: DataFrame, unknown: bool = True) -> DataFrame:
    """Each key with its state; blanks are skipped. ``unknown`` is what a key that cannot be looked up counts as: the
    scorer takes it as allowed, the gate and the rescue as not allowed."""
    have = allowed.select(F.lower("pubkey").alias("_k")).distinct().withColumn("_on", F.lit(True))
    k = keys.filter(F.trim("pubkey") != "")
    state = F.when(~well_formed(F.col("pubkey")), F.lit(unknown)).otherwise(F.coalesce("_on", F.lit(False)))
    return k.join(have, F.lower(k["pubkey"]) == F.col("_k"), "left").select(*[k[c] for c in k.columns], state.alias("allowed"))


def route(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """``action``, ``reason`` and whether an event is held back: malformed → reject, allowed → accept, else reject, and
    hold back what the admission heuristic keeps."""
    have = allowed.select(F.lower("pubkey").alias("_k")).distinct().withColumn("_on", F.lit(True))
    j = events.join(have, F.lower(events["pubkey"]) == F.col("_k"), "left")
    malformed = ~F.coalesce(well_formed(F.col("pubkey")), F.lit(False)) | ~F.coalesce(F.length("id") == 64, F.lit(False))
    why = admission()
    on = F.coalesce("_on", F.lit(False))
    return j.select(
        *[events[c] for c in events.columns], F.when(~malformed & on, "accept").otherwise("reject").alias("action"),
        F.when(malformed, "malformed").when(on, "allowed").otherwise("not allowed").alias("reason"),
        (~malformed & ~on & (why == "keep")).alias("held"), F.when(~malformed & ~on, why).alias("cause"))


def rescue(held: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Held events whose author is allowed by now, for replay in time order within each author, and what stays."""
    back = members(held, allowed).repartition("pubkey").sortWithinPartitions("pubkey", "created_at", "lev_id")
    return back, members(held, allowed, accept=False)


def rescue_summary(held: DataFrame, allowed: DataFrame) -> DataFrame:
    a = bulk_check(held.select("pubkey", "lev_id"), allowed, unknown=False)
    return a.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("pubkey").alias("authors"), F.count_if("allowed").alias("rescued"),
                 F.count_distinct(F.when(F.col("allowed"), F.col("pubkey"))).alias("rescued_authors"))
