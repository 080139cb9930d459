"""Readers of the stored tables and the engine's views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEX64 = "^[0-9a-f]{64}$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as stored: one row a delivery, ``lev_id`` unique."""
    return table(spark, sf_dir, "seed_events")


def effective_profiles(spark: SparkSession, sf_dir: str, snapshot_no: int = 4) -> DataFrame:
    """One row a uid of one full snapshot: the row with the largest ``kind3createdat``, null lowest. ``max_by`` over a
    struct combines before the shuffle, so repeated rows of one uid never meet in a task. Equal ``kind3createdat``: the
    larger ``last_attempt``, then ``last_db_update`` decides."""
    p = table(spark, sf_dir, "profile_snapshot").filter(F.col("snapshot_no") == snapshot_no)
    cols = [c for c in p.columns if c not in ("uid", "snapshot_no", "delivered_at")]
    order = F.struct(
        F.col("kind3createdat").isNotNull(), F.coalesce("kind3createdat", F.lit(0)),
        F.coalesce("last_attempt", F.lit(-1)), F.coalesce("last_db_update", F.lit(-1)),
    )
    best = p.groupBy("uid").agg(F.max_by(F.struct(*cols), order).alias("r"))
    return best.select("uid", *[F.col(f"r.{c}").alias(c) for c in cols])


def follow_edges(profiles: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` of follow lists held as arrays; distinct within the row needs no shuffle."""
    return profiles.select(F.col("uid").alias("src"), F.explode(F.array_distinct("follows")).alias("dst")).filter("dst is not null")


def canonical_source(c) -> F.Column:
    """A relay address in its proper spelling: trimmed, lower case, no closing slash."""
    return F.regexp_replace(F.lower(F.trim(c)), "/+$", "")
