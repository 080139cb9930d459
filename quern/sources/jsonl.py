"""Event logs as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ranking import global_rank
from quern.schema import EVENT

MOST_LINE = 1024 * 1024


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events with their raw line, skipped lines with a reason). Malformed, empty and overlong lines are skipped and
    kept apart, never fatal; events need an id and a pubkey."""
    lines = spark.read.text(path).withColumnRenamed("value", "raw").filter(F.trim("raw") != "")
    e = lines.withColumn("e", F.from_json("raw", EVENT, {"mode": "PERMISSIVE"}))
    no = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    why = F.when(F.octet_length("raw") > MOST_LINE, "too long").when(F.col("e").isNull() | no("e.id") | no("e.pubkey"), "malformed")
    e = e.withColumn("why", why)
    return e.filter("why is null").select("e.*", "raw"), e.filter("why is not null").select("raw", "why")


def assign_lev_ids(events: DataFrame, start: int = 1) -> DataFrame:
    """``lev_id`` in the order (created_at, id), to be stored once at ingest."""
    numbered = global_rank(events.withColumn("_t", F.coalesce("created_at", F.lit(-1))), ["_t", "id"], "lev_id")
    return numbered.withColumn("lev_id", F.col("lev_id") + (start - 1)).drop("_t")


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, one_file: bool = False) -> None:
    """One JSON object a line, sorted over all files; ``one_file`` only for reports known to be small."""
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if one_file else out).write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A ranked report as CSV with a header and as JSON."""
    df.coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)
    df.coalesce(1).write.mode("overwrite").json(f"{path}/json")


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
