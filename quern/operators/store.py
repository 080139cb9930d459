"""The scoring store: run table, keyed merges, export of suspects, review sample."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import fnv1a64, unsigned_hex
from quern.operators.ranking import group_rank
from quern.schema import STORE
from quern.session import Scratch


def merge(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Last write wins: rows of ``new`` replace those of ``old`` with the same key; within ``new`` the largest ``order``.
    One mergeable aggregate, so a key written again and again is combined before the shuffle."""
    cols = old.columns
    rest = [c for c in cols if c not in key]
    rank = F.struct(F.lit(1).alias("g"), (F.col(order) if order else F.lit(0)).alias("o"))
    n = new.select(*cols, rank.alias("_r"))
    o = old.select(*cols, F.struct(F.lit(0).alias("g"), (F.col(order) if order else F.lit(0)).alias("o")).alias("_r"))
    both = o.unionByName(n)
    if not rest:
        return both.select(*key).distinct()
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), "_r").alias("v")).select(*[c if c in key else F.col(f"v.{c}").alias(c) for c in cols])


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet; the stored row stays."""
    return old.unionByName(new.select(*old.columns).dropDuplicates(key).join(old.select(*key), key, "left_anti"))


class Store:
    """Parquet tables under one folder. Tables with a run are written a run at a time: writing a run again replaces it,
    nothing else. Data is committed before the run row that says so."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        schema, _ = STORE[name]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def write_run(self, name: str, df: DataFrame) -> None:
        cols = self.read(name).columns
        df.select(*cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{self.path}/{name}")

    def write_small(self, name: str, df: DataFrame) -> None:
        """Replaces a table kept as a whole; the new rows are read to the end before the old files go."""
        rows = self.spark.createDataFrame(df.collect(), self.read(name).schema)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def begin_run(self, run_id: int, now: int, max_lev_id: int, config: dict) -> None:
        row = self.spark.createDataFrame([(run_id, now, None, max_lev_id, None, None, json.dumps(config, sort_keys=True), "running")], STORE["run"][0])
        self.write_small("run", merge(self.read("run"), row, ["run_id"]))

    def finish_run(self, run_id: int, now: int, max_lev_id: int, status: str = "done", cursor: str | None = None) -> None:
        r = self.read("run").filter(F.col("run_id") == run_id)
        done = r.withColumn("finished_at", F.lit(now).cast("bigint")).withColumn("max_lev_id_end", F.lit(max_lev_id).cast("bigint")).withColumn("status", F.lit(status)).withColumn("last_cursor", F.lit(cursor).cast("string"))
        self.write_small("run", merge(self.read("run"), done, ["run_id"]))

    def unfinished(self):
        return self.read("run").filter("status = 'running'").orderBy(F.desc("run_id")).first()

    def advance(self, run_id: int, cursor: str) -> None:
        """Notes how far a run has come; call it after the data up to there is written."""
        r = self.read("run").filter(F.col("run_id") == run_id).withColumn("last_cursor", F.lit(cursor))
        self.write_small("run", merge(self.read("run"), r, ["run_id"]))

    def run_pages(self, authors: DataFrame, score: Callable[[DataFrame, int], DataFrame], now: int, max_lev_id: int, config: dict, page: int = 100_000) -> int:
        """Scores all ``authors(pubkey)`` page by page in the order of their keys and returns the run. An unfinished run goes on
        behind its cursor, in its own configuration; else a new one begins. A page is written before the cursor moves, and
        writing it again replaces it, so a run that is broken off anywhere ends with every author once."""
        row = self.unfinished()
        if row is None:
            last = self.read("run").agg(F.max("run_id")).first()[0]
            run_id, cursor = (last or 0) + 1, None
            self.begin_run(run_id, now, max_lev_id, config)
        else:
            run_id, cursor = row["run_id"], row["last_cursor"]
        keys = authors.select("pubkey").filter("pubkey is not null").distinct()
        while True:
            rest = keys.filter(F.col("pubkey") > cursor) if cursor is not None else keys
            part = rest.orderBy("pubkey").limit(page)
            end = part.agg(F.max("pubkey")).first()[0]
            if end is None:
                break
            out = score(rest.filter(F.col("pubkey") <= end), run_id)
            self.write_page("score", out, run_id, cursor, end)
            self.advance(run_id, end)
            cursor = end
        self.finish_run(run_id, now, max_lev_id, cursor=cursor)
        return run_id

    def write_page(self, name: str, df: DataFrame, run_id: int, after: str | None, end: str) -> None:
        """Writes the rows of a run with keys behind ``after`` up to ``end``; what was written of them before goes."""
        kept = self.read(name).filter((F.col("run_id") == run_id) & ((F.col("pubkey") > end) | (F.col("pubkey") <= (after if after is not None else ""))))
        scratch = Scratch(self.spark)
        if kept.isEmpty():
            self.write_run(name, df)
            return
        stale = self.read(name).filter((F.col("run_id") == run_id) & (F.col("pubkey") <= end) & (F.col("pubkey") > (after if after is not None else "")))
        if stale.isEmpty():
            df.select(*self.read(name).columns).write.mode("append").partitionBy("run_id").parquet(f"{self.path}/{name}")
        else:  # a page that was broken off: the run is written anew without it
            self.write_run(name, scratch.write(kept.unionByName(df.select(*kept.columns))))

    def threshold(self, run_id: int) -> float:
        row = self.read("run").filter(F.col("run_id") == run_id).select(F.get_json_object("config_json", "$._threshold").cast("double")).first()
        if row is None or row[0] is None:
            raise ValueError(f"run {run_id} has no threshold in its configuration")
        return row[0]

    def weights(self, default: dict[str, float]) -> dict[str, float]:
        """Stored weights, seeded from ``default`` when there are none; stored ones win."""
        stored = {r["layer"]: r["value"] for r in self.read("weight").collect()}
        if not stored:
            self.write_small("weight", self.spark.createDataFrame(sorted((k, float(v)) for k, v in default.items()), STORE["weight"][0]))
        return default | stored

    def export(self, run_id: int | None = None) -> DataFrame:
        if run_id is None:
            row = self.read("run").filter("status = 'done'").agg(F.max("run_id")).first()
            if row[0] is None:
                raise ValueError("no finished run")
            run_id = row[0]
        out = ranked_suspects(self.read("score").filter(F.col("run_id") == run_id), self.threshold(run_id))
        self.write_run("suspected_spammer", out)
        return self.read("suspected_spammer").filter(F.col("run_id") == run_id)


def ranked_suspects(scores: DataFrame, threshold: float) -> DataFrame:
    """Scores strictly above the threshold ranked within their run, ties by key.

    Scores are cut into buckets, so no single task sorts a run."""
    s = scores.filter(F.col("score") > threshold)
    bucket = F.floor((1 - F.col("score")) * 4096).cast("int")
    return group_rank(s, ["run_id"], bucket, [F.desc("score"), "pubkey"], "rank").select("run_id", "pubkey", "score", "rank")


def review_sample(scores: DataFrame, n: int) -> DataFrame:
    """``n`` scores that were not flagged, by the unsigned FNV-1a hash of their key, then the key: the same each time."""
    h = scores.filter("suspected = 0").withColumn("h", unsigned_hex(fnv1a64("pubkey")))
    return h.orderBy("h", "pubkey").limit(n).drop("h")
