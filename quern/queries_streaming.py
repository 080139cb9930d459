"""Streaming queries, run over all stored events as one catch-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.sources.tables import event_log
from quern.streaming import events as S


def _stream(spark, d):
    return S.event_stream(spark, f"{d}/seed_events.parquet")


def sm_window_counts(spark, d):
    """Hourly windows by kind, all of them: the stream's complete state."""
    w = _stream(spark, d).filter("ts is not null").groupBy(F.window("ts", "1 hour"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return S.catch_up(spark, w.select(F.unix_seconds("window.start").alias("start"), "kind", "n"), "complete")


def sm_final_windows(spark, d):
    """Windows that are final: the stream has passed them by the lateness allowed."""
    return S.catch_up(spark, S.window_counts(_stream(spark, d).filter("created_at > 0"), 3600, 10))


def sm_distinct(spark, d):
    """Ids of the stream, each once."""
    return S.catch_up(spark, S.without_repeats(_stream(spark, d)).select("id"))


def sm_telemetry(spark, d):
    return S.catch_up(spark, S.telemetry(_stream(spark, d)), "complete")


def sm_latest_lists(spark, d):
    return S.LatestLists(spark).run(_stream(spark, d)).select("pubkey", "lev_id", "created_at")


def sm_list_versions(spark, d):
    """The newest list of each author, as the last entry of the change log of accepted versions."""
    log = S.catch_up(spark, S.accepted_versions(_stream(spark, d)))
    return log.groupBy("pubkey").agg(F.max_by(F.struct("lev_id", "created_at"), "created_at").alias("r")).select("pubkey", "r.*")


def sm_sliding_rates(spark, d):
    """Events a second over the trailing ten seconds, every second, as far as the stream has passed them."""
    return S.catch_up(spark, S.sliding_rates(_stream(spark, d).filter("created_at between 0 and 4102444800"))).select("at", "n", "rate")


def sm_trailing_minutes(spark, d):
    """Busiest trailing ten minutes, as a table expression of the same rule as the stream's."""
    e = event_log(spark, d).filter("created_at between 0 and 4102444800").withColumn("ts", F.timestamp_seconds("created_at"))
    w = e.groupBy(F.window("ts", "10 minutes", "1 minute")).agg(F.count(F.lit(1)).alias("n"))
    return w.agg(F.count(F.lit(1)).alias("windows"), F.max("n").alias("busiest"), F.sum("n").alias("total"))


def sm_outside(spark, d):
    """Events that are in no window of the stream, by kind and reason."""
    return S.catch_up(spark, S.outside_counts(_stream(spark, d)), "complete")


QUERIES = {f.__name__: f for f in (sm_window_counts, sm_final_windows, sm_distinct, sm_telemetry, sm_latest_lists, sm_list_versions, sm_sliding_rates, sm_trailing_minutes, sm_outside)}

_LAG = "(CAST(floor(epoch_us(received_at) / 1000000) AS BIGINT) - created_at)"
ORACLE = {
    "sm_window_counts": "SELECT created_at // 3600 * 3600 AS start, kind, count(*) AS n FROM seed_events WHERE created_at IS NOT NULL GROUP BY 1, 2",
    "sm_distinct": "SELECT DISTINCT id FROM seed_events",
    "sm_final_windows": """WITH e AS (SELECT * FROM seed_events WHERE created_at > 0 AND created_at <= CAST(floor(epoch_us(received_at) / 1000000) AS BIGINT) + 86400)
        SELECT created_at // 3600 * 3600 AS start, created_at // 3600 * 3600 + 3600 AS end, kind, count(*) AS n FROM e WHERE created_at // 3600 * 3600 + 3600 <= (SELECT max(created_at) FROM e) - 10 GROUP BY 1, 2, 3""",
    "sm_telemetry": f"SELECT kind, count(*) AS n, count(*) FILTER (WHERE source IS NULL) AS unknown_source, count(*) FILTER (WHERE {_LAG} > 3600) AS late, max({_LAG}) AS longest FROM seed_events GROUP BY 1",
    "sm_latest_lists": """SELECT pubkey, lev_id, created_at FROM seed_events WHERE kind = 3 AND pubkey IS NOT NULL AND created_at IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, lev_id) = 1""",
    "sm_trailing_minutes": """WITH e AS (SELECT created_at FROM seed_events WHERE created_at BETWEEN 0 AND 4102444800),
        w AS (SELECT created_at // 60 * 60 - 60 * i AS start, count(*) AS n FROM e, range(10) r(i) GROUP BY 1) SELECT count(*) AS windows, max(n) AS busiest, CAST(sum(n) AS BIGINT) AS total FROM w""",
}
ORACLE["sm_sliding_rates"] = """WITH e AS (SELECT created_at FROM seed_events WHERE created_at BETWEEN 0 AND 4102444800)
    SELECT created_at + i AS at, count(*) AS n, count(*) / 10 AS rate FROM e, range(1, 11) r(i) GROUP BY 1 HAVING created_at + i <= (SELECT max(created_at) FROM e) - 10"""
ORACLE["sm_outside"] = """WITH e AS (SELECT kind, created_at IS NULL OR received_at IS NULL AS none, created_at - CAST(floor(epoch_us(received_at) / 1000000) AS BIGINT) AS lead FROM seed_events)
    SELECT kind, count(*) FILTER (WHERE none) AS without_time, count(*) FILTER (WHERE NOT none) AS ahead FROM e WHERE none OR lead > 86400 GROUP BY 1"""
ORACLE["sm_list_versions"] = ORACLE["sm_latest_lists"]
