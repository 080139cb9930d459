"""Queries of the two general problems: hot keys and snapshot changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import hotkeys, snapshots
from quern.sources.tables import table


def p1_found(spark, d):
    """Keys holding at least 2 percent of the rows: those of the operator's per-key medians, by the counts of their bins."""
    parts = []
    for name, key, value in (("seed_events", "pubkey", "created_at"), ("profile_followers", "uid", "follower")):
        found = hotkeys.key_quantiles(table(spark, d, name), key, value, [500], min_share=0.02)
        parts.append(found.select(F.lit(f"{name}.{key}").alias("field_name"), F.col("key").cast("string").alias("key_value")))
    return parts[0].unionByName(parts[1])


def p1_author_quantiles(spark, d):
    """Median, 90th and 99th percentile of ``created_at`` of every author."""
    return hotkeys.key_quantiles(table(spark, d, "seed_events"), "pubkey", "created_at", [500, 900, 990]).withColumnRenamed("key", "pubkey")


def p1_profile_quantiles(spark, d):
    """Quantiles of the whole second a Profile's followers were seen."""
    t = table(spark, d, "profile_followers")
    t = t.withColumn("seen_s", F.unix_seconds(F.col("seen_at").cast("timestamp")))
    return hotkeys.key_quantiles(t, "uid", "seen_s", [100, 500, 900]).withColumnRenamed("key", "uid")


def _changes(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "profile_snapshot"), "snapshot_no", "uid", "kind3createdat", snapshots.follows_content())


def p3_found(spark, d):
    return _changes(spark, d).withColumnRenamed("key", "uid")


def p3_change_details(spark, d):
    return snapshots.profile_change_details(table(spark, d, "profile_snapshot"), _changes(spark, d))


def p3_change_counts(spark, d):
    return _changes(spark, d).groupBy("snapshot_no", "change").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_author_quantiles, p1_profile_quantiles, p3_found, p3_change_details, p3_change_counts)}


def _quantile_sql(source: str, key: str, value: str, permille: list[int]) -> str:
    picks = ", ".join(f"max(v) FILTER (WHERE rn = greatest((n_values * {p} + 999) // 1000, 1)) AS q{p}" for p in permille)
    return f"""
        WITH r AS (SELECT {key} AS k, {value} AS v FROM {source} WHERE {key} IS NOT NULL),
        n AS (SELECT k, count(*) AS n_rows, count(v) AS n_values FROM r GROUP BY k),
        o AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS rn FROM r WHERE v IS NOT NULL)
        SELECT n.k AS {key}, n.n_rows, n.n_values, {picks}
        FROM n LEFT JOIN o ON n.k = o.k GROUP BY n.k, n.n_rows, n.n_values"""


_EFFECTIVE = """
    e AS (SELECT snapshot_no, uid, kind3createdat AS v, list_sort(list_distinct(coalesce(follows, []))) AS f
          FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, uid ORDER BY kind3createdat DESC NULLS LAST) AS rn FROM profile_snapshot)
          WHERE rn = 1),
    c AS (SELECT coalesce(b.snapshot_no, a.snapshot_no + 1) AS snapshot_no, coalesce(b.uid, a.uid) AS uid,
                 CASE WHEN a.uid IS NULL THEN 'added' WHEN b.uid IS NULL THEN 'removed' ELSE 'changed' END AS change,
                 a.v AS old_kind3, b.v AS new_kind3, coalesce(a.f, []) AS old_f, coalesce(b.f, []) AS new_f
          FROM (SELECT * FROM e WHERE snapshot_no < 4) a FULL JOIN (SELECT * FROM e WHERE snapshot_no > 1) b
            ON a.uid = b.uid AND a.snapshot_no + 1 = b.snapshot_no
          WHERE a.uid IS NULL OR b.uid IS NULL OR a.v IS DISTINCT FROM b.v OR a.f <> b.f)"""

ORACLE = {
    "p1_found": """
        SELECT 'seed_events.pubkey' AS field_name, pubkey AS key_value FROM seed_events WHERE pubkey IS NOT NULL
        GROUP BY pubkey HAVING count(*) >= 0.02 * (SELECT count(*) FROM seed_events)
        UNION ALL
        SELECT 'profile_followers.uid', CAST(uid AS VARCHAR) FROM profile_followers WHERE uid IS NOT NULL
        GROUP BY uid HAVING count(*) >= 0.02 * (SELECT count(*) FROM profile_followers)""",
    "p1_author_quantiles": _quantile_sql("seed_events", "pubkey", "created_at", [500, 900, 990]),
    "p1_profile_quantiles": _quantile_sql(
        "(SELECT uid, CAST(floor(epoch_us(seen_at) / 1000000) AS BIGINT) AS seen_s FROM profile_followers)", "uid", "seen_s", [100, 500, 900]),
    "p3_found": f"WITH {_EFFECTIVE} SELECT CAST(snapshot_no AS INTEGER) AS snapshot_no, uid, change FROM c",
    "p3_change_details": f"""WITH {_EFFECTIVE} SELECT CAST(snapshot_no AS INTEGER) AS snapshot_no, uid, change, old_kind3, new_kind3,
        CAST(len(list_filter(new_f, lambda x: NOT list_contains(old_f, x))) AS BIGINT) AS follows_in,
        CAST(len(list_filter(old_f, lambda x: NOT list_contains(new_f, x))) AS BIGINT) AS follows_out FROM c""",
    "p3_change_counts": f"WITH {_EFFECTIVE} SELECT CAST(snapshot_no AS INTEGER) AS snapshot_no, change, count(*) AS n FROM c GROUP BY ALL",
}
