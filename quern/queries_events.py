"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import events as E
from quern.operators.ranking import group_rank
from quern.plans.filters import Cursor, EventFilter, compile_filter, expired
from quern.sources.tables import HEX64, canonical_source, event_log

NOW, SINCE, UNTIL = 1_753_000_000, 1_740_000_000, 1_760_000_000
# fixed inputs of the queries: a heavy author, a cursor
AUTHOR = "17bd2e246f56b35f40d2650ddfb1eccb7fead5d6fbcb74f91ec1e59e226c1471"
CURSOR = Cursor(1_750_000_000, 5_000)


def _notes_filter():
    return EventFilter(kinds=[1, 30023], since=SINCE, until=UNTIL, now=NOW)


def ev_page(spark, d):
    return E.page(event_log(spark, d), _notes_filter(), 100, columns=["id", "pubkey", "created_at", "kind", "content"])


def ev_page_after_cursor(spark, d):
    return E.page(event_log(spark, d), _notes_filter(), 500, CURSOR, columns=["id", "created_at", "kind"])


def ev_page_late(spark, d):
    return E.late_page(event_log(spark, d), EventFilter(kinds=[1], until=UNTIL), 200).select("lev_id", "id", "created_at", "content")


def ev_filter_authors_kinds(spark, d):
    f = EventFilter(authors=[AUTHOR, "00", AUTHOR.upper()], kinds=[1, 6, 7])
    return E.matching(event_log(spark, d), f).select("lev_id", "kind", "created_at")


def ev_filter_ids(spark, d):
    log = event_log(spark, d)
    ids = [r["id"] for r in log.filter(F.col("pubkey") == AUTHOR).select("id").orderBy("lev_id").limit(5).collect()]
    return E.matching(log, EventFilter(ids=ids)).select("lev_id", "id")


def ev_filter_tags(spark, d):
    """Events that carry a topic tag with one of two values, and any event reference."""
    log = event_log(spark, d)
    topics = E.matching(log, EventFilter(tags=[("t", ["garden", "pillow", "ocean"])], since=SINCE))
    return topics.select("lev_id", "kind", F.size("tags").alias("n_tags"))


def ev_filter_tag_and(spark, d):
    log = event_log(spark, d)
    has = lambda n: F.exists("tags", lambda t: F.coalesce((F.get(t, F.lit(0)) == n) & (F.size(t) >= 2), F.lit(False)))
    return log.filter(F.coalesce(has("e") & has("p"), F.lit(False))).select("lev_id")


def ev_filter_long_tag_only(spark, d):
    """A query by tags alone without a tag of one byte has no rows."""
    return E.matching(event_log(spark, d), EventFilter(tags=[("expiration", ["1"])])).select("lev_id")


def ev_expired(spark, d):
    return event_log(spark, d).filter(expired(NOW)).select("lev_id", "created_at")


def ev_empty_list(spark, d):
    return E.matching(event_log(spark, d), EventFilter(kinds=[])).select("lev_id")


def ev_time_range(spark, d):
    return E.matching(event_log(spark, d), EventFilter(since=SINCE, until=UNTIL)).agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))


def ev_latest_per_author(spark, d):
    return E.latest_per_author(event_log(spark, d), 1, 100, now=NOW).select("pubkey", "lev_id", "created_at", "pos")


def ev_latest_of_authors(spark, d):
    return E.latest_per_author(event_log(spark, d), 7, 10, authors=[AUTHOR, AUTHOR, "f" * 64]).select("pubkey", "lev_id", "pos")


def ev_authors_page(spark, d):
    return E.authors(event_log(spark, d), after="4" + "0" * 63, limit=250)


def ev_authors_all(spark, d):
    return event_log(spark, d).filter("pubkey is not null").select("pubkey").distinct()


def ev_stats(spark, d):
    return E.stats(event_log(spark, d))


def ev_scan_kind_order(spark, d):
    log = event_log(spark, d).filter("kind is not null and created_at is not null")
    return E.range_scan(log, ["kind", "created_at"], [255, 0], limit=300).select("lev_id", "kind", "created_at")


def ev_scan_reverse(spark, d):
    log = event_log(spark, d).filter("created_at is not null")
    return E.range_scan(log, ["created_at"], [UNTIL], reverse=True, limit=300).select("lev_id", "created_at")


def ev_scan_author_order(spark, d):
    """Position of every event of an author in the order (author, kind, time); a month of a kind is sorted at a time."""
    log = event_log(spark, d).filter("pubkey is not null and kind is not null and created_at is not null").select("lev_id", "pubkey", "kind", "created_at")
    bucket = F.struct("kind", F.floor(F.col("created_at") / 2_592_000))
    return group_rank(log, ["pubkey"], bucket, ["kind", "created_at", "lev_id"]).select("lev_id", "pos")


def _wanted(log):
    """The events of kind 6 and an id that does not exist."""
    own = log.filter("kind = 6").select((F.col("lev_id") * 1).alias("lev_id"))
    return own.unionByName(own.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("lev_id")))


def ev_lookup(spark, d):
    log = event_log(spark, d)
    return E.lookup(log.select("lev_id", "id", "kind"), _wanted(log))


def ev_missing(spark, d):
    log = event_log(spark, d)
    return E.missing(log, _wanted(log))


def ev_by_author(spark, d):
    log = event_log(spark, d)
    newest = E.latest_per_author(log, 30023, 20)
    wanted = log.filter("kind = 0 and pubkey is not null").groupBy("pubkey").agg(F.min("lev_id").alias("ord"))
    out = E.by_author(wanted.select("ord", "pubkey"), newest)
    return out.select("ord", "pubkey", F.size("lev_ids").cast("bigint").alias("n"), F.array_join("lev_ids", ",").alias("lev_ids"))


def ev_distinct(spark, d):
    log = event_log(spark, d).select("id", "lev_id", "kind", "created_at")
    return E.distinct_events(log)


def ev_valid_keys(spark, d):
    """Events by the shape of their author key, as a health check describes it."""
    k = F.col("pubkey")
    shape = F.when(k.isNull() | (k == ""), "(empty)").when(k.rlike(HEX64), "ok").when(F.length(k) != 64, F.concat(F.lit("(length "), F.length(k), F.lit(")"))).otherwise("(non-hex characters)")
    return event_log(spark, d).groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def ev_by_relay(spark, d):
    """Distinct events of each relay, by its proper spelling."""
    log = event_log(spark, d).select(canonical_source(F.col("source")).alias("relay"), "id")
    return log.groupBy("relay").agg(F.countDistinct("id").alias("events"), F.count(F.lit(1)).alias("deliveries"))


def ev_exploded_tags(spark, d):
    """Counts of tags by name and position."""
    t = event_log(spark, d).select(F.posexplode("tags").alias("pos", "tag")).select("pos", F.get("tag", F.lit(0)).alias("name"))
    return t.groupBy("name", "pos").agg(F.count(F.lit(1)).alias("n")).withColumn("pos", F.col("pos").cast("bigint"))


QUERIES = {f.__name__: f for f in (
    ev_page, ev_page_after_cursor, ev_page_late, ev_filter_authors_kinds, ev_filter_ids, ev_filter_tags, ev_filter_tag_and, ev_filter_long_tag_only, ev_expired, ev_empty_list,
    ev_time_range, ev_latest_per_author, ev_latest_of_authors, ev_authors_page, ev_authors_all, ev_stats, ev_scan_kind_order, ev_scan_reverse, ev_scan_author_order, ev_lookup,
    ev_missing, ev_by_author, ev_distinct, ev_valid_keys, ev_by_relay, ev_exploded_tags)}

_EXPIRED = f"""len(list_filter(coalesce(tags, []), lambda t: t[1] = 'expiration' AND regexp_full_match(coalesce(t[2], ''), '\\+?[0-9]+')
    AND TRY_CAST(t[2] AS HUGEINT) <> 0 AND TRY_CAST(t[2] AS HUGEINT) <= {NOW})) > 0"""
_NOTES = f"kind IN (1, 30023) AND created_at BETWEEN {SINCE} AND {UNTIL} AND NOT ({_EXPIRED})"
_NEWEST = "row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, lev_id DESC)"

ORACLE = {
    "ev_page": f"SELECT lev_id, id, pubkey, created_at, kind, content FROM seed_events WHERE {_NOTES} ORDER BY created_at DESC, lev_id DESC LIMIT 100",
    "ev_page_after_cursor": f"""SELECT lev_id, id, created_at, kind FROM seed_events WHERE {_NOTES}
        AND (created_at < {CURSOR.created_at} OR created_at = {CURSOR.created_at} AND lev_id < {CURSOR.lev_id}) ORDER BY created_at DESC, lev_id DESC LIMIT 500""",
    "ev_page_late": f"SELECT lev_id, id, created_at, content FROM seed_events WHERE kind = 1 AND created_at <= {UNTIL} ORDER BY created_at DESC, lev_id DESC LIMIT 200",
    "ev_filter_authors_kinds": f"SELECT lev_id, kind, created_at FROM seed_events WHERE pubkey = '{AUTHOR}' AND kind IN (1, 6, 7) AND created_at IS NOT NULL",
    "ev_filter_ids": f"SELECT lev_id, id FROM seed_events WHERE created_at IS NOT NULL AND id IN (SELECT id FROM seed_events WHERE pubkey = '{AUTHOR}' ORDER BY lev_id LIMIT 5)",
    "ev_filter_tags": f"""SELECT lev_id, kind, CAST(len(tags) AS INTEGER) AS n_tags FROM seed_events WHERE created_at >= {SINCE}
        AND len(list_filter(tags, lambda t: len(t) >= 2 AND t[1] = 't' AND t[2] IN ('garden', 'pillow', 'ocean'))) > 0""",
    "ev_filter_tag_and": """SELECT lev_id FROM seed_events WHERE len(list_filter(tags, lambda t: len(t) >= 2 AND t[1] = 'e')) > 0
        AND len(list_filter(tags, lambda t: len(t) >= 2 AND t[1] = 'p')) > 0""",
    "ev_filter_long_tag_only": "SELECT lev_id FROM seed_events WHERE false",
    "ev_expired": f"SELECT lev_id, created_at FROM seed_events WHERE {_EXPIRED}",
    "ev_empty_list": "SELECT lev_id FROM seed_events WHERE false",
    "ev_time_range": f"SELECT count(*) AS n, min(created_at) AS lo, max(created_at) AS hi FROM seed_events WHERE created_at BETWEEN {SINCE} AND {UNTIL}",
    "ev_latest_per_author": f"""SELECT pubkey, lev_id, created_at, pos FROM (SELECT *, CAST({_NEWEST} AS INTEGER) AS pos FROM seed_events
        WHERE kind = 1 AND pubkey IS NOT NULL AND created_at IS NOT NULL) WHERE pos <= 100 AND NOT ({_EXPIRED})""",
    "ev_latest_of_authors": f"""SELECT pubkey, lev_id, pos FROM (SELECT *, CAST({_NEWEST} AS INTEGER) AS pos FROM seed_events
        WHERE kind = 7 AND pubkey = '{AUTHOR}' AND created_at IS NOT NULL) WHERE pos <= 10""",
    "ev_authors_page": f"SELECT DISTINCT pubkey FROM seed_events WHERE pubkey > '4{'0' * 63}' ORDER BY pubkey LIMIT 250",
    "ev_authors_all": "SELECT DISTINCT pubkey FROM seed_events WHERE pubkey IS NOT NULL",
    "ev_stats": "SELECT count(*) AS event_count, coalesce(max(lev_id), 0) AS max_lev_id, CAST(1 AS INTEGER) AS db_version FROM seed_events",
    "ev_scan_kind_order": """SELECT lev_id, kind, created_at FROM seed_events WHERE kind IS NOT NULL AND created_at IS NOT NULL
        AND (kind > 255 OR kind = 255 AND created_at >= 0) ORDER BY kind, created_at, lev_id LIMIT 300""",
    "ev_scan_reverse": f"SELECT lev_id, created_at FROM seed_events WHERE created_at <= {UNTIL} ORDER BY created_at DESC, lev_id DESC LIMIT 300",
    "ev_scan_author_order": """SELECT lev_id, row_number() OVER (PARTITION BY pubkey ORDER BY kind, created_at, lev_id) AS pos FROM seed_events
        WHERE pubkey IS NOT NULL AND kind IS NOT NULL AND created_at IS NOT NULL""",
    "ev_lookup": "SELECT lev_id, id, kind FROM seed_events WHERE kind = 6",
    "ev_missing": "SELECT CAST(-1 AS BIGINT) AS lev_id",
    "ev_by_author": f"""WITH w AS (SELECT pubkey, min(lev_id) AS ord FROM seed_events WHERE kind = 0 AND pubkey IS NOT NULL GROUP BY pubkey),
        n AS (SELECT pubkey, lev_id FROM (SELECT *, {_NEWEST} AS pos FROM seed_events WHERE kind = 30023 AND pubkey IS NOT NULL AND created_at IS NOT NULL) WHERE pos <= 20)
        SELECT ord, w.pubkey, count(n.lev_id) AS n, coalesce(string_agg(CAST(n.lev_id AS VARCHAR), ',' ORDER BY n.lev_id), '') AS lev_ids
        FROM w LEFT JOIN n ON w.pubkey = n.pubkey GROUP BY ord, w.pubkey""",
    "ev_distinct": "SELECT id, min(lev_id) AS lev_id, arg_min(kind, lev_id) AS kind, arg_min(created_at, lev_id) AS created_at FROM (SELECT id, lev_id, kind, created_at FROM seed_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY lev_id) = 1) GROUP BY id",
    "ev_valid_keys": """SELECT CASE WHEN pubkey IS NULL OR pubkey = '' THEN '(empty)' WHEN regexp_full_match(pubkey, '[0-9a-f]{64}') THEN 'ok'
        WHEN length(pubkey) <> 64 THEN '(length ' || length(pubkey) || ')' ELSE '(non-hex characters)' END AS shape, count(*) AS n FROM seed_events GROUP BY 1""",
    "ev_by_relay": "SELECT regexp_replace(lower(trim(source)), '/+$', '') AS relay, count(DISTINCT id) AS events, count(*) AS deliveries FROM seed_events GROUP BY 1",
    "ev_exploded_tags": """SELECT t[1] AS name, pos - 1 AS pos, count(*) AS n FROM (SELECT unnest(tags) AS t, generate_subscripts(tags, 1) AS pos FROM seed_events)
        GROUP BY 1, 2""",
}
