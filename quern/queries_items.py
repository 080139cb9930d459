"""Smaller operators: replaceable records, set operations, files, messages, last hundreds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import index_keys
from quern.operators import events as E
from quern.operators import graph as G
from quern.queries_analysis import allowed_of
from quern.queries_graph import _E, _FRONT, _P, NOW
from quern.session import Scratch
from quern.sources import jsonl
from quern.sources.tables import HEX64, canonical_source, effective_profiles, event_log, follow_edges, table

# keys that are always on the allow-list
FIXED_KEYS = [c * 64 for c in "abcde"]


def it_replaceable(spark, d):
    return E.newest_replaceable(event_log(spark, d), 30023)


def it_last_hundred(spark, d):
    """Delays of the last hundred deliveries of each relay: mean, largest, and the true 95th percentile."""
    lag = F.unix_seconds(F.col("received_at").cast("timestamp")) - F.col("created_at")
    e = event_log(spark, d).select(canonical_source(F.col("source")).alias("relay"), "lev_id", lag.alias("lag")).filter("relay is not null and lag is not null")
    w = Window.partitionBy("relay").orderBy(F.desc("lev_id"))
    last = e.withColumn("k", F.row_number().over(w)).filter("k <= 100")
    return last.groupBy("relay").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lag"), 3).alias("mean"), F.max("lag").alias("most"), F.round(F.percentile("lag", 0.95), 6).alias("p95"))


def it_union_keys(spark, d):
    fixed = spark.createDataFrame([(k,) for k in FIXED_KEYS], "pubkey string")
    return allowed_of(spark, d).union(fixed).distinct()


def it_token_import(spark, d):
    """The tokens of all report texts between blanks and commas: how often each occurs, and whether it is a key."""
    t = event_log(spark, d).filter("kind = 1984 and content is not null").select(F.explode(F.split(F.trim("content"), r"[\s,]+")).alias("token")).filter("token <> ''")
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", F.col("token").rlike(HEX64))


def it_relay_spellings(spark, d):
    """Relays by their one form, each in the spelling first seen."""
    e = event_log(spark, d).filter("source is not null")
    return e.groupBy(canonical_source(F.col("source")).alias("relay")).agg(F.min_by("source", "lev_id").alias("first_spelling"))


def it_relay_config(spark, d):
    """Known relays and those seen in the log, once each."""
    seen = event_log(spark, d).filter("source is not null").select(canonical_source(F.col("source")).alias("relay"))
    return table(spark, d, "relay_info").select(canonical_source(F.col("source")).alias("relay")).union(seen).distinct()


def it_skip_list(spark, d):
    """The frontier without the keys on the allow-list, which a batch skips."""
    f = G.frontier(effective_profiles(spark, d), 500, NOW).select("uid", "pubkey")
    return f.join(allowed_of(spark, d), "pubkey", "left_anti").select("uid")


def it_followed_keys_file(spark, d):
    """Keys with at least one follower, written as CSV and read back."""
    p = effective_profiles(spark, d)
    keys = p.join(follow_edges(p).select(F.col("dst").alias("uid")), "uid", "left_semi").filter("pubkey is not null").select("pubkey")
    at = Scratch(spark).base + "/keys"
    keys.write.csv(at, header=True)
    return spark.read.csv(at, header=True, schema="pubkey string")


def it_score_lines(spark, d):
    """Follower counts as sorted lines of JSON, read back."""
    p = effective_profiles(spark, d).filter("pubkey is not null").select("pubkey", F.col("follower_count").alias("valid_follower_count"))
    at = Scratch(spark).base + "/scores"
    jsonl.write_jsonl(p, at, ["pubkey"])
    return spark.read.schema("pubkey string, valid_follower_count bigint").json(at)


def it_delete(spark, d):
    """The log without the events that deletion requests of their own authors name."""
    log = event_log(spark, d)
    return E.delete_ids(log.select("lev_id", "id", "pubkey"), E.deletion_requests(log)).select("lev_id")


def it_reacted(spark, d):
    """The log without the events that reactions name."""
    log = event_log(spark, d)
    return E.delete_ids(log.select("lev_id", "id"), E.named_events(log, 7).select("id")).select("lev_id")


def it_sample(spark, d):
    """Five hundred authors in a seeded random order."""
    return event_log(spark, d).filter("pubkey is not null").select("pubkey").distinct().orderBy(F.md5(F.concat(F.lit("11:"), "pubkey")), "pubkey").limit(500)


def it_flatten(spark, d):
    """Follow lists nested as a graph server answers, as edges again."""
    p = effective_profiles(spark, d).select(F.struct("uid", F.transform(F.array_distinct("follows"), lambda u: F.struct(u.alias("uid"))).alias("follows")).alias("s"))
    nested = p.select(F.from_json(F.to_json("s"), "uid bigint, follows array<struct<uid: bigint>>").alias("s")).select("s.*")
    return G.flatten(nested)


def it_messages(spark, d):
    """Gate messages as lines of JSON with fields nobody asked for, read back."""
    m = event_log(spark, d).select(F.to_json(F.struct(F.lit("new").alias("type"), F.struct("id", "pubkey", "kind", F.lit(1).alias("extra")).alias("event"), F.lit("x").alias("sourceInfo"))).alias("line"))
    r = m.select(F.from_json("line", "type string, event struct<id: string, pubkey: string, kind: bigint>").alias("m"))
    return r.groupBy("m.type", "m.event.kind").agg(F.count("m.event.pubkey").alias("n"))


def it_key_prefixes(spark, d):
    return event_log(spark, d).filter("pubkey is not null").groupBy(F.substring("pubkey", 1, 8).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def it_sorted_keys(spark, d):
    """All keys of the graph in order, with their rank."""
    from quern.operators.ranking import global_rank

    return global_rank(effective_profiles(spark, d).filter("pubkey is not null").select("pubkey", "uid"), ["pubkey", "uid"]).select("uid", "idx")


def it_tag_values(spark, d):
    """Every tag value as the bytes of an index."""
    t = event_log(spark, d).select("lev_id", F.posexplode("tags").alias("pos", "t")).select("lev_id", "pos", F.get("t", F.lit(1)).alias("v")).filter("v is not null")
    return t.select("lev_id", "pos", F.lower(F.hex(index_keys.value_bytes(F.col("v")))).alias("bytes"))


def it_index_order(spark, d):
    """Events ranked by the bytes of (author, kind, time, number): the order of the typed columns."""
    from quern.operators.ranking import global_rank

    n = index_keys.number_bytes
    e = event_log(spark, d).filter(F.col("pubkey").rlike(HEX64)).select("lev_id", "created_at", index_keys.key(F.unhex("pubkey"), n(F.col("kind")), n(F.col("created_at"))).alias("key")).filter("key is not null")
    ranked = global_rank(e.select("lev_id", "created_at", index_keys.key(F.col("key"), n(F.col("lev_id"))).alias("key"), F.col("key").alias("short")), ["key"])
    return ranked.select("lev_id", "idx", (index_keys.number_at_end(F.col("short")) == F.col("created_at")).alias("same"))


def it_seek(spark, d):
    """For each author the next one, found as the first key from its successor on."""
    a = event_log(spark, d).filter(F.col("pubkey").rlike(HEX64)).select("pubkey").distinct()
    return a.select("pubkey", F.lower(F.hex(index_keys.successor(F.unhex("pubkey")))).alias("from_key"))


def it_chunks(spark, d):
    """The keys of the graph in chunks of two hundred, in order: first, last and size of each."""
    from quern.operators.ranking import global_rank

    r = global_rank(effective_profiles(spark, d).filter("pubkey is not null").select("pubkey", "uid"), ["pubkey", "uid"])
    return r.groupBy(F.floor((F.col("idx") - 1) / 200).alias("chunk")).agg(F.min("pubkey").alias("first"), F.max("pubkey").alias("last"), F.count(F.lit(1)).alias("n"))


def it_crawl_averages(spark, d):
    """Mean misses and waits by whether a Profile has a list."""
    p = effective_profiles(spark, d)
    return p.groupBy((F.col("kind3createdat").isNotNull()).alias("has_list")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("miss_count"), 6).alias("misses"), F.round(F.avg(F.col("next_attempt") - F.col("last_attempt")), 3).alias("wait"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("it_")}

_LAG = "(CAST(floor(epoch_us(received_at) / 1000000) AS BIGINT) - created_at)"
_RELAY = "regexp_replace(lower(trim(source)), '/+$', '')"
_PE = f"WITH {_P}, {_E}"
_OK = f"WITH {_P}, a AS (SELECT DISTINCT pubkey FROM p WHERE follower_count >= 20 AND pubkey IS NOT NULL)"
ORACLE = {
    "it_replaceable": """WITH e AS (SELECT pubkey, lev_id, created_at, coalesce(list_filter(coalesce(tags, []), lambda t: len(t) >= 2 AND t[1] = 'd')[1][2], '') AS d FROM seed_events
        WHERE kind = 30023 AND pubkey IS NOT NULL AND created_at IS NOT NULL) SELECT pubkey, d, lev_id, created_at FROM e QUALIFY row_number() OVER (PARTITION BY pubkey, d ORDER BY created_at DESC, lev_id DESC) = 1""",
    "it_last_hundred": f"""WITH e AS (SELECT {_RELAY} AS relay, lev_id, {_LAG} AS lag FROM seed_events), k AS (SELECT * FROM e WHERE relay IS NOT NULL AND lag IS NOT NULL QUALIFY row_number() OVER (PARTITION BY relay ORDER BY lev_id DESC) <= 100)
        SELECT relay, count(*) AS n, round(avg(lag), 3) AS mean, max(lag) AS most, round(quantile_cont(CAST(lag AS DOUBLE), 0.95), 6) AS p95 FROM k GROUP BY 1""",
    "it_union_keys": f"{_OK} SELECT pubkey FROM a UNION SELECT repeat(c, 64) FROM (VALUES ('a'), ('b'), ('c'), ('d'), ('e')) v(c)",
    "it_token_import": r"""WITH t AS (SELECT unnest(regexp_split_to_array(trim(content), '[\s,]+')) AS token FROM seed_events WHERE kind = 1984 AND content IS NOT NULL)
        SELECT token, count(*) AS n, regexp_full_match(token, '[0-9a-f]{64}') AS valid FROM t WHERE token <> '' GROUP BY 1""",
    "it_relay_spellings": f"SELECT {_RELAY} AS relay, arg_min(source, lev_id) AS first_spelling FROM seed_events WHERE source IS NOT NULL GROUP BY 1",
    "it_relay_config": f"SELECT {_RELAY} AS relay FROM relay_info UNION SELECT {_RELAY} FROM seed_events WHERE source IS NOT NULL",
    "it_skip_list": f"WITH {_P}, {_FRONT}, a AS (SELECT DISTINCT pubkey FROM p WHERE follower_count >= 20 AND pubkey IS NOT NULL) SELECT uid FROM fr WHERE pubkey NOT IN (SELECT pubkey FROM a)",
    "it_followed_keys_file": f"{_PE} SELECT pubkey FROM p WHERE pubkey IS NOT NULL AND uid IN (SELECT dst FROM e)",
    "it_score_lines": f"WITH {_P} SELECT pubkey, follower_count AS valid_follower_count FROM p WHERE pubkey IS NOT NULL",
    "it_delete": """WITH g AS (SELECT pubkey, unnest(tags) AS t FROM seed_events WHERE kind = 5 AND pubkey IS NOT NULL),
        i AS (SELECT DISTINCT pubkey, t[2] AS id FROM g WHERE t[1] = 'e' AND len(t) >= 2 AND t[2] IS NOT NULL)
        SELECT lev_id FROM seed_events s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.id = s.id AND i.pubkey = s.pubkey)""",
    "it_reacted": """WITH g AS (SELECT unnest(tags) AS t FROM seed_events WHERE kind = 7), i AS (SELECT DISTINCT t[2] AS id FROM g WHERE t[1] = 'e' AND len(t) >= 2 AND t[2] IS NOT NULL)
        SELECT lev_id FROM seed_events WHERE id NOT IN (SELECT id FROM i)""",
    "it_sample": "SELECT pubkey FROM (SELECT DISTINCT pubkey FROM seed_events WHERE pubkey IS NOT NULL) ORDER BY md5('11:' || pubkey), pubkey LIMIT 500",
    "it_flatten": f"{_PE} SELECT src, dst FROM e WHERE dst IS NOT NULL",
    "it_messages": "SELECT 'new' AS type, kind, count(pubkey) AS n FROM seed_events GROUP BY kind",
    "it_key_prefixes": "SELECT substr(pubkey, 1, 8) AS prefix, count(*) AS n FROM seed_events WHERE pubkey IS NOT NULL GROUP BY 1",
    "it_sorted_keys": f"WITH {_P} SELECT uid, row_number() OVER (ORDER BY pubkey, uid) AS idx FROM p WHERE pubkey IS NOT NULL",
    "it_crawl_averages": f"WITH {_P} SELECT kind3createdat IS NOT NULL AS has_list, count(*) AS n, round(avg(miss_count), 6) AS misses, round(avg(next_attempt - last_attempt), 3) AS wait FROM p GROUP BY 1",
    "it_tag_values": """SELECT lev_id, CAST(pos - 1 AS INTEGER) AS pos, CASE WHEN regexp_full_match(v, '[0-9a-f]{64}') THEN v ELSE lower(hex(encode(v))) END AS bytes
        FROM (SELECT lev_id, g[2] AS v, pos FROM (SELECT lev_id, unnest(tags) AS g, generate_subscripts(tags, 1) AS pos FROM seed_events)) WHERE v IS NOT NULL""",
    "it_index_order": """SELECT lev_id, row_number() OVER (ORDER BY pubkey, kind, created_at, lev_id) AS idx, true AS same FROM seed_events
        WHERE regexp_full_match(pubkey, '[0-9a-f]{64}') AND kind >= 0 AND created_at >= 0""",
    "it_seek": """SELECT DISTINCT pubkey, CASE WHEN regexp_matches(pubkey, '[0-9a-e]f*$') THEN regexp_extract(pubkey, '^(.*)[0-9a-e]f*$', 1)
        || translate(regexp_extract(pubkey, '([0-9a-e])f*$', 1), '0123456789abcde', '123456789abcdef') || repeat('0', 63 - length(regexp_extract(pubkey, '^(.*)[0-9a-e]f*$', 1))) END AS from_key
        FROM seed_events WHERE regexp_full_match(pubkey, '[0-9a-f]{64}')""",
    "it_chunks": f"""WITH {_P}, r AS (SELECT pubkey, row_number() OVER (ORDER BY pubkey, uid) AS idx FROM p WHERE pubkey IS NOT NULL)
        SELECT (idx - 1) // 200 AS chunk, min(pubkey) AS first, max(pubkey) AS last, count(*) AS n FROM r GROUP BY 1""",
}
