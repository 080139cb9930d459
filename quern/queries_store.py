"""Queries of the scoring store, the tuner, the gate, sources, sinks and scalar rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quern.functions import keys, scalars
from quern.functions.text import fnv1a64, unsigned_hex
from quern.operators import events as E
from quern.operators import gate, graph, layers, store, tune
from quern.operators.analysis import SANE_UNTIL, sane_time
from quern.operators.ranking import group_rank
from quern.queries_analysis import _SIGNALS, FNV, HOST, WINDOW100, allowed_of, stored_window, window_of
from quern.queries_graph import _E, _P
from quern.session import Scratch
from quern.sources import frames, jsonl, payloads
from quern.sources.tables import canonical_source, effective_profiles, event_log, follow_edges, table

RUN = 1
#: a delivery is late after so many seconds
LATE = 10 * 86_400


def _scores(spark, d):
    """Link signals alone, combined: a score that SQL can follow."""
    wide = layers.pivot_signals(layers.link_layer(window_of(spark, d)))
    return layers.combine(wide, {"_bias": -1.0}).select(F.lit(RUN).cast("bigint").alias("run_id"), "pubkey", "score", "suspected")


def st_ranked_suspects(spark, d):
    return store.ranked_suspects(_scores(spark, d), 0.3).select("pubkey", "rank", F.round("score", 9).alias("score"))


def st_review_sample(spark, d):
    return store.review_sample(_scores(spark, d), 100).select("run_id", "pubkey", F.round("score", 9).alias("score"))


def st_export(spark, d):
    """A whole run on disk: begin, scores, finish, export; then the suspects beside their signals, by rank."""
    s = store.Store(spark, Scratch(spark).base + "/store")
    weights = s.weights(layers.WEIGHTS | {"_threshold": 0.1})
    s.begin_run(RUN, 1_700_000_000, 1, weights)
    signals = layers.signals(stored_window(spark, d), allowed_of(spark, d)).withColumn("run_id", F.lit(RUN).cast("bigint"))
    s.write_run("signal", signals)
    wide = layers.combine(layers.pivot_signals(s.read("signal")), weights)
    s.write_run("score", wide.select(F.lit(RUN).cast("bigint").alias("run_id"), "pubkey", "score", "suspected", (F.col("L0_whitelist") == 0).cast("int").alias("whitelisted")))
    s.finish_run(RUN, 1_700_000_100, 2)
    return s.export().join(s.read("signal"), ["run_id", "pubkey"]).select("rank", "pubkey", "layer", F.round("value", 6).alias("value")).orderBy("rank")


def st_merge(spark, d):
    """Profiles of snapshot 3 with those of snapshot 4 merged in, the last write winning."""
    p = lambda n: effective_profiles(spark, d, n).select("uid", "kind3createdat", "follower_count")
    return store.merge(p(3), p(4), ["uid"])


def st_insert_new(spark, d):
    p = lambda n: effective_profiles(spark, d, n).select("uid", "kind3createdat")
    return store.insert_new(p(3), p(4), ["uid"])


def author_labels(spark, d):
    """An author is spam if an event of theirs has a majority of abusive verdicts."""
    v = table(spark, d, "abuse_labels").filter("is_abusive is not null").groupBy("id").agg(F.avg("is_abusive").alias("y"))
    e = event_log(spark, d).filter("pubkey is not null").select("id", "pubkey").distinct()
    return e.join(v, "id").groupBy("pubkey").agg(F.max((F.col("y") > 0.5).cast("int")).alias("is_spam"))


def st_labels(spark, d):
    return author_labels(spark, d)


def st_labelled_signals(spark, d):
    signals = layers.link_layer(window_of(spark, d))
    rows = tune.labelled(author_labels(spark, d), signals)
    return rows.select("pubkey", "is_spam", F.round("L4_link_mention", 9).alias("links"), "L0_whitelist")


def st_tune(spark, d):
    """The gate's verdict on a fit to all labels, and its weights."""
    verdict, weights = tune.tune(author_labels(spark, d), layers.signals(stored_window(spark, d), allowed_of(spark, d)))
    return spark.createDataFrame([(verdict.partition(":")[0], k, float(v)) for k, v in sorted(weights.items())], "verdict string, layer string, value double")


def gt_accepted(spark, d):
    return gate.members(event_log(spark, d), allowed_of(spark, d)).groupBy("pubkey").agg(F.count(F.lit(1)).alias("n"))


def gt_rejected(spark, d):
    return gate.members(event_log(spark, d), allowed_of(spark, d), accept=False).groupBy("pubkey").agg(F.count(F.lit(1)).alias("n"))


def gt_route(spark, d):
    r = gate.route(event_log(spark, d).select("id", "pubkey", "kind", "content"), allowed_of(spark, d))
    return r.groupBy("action", "reason", "held", "cause").agg(F.count(F.lit(1)).alias("n"))


def gt_bulk_check(spark, d):
    k = event_log(spark, d).select("pubkey").distinct().filter("pubkey is not null")
    return gate.bulk_check(k, allowed_of(spark, d))


def gt_rescue(spark, d):
    """What routing held back, against the allow-list of all authors with a Profile: rescued events by author, with the
    order of replay."""
    held = gate.route(event_log(spark, d), allowed_of(spark, d)).filter("held")
    back, _ = gate.rescue(held, effective_profiles(spark, d).select("pubkey"))
    bucket = F.floor(F.coalesce("created_at", F.lit(-1)) / 2_592_000)
    return group_rank(back.select("pubkey", "lev_id", "created_at"), ["pubkey"], bucket, ["created_at", "lev_id"], "turn").select("pubkey", "lev_id", "turn")


def gt_rescue_summary(spark, d):
    held = gate.route(event_log(spark, d), allowed_of(spark, d)).filter("held")
    return gate.rescue_summary(held, effective_profiles(spark, d).filter("pubkey is not null").select("pubkey"))


def gt_bloom(spark, d):
    """Authors that a Bloom filter of the allow-list lets through; none of the allowed is missed."""
    allowed = allowed_of(spark, d)
    f = frames.Bloom.decode(frames.Bloom.build(allowed, "pubkey").encode())
    authors = event_log(spark, d).filter("pubkey is not null").select("pubkey").distinct()
    return authors.filter(f.may_contain(F.col("pubkey")))


def io_jsonl_round_trip(spark, d):
    """The log written as lines of JSON, read back and numbered: the same ids in the order (time, id)."""
    base = Scratch(spark).base
    e = E.distinct_events(event_log(spark, d)).filter("pubkey is not null").select("id", "pubkey", "created_at", "kind", "tags", "content", "sig")
    jsonl.write_jsonl(e, f"{base}/events")
    good, _ = jsonl.read_events(spark, f"{base}/events")
    return jsonl.assign_lev_ids(good).select("lev_id", "id", "kind", F.size("tags").alias("n_tags"))


def io_payloads(spark, d):
    """Every event packed whole, a third as it is and the others as zstd frames of two dictionaries, then decoded and parsed."""
    words = {1: b'{"id":"","pubkey":"","created_at":17,"kind":1,"tags":[["e",""],["p",""]],"content":"","sig":""}', 2: b'"kind":7,"content":"+","tags":[["t","nostr"]]'}
    e = event_log(spark, d).select("lev_id", F.to_json(F.struct("id", "pubkey", "created_at", "kind", "tags", "content", "sig")).alias("raw"))
    packed = payloads.encode_payloads(e, words, F.pmod("lev_id", F.lit(3)))
    p = payloads.parse_events(payloads.decode_payloads(packed, words))
    return p.select("lev_id", "id", "kind", "bad", "content", "sig", F.size("tags").alias("n_tags"), F.element_at(F.try_element_at("tags", F.lit(1)), 1).alias("first_tag"))


def io_relay_lists(spark, d):
    """Relays named in relay lists, secure ones only, in one form, with how many authors name them."""
    newest = graph.latest_lists(event_log(spark, d), 10002)
    t = newest.select("pubkey", F.explode("tags").alias("t")).filter((F.get("t", F.lit(0)) == "r") & (F.size("t") >= 2)).select("pubkey", scalars.relay_form(F.get("t", F.lit(1))).alias("relay"))
    return t.filter(F.startswith("relay", F.lit("wss://"))).groupBy("relay").agg(F.count_distinct("pubkey").alias("authors"))


def io_relay_delay(spark, d):
    """Relays by the mean delay of their deliveries, the quickest fifty: count, mean, largest, and the true 95th percentile."""
    lag = F.unix_seconds(F.col("received_at").cast("timestamp")) - F.col("created_at")
    e = event_log(spark, d).select(canonical_source(F.col("source")).alias("relay"), lag.alias("lag")).filter("relay is not null and lag between 0 and 864000")
    return e.groupBy("relay").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lag"), 3).alias("mean"), F.max("lag").alias("most"), F.percentile("lag", 0.95).alias("p95")).orderBy("mean", "relay").limit(50)


def io_relay_delay_whole(spark, d):
    """Relays by the mean delay of all their deliveries, the quickest fifty: count, those over ten days and before their time,
    mean, largest, the true 95th percentile, and the deliveries without a sane time, which have no delay."""
    lag = F.unix_seconds(F.col("received_at").cast("timestamp")) - F.col("created_at")
    e = event_log(spark, d).select(canonical_source(F.col("source")).alias("relay"), F.when(sane_time(), lag).alias("lag")).filter("relay is not null")
    return e.groupBy("relay").agg(
        F.count("lag").alias("n"), F.count_if(F.col("lag") > LATE).alias("late"), F.count_if(F.col("lag") < 0).alias("early"), F.round(F.avg("lag"), 3).alias("mean"), F.max("lag").alias("most"),
        F.percentile("lag", 0.95).alias("p95"), F.count_if(F.col("lag").isNull()).alias("rejected")).orderBy(F.asc_nulls_last("mean"), "relay").limit(50)


def io_frame(spark, d):
    """The graph frame encoded and decoded: nodes, edges, and sums of its sections."""
    p = effective_profiles(spark, d)
    e = Scratch(spark).write(follow_edges(p).join(p.select(F.col("uid").alias("dst")), "dst", "left_semi"))
    n = frames.node_index(graph.degrees(e, p.select(F.col("uid").alias("node"))), "node").join(p.withColumnRenamed("uid", "node"), "node").withColumn("community", F.col("idx"))
    f = frames.GraphFrame.decode(frames.export_frame(n, e).encode())
    row = (len(f.in_degree), len(f.edges), int(f.in_degree.sum()), int(f.out_degree.sum()), int(f.kind3.astype("int64").sum()), len(f.pubkeys))
    return spark.createDataFrame([row], "nodes bigint, edges bigint, in_sum bigint, out_sum bigint, kind3_sum bigint, key_bytes bigint")


def io_run_metrics(spark, d):
    """Rates of a crawl of snapshot 4, to three places."""
    p = effective_profiles(spark, d).filter("last_attempt is not null")
    hits = F.count_if(F.col("miss_count") == 0)
    n = F.count(F.lit(1))
    return p.agg(n.alias("tried"), hits.alias("hits"), scalars.round3(hits / n).alias("hit_rate"), scalars.round3(F.avg(F.size("follows"))).alias("mean_follows"))


def fn_windows(spark, d):
    """Starts of the windows of five seconds, an hour and a week that hold each event."""
    e = event_log(spark, d).filter("created_at is not null")
    ts = F.col("created_at")
    return e.select("lev_id", scalars.truncate_time(ts, 5).alias("w5"), scalars.truncate_time(ts, 3600).alias("w3600"), scalars.truncate_time(ts, 7 * 86_400).alias("week"))


def fn_kind_names(spark, d):
    return event_log(spark, d).filter("kind is not null").groupBy(scalars.kind_name(F.col("kind")).alias("name")).agg(scalars.with_commas(F.count(F.lit(1))).alias("n"))


def fn_identifiers(spark, d):
    """Every author's key in its three forms, parsed back."""
    a = event_log(spark, d).filter("pubkey is not null").select("pubkey").distinct()

    @F.pandas_udf("array<string>")
    def forms(k: pd.Series) -> pd.Series:
        return k.map(lambda k: [k.upper(), " " + keys.bech32_encode("npub", bytes.fromhex(k)) + "\n", keys.bech32_encode("nprofile", b"\x00\x20" + bytes.fromhex(k))])

    return a.select("pubkey", F.explode(forms("pubkey")).alias("form")).select("pubkey", keys.identifier("form").alias("parsed")).filter("parsed = pubkey").groupBy("pubkey").agg(F.count(F.lit(1)).alias("n"))


def fn_backoff(spark, d):
    return effective_profiles(spark, d).select("uid", graph.backoff(F.coalesce("miss_count", F.lit(0))).alias("wait"))


def fn_last_tag(spark, d):
    """The last ``p`` tag of every event, and whether its value is a key."""
    v = scalars.tag_value(F.col("tags"), "p")
    return event_log(spark, d).select("lev_id", v.alias("p"), F.coalesce(F.length(keys.hex_to_bytes(v)) == 32, F.lit(False)).alias("is_key")).filter("p is not null")


def fn_review_hash(spark, d):
    return event_log(spark, d).filter("pubkey is not null").select("pubkey").distinct().select("pubkey", unsigned_hex(fnv1a64("pubkey")).alias("h"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith(("st_", "gt_", "io_", "fn_")) and k != "fnv1a64"}

_ALLOWED = f"WITH {_P}, a AS (SELECT DISTINCT pubkey FROM p WHERE follower_count >= 20 AND pubkey IS NOT NULL)"
_ADMIT = """CASE WHEN coalesce(id, '') = '' OR coalesce(s.pubkey, '') = '' THEN 'missing fields' WHEN kind IS NULL OR kind NOT IN (0, 1, 3) THEN 'kind'
    WHEN strlen(coalesce(content, '')) > 262144 THEN 'size' ELSE 'keep' END"""
_ROUTE = f"""r AS (SELECT s.*, CASE WHEN m THEN 'reject' WHEN inn THEN 'accept' ELSE 'reject' END AS action, CASE WHEN m THEN 'malformed' WHEN inn THEN 'allowed' ELSE 'not allowed' END AS reason,
    NOT m AND NOT inn AND {_ADMIT} = 'keep' AS held, CASE WHEN NOT m AND NOT inn THEN {_ADMIT} END AS cause
    FROM (SELECT e.*, NOT coalesce(regexp_full_match(lower(e.pubkey), '[0-9a-f]{{64}}'), false) OR coalesce(length(id), 0) <> 64 AS m, a.pubkey IS NOT NULL AS inn FROM seed_events e LEFT JOIN a ON lower(e.pubkey) = a.pubkey) s)"""
_LINKS = f"""{WINDOW100},
    h AS (SELECT DISTINCT pubkey, lev_id, lower({HOST}) AS host FROM (SELECT pubkey, lev_id, unnest(regexp_split_to_array(coalesce(content, ''), '[\\s\\p{{Z}}]+')) AS tok FROM w) WHERE {HOST} <> ''),
    k AS (SELECT pubkey, max(k) AS k FROM (SELECT pubkey, host, count(*) AS k FROM h GROUP BY 1, 2) GROUP BY 1), u AS (SELECT pubkey, count(DISTINCT lev_id) AS u FROM h GROUP BY 1),
    b AS (SELECT pubkey, count(*) AS n, sum(len(list_filter(coalesce(tags, []), lambda x: x[1] = 'p'))) AS p, sum(len(list_filter(coalesce(tags, []), lambda x: x[1] = 't'))) AS t FROM w GROUP BY 1),
    l AS (SELECT b.pubkey, CASE WHEN n < 5 THEN 0 ELSE greatest(least(coalesce(u, 0) / n / 0.8, 1), least(coalesce(k / u, 0) / 0.7, 1), least(p / n / 10, 1), least(b.t / n / 8, 1)) END AS value
    FROM b LEFT JOIN k ON b.pubkey = k.pubkey LEFT JOIN u ON b.pubkey = u.pubkey),
    sc AS (SELECT pubkey, 1 / (1 + exp(-(-1.0 + 1.5 * value))) AS score FROM l)"""
_P3 = _P.replace("p AS", "p3 AS").replace("= 4", "= 3")
_LABELS = """v AS (SELECT id, avg(is_abusive) AS y FROM abuse_labels WHERE is_abusive IS NOT NULL GROUP BY id),
    lab AS (SELECT pubkey, CAST(max(y > 0.5) AS INTEGER) AS is_spam FROM (SELECT DISTINCT id, pubkey FROM seed_events WHERE pubkey IS NOT NULL) e JOIN v ON v.id = e.id GROUP BY 1)"""

ORACLE = {
    "st_ranked_suspects": f"WITH {_LINKS} SELECT pubkey, row_number() OVER (ORDER BY round(score, 12) DESC, pubkey) AS rank, round(score, 9) AS score FROM sc WHERE score > 0.3",
    "st_merge": f"WITH {_P}, {_P3} SELECT uid, kind3createdat, follower_count FROM p UNION ALL SELECT uid, kind3createdat, follower_count FROM p3 WHERE uid NOT IN (SELECT uid FROM p)",
    "st_insert_new": f"WITH {_P}, {_P3} SELECT uid, kind3createdat FROM p3 UNION ALL SELECT uid, kind3createdat FROM p WHERE uid NOT IN (SELECT uid FROM p3)",
    "st_labels": f"WITH {_LABELS} SELECT * FROM lab",
    "st_labelled_signals": f"WITH {_LINKS}, {_LABELS} SELECT lab.pubkey, is_spam, round(coalesce(value, 0), 9) AS links, CAST(0 AS DOUBLE) AS L0_whitelist FROM lab LEFT JOIN l ON l.pubkey = lab.pubkey",
    "gt_accepted": f"{_ALLOWED} SELECT pubkey, count(*) AS n FROM seed_events WHERE pubkey IN (SELECT pubkey FROM a) GROUP BY 1",
    "gt_rejected": f"{_ALLOWED} SELECT pubkey, count(*) AS n FROM seed_events WHERE coalesce(pubkey, '') NOT IN (SELECT pubkey FROM a) GROUP BY 1",
    "gt_route": f"{_ALLOWED}, {_ROUTE} SELECT action, reason, held, cause, count(*) AS n FROM r GROUP BY ALL",
    "gt_bulk_check": f"{_ALLOWED} SELECT DISTINCT pubkey, pubkey IN (SELECT pubkey FROM a) AS allowed FROM seed_events WHERE pubkey IS NOT NULL",
    "gt_rescue": f"{_ALLOWED}, {_ROUTE} SELECT pubkey, lev_id, row_number() OVER (PARTITION BY pubkey ORDER BY created_at NULLS FIRST, lev_id) AS turn FROM r WHERE held AND pubkey IN (SELECT pubkey FROM p WHERE pubkey IS NOT NULL)",
    "gt_rescue_summary": f"""{_ALLOWED}, {_ROUTE} SELECT count(*) AS events, count(DISTINCT pubkey) AS authors, count(*) FILTER (WHERE x) AS rescued, count(DISTINCT CASE WHEN x THEN pubkey END) AS rescued_authors
        FROM (SELECT pubkey, pubkey IN (SELECT pubkey FROM p WHERE pubkey IS NOT NULL) AS x FROM r WHERE held)""",
    "io_jsonl_round_trip": """WITH e AS (SELECT * FROM seed_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY lev_id) = 1)
        SELECT row_number() OVER (ORDER BY coalesce(created_at, -1), id) AS lev_id, id, kind, CAST(len(tags) AS INTEGER) AS n_tags FROM e WHERE pubkey IS NOT NULL""",
    "io_payloads": "SELECT lev_id, id, kind, pubkey IS NULL AS bad, content, sig, CAST(len(tags) AS INTEGER) AS n_tags, tags[1][1] AS first_tag FROM seed_events",
    "io_relay_lists": """WITH l AS (SELECT * FROM seed_events WHERE kind = 10002 AND pubkey IS NOT NULL AND created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, lev_id) = 1),
        t AS (SELECT pubkey, unnest(tags) AS g FROM l), r AS (SELECT pubkey, regexp_replace(lower(trim(g[2])), '/+$', '') AS relay FROM t WHERE g[1] = 'r' AND len(g) >= 2)
        SELECT relay, count(DISTINCT pubkey) AS authors FROM r WHERE starts_with(relay, 'wss://') GROUP BY 1""",
    "io_relay_delay": """WITH e AS (SELECT regexp_replace(lower(trim(source)), '/+$', '') AS relay, CAST(floor(epoch_us(received_at) / 1000000) AS BIGINT) - created_at AS lag FROM seed_events)
        SELECT relay, count(*) AS n, round(avg(lag), 3) AS mean, max(lag) AS most, quantile_cont(CAST(lag AS DOUBLE), 0.95) AS p95 FROM e WHERE relay IS NOT NULL AND lag BETWEEN 0 AND 864000 GROUP BY 1 ORDER BY mean, relay LIMIT 50""",
    "io_relay_delay_whole": f"""WITH e AS (SELECT regexp_replace(lower(trim(source)), '/+$', '') AS relay, CASE WHEN created_at BETWEEN 0 AND {SANE_UNTIL} THEN CAST(floor(epoch_us(received_at) / 1000000) AS BIGINT) - created_at END AS lag FROM seed_events)
        SELECT relay, count(lag) AS n, count(*) FILTER (WHERE lag > {LATE}) AS late, count(*) FILTER (WHERE lag < 0) AS early, round(avg(lag), 3) AS mean, max(lag) AS most, quantile_cont(CAST(lag AS DOUBLE), 0.95) AS p95,
        count(*) FILTER (WHERE lag IS NULL) AS rejected FROM e WHERE relay IS NOT NULL GROUP BY 1 ORDER BY mean NULLS LAST, relay LIMIT 50""",
    "io_frame": f"""WITH {_P}, {_E}, x AS (SELECT * FROM e WHERE dst IN (SELECT uid FROM p)) SELECT (SELECT count(*) FROM p) AS nodes, (SELECT count(*) FROM x) AS edges,
        (SELECT count(*) FROM x WHERE dst IN (SELECT uid FROM p)) AS in_sum, (SELECT count(*) FROM x WHERE src IN (SELECT uid FROM p)) AS out_sum,
        (SELECT CAST(sum(greatest(least(coalesce(kind3createdat, 0), 2147483647), -2147483648)) AS BIGINT) FROM p) AS kind3_sum, (SELECT 32 * count(*) FROM p) AS key_bytes""",
    "io_run_metrics": f"""WITH {_P} SELECT count(*) AS tried, count(*) FILTER (WHERE miss_count = 0) AS hits, round(count(*) FILTER (WHERE miss_count = 0) / count(*), 3) AS hit_rate, round(avg(len(follows)), 3) AS mean_follows
        FROM p WHERE last_attempt IS NOT NULL""",
    "fn_windows": """SELECT lev_id, created_at // 5 * 5 AS w5, created_at // 3600 * 3600 AS w3600, (created_at + 62135596800) // 604800 * 604800 - 62135596800 AS week FROM seed_events WHERE created_at IS NOT NULL""",
    "fn_kind_names": """SELECT CASE kind WHEN 0 THEN 'User Metadata' WHEN 1 THEN 'Short Text Note' WHEN 2 THEN 'Recommend Relay' WHEN 3 THEN 'Follows' WHEN 4 THEN 'Encrypted Direct Messages' WHEN 5 THEN 'Event Deletion Request'
        WHEN 6 THEN 'Repost' WHEN 7 THEN 'Reaction' WHEN 1984 THEN 'Reporting' WHEN 9735 THEN 'Zap' WHEN 10002 THEN 'Relay List Metadata' WHEN 30023 THEN 'Long-form Content' ELSE 'Kind ' || kind END AS name, format('{:,}', count(*)) AS n
        FROM seed_events WHERE kind IS NOT NULL GROUP BY 1""",
    "fn_identifiers": "SELECT DISTINCT pubkey, CAST(3 AS BIGINT) AS n FROM seed_events WHERE pubkey IS NOT NULL",
    "fn_backoff": f"WITH {_P} SELECT uid, CAST(least(7200 * pow(2, coalesce(miss_count, 0)), 604800) AS BIGINT) AS wait FROM p",
    "fn_last_tag": """SELECT lev_id, p, coalesce(regexp_full_match(lower(p), '[0-9a-f]{64}'), false) AS is_key FROM (SELECT lev_id, list_filter(coalesce(tags, []), lambda t: len(t) >= 2 AND t[1] = 'p')[-1][2] AS p FROM seed_events) WHERE p IS NOT NULL""",
    "gt_bloom": f"{_ALLOWED} SELECT DISTINCT pubkey FROM seed_events WHERE pubkey IN (SELECT pubkey FROM a)",
    "fn_review_hash": f"SELECT pubkey, {FNV.format('pubkey')} AS h FROM (SELECT DISTINCT pubkey FROM seed_events WHERE pubkey IS NOT NULL)",
    "st_review_sample": f"WITH {_LINKS} SELECT CAST(1 AS BIGINT) AS run_id, pubkey, round(score, 9) AS score FROM sc WHERE NOT score > 0.5 ORDER BY {FNV.format('pubkey')}, pubkey LIMIT 100",
}
ORACLE["st_export"] = f"""WITH {_SIGNALS}, rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, pubkey) AS rank FROM sc4 WHERE score > 0.1)
    {" UNION ALL ".join(f"SELECT rank, pubkey, '{layer}' AS layer, round({v}, 6) AS value FROM rk" for layer, v in zip(layers.LAYERS, ("l0", "l1", "l3", "l4")))}"""
