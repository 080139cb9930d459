"""Queries over authors' behaviour, the scoring layers and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import analysis as A
from quern.operators import events as E
from quern.operators import layers as L
from quern.session import Scratch
from quern.sources.tables import event_log

WIDE = 86_400


def window_of(spark, d, per_author: int = 100):
    """The newest notes of every author, what the analyses look at."""
    return E.latest_per_author(event_log(spark, d), 1, per_author)


def stored_window(spark, d):
    """The same, written once for what reads it several times."""
    return Scratch(spark).write(window_of(spark, d).select("lev_id", "pubkey", "created_at", "kind", "tags", "content"))


def an_kinds(spark, d):
    return A.kind_histogram(event_log(spark, d))


def an_tag_summary(spark, d):
    return A.tag_summary(event_log(spark, d))


def an_top_mentions(spark, d):
    return A.top_tag_values(event_log(spark, d), "p")


def an_top_topics(spark, d):
    return A.top_tag_values(event_log(spark, d), "t")


def an_rates(spark, d):
    return A.rates(event_log(spark, d))


def an_rates_wide(spark, d):
    return A.rates(event_log(spark, d), WIDE)


def an_bins(spark, d):
    return A.time_bins(event_log(spark, d))


def an_metadata(spark, d):
    return A.window_metadata(event_log(spark, d))


def an_duplicates(spark, d):
    return A.duplicate_clusters(window_of(spark, d))


def an_triage(spark, d):
    return A.triage(stored_window(spark, d))


def fn_collapse(spark, d):
    return event_log(spark, d).filter("content is not null").select("lev_id", X.collapse(F.col("content")).alias("t"))


def fn_fnv(spark, d):
    """FNV-1a of every event's id, as the unsigned number in hex."""
    return event_log(spark, d).select("lev_id", X.unsigned_hex(X.fnv1a64("id")).alias("h"))


def fn_hosts(spark, d):
    h = event_log(spark, d).select("lev_id", F.explode(X.url_hosts(F.coalesce("content", F.lit("")))).alias("host"))
    return h.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def fn_jaccard(spark, d):
    """Similarity of each note with the author's first one, on sets of words."""
    words = F.array_distinct(F.split(F.lower("content"), " "))
    e = event_log(spark, d).filter("kind = 1 and content is not null and pubkey is not null").select("lev_id", "pubkey", words.alias("a"))
    first = e.groupBy("pubkey").agg(F.min_by("a", "lev_id").alias("b"))
    return e.join(first, "pubkey").select("lev_id", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("j"))


def fn_entropy(spark, d):
    """Bits a character of each distinct content, from a character histogram."""
    e = event_log(spark, d).filter("content <> ''").select("content").distinct()
    chars = e.select("content", F.explode(F.split("content", "")).alias("c")).filter("c <> ''").groupBy("content", "c").agg(F.count(F.lit(1)).alias("k"))
    n = F.sum("k")
    # H = log2 n - (sum k log2 k) / n needs one pass
    return chars.groupBy("content").agg((F.log2(n) - F.sum(F.col("k") * F.log2("k")) / n).alias("h")).select(F.md5("content").alias("m"), F.round("h", 6).alias("h"))


def fn_admission(spark, d):
    """Events by whether they are admitted, and why not."""
    from quern.operators.gate import admission

    return event_log(spark, d).groupBy(admission().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def layer_links(spark, d):
    return L.link_layer(window_of(spark, d)).select("pubkey", F.round("value", 9).alias("value"))


def layer_top_hosts(spark, d):
    return L.link_layer(window_of(spark, d)).select("pubkey", F.get_json_object("evidence", "$.top_domain").alias("host"))


def layer_duplicates(spark, d):
    return L.duplicate_layer(window_of(spark, d))


def layer_entropy(spark, d):
    return L.entropy_layer(window_of(spark, d))


def layer_entropy_bits(spark, d):
    """Bits a character of all contents of an author's window together, the evidence of the entropy layer."""
    return L.entropy_layer(window_of(spark, d)).select("pubkey", F.round(F.get_json_object("evidence", "$.entropy_bits").cast("double"), 6).alias("bits"))


def layer_fingerprints(spark, d):
    return L.fingerprints(window_of(spark, d))


def allowed_of(spark, d):
    """Authors with a Profile that is followed at least 20 times stand for the allow-list."""
    from quern.sources.tables import effective_profiles

    return effective_profiles(spark, d).filter("follower_count >= 20 and pubkey is not null").select("pubkey")


def layer_allow(spark, d):
    log = event_log(spark, d).filter("pubkey is not null").select("pubkey").distinct()
    return L.allow_layer(log, allowed_of(spark, d)).select("pubkey", "layer", "value")


def scores(spark, d):
    """Signals of all layers, pivoted and combined."""
    wide = L.combine(L.pivot_signals(L.signals(stored_window(spark, d), allowed_of(spark, d))))
    return wide.select("pubkey", *[F.round(c, 9).alias(c) for c in (*L.LAYERS, "score")], "suspected")


QUERIES = {f.__name__: f for f in (
    an_kinds, an_tag_summary, an_top_mentions, an_top_topics, an_rates, an_rates_wide, an_bins, an_metadata, an_duplicates, an_triage, fn_collapse, fn_fnv, fn_hosts, fn_jaccard,
    fn_entropy, fn_admission, layer_links, layer_top_hosts, layer_duplicates, layer_entropy, layer_entropy_bits, layer_fingerprints, layer_allow, scores)}

SANE = "created_at BETWEEN 0 AND 4102444800"
_TAGS = """WITH t AS (SELECT lev_id, pubkey, g[1] AS name, g[2] AS value, pos FROM (SELECT lev_id, pubkey, unnest(tags) AS g, generate_subscripts(tags, 1) AS pos FROM seed_events)),
    m AS (SELECT *, name IS NULL OR name <> 'e' AND value IS NULL AS bad FROM t)"""
WINDOW100 = """w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, lev_id DESC) AS pos FROM seed_events
    WHERE kind = 1 AND pubkey IS NOT NULL AND created_at IS NOT NULL) WHERE pos <= 100)"""


def _rates_sql(window_s: int) -> str:
    return f"""WITH s AS (SELECT pubkey, created_at, created_at - lag(created_at) OVER w AS gap, created_at - lag(created_at, 4) OVER w AS span
            FROM seed_events WHERE {SANE} AND pubkey IS NOT NULL WINDOW w AS (PARTITION BY pubkey ORDER BY created_at, lev_id)),
        g AS (SELECT pubkey, count(*) AS analyzed, min(gap) AS tightest_gap, max(span <= {window_s}) AS burst FROM s GROUP BY pubkey)
        SELECT e.pubkey, coalesce(max(analyzed), 0) AS analyzed, count(*) FILTER (WHERE NOT coalesce({SANE}, false)) AS rejected, max(tightest_gap) AS tightest_gap,
            coalesce(bool_or(burst), false) AS burst FROM seed_events e LEFT JOIN g ON e.pubkey = g.pubkey WHERE e.pubkey IS NOT NULL GROUP BY e.pubkey"""


def _top_sql(name: str) -> str:
    return f"""{_TAGS} SELECT value, n FROM (SELECT value, count(*) AS n, min(lev_id * 100000 + pos) AS first FROM m WHERE name = '{name}' AND NOT bad GROUP BY value)
        ORDER BY n DESC, first LIMIT 10"""


HOST = r"regexp_extract(tok, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@\s]+)', 1)"

FNV = ("printf('%016x', CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({}, ''), lambda c: ord(c)::HUGEINT)), "
       "lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT))")

ORACLE = {
    "fn_fnv": f"SELECT lev_id, {FNV.format('id')} AS h FROM seed_events",
    "layer_top_hosts": f"""WITH {WINDOW100}, h AS (SELECT DISTINCT pubkey, lev_id, lower({HOST}) AS host FROM (SELECT pubkey, lev_id, unnest(regexp_split_to_array(coalesce(content, ''), '[\\s\\p{{Z}}]+')) AS tok FROM w) WHERE {HOST} <> ''),
        k AS (SELECT pubkey, host, count(*) AS k FROM h GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY k DESC, host) = 1)
        SELECT DISTINCT w.pubkey, coalesce(host, '') AS host FROM w LEFT JOIN k ON k.pubkey = w.pubkey""",
    "an_kinds": "SELECT kind, count(*) AS n FROM seed_events WHERE kind BETWEEN 0 AND 9007199254740991 GROUP BY kind",
    "an_tag_summary": f"""{_TAGS}, e AS (SELECT pubkey, lev_id, count(*) FILTER (WHERE bad) AS malformed, count(*) FILTER (WHERE NOT bad) AS tags, count(*) FILTER (WHERE name = 'e' AND NOT bad) AS refs,
        count(*) FILTER (WHERE name = 'p' AND NOT bad) AS p, count(*) FILTER (WHERE name = 't' AND NOT bad) AS t FROM m GROUP BY pubkey, lev_id)
        SELECT pubkey, CAST(sum(malformed) AS BIGINT) AS malformed_tags, CAST(sum(refs) AS BIGINT) AS event_refs, bool_or(p > 20) AS mass_mention, bool_or(t > 15) AS stuffing,
        count(*) FILTER (WHERE tags > 20 OR p > 20 OR t > 15) AS outliers FROM e GROUP BY pubkey""",
    "an_top_mentions": _top_sql("p"), "an_top_topics": _top_sql("t"), "an_rates": _rates_sql(60), "an_rates_wide": _rates_sql(WIDE),
    "an_bins": f"""WITH o AS (SELECT pubkey, min(created_at) AS origin FROM seed_events WHERE {SANE} AND pubkey IS NOT NULL GROUP BY pubkey HAVING count(*) >= 2)
        SELECT pubkey, origin + (created_at - origin) // 3600 * 3600 AS start, count(*) AS n FROM seed_events JOIN o USING (pubkey) WHERE {SANE} GROUP BY 1, 2""",
    "an_metadata": "SELECT pubkey, count(*) AS n, min(created_at) AS oldest, max(created_at) AS newest FROM seed_events WHERE pubkey IS NOT NULL GROUP BY pubkey",
    "fn_collapse": r"SELECT lev_id, trim(regexp_replace(lower(content), '[\s\p{Z}]+', ' ', 'g')) AS t FROM seed_events WHERE content IS NOT NULL",
    "fn_hosts": f"SELECT lower(host) AS host, count(*) AS n FROM (SELECT {HOST} AS host FROM (SELECT unnest(regexp_split_to_array(content, '[\\s\\p{{Z}}]+')) AS tok FROM seed_events)) WHERE host <> '' GROUP BY 1",
    "fn_jaccard": """WITH e AS (SELECT lev_id, pubkey, list_distinct(string_split(lower(content), ' ')) AS a FROM seed_events WHERE kind = 1 AND content IS NOT NULL AND pubkey IS NOT NULL),
        f AS (SELECT pubkey, arg_min(a, lev_id) AS b FROM e GROUP BY 1)
        SELECT lev_id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS j FROM e JOIN f ON e.pubkey = f.pubkey""",
    "fn_entropy": """WITH e AS (SELECT DISTINCT content FROM seed_events WHERE content <> ''),
        c AS (SELECT content, ch, count(*) AS k FROM (SELECT content, unnest(list_transform(range(1, length(content) + 1), lambda i: array_extract(content, i))) AS ch FROM e) GROUP BY 1, 2)
        SELECT md5(content) AS m, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) AS h FROM c GROUP BY content""",
    "fn_admission": """SELECT CASE WHEN coalesce(id, '') = '' OR coalesce(pubkey, '') = '' THEN 'missing fields' WHEN kind IS NULL OR kind NOT IN (0, 1, 3) THEN 'kind'
        WHEN strlen(coalesce(content, '')) > 262144 THEN 'size' ELSE 'keep' END AS reason, count(*) AS n FROM seed_events GROUP BY 1""",
    "layer_links": f"""WITH {WINDOW100},
        h AS (SELECT DISTINCT pubkey, lev_id, lower({HOST}) AS host FROM (SELECT pubkey, lev_id, unnest(regexp_split_to_array(coalesce(content, ''), '[\\s\\p{{Z}}]+')) AS tok FROM w) WHERE {HOST} <> ''),
        t AS (SELECT pubkey, max(k) AS k FROM (SELECT pubkey, host, count(*) AS k FROM h GROUP BY 1, 2) GROUP BY 1),
        u AS (SELECT pubkey, count(DISTINCT lev_id) AS u FROM h GROUP BY 1),
        b AS (SELECT pubkey, count(*) AS n, sum(len(list_filter(coalesce(tags, []), lambda x: x[1] = 'p'))) AS p, sum(len(list_filter(coalesce(tags, []), lambda x: x[1] = 't'))) AS t FROM w GROUP BY 1)
        SELECT b.pubkey, round(CASE WHEN n < 5 THEN 0 ELSE greatest(least(coalesce(u, 0) / n / 0.8, 1), least(coalesce(k / u, 0) / 0.7, 1), least(p / n / 10, 1), least(b.t / n / 8, 1)) END, 9) AS value
        FROM b LEFT JOIN t ON b.pubkey = t.pubkey LEFT JOIN u ON b.pubkey = u.pubkey""",
    "layer_allow": """WITH p AS (SELECT * FROM profile_snapshot WHERE snapshot_no = 4 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY kind3createdat DESC NULLS LAST, last_attempt DESC NULLS LAST, last_db_update DESC NULLS LAST) = 1),
        a AS (SELECT DISTINCT pubkey FROM p WHERE follower_count >= 20 AND pubkey IS NOT NULL)
        SELECT s.pubkey, 'L0_whitelist' AS layer, CASE WHEN a.pubkey IS NULL THEN 1.0 ELSE 0.0 END AS value FROM (SELECT DISTINCT pubkey FROM seed_events WHERE pubkey IS NOT NULL) s LEFT JOIN a ON s.pubkey = a.pubkey""",
}

# clusters of an author's window: classes of one normal form, joined on shared runs of three words, closed over any steps
_CLUSTERS = rf"""{WINDOW100},
    n AS (SELECT pubkey, lev_id, trim(regexp_replace(lower(nfc_normalize(coalesce(content, ''))), '[\s\p{{Z}}]+', ' ', 'g')) AS key FROM w),
    k AS MATERIALIZED (SELECT pubkey, key, min(lev_id) AS node, count(*) AS n, string_split(key, ' ') AS ws FROM n GROUP BY pubkey, key),
    sh AS (SELECT pubkey, node, CASE WHEN key = '' THEN [] WHEN len(ws) < 3 THEN [key] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM k),
    u AS MATERIALIZED (SELECT pubkey, node, len(g) AS size, unnest(g) AS g FROM sh),
    ed AS MATERIALIZED (SELECT a.pubkey, a.node AS a, b.node AS b FROM u a JOIN u b ON a.pubkey = b.pubkey AND a.g = b.g AND a.node < b.node
        GROUP BY 1, 2, 3, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9),
    both_ways AS MATERIALIZED (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
    reach AS (SELECT DISTINCT a AS node, a AS to_node FROM both_ways UNION SELECT r.node, b FROM reach r JOIN both_ways ON to_node = a),
    part AS (SELECT node, min(to_node) AS cluster FROM reach GROUP BY 1),
    cl AS (SELECT k.pubkey, coalesce(cluster, k.node) AS cluster, CASE WHEN count(*) = 1 THEN 'exact' ELSE 'near' END AS kind, CAST(sum(n) AS BIGINT) AS n FROM k LEFT JOIN part ON part.node = k.node GROUP BY 1, 2 HAVING sum(n) >= 2)"""
ORACLE |= {
    "an_duplicates": f"WITH RECURSIVE {_CLUSTERS} SELECT pubkey, cluster, kind, n FROM cl",
    "an_triage": f"""WITH RECURSIVE {_CLUSTERS}, sp AS (SELECT pubkey, created_at - lag(created_at, 4) OVER (PARTITION BY pubkey ORDER BY created_at, lev_id) AS span FROM w WHERE {SANE}),
        bu AS (SELECT pubkey, bool_or(coalesce(span <= 60, false)) AS burst FROM sp GROUP BY 1),
        tg AS (SELECT lev_id, pubkey, g[1] AS name, g[2] AS value FROM (SELECT lev_id, pubkey, unnest(tags) AS g FROM w)),
        fe AS (SELECT pubkey, lev_id, count(*) FILTER (WHERE name = 'p') AS p, count(*) FILTER (WHERE name = 't') AS t FROM tg GROUP BY 1, 2), fa AS (SELECT pubkey, bool_or(p > 20 OR t > 15) AS fan FROM fe GROUP BY 1)
        SELECT m.pubkey, event_count, coalesce(burst, false) AS burst, m.pubkey IN (SELECT pubkey FROM cl) AS near_dup, coalesce(fan, false) AS tag_fan_out
        FROM (SELECT pubkey, count(*) AS event_count FROM w GROUP BY 1) m LEFT JOIN bu ON bu.pubkey = m.pubkey LEFT JOIN fa ON fa.pubkey = m.pubkey""",
    "layer_entropy_bits": rf"""WITH {WINDOW100}, n AS (SELECT pubkey, trim(regexp_replace(lower(coalesce(content, '')), '[\s\p{{Z}}]+', ' ', 'g')) AS t FROM w),
        j AS (SELECT pubkey, string_agg(t, ' ') AS t FROM n GROUP BY 1), c AS (SELECT pubkey, ch, count(*) AS k FROM (SELECT pubkey, unnest(list_transform(range(1, length(t) + 1), lambda i: array_extract(t, i))) AS ch FROM j) GROUP BY 1, 2),
        h AS (SELECT pubkey, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h FROM c GROUP BY 1) SELECT j.pubkey, round(coalesce(h, 0), 6) AS bits FROM j LEFT JOIN h ON h.pubkey = j.pubkey""",
}

# SimHash of each content of a window: words, runs of three, FNV-1a of their bytes, a vote of every bit
_WORD_SQL = r"[\p{L}\p{N}\p{M}_](?:(?:[\p{L}\p{N}\p{M}_''’.]|\p{L}:\p{L})*[\p{L}\p{N}\p{M}_])?"
_FNV_BYTES = ("list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, length(hx) // 2), lambda i: CAST(CAST('0x' || substr(hx, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS HUGEINT))), "
              "lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)")
_SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808::HUGEINT THEN {0} - 18446744073709551616::HUGEINT ELSE {0} END AS BIGINT)"
_SIMHASH = rf"""{WINDOW100},
    n AS MATERIALIZED (SELECT pubkey, lev_id, trim(regexp_replace(lower(coalesce(content, '')), '[\s\p{{Z}}]+', ' ', 'g')) AS t FROM w),
    d AS MATERIALIZED (SELECT t, hex(encode(t)) AS hx, regexp_extract_all(t, '{_WORD_SQL}') AS ws FROM (SELECT DISTINCT t FROM n)),
    sg AS MATERIALIZED (SELECT t, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [t] END) AS g FROM d),
    hs AS MATERIALIZED (SELECT g, {_FNV_BYTES} AS h FROM (SELECT g, hex(encode(g)) AS hx FROM (SELECT DISTINCT g FROM sg))),
    vt AS (SELECT t, b, sum(CASE WHEN (h // CAST(pow(2, b) AS HUGEINT)) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM sg JOIN hs ON sg.g = hs.g, range(64) r(b) GROUP BY t, b),
    si AS (SELECT t, sum(CASE WHEN v > 0 THEN CAST(pow(2, b) AS HUGEINT) ELSE 0 END) AS s FROM vt GROUP BY t),
    f AS MATERIALIZED (SELECT n.pubkey, n.lev_id, {_SIGNED.format(_FNV_BYTES)} AS content_hash, {_SIGNED.format('CAST(s AS HUGEINT)')} AS simhash FROM n JOIN d ON d.t = n.t JOIN si ON si.t = n.t)"""
ORACLE |= {
    "layer_fingerprints": f"WITH {_SIMHASH} SELECT pubkey, content_hash, arg_min(simhash, lev_id) AS simhash FROM f WHERE pubkey IN (SELECT pubkey FROM f GROUP BY 1 HAVING count(*) >= 5) GROUP BY 1, 2",
    "layer_duplicates": f"""WITH {_SIMHASH}, c AS MATERIALIZED (SELECT pubkey, simhash, count(*) AS n FROM f GROUP BY 1, 2),
        k AS (SELECT DISTINCT a.pubkey, a.simhash FROM c a JOIN c b ON a.pubkey = b.pubkey AND a.simhash <> b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3),
        e AS (SELECT c.pubkey, sum(n) AS n, coalesce(sum(n) FILTER (WHERE n > 1 OR k.simhash IS NOT NULL), 0) AS i FROM c LEFT JOIN k ON k.pubkey = c.pubkey AND k.simhash = c.simhash GROUP BY 1)
        SELECT pubkey, 'L1_near_duplicate' AS layer, CASE WHEN n < 5 THEN 0.0 ELSE i / n END AS value, '{{"clustered":' || i || ',"events":' || n || '}}' AS evidence FROM e""",
}

# all layers of an author's window and their combination
_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{FE00}-\x{FE0F}]"
_SIGNALS = rf"""{_SIMHASH}, c AS MATERIALIZED (SELECT pubkey, simhash, count(*) AS n FROM f GROUP BY 1, 2),
    k AS (SELECT DISTINCT a.pubkey, a.simhash FROM c a JOIN c b ON a.pubkey = b.pubkey AND a.simhash <> b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3),
    l1 AS (SELECT c.pubkey, CASE WHEN sum(n) < 5 THEN 0.0 ELSE coalesce(sum(n) FILTER (WHERE n > 1 OR k.simhash IS NOT NULL), 0) / sum(n) END AS v FROM c LEFT JOIN k ON k.pubkey = c.pubkey AND k.simhash = c.simhash GROUP BY 1),
    pe AS (SELECT d.t, length_grapheme(d.t) AS gr, len(ws) AS wd, len(list_filter(string_split(d.t, ' '), lambda x: starts_with(x, '#'))) AS tp, CASE WHEN NOT regexp_matches(d.t, '{_EMOJI}') THEN 0
        ELSE len(list_filter(list_transform(range(1, length_grapheme(d.t) + 1), lambda i: substring_grapheme(d.t, i, 1)), lambda x: regexp_matches(x, '^{_EMOJI}'))) END AS em FROM d),
    pa AS (SELECT pubkey, sum(gr) + count(*) - 1 AS gr, sum(wd) AS wd, sum(tp) AS tp, sum(em) AS em, string_agg(n.t, ' ') AS j FROM n JOIN pe ON pe.t = n.t GROUP BY 1),
    ch AS (SELECT pubkey, x, count(*) AS k FROM (SELECT pubkey, unnest(list_transform(range(1, length(j) + 1), lambda i: array_extract(j, i))) AS x FROM pa) GROUP BY 1, 2),
    en AS (SELECT pubkey, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h, sum(k) AS len FROM ch GROUP BY 1),
    l3 AS (SELECT pa.pubkey, greatest(CASE WHEN coalesce(len, 0) < 200 THEN 0 ELSE greatest(least(3.0 - h, 1), 0) END, greatest(least((coalesce(h, 0) - 5.0) / 0.5, 1), 0), least(em / greatest(gr, 1) / 0.5, 1), least(tp / greatest(wd, 1) / 0.3, 1)) AS v
        FROM pa LEFT JOIN en ON en.pubkey = pa.pubkey),
    ho AS (SELECT DISTINCT pubkey, lev_id, lower({HOST}) AS host FROM (SELECT pubkey, lev_id, unnest(regexp_split_to_array(coalesce(content, ''), '[\s\p{{Z}}]+')) AS tok FROM w) WHERE {HOST} <> ''),
    th AS (SELECT pubkey, max(k) AS k FROM (SELECT pubkey, host, count(*) AS k FROM ho GROUP BY 1, 2) GROUP BY 1), uh AS (SELECT pubkey, count(DISTINCT lev_id) AS u FROM ho GROUP BY 1),
    ba AS (SELECT pubkey, count(*) AS n, sum(len(list_filter(coalesce(tags, []), lambda x: x[1] = 'p'))) AS p, sum(len(list_filter(coalesce(tags, []), lambda x: x[1] = 't'))) AS t FROM w GROUP BY 1),
    l4 AS (SELECT ba.pubkey, CASE WHEN n < 5 THEN 0 ELSE greatest(least(coalesce(u, 0) / n / 0.8, 1), least(coalesce(k / u, 0) / 0.7, 1), least(p / n / 10, 1), least(ba.t / n / 8, 1)) END AS v
        FROM ba LEFT JOIN th ON ba.pubkey = th.pubkey LEFT JOIN uh ON ba.pubkey = uh.pubkey),
    pr AS (SELECT * FROM profile_snapshot WHERE snapshot_no = 4 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY kind3createdat DESC NULLS LAST, last_attempt DESC NULLS LAST, last_db_update DESC NULLS LAST) = 1),
    al AS (SELECT DISTINCT pubkey FROM pr WHERE follower_count >= 20 AND pubkey IS NOT NULL),
    sg4 AS MATERIALIZED (SELECT l4.pubkey, CASE WHEN al.pubkey IS NULL THEN 1.0 ELSE 0.0 END AS l0, l1.v AS l1, l3.v AS l3, l4.v AS l4 FROM l4 JOIN l1 ON l1.pubkey = l4.pubkey JOIN l3 ON l3.pubkey = l4.pubkey LEFT JOIN al ON al.pubkey = l4.pubkey),
    sc4 AS MATERIALIZED (SELECT *, 1 / (1 + exp(-(-4.0 + 0.8 * l0 + 2.0 * l1 + 1.5 * l3 + 1.5 * l4))) AS score FROM sg4)"""
ORACLE["scores"] = f"""WITH {_SIGNALS} SELECT pubkey, round(l0, 9) AS L0_whitelist, round(l1, 9) AS L1_near_duplicate, round(l3, 9) AS L3_content_entropy, round(l4, 9) AS L4_link_mention, round(score, 9) AS score,
    CAST(score > 0.5 AS INTEGER) AS suspected FROM sc4"""
