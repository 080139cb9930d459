"""Queries over the follow graph: snapshot 4 of Profile, and the follow lists in the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.session import Scratch
from quern.sources import jsonl
from quern.sources.tables import HEX64, effective_profiles, event_log, follow_edges, table

NOW = 1_745_000_000
DEPTH = 4


def profiles(spark, d):
    return effective_profiles(spark, d)


def graph(spark, d):
    """The follow edges, written once for the loops that read them again and again."""
    return Scratch(spark).write(follow_edges(profiles(spark, d)))


def edges(spark, d):
    return follow_edges(profiles(spark, d))


def nodes(spark, d):
    return profiles(spark, d).select(F.col("uid").alias("node"))


def seed(e):
    return e.agg(F.min("src")).first()[0]


def gr_latest_lists(spark, d):
    return G.latest_lists(event_log(spark, d)).select("pubkey", "lev_id", "created_at", F.size(G.followed_keys(F.col("tags"))).cast("bigint").alias("follows"))


def gr_list_edges(spark, d):
    return G.list_edges(G.latest_lists(event_log(spark, d)))


def gr_upsert(spark, d):
    """The log's lists up to a time, then the later ones merged in: the same edges as from all at once."""
    log = event_log(spark, d).filter("kind = 3 and pubkey is not null and created_at is not null")
    early = G.latest_lists(log.filter("lev_id % 2 = 0"))
    e, _ = G.upsert_lists(G.list_edges(early), early.select("pubkey", "created_at"), log.filter("lev_id % 2 = 1"))
    return e


def gr_list_delta(spark, d):
    return G.list_delta(follow_edges(effective_profiles(spark, d, 3)), edges(spark, d))


def gr_counts(spark, d):
    p = profiles(spark, d)
    e = follow_edges(p).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"))
    n = p.agg(F.count(F.lit(1)).alias("nodes"), F.count("kind3createdat").alias("with_list")).first()
    return e.withColumn("nodes", F.lit(n["nodes"])).withColumn("with_list", F.lit(n["with_list"]))


def gr_stale(spark, d):
    return profiles(spark, d).agg(F.count_if(F.col("last_attempt").isNull()).alias("never"), F.count_if(F.col("next_attempt") < NOW).alias("due"))


def gr_degrees(spark, d):
    return G.degrees(edges(spark, d), nodes(spark, d))


def gr_follower_backfill(spark, d):
    """Recounted followers against the stored count of every Profile."""
    deg = G.degrees(edges(spark, d), nodes(spark, d)).select(F.col("node").alias("uid"), "in_degree")
    return profiles(spark, d).select("uid", "follower_count").join(deg, "uid").select("uid", F.col("in_degree").alias("recounted"), (F.col("in_degree") - F.col("follower_count")).alias("drift"))


def gr_degree_summary(spark, d):
    return G.degree_summary(G.degrees(edges(spark, d), nodes(spark, d)), "in_degree").withColumn("mean", F.round("mean", 6))


def gr_min_followers(spark, d):
    return edges(spark, d).groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")


def gr_mutual(spark, d):
    return G.mutual(edges(spark, d))


def gr_levels(spark, d):
    e = graph(spark, d)
    return G.levels(e, seed(e), DEPTH)[0]


def gr_upstream(spark, d):
    e = graph(spark, d)
    lv, explored = G.levels(e, seed(e), DEPTH)
    return G.upstream_followers(lv, explored)


def gr_weakly_followed(spark, d):
    e = graph(spark, d)
    lv, explored = G.levels(e, seed(e), DEPTH)
    return G.weakly_followed(lv, G.upstream_followers(lv, explored))


def _seeds(e):
    """The twenty sources with the smallest uid."""
    return e.select(F.col("src").alias("node")).distinct().orderBy("node").limit(20)


def gr_trust(spark, d):
    e = graph(spark, d)
    return G.trust_closure(e, _seeds(e)).select("node", "round")


def _trusted(e):
    """Whoever the seeds reach in one step with three endorsements: a set with an outside."""
    s = _seeds(e)
    one = e.join(s.withColumnRenamed("node", "src"), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("c")).filter("c >= 3").select("node")
    return Scratch(e.sparkSession).write(s.unionByName(one).distinct())


def gr_endorsements(spark, d):
    e = graph(spark, d)
    return G.endorsements(e, _trusted(e))


def gr_weak_bridges(spark, d):
    e = graph(spark, d)
    return G.weak_bridges(e, _trusted(e))


def gr_beneath(spark, d):
    e = graph(spark, d)
    bridges = G.weak_bridges(e, _trusted(e), most=1)
    return G.beneath(e, bridges, 2).groupBy("bridge").agg(F.count(F.lit(1)).alias("n"))


def gr_cluster_report(spark, d):
    e = graph(spark, d)
    t = _trusted(e)
    b = G.weak_bridges(e, t)
    return G.cluster_report(G.beneath(e, b, 2), t, b).withColumn("score", F.round("score", 6))


def _closed(e):
    """The trust fixpoint (k = 2) of the twenty seeds; most of the graph stays outside."""
    return Scratch(e.sparkSession).write(G.trust_closure(e, _seeds(e)).select("node"))


def gr_trust_endorsements(spark, d):
    e = graph(spark, d)
    return G.endorsements(e, _closed(e))


def gr_trust_bridges(spark, d):
    e = graph(spark, d)
    return G.weak_bridges(e, _closed(e))


def gr_trust_beneath(spark, d):
    """How many nodes each bridge (weight 1 and 2) of the fixpoint reaches in up to three hops."""
    e = graph(spark, d)
    return G.beneath(e, G.weak_bridges(e, _closed(e))).groupBy("bridge").agg(F.count(F.lit(1)).alias("n"))


def gr_trust_clusters(spark, d):
    """The whole scan: trust to the fixpoint, weak bridges, clusters of three hops."""
    e = graph(spark, d)
    t = _closed(e)
    b = Scratch(spark).write(G.weak_bridges(e, t))
    return G.cluster_report(G.beneath(e, b), t, b).withColumn("score", F.round("score", 6))


def gr_trust_report(spark, d):
    """The report of the whole scan as a file with a header, read back."""
    at = Scratch(spark).base + "/report"
    jsonl.write_report(gr_trust_clusters(spark, d), at)
    return spark.read.csv(f"{at}/csv", header=True, schema="bridge bigint, cluster_size bigint, weight bigint, score double")


def gr_trust_members(spark, d):
    """Who is in the clusters that the whole scan reports."""
    e = graph(spark, d)
    t = _closed(e)
    b = Scratch(spark).write(G.weak_bridges(e, t))
    return G.cluster_members(Scratch(spark).write(G.beneath(e, b)), t, b)


def gr_frontier(spark, d):
    return G.frontier(profiles(spark, d), 500, NOW).select("uid", "phase")


def gr_mark_attempted(spark, d):
    """Everyone on the frontier was tried; those with an even uid answered."""
    p = profiles(spark, d)
    tried = G.frontier(p, 500, NOW).select("pubkey", F.lit(NOW).alias("ts"), (F.col("uid") % 2 == 0).alias("hit"))
    return G.mark_attempted(p, tried).select("uid", "last_attempt", "next_attempt", "miss_count", "uncrawled")


def gr_backfill_next(spark, d):
    return G.backfill_next_attempt(profiles(spark, d)).select("uid", "next_attempt", "miss_count")


def gr_touch(spark, d):
    p = profiles(spark, d)
    return G.touch(p, p.filter("follower_count > 5").select("pubkey"), NOW).select("uid", "last_db_update")


def gr_remove_follow(spark, d):
    e = edges(spark, d)
    return G.remove_follow(e, e.filter("(src + dst) % 3 = 0"))


def gr_remove_nodes(spark, d):
    e, n = G.remove_nodes(edges(spark, d), nodes(spark, d), nodes(spark, d).filter("node % 5 = 0"))
    return e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))


def gr_no_followers(spark, d):
    return nodes(spark, d).join(edges(spark, d).select(F.col("dst").alias("node")), "node", "left_anti")


def gr_no_follows(spark, d):
    return nodes(spark, d).join(edges(spark, d).select(F.col("src").alias("node")), "node", "left_anti")


def gr_both(spark, d):
    e = edges(spark, d)
    return nodes(spark, d).join(e.select(F.col("dst").alias("node")), "node", "left_semi").join(e.select(F.col("src").alias("node")), "node", "left_semi")


def gr_top_connected(spark, d):
    deg = G.degrees(edges(spark, d), nodes(spark, d)).withColumn("total", F.col("in_degree") + F.col("out_degree"))
    return deg.orderBy(F.desc("total"), "node").limit(20)


def gr_recent(spark, d):
    return profiles(spark, d).filter("last_db_update is not null").orderBy(F.desc("last_db_update"), "uid").limit(20).select("uid", "last_db_update")


def gr_oldest(spark, d):
    return profiles(spark, d).filter("last_db_update is not null").orderBy("last_db_update", "uid").limit(20).select("uid", "last_db_update")


def gr_nested(spark, d):
    e = edges(spark, d)
    roots = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(50).select("node")
    return G.nested_neighbours(e, roots, 10, 5)


def gr_two_hops(spark, d):
    """Nodes exactly one or two hops from the seed, with the hops."""
    e = graph(spark, d)
    return G.levels(e, seed(e), 2)[0].filter("level > 0")


def gr_dense_index(spark, d):
    e = edges(spark, d).withColumn("ord", F.col("src") * F.lit(1_000_000) + F.col("dst"))
    return G.dense_index(e)


def gr_components(spark, d):
    from quern.operators.components import connected_components

    return connected_components(G.mutual(edges(spark, d)))


def gr_louvain(spark, d):
    return G.louvain(graph(spark, d))


def gr_duplicate_nodes(spark, d):
    """Keys that several stored rows of a snapshot hold, with the number of extra rows."""
    p = table(spark, d, "profile_snapshot").filter("snapshot_no = 4 and pubkey is not null")
    return p.groupBy("pubkey").agg((F.count(F.lit(1)) - 1).alias("extra")).filter("extra > 0")


def gr_keep_best(spark, d):
    p = table(spark, d, "profile_snapshot").filter("snapshot_no = 4")
    return G.keep_best(p).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def gr_invalid_keys(spark, d):
    return profiles(spark, d).filter(F.col("pubkey").isNull() | ~F.col("pubkey").rlike(HEX64)).select("uid")


def gr_profile_authors(spark, d):
    """Profiles resolved to the authors of the log, with their events."""
    log = event_log(spark, d).filter("pubkey is not null").groupBy("pubkey").agg(F.count(F.lit(1)).alias("events"))
    return profiles(spark, d).select("uid", "pubkey").join(log, "pubkey").select("uid", "events")


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("gr_")}

_P = """p AS (SELECT * FROM profile_snapshot WHERE snapshot_no = 4
    QUALIFY row_number() OVER (PARTITION BY uid ORDER BY kind3createdat DESC NULLS LAST, last_attempt DESC NULLS LAST, last_db_update DESC NULLS LAST) = 1)"""
_P3 = _P.replace("p AS", "p3 AS").replace("= 4", "= 3")
_E = "e AS (SELECT uid AS src, unnest(list_distinct(follows)) AS dst FROM p)"
_PE = f"WITH {_P}, {_E}"
_DEG = """g AS (SELECT p.uid AS node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM p LEFT JOIN (SELECT dst, count(*) AS i FROM e GROUP BY 1) a ON a.dst = p.uid
    LEFT JOIN (SELECT src, count(*) AS o FROM e GROUP BY 1) b ON b.src = p.uid)"""
_LISTS = """l AS (SELECT * FROM seed_events WHERE kind = 3 AND pubkey IS NOT NULL AND created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, lev_id) = 1),
    f AS (SELECT DISTINCT pubkey AS src, g[2] AS dst FROM (SELECT pubkey, unnest(tags) AS g FROM l) WHERE len(g) >= 2 AND g[1] = 'p' AND regexp_full_match(coalesce(g[2], ''), '[0-9a-f]{64}'))"""


def _levels_sql(depth: int) -> str:
    return f"""WITH RECURSIVE {_P}, {_E}, s AS (SELECT min(src) AS node FROM e),
        r AS (SELECT node, 0 AS level FROM s UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node WHERE r.level < {depth}),
        lv AS (SELECT node, min(level) AS level FROM r GROUP BY node)"""


_VALID = f"""{_levels_sql(DEPTH)}, v AS (SELECT e.dst AS node, count(*) AS valid FROM e JOIN lv a ON a.node = e.src AND a.level < {DEPTH} JOIN lv b ON b.node = e.dst WHERE a.level < b.level GROUP BY 1)"""
_T = """s AS (SELECT DISTINCT src AS node FROM e ORDER BY 1 LIMIT 20),
    t AS (SELECT node FROM s UNION SELECT dst FROM e WHERE src IN (SELECT node FROM s) GROUP BY dst HAVING count(*) >= 3)"""
_ENDORSE = f"""{_PE}, {_T}, i AS (SELECT dst AS node, count(*) AS c FROM e WHERE src IN (SELECT node FROM t) GROUP BY 1), o AS (SELECT src AS node, count(*) AS c FROM e WHERE dst IN (SELECT node FROM t) GROUP BY 1),
    w AS (SELECT coalesce(i.node, o.node) AS node, coalesce(i.c, 0) AS trusted_followers, coalesce(o.c, 0) AS trusted_followees, coalesce(i.c, 0) + coalesce(o.c, 0) AS weight
    FROM i FULL JOIN o ON i.node = o.node WHERE coalesce(i.node, o.node) NOT IN (SELECT node FROM t))"""
_FRONT = f"""fr AS (SELECT uid, pubkey, CASE WHEN uncrawled = 1 THEN 0 WHEN next_attempt < {NOW} THEN 1 END AS phase FROM p WHERE pubkey IS NOT NULL AND (coalesce(uncrawled, 0) = 1 OR next_attempt < {NOW})
    ORDER BY phase, follower_count DESC NULLS LAST, pubkey, uid LIMIT 500)"""

_TWO = """h AS (SELECT node AS bridge, dst AS node FROM w JOIN e ON e.src = w.node WHERE weight BETWEEN 1 AND {most}),
    r AS (SELECT bridge, node FROM h UNION SELECT bridge, dst FROM h JOIN e ON e.src = h.node), c AS (SELECT * FROM r WHERE bridge <> node)"""

ORACLE = {
    "gr_latest_lists": f"WITH {_LISTS} SELECT l.pubkey, lev_id, created_at, coalesce(n, 0) AS follows FROM l LEFT JOIN (SELECT src, count(*) AS n FROM f GROUP BY 1) x ON x.src = l.pubkey",
    "gr_list_edges": f"WITH {_LISTS} SELECT src, dst FROM f",
    "gr_list_delta": f"""WITH {_P}, {_E}, {_P3}, e3 AS (SELECT uid AS src, unnest(list_distinct(follows)) AS dst FROM p3)
        SELECT src, dst, 'added' AS change FROM (FROM e EXCEPT FROM e3) UNION ALL SELECT src, dst, 'removed' FROM (FROM e3 EXCEPT FROM e)""",
    "gr_counts": f"{_PE} SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT src) FROM e) AS sources, (SELECT count(*) FROM p) AS nodes, (SELECT count(kind3createdat) FROM p) AS with_list",
    "gr_stale": f"WITH {_P} SELECT count(*) FILTER (WHERE last_attempt IS NULL) AS never, count(*) FILTER (WHERE next_attempt < {NOW}) AS due FROM p",
    "gr_degrees": f"{_PE}, {_DEG} SELECT * FROM g",
    "gr_follower_backfill": f"{_PE}, {_DEG} SELECT uid, in_degree AS recounted, in_degree - follower_count AS drift FROM g JOIN p ON p.uid = g.node",
    "gr_degree_summary": f"""{_PE}, {_DEG}, s AS (SELECT list_sort(list(in_degree)) AS s, count(*) AS n, round(avg(in_degree), 6) AS mean FROM g)
        SELECT n, mean, {', '.join(f's[(n - 1) * {p} // 100 + 1] AS p{p}' for p in (25, 50, 75, 90, 99))}, s[-1] AS max FROM s""",
    "gr_min_followers": f"{_PE} SELECT dst, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 10",
    "gr_mutual": f"{_PE} SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst",
    "gr_levels": f"{_levels_sql(DEPTH)} SELECT node, level FROM lv",
    "gr_two_hops": f"{_levels_sql(2)} SELECT node, level FROM lv WHERE level > 0",
    "gr_upstream": f"{_VALID} SELECT node, valid FROM v",
    "gr_weakly_followed": f"{_VALID} SELECT lv.node, coalesce(valid, 0) AS valid_follower_count FROM lv LEFT JOIN v ON v.node = lv.node WHERE level > 1 AND coalesce(valid, 0) < 2",
    "gr_endorsements": f"{_ENDORSE} SELECT * FROM w",
    "gr_weak_bridges": f"{_ENDORSE} SELECT * FROM w WHERE weight BETWEEN 1 AND 2",
    "gr_beneath": f"{_ENDORSE}, {_TWO.format(most=1)} SELECT bridge, count(*) AS n FROM c GROUP BY 1",
    "gr_cluster_report": f"""{_ENDORSE}, {_TWO.format(most=2)} SELECT bridge, count(*) AS cluster_size, max(weight) AS weight, round(count(*) / max(weight), 6) AS score
        FROM c JOIN w ON w.node = c.bridge WHERE c.node NOT IN (SELECT node FROM t) GROUP BY 1 HAVING count(*) >= 5""",
    "gr_frontier": f"WITH {_P}, {_FRONT} SELECT uid, phase FROM fr",
    "gr_mark_attempted": f"""WITH {_P}, {_FRONT}, a AS (SELECT pubkey, max(uid % 2 = 0) AS hit FROM fr GROUP BY 1)
        SELECT uid, CASE WHEN a.pubkey IS NULL THEN last_attempt ELSE {NOW} END AS last_attempt,
        CASE WHEN a.pubkey IS NULL THEN next_attempt WHEN hit THEN {NOW} + 86400 ELSE {NOW} + CAST(least(7200 * pow(2, coalesce(miss_count, 0)), 604800) AS BIGINT) END AS next_attempt,
        CASE WHEN a.pubkey IS NULL THEN miss_count WHEN hit THEN 0 ELSE coalesce(miss_count, 0) + 1 END AS miss_count, CASE WHEN a.pubkey IS NULL THEN uncrawled END AS uncrawled
        FROM p LEFT JOIN a ON a.pubkey = p.pubkey""",
    "gr_backfill_next": f"""WITH {_P} SELECT uid, CASE WHEN last_attempt IS NOT NULL AND next_attempt IS NULL THEN last_attempt + 86400 ELSE next_attempt END AS next_attempt,
        CASE WHEN last_attempt IS NOT NULL AND next_attempt IS NULL THEN 0 ELSE miss_count END AS miss_count FROM p""",
    "gr_touch": f"WITH {_P} SELECT uid, CASE WHEN pubkey IN (SELECT pubkey FROM p WHERE follower_count > 5 AND pubkey IS NOT NULL) AND coalesce(kind3createdat, 0) <> 0 THEN {NOW} ELSE last_db_update END AS last_db_update FROM p",
    "gr_remove_follow": f"{_PE} SELECT * FROM e WHERE (src + dst) % 3 <> 0",
    "gr_remove_nodes": f"{_PE} SELECT src, count(*) AS n FROM e WHERE src % 5 <> 0 AND NOT (dst % 5 = 0 AND dst IN (SELECT uid FROM p)) GROUP BY 1",
    "gr_no_followers": f"{_PE} SELECT uid AS node FROM p WHERE uid NOT IN (SELECT dst FROM e)",
    "gr_no_follows": f"{_PE} SELECT uid AS node FROM p WHERE uid NOT IN (SELECT src FROM e)",
    "gr_both": f"{_PE} SELECT uid AS node FROM p WHERE uid IN (SELECT src FROM e) AND uid IN (SELECT dst FROM e)",
    "gr_top_connected": f"{_PE}, {_DEG} SELECT *, in_degree + out_degree AS total FROM g ORDER BY total DESC, node LIMIT 20",
    "gr_recent": f"WITH {_P} SELECT uid, last_db_update FROM p WHERE last_db_update IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 20",
    "gr_oldest": f"WITH {_P} SELECT uid, last_db_update FROM p WHERE last_db_update IS NOT NULL ORDER BY 2, 1 LIMIT 20",
    "gr_nested": f"""{_PE}, q AS (SELECT src AS node FROM e GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 50), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM e)
        SELECT q.node AS root, a.dst AS first, b.dst AS second FROM q JOIN k a ON a.src = q.node AND a.k <= 10 LEFT JOIN k b ON b.src = a.dst AND b.k <= 5""",
    "gr_dense_index": f"""{_PE}, o AS (SELECT src AS node, (src * 1000000 + dst) * 2 AS place FROM e UNION ALL SELECT dst, (src * 1000000 + dst) * 2 + 1 FROM e)
        SELECT node, row_number() OVER (ORDER BY min(place)) - 1 AS idx FROM o GROUP BY node""",
    "gr_duplicate_nodes": "SELECT pubkey, count(*) - 1 AS extra FROM profile_snapshot WHERE snapshot_no = 4 AND pubkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "gr_invalid_keys": f"WITH {_P} SELECT uid FROM p WHERE pubkey IS NULL OR NOT regexp_full_match(pubkey, '[0-9a-f]{{64}}')",
    "gr_profile_authors": f"WITH {_P} SELECT uid, events FROM p JOIN (SELECT pubkey, count(*) AS events FROM seed_events GROUP BY 1) l ON l.pubkey = p.pubkey",
}
ORACLE["gr_keep_best"] = """SELECT CAST(rank AS INTEGER) AS rank, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY pubkey ORDER BY kind3createdat DESC NULLS LAST, last_db_update DESC NULLS LAST, CAST(uid AS VARCHAR)) AS rank
    FROM profile_snapshot WHERE snapshot_no = 4 AND pubkey IN (SELECT pubkey FROM profile_snapshot WHERE snapshot_no = 4 AND pubkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) GROUP BY 1"""
ORACLE["gr_components"] = f"""WITH RECURSIVE {_P}, {_E}, m AS (SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst),
    r AS (SELECT a AS node, a AS other FROM m UNION SELECT r.node, m.b FROM r JOIN m ON m.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY 1"""
ORACLE["gr_upsert"] = ORACLE["gr_list_edges"]


def _fixpoint(rounds: int = 24) -> str:
    """``t`` (node, round): the trust fixpoint (k = 2) of the twenty smallest sources, one table a round; more rounds than
    there are change nothing."""
    steps = ["t0 AS MATERIALIZED (SELECT src AS node, 0 AS round FROM (SELECT DISTINCT src FROM e ORDER BY src LIMIT 20))"]
    for i in range(rounds):
        steps.append(f"""t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} UNION ALL SELECT dst, {i + 1} FROM e JOIN t{i} ON src = node
            WHERE dst IS NOT NULL AND dst NOT IN (SELECT node FROM t{i}) GROUP BY dst HAVING count(*) >= 2)""")
    return ", ".join([*steps, f"t AS (SELECT * FROM t{rounds})"])


_CLOSED = f"WITH {_P}, {_E}, {_fixpoint()}"
_SCAN = _CLOSED + """, tf AS (SELECT dst AS node, count(*) AS trusted_followers FROM e WHERE src IN (SELECT node FROM t) GROUP BY 1), tg AS (SELECT src AS node, count(*) AS trusted_followees FROM e WHERE dst IN (SELECT node FROM t) GROUP BY 1),
    w AS (SELECT node, coalesce(trusted_followers, 0) AS trusted_followers, coalesce(trusted_followees, 0) AS trusted_followees, coalesce(trusted_followers, 0) + coalesce(trusted_followees, 0) AS weight
        FROM tf FULL JOIN tg USING (node) WHERE node NOT IN (SELECT node FROM t))"""
_THREE = """h1 AS (SELECT node AS bridge, dst AS node FROM w JOIN e ON e.src = w.node WHERE weight BETWEEN 1 AND 2), h2 AS (SELECT * FROM h1 UNION SELECT bridge, dst FROM h1 JOIN e ON e.src = h1.node),
    r AS (SELECT * FROM h2 UNION SELECT bridge, dst FROM h2 JOIN e ON e.src = h2.node), c AS (SELECT * FROM r WHERE bridge <> node)"""
ORACLE |= {
    "gr_trust": f"{_CLOSED} SELECT node, CAST(round AS INTEGER) AS round FROM t",
    "gr_trust_endorsements": f"{_SCAN} SELECT * FROM w",
    "gr_trust_bridges": f"{_SCAN} SELECT * FROM w WHERE weight BETWEEN 1 AND 2",
    "gr_trust_beneath": f"{_SCAN}, {_THREE} SELECT bridge, count(*) AS n FROM c GROUP BY 1",
    "gr_trust_members": f"""{_SCAN}, {_THREE}, m AS (SELECT * FROM c WHERE node NOT IN (SELECT node FROM t))
        SELECT bridge, node FROM m WHERE bridge IN (SELECT bridge FROM m GROUP BY 1 HAVING count(*) >= 5)""",
    "gr_trust_clusters": f"""{_SCAN}, {_THREE} SELECT bridge, count(*) AS cluster_size, max(weight) AS weight, round(count(*) / max(weight), 6) AS score
        FROM c JOIN w ON w.node = c.bridge WHERE c.node NOT IN (SELECT node FROM t) GROUP BY 1 HAVING count(*) >= 5""",
}
ORACLE["gr_trust_report"] = ORACLE["gr_trust_clusters"]
