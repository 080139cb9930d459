"""The follow graph: lists, counts, levels, trust, bridges, clusters, communities, crawl scheduling.

Edges are ``(src, dst)``, distinct. Iterations run as a driver loop over DataFrames, each round written to the shared
folder, so that neither the plan grows nor a lost executor takes earlier rounds with it.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.communities import in_one_task
from quern.operators.ranking import global_rank
from quern.session import Scratch

# crawl schedule, in seconds: fixed values
HIT_EVERY, BASE, RATIO, CAP = 24 * 3600, 2 * 3600, 2.0, 168 * 3600


# -- follow lists -----------------------------------------------------------------------------------------------------
def latest_lists(events: DataFrame, kind: int = 3) -> DataFrame:
    """The newest follow list of each author; of equal times the first to arrive."""
    rows = events.filter((F.col("kind") == kind) & F.col("pubkey").isNotNull() & F.col("created_at").isNotNull())
    return rows.groupBy("pubkey").agg(F.max_by(F.struct("lev_id", "created_at", "tags"), F.struct(F.col("created_at"), -F.col("lev_id"))).alias("r")).select("pubkey", "r.*")


def followed_keys(tags: Column) -> Column:
    """Distinct valid keys of the ``p`` tags with at least two items."""
    p = F.filter(F.coalesce(tags, F.array().cast("array<array<string>>")), lambda t: (F.size(t) >= 2) & F.coalesce(F.get(t, F.lit(0)) == "p", F.lit(False)) & F.coalesce(F.get(t, F.lit(1)).rlike("^[0-9a-f]{64}$"), F.lit(False)))
    return F.array_distinct(F.transform(p, lambda t: F.get(t, F.lit(1))))


def list_edges(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("pubkey").alias("src"), F.explode(followed_keys(F.col("tags"))).alias("dst"))


def upsert_lists(edges: DataFrame, versions: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged ``(edges, versions)``. ``incoming`` is (pubkey, created_at, lev_id, tags); per author its newest version
    replaces all edges if it is newer than the stored one, else it is ignored. An empty list removes all edges."""
    new = latest_lists(incoming.withColumn("kind", F.lit(3)))
    newer = new.join(versions.select("pubkey", F.col("created_at").alias("_v")), "pubkey", "left").filter("_v is null or created_at > _v").drop("_v")
    kept = edges.join(newer.select(F.col("pubkey").alias("src")), "src", "left_anti")
    old = versions.join(newer.select("pubkey"), "pubkey", "left_anti")
    return kept.unionByName(list_edges(newer)), old.unionByName(newer.select("pubkey", "created_at"))


def list_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, change): edges 'added' and 'removed' between two edge tables; set differences, one shuffle."""
    both = old.select("src", "dst", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select("src", "dst", F.lit(0).alias("o"), F.lit(1).alias("n")))
    side = both.groupBy("src", "dst").agg(F.max("o").alias("o"), F.max("n").alias("n")).filter("o <> n")
    return side.select("src", "dst", F.when(F.col("n") == 1, "added").otherwise("removed").alias("change"))


# -- counts -----------------------------------------------------------------------------------------------------------
def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) of every node, zeros included; one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    d = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0).cast("bigint")
    return nodes.join(d, "node", "left").select("node", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def degree_summary(degrees_: DataFrame, column: str) -> DataFrame:
    """n, mean, maximum and the values at index (n-1)*p/100, rounded down, of the sorted degrees: from a histogram, as
    there are few distinct degrees."""
    h = degrees_.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("v")  # one row a distinct degree
    run = h.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p / 100), F.col("v")))
    return run.agg(F.max("n").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), *[at(p).alias(f"p{p}") for p in (25, 50, 75, 90, 99)], F.max("v").alias("max"))


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that follow each other: both directions of a pair meet in one group."""
    pair = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count_distinct(F.col("src")).alias("n"))
    return pair.filter("n = 2").select("a", "b")


def resolve_seed(profiles: DataFrame, pubkey: str):
    """The node of a key; an error if there is none."""
    row = profiles.filter(F.col("pubkey") == pubkey).agg(F.min("uid")).first()
    if row[0] is None:
        raise LookupError(f"no profile has the key {pubkey}")
    return row[0]


def flatten(nested: DataFrame) -> DataFrame:
    """Edges of ``nested(uid, follows: array<struct<uid>>)``; nodes without follows give none."""
    return nested.select(F.col("uid").alias("src"), F.explode("follows").alias("f")).select("src", F.col("f.uid").alias("dst")).filter("dst is not null")


# -- levels -----------------------------------------------------------------------------------------------------------
def levels(edges: DataFrame, seed, most: int = 0, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """((node, level), explored edges): hops from ``seed``, the shortest counts; ``most`` levels, 0 for all. Edges are
    explored from nodes that were expanded. A seed without edges is alone at level 0."""
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark)
    kind = edges.schema["src"].dataType
    reached = frontier = spark.createDataFrame([(seed, 0)], "node string, level int" if kind.simpleString() == "string" else "node bigint, level int")
    depth = 0
    while not most or depth < most:
        step = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = scratch.write(step.join(reached.select("node"), "node", "left_anti").select("node", F.lit(depth + 1).alias("level")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        depth += 1
    open_ = reached.filter(F.col("level") < most) if most else reached
    explored = edges.join(open_.select(F.col("node").alias("src")), "src", "left_semi")
    return reached, explored


def upstream_followers(levels_: DataFrame, explored: DataFrame) -> DataFrame:
    """(node, valid): followers strictly closer to the seed, for nodes that have any."""
    s = levels_.select(F.col("node").alias("src"), F.col("level").alias("ls"))
    d = levels_.select(F.col("node").alias("dst"), F.col("level").alias("ld"))
    return explored.join(s, "src").join(d, "dst").filter("ls < ld").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("valid"))


def weakly_followed(levels_: DataFrame, valid: DataFrame, beyond: int = 1, threshold: int = 2) -> DataFrame:
    """Nodes deeper than ``beyond`` with fewer than ``threshold`` valid followers, in order."""
    j = levels_.filter(F.col("level") > beyond).join(valid, "node", "left").select("node", F.coalesce("valid", F.lit(0)).alias("valid_follower_count"))
    return j.filter((F.col("valid_follower_count") < threshold) & (F.col("node").cast("string") != "")).orderBy("node")


# -- trust ------------------------------------------------------------------------------------------------------------
def trust_closure(edges: DataFrame, seeds: DataFrame, k: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(node, round): seeds, and whoever at least ``k`` trusted nodes follow, to the fixpoint.

    Each round adds only the followers that became trusted in the round before to running counts, so an edge is joined
    once over the whole run."""
    scratch = scratch or Scratch(edges.sparkSession)
    trusted = fresh = scratch.write(seeds.select("node").distinct().withColumn("round", F.lit(0)))
    counts, n = None, 0
    while not fresh.isEmpty():
        n += 1
        votes = edges.join(fresh.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("c"))
        both = votes if counts is None else counts.unionByName(votes).groupBy("node").agg(F.sum("c").alias("c"))
        counts = scratch.write(both.join(trusted.select("node"), "node", "left_anti"))
        fresh = scratch.write(counts.filter(F.col("c") >= k).select("node", F.lit(n).alias("round")))
        trusted = trusted.unionByName(fresh)
    return trusted


def endorsements(edges: DataFrame, trusted: DataFrame) -> DataFrame:
    """For nodes outside: trusted followers, trusted followees, and their sum."""
    t = trusted.select("node").distinct()
    inward = edges.join(t.withColumnRenamed("node", "src"), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("trusted_followers"))
    outward = edges.join(t.withColumnRenamed("node", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("trusted_followees"))
    j = inward.join(outward, "node", "full").join(t, "node", "left_anti")
    a, b = F.coalesce("trusted_followers", F.lit(0)), F.coalesce("trusted_followees", F.lit(0))
    return j.select("node", a.alias("trusted_followers"), b.alias("trusted_followees"), (a + b).alias("weight"))


def weak_bridges(edges: DataFrame, trusted: DataFrame, most: int = 2) -> DataFrame:
    return endorsements(edges, trusted).filter(F.col("weight").between(1, most)).orderBy("node")


def beneath(edges: DataFrame, bridges: DataFrame, depth: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """(bridge, node): what each bridge reaches in up to ``depth`` hops, itself left out; all bridges at once. The walk
    passes through trusted nodes, which are to be removed afterwards."""
    scratch = scratch or Scratch(edges.sparkSession)
    reached = fresh = scratch.write(bridges.select(F.col("node").alias("bridge"), "node").distinct())
    for _ in range(depth):
        step = fresh.join(edges, fresh["node"] == edges["src"]).select("bridge", F.col("dst").alias("node")).distinct()
        fresh = scratch.write(step.join(reached, ["bridge", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        reached = reached.unionByName(fresh)
    return reached.filter("bridge <> node")


def cluster_report(reached: DataFrame, trusted: DataFrame, bridges: DataFrame, least: int = 5) -> DataFrame:
    """Size of each bridge's cluster outside the trusted set, and size / weight, the largest first."""
    c = reached.join(trusted.select("node"), "node", "left_anti").groupBy("bridge").agg(F.count(F.lit(1)).alias("cluster_size")).filter(F.col("cluster_size") >= least)
    j = c.join(bridges.select(F.col("node").alias("bridge"), "weight"), "bridge")
    return j.withColumn("score", F.col("cluster_size") / F.col("weight")).orderBy(F.desc("score"), F.desc("cluster_size"), "bridge")


def cluster_members(reached: DataFrame, trusted: DataFrame, bridges: DataFrame, least: int = 5) -> DataFrame:
    """(bridge, node) of the clusters in ``cluster_report``, all of their nodes."""
    told = cluster_report(reached, trusted, bridges, least).select("bridge")
    return reached.join(trusted.select("node"), "node", "left_anti").join(told, "bridge", "left_semi").select("bridge", "node")


# -- crawl scheduling -------------------------------------------------------------------------------------------------
def backoff(misses: Column, base: int = BASE, ratio: float = RATIO, cap: int = CAP) -> Column:
    """base * ratio^misses up to the cap; base if there was no miss or the ratio does not grow."""
    first = min(base, cap)
    if ratio <= 1:
        return F.lit(first).cast("bigint")
    # powers beyond the cap are not computed, so nothing overflows
    grown = F.lit(float(base)) * F.pow(F.lit(float(ratio)), F.least(misses, F.lit(200)))
    return F.when(misses <= 0, F.lit(first)).otherwise(F.least(grown, F.lit(float(cap)))).cast("bigint")


def frontier(profiles: DataFrame, n: int, now: int) -> DataFrame:
    """The next ``n`` to crawl: never crawled first, then those that are due, each by followers; ties by key."""
    phase = F.when(F.col("uncrawled") == 1, 0).when(F.col("next_attempt") < now, 1)
    p = profiles.filter(F.col("pubkey").isNotNull()).withColumn("phase", phase).filter("phase is not null")
    return p.orderBy("phase", F.desc_nulls_last("follower_count"), "pubkey", "uid").limit(n)


def mark_attempted(profiles: DataFrame, attempts: DataFrame) -> DataFrame:
    """``attempts`` is (pubkey, ts, hit). A hit comes again after a day with no misses; a miss after the backoff of the
    old miss count, which then grows."""
    a = attempts.groupBy("pubkey").agg(F.max(F.struct("ts", "hit")).alias("a")).select("pubkey", F.col("a.ts").alias("_ts"), F.col("a.hit").alias("_hit"))
    j = profiles.join(a, "pubkey", "left")
    on, misses = F.col("_ts").isNotNull(), F.coalesce("miss_count", F.lit(0))
    new = {
        "last_attempt": F.col("_ts"), "uncrawled": F.lit(None).cast("int"),
        "next_attempt": F.when(F.col("_hit"), F.col("_ts") + HIT_EVERY).otherwise(F.col("_ts") + backoff(misses)),
        "miss_count": F.when(F.col("_hit"), 0).otherwise(misses + 1).cast("int"),
    }
    return j.select(*[F.when(on, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in profiles.columns])


def backfill_next_attempt(profiles: DataFrame, cadence: int = HIT_EVERY) -> DataFrame:
    due = F.col("last_attempt").isNotNull() & F.col("next_attempt").isNull()
    return profiles.withColumn("miss_count", F.when(due, 0).otherwise(F.col("miss_count")).cast("int")).withColumn(
        "next_attempt", F.when(due, F.col("last_attempt") + cadence).otherwise(F.col("next_attempt")))


def touch(profiles: DataFrame, keys: DataFrame, ts: int) -> DataFrame:
    """Sets ``last_db_update`` of the named profiles that have a follow list."""
    k = keys.select("pubkey").distinct().withColumn("_on", F.lit(True))
    hit = F.col("_on") & (F.coalesce("kind3createdat", F.lit(0)) != 0)
    return profiles.join(k, "pubkey", "left").select(*[F.when(hit, F.lit(ts)).otherwise(F.col(c)).alias(c) if c == "last_db_update" else F.col(c) for c in profiles.columns])


def remove_follow(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def remove_nodes(edges: DataFrame, nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = gone.select("node").distinct()
    e = edges.join(g.withColumnRenamed("node", "src"), "src", "left_anti").join(g.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return e.select("src", "dst"), nodes.join(g, "node", "left_anti")


# -- shapes -----------------------------------------------------------------------------------------------------------
def dense_index(edges: DataFrame) -> DataFrame:
    """(node, idx): 0, 1, ... in the order of first appearance, a source before its targets. ``edges`` has ``ord``.

    Numbered range by range, so no single task sorts all nodes."""
    first = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), (F.col("ord") * 2).alias("at")), F.struct(F.col("dst").alias("node"), (F.col("ord") * 2 + 1).alias("at")))).alias("e")).select("e.*").groupBy("node").agg(F.min("at").alias("at"))
    return global_rank(first, ["at"]).select("node", (F.col("idx") - 1).alias("idx"))


def nested_neighbours(edges: DataFrame, roots: DataFrame, a: int, b: int) -> DataFrame:
    """(root, first, second): for each root its first ``a`` followees, for each of those its first ``b``."""
    w = Window.partitionBy("src").orderBy("dst")
    top = lambda n: edges.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k")
    x = roots.select(F.col("node").alias("src")).join(top(a), "src").select(F.col("src").alias("root"), F.col("dst").alias("first"))
    y = top(b).select(F.col("src").alias("first"), F.col("dst").alias("second"))
    return x.join(y, "first", "left").select("root", "first", "second")


def louvain(edges: DataFrame, scratch: Scratch | None = None, rounds: int = 20, sweeps: int = 200, eps: float = 1e-7, within: int = 8_000_000) -> DataFrame:
    """(node, community): communities of the undirected graph in which each directed edge weighs 1.

    As soon as a level has no more than ``within`` pairs of neighbours, the first one included, one task on an executor
    runs all that is left over arrays (``communities.py``), node after node until no node gains, and then again from the
    first of its levels until that brings nothing either; no round of Spark is spent on a sweep there.

    Larger levels, by distributed local moving: in a sweep every node looks at the communities of its neighbours and
    takes the one with the best gain; half of the nodes, by a hash, may move at a time, which keeps neighbours from
    swapping, and then the other half. A level ends when no node gains by a move, or when two sweeps of both halves have not raised the best
    modularity by ``eps``; the best communities become the nodes of the next level. ``sweeps`` halves a level and
    ``rounds`` levels are caps: a warning says so where one ends the run.
    Community numbers are the smallest node in each. Self-loops are left out; nodes without edges have no row."""
    scratch = scratch or Scratch(edges.sparkSession)
    half = scratch.write(edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w")))
    if half.count() <= within:
        return _louvain_in_one_task(half, scratch, 0, rounds, sweeps, eps)
    g = scratch.write(half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    m2 = g.agg(F.sum("w")).first()[0]
    label = scratch.write(g.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    best = -1.0
    for level in range(rounds):
        if level and g.filter("a < b").count() <= within:
            up = _louvain_in_one_task(g.filter("a <= b"), scratch, level, rounds - level, sweeps, eps)
            label = scratch.write(label.join(up.select(F.col("node").alias("community"), F.col("community").alias("c")), "community").select("node", F.col("c").alias("community")))
            break
        nodes = g.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
        state = scratch.write(nodes.withColumn("c", F.col("node")))
        q_level, top, idle = None, state, 0
        for sweep in range(sweeps):
            total = state.groupBy("c").agg(F.sum("k").alias("tot"))
            to = g.filter("a <> b").join(state.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("w"))
            own = state.select("node", "c", F.lit(0.0).alias("w"))
            options = to.unionByName(own).groupBy("node", "c").agg(F.sum("w").alias("w")).join(total, "c").join(state.select("node", "k", F.col("c").alias("now")), "node")
            rest = F.col("tot") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
            gain = F.col("w") - rest * F.col("k") / m2
            pick = options.groupBy("node").agg(F.max_by(F.struct("c", gain.alias("g")), F.struct(F.round(gain, 9), -F.col("c"))).alias("best"), F.max(F.when(F.col("c") == F.col("now"), gain)).alias("stay"), F.first("k").alias("k"), F.first("now").alias("now"))
            may = F.pmod(F.xxhash64("node", F.lit(level * 1000 + sweep // 2)), F.lit(2)) == sweep % 2
            gains = F.col("best.g") > F.col("stay") + 1e-9
            moved = pick.select("node", "k", F.when(may & gains, F.col("best.c")).otherwise(F.col("now")).alias("c"), gains.alias("gains"))
            last, state = state, scratch.write(moved)
            if last is not top:
                scratch.drop(last)
            if sweep % 2 == 0 and sweep + 1 < sweeps:
                continue
            x = state.select("node", "c")
            inner = g.join(x.withColumnRenamed("node", "a").withColumnRenamed("c", "ca"), "a").join(x.withColumnRenamed("node", "b").withColumnRenamed("c", "cb"), "b").filter("ca = cb").agg(F.sum("w")).first()[0] or 0.0
            s = state.groupBy("c").agg(F.sum("k").alias("t"), F.count_if("gains").alias("n")).agg(F.sum(F.col("t") * F.col("t")), F.sum("n")).first()
            q = inner / m2 - s[0] / (m2 * m2)
            idle = 0 if q_level is None or q - q_level >= eps else idle + 1
            if q_level is None or q > q_level:
                q_level, top = q, state
            if not s[1] or idle == 2:
                break
        else:
            warnings.warn(f"louvain: level {level} was cut at {sweeps} half sweeps, modularity {q_level}", stacklevel=2)
        state = top
        if q_level is None or q_level - best < eps:
            break
        best = q_level
        x = state.select("node", "c")
        label = scratch.write(label.join(x.select(F.col("node").alias("community"), "c"), "community").select("node", F.col("c").alias("community")))
        g = scratch.write(g.join(x.withColumnRenamed("node", "a").withColumnRenamed("c", "ca"), "a").join(x.withColumnRenamed("node", "b").withColumnRenamed("c", "cb"), "b")
                          .groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    else:
        warnings.warn(f"louvain: cut at {rounds} levels, modularity {best}", stacklevel=2)
    names = label.groupBy("community").agg(F.min("node").alias("name"))
    return label.join(names, "community").select("node", F.col("name").alias("community"))


def _louvain_in_one_task(pairs: DataFrame, scratch: Scratch, level: int, rounds: int, sweeps: int, eps: float) -> DataFrame:
    """(node, community) of the pairs ``(a <= b, w)`` of a level; warns as ``louvain`` does."""
    kind = pairs.schema["a"].dataType.simpleString()
    rows = scratch.write(pairs.coalesce(1).mapInArrow(in_one_task(rounds, sweeps, eps), f"node {kind}, community {kind}, level int, q double"))
    for cut in rows.filter("node is null").collect():
        if cut["level"] < 0:
            warnings.warn(f"louvain: cut at {rounds + level} levels, modularity {cut['q']}", stacklevel=3)
        else:
            warnings.warn(f"louvain: level {cut['level'] + level} was cut at {sweeps} half sweeps, modularity {cut['q']}", stacklevel=3)
    return rows.filter("node is not null").select("node", "community")


def modularity(edges: DataFrame, label: DataFrame) -> float:
    e = edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    a = label.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    b = label.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    j = both.join(a, "a").join(b, "b")
    m2 = j.count()
    if not m2:
        return 0.0
    inner = j.filter("ca = cb").count() / m2
    return inner - (j.groupBy("ca").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] / (m2 * m2))


def keep_best(profiles: DataFrame) -> DataFrame:
    """Rows of keys held by several nodes, ranked: newest list, newest update, then the smallest uid as text; all but
    the first are to be purged."""
    w = Window.partitionBy("pubkey").orderBy(F.desc_nulls_last("kind3createdat"), F.desc_nulls_last("last_db_update"), F.col("uid").cast("string"))
    many = profiles.groupBy("pubkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and pubkey is not null").select("pubkey")
    return profiles.join(many, "pubkey", "left_semi").withColumn("rank", F.row_number().over(w))


def sampled_nodes(nodes: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``n`` nodes by seeded hash: the same whatever the partitions."""
    return nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(n)


def purge_invalid(profiles: DataFrame) -> DataFrame:
    """Profiles with a well-formed key; upper case is folded first."""
    return profiles.withColumn("pubkey", F.lower(F.trim("pubkey"))).filter(F.col("pubkey").rlike("^[0-9a-f]{64}$"))
