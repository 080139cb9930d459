import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators.components import connected_components
from quern.sources.frames import Bloom, GraphFrame
from quern.sources.synthetic import preferential_edges


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def as_dict(df, *cols):
    return {r[cols[0]]: (r[cols[1]] if len(cols) == 2 else tuple(r[c] for c in cols[1:])) for r in df.collect()}


@pytest.mark.parametrize("pairs, most, want", [
    ([(0, 1), (0, 2), (1, 2)], 0, {0: 0, 1: 1, 2: 1}), ([(0, 1), (0, 3), (1, 4), (3, 4)], 0, {0: 0, 1: 1, 3: 1, 4: 2}), ([(0, 1), (1, 0), (1, 2), (2, 3)], 2, {0: 0, 1: 1, 2: 2}), ([(5, 6)], 0, {0: 0}),
])
def test_levels(spark, pairs, most, want):
    assert as_dict(G.levels(edges(spark, pairs), 0, most)[0], "node", "level") == want


def test_upstream_followers(spark):
    lv, explored = G.levels(edges(spark, [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]), 0)
    assert as_dict(G.upstream_followers(lv, explored), "node", "valid") == {1: 1, 2: 1, 3: 2}


def test_weakly_followed_is_strict_and_sorted(spark):
    lv = spark.createDataFrame([("b", 2), ("a", 2), ("d", 3), ("c", 2), ("x", 1), ("", 2)], "node string, level int")
    valid = spark.createDataFrame([("a", 5), ("b", 1), ("c", 2), ("d", 1)], "node string, valid bigint")
    assert [r["node"] for r in G.weakly_followed(lv, valid).collect()] == ["b", "d"]


def test_trust_closure(spark):
    e = edges(spark, [(1, 3), (2, 3), (1, 4), (3, 4), (3, 5), (4, 5), (5, 6), (9, 6)])
    t = as_dict(G.trust_closure(e, spark.createDataFrame([(1,), (2,)], "node bigint")), "node", "round")
    assert t == {1: 0, 2: 0, 3: 1, 4: 2, 5: 3}


def test_bridges_and_clusters(spark):
    e = edges(spark, [(1, 2), (2, 1), (1, 10), (10, 11), (11, 12), (12, 10), (11, 1), (12, 13), (13, 14)])
    trusted = spark.createDataFrame([(1,), (2,)], "node bigint")
    b = G.weak_bridges(e, trusted)
    assert as_dict(b, "node", "trusted_followers", "trusted_followees", "weight") == {10: (1, 0, 1), 11: (0, 1, 1)}
    r = G.beneath(e, b, 2)
    assert {(x["bridge"], x["node"]) for x in r.collect()} == {(10, 11), (10, 12), (10, 1), (11, 12), (11, 1), (11, 10), (11, 13), (11, 2)}
    rep = as_dict(G.cluster_report(r, trusted, b, least=2), "bridge", "cluster_size", "score")
    assert rep == {10: (2, 2.0), 11: (3, 3.0)}


def test_cluster_scan_to_the_fixpoint(spark, monkeypatch):
    from quern import queries_graph as Q

    rng = np.random.default_rng(5)
    # seeds 0 to 19 trust 20 and 21, those trust 22: the fixpoint is two steps away
    pairs = {(i, j) for i in range(20) for j in (20, 21)} | {(20, 22), (21, 22)}
    pairs |= {(22, 100), (0, 101), (1, 102), (103, 22), (103, 21), (104, 2)}
    # beneath 101 a chain that widens at the third hop only
    pairs |= {(101, 110), (110, 111), *((111, x) for x in range(112, 118))}
    # within the outside only, so that nobody there becomes trusted
    pairs |= {(int(a), int(b)) for a, b in rng.integers(200, 260, (150, 2)) if a != b} | {(100, 200), (102, 201), (103, 202), (104, 203)}
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    trusted = set(range(20))
    while new := {n for n in {b for _, b in pairs} - trusted if sum(a in trusted for a, b in pairs if b == n) >= 2}:
        trusted |= new
    assert trusted == set(range(23))
    weight = {}
    for a, b in pairs:
        if a in trusted and b not in trusted:
            weight[b] = weight.get(b, 0) + 1
        if b in trusted and a not in trusted:
            weight[a] = weight.get(a, 0) + 1
    weight = {n: w for n, w in weight.items() if w <= 2}
    beneath, clusters = {}, {}
    for n, w in weight.items():
        seen = level = {n}
        for _ in range(3):
            level = {y for x in level for y in out.get(x, ())} - seen
            seen = seen | level
        if seen - {n}:
            beneath[n] = len(seen) - 1
        if len(c := seen - {n} - trusted) >= 5:
            clusters[n] = (len(c), w, round(len(c) / w, 6))
    assert 101 in clusters and set(weight.values()) == {1, 2}
    monkeypatch.setattr(Q, "graph", lambda spark, d: edges(spark, sorted(pairs)))
    assert as_dict(Q.gr_trust_bridges(spark, ""), "node", "weight") == weight
    assert set(as_dict(Q.gr_trust_endorsements(spark, ""), "node", "weight").items()) >= set(weight.items())
    assert as_dict(Q.gr_trust_beneath(spark, ""), "bridge", "n") == beneath
    assert as_dict(Q.gr_trust_clusters(spark, ""), "bridge", "cluster_size", "weight", "score") == clusters


@pytest.mark.parametrize("base, cap, want", [(7200, 604800, [7200, 14400, 28800, 57600, 115200, 230400, 460800, 604800]), (7200, 18000, [7200, 14400, 18000])])
def test_backoff(spark, base, cap, want):
    df = spark.createDataFrame([(i,) for i in range(len(want))], "m int")
    assert [r[0] for r in df.orderBy("m").select(G.backoff(F.col("m"), base, 2.0, cap)).collect()] == want
    big = spark.createDataFrame([(-4,), (100_000,)], "m int").orderBy("m").select(G.backoff(F.col("m"), base, 2.0, cap)).collect()
    assert [r[0] for r in big] == [base, cap]


def test_upsert_versions(spark):
    k = lambda c: c * 64
    stored = spark.createDataFrame([(k("a"), k("b")), (k("c"), k("d"))], "src string, dst string")
    versions = spark.createDataFrame([(k("a"), 10), (k("c"), 10)], "pubkey string, created_at bigint")
    new = spark.createDataFrame([
        (k("a"), 10, 1, [["p", k("e")]]), (k("c"), 11, 2, []), (k("f"), 5, 4, [["p", k("a")], ["p", k("a")], ["p", "bad"], ["p"], ["e", k("b")]]), (k("f"), 5, 9, [["p", k("c")]]),
    ], "pubkey string, created_at bigint, lev_id bigint, tags array<array<string>>")
    e, v = G.upsert_lists(stored, versions, new)
    assert {(r[0][0], r[1][0]) for r in e.select("src", "dst").collect()} == {("a", "b"), ("f", "a")}
    assert {(r[0][0], r[1]) for r in v.collect()} == {("a", 10), ("c", 11), ("f", 5)}


def test_list_delta(spark):
    d = G.list_delta(edges(spark, [(1, 1), (1, 2)]), edges(spark, [(1, 2), (1, 3)]))
    assert {(r["dst"], r["change"]) for r in d.collect()} == {(1, "removed"), (3, "added")}


def test_two_cliques_are_two_communities(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)])
    label = G.louvain(e)
    got = as_dict(label, "node", "community")
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert G.modularity(e, label) > 0.3


def settled(pairs):
    """Communities of a sequential run: a level ends when no node gains, as in the survey's G8."""
    w = {}
    for a, b in pairs:
        if a != b:
            w.setdefault(a, {}).setdefault(b, 0.0)
            w.setdefault(b, {}).setdefault(a, 0.0)
            w[a][b] += 1
            w[b][a] += 1
    m2 = sum(sum(x.values()) for x in w.values())
    label = {n: n for n in w}
    while True:
        k = {n: sum(x.values()) for n, x in w.items()}
        c, tot, any_moved, moved = {n: n for n in w}, dict(k), False, True
        while moved:
            moved = False
            for n in w:
                tot[c[n]] -= k[n]
                to = {c[n]: 0.0}
                for b, x in w[n].items():
                    if b != n:
                        to[c[b]] = to.get(c[b], 0.0) + x
                gain = {x: v - tot[x] * k[n] / m2 for x, v in to.items()}
                best = max(gain, key=lambda x: (gain[x], x == c[n]))
                if gain[best] > gain[c[n]] + 1e-9:
                    c[n], moved, any_moved = best, True, True
                tot[c[n]] += k[n]
        if not any_moved:
            return label
        label = {n: c[x] for n, x in label.items()}
        up = {}
        for a, x in w.items():
            for b, v in x.items():
                to = up.setdefault(c[a], {})
                to[c[b]] = to.get(c[b], 0.0) + v
        w = up


def test_louvain_settles_and_says_when_it_is_cut(spark, recwarn):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (700, 2)) if a // 10 == b // 10 or rng.random() < 0.1]
    e = edges(spark, pairs)
    want = G.modularity(e, spark.createDataFrame(list(settled(pairs).items()), "node bigint, community bigint"))
    assert G.modularity(e, G.louvain(e)) > want - 0.01
    assert not [w for w in recwarn if "louvain" in str(w.message)]
    with pytest.warns(UserWarning, match="cut at 2 half sweeps"):
        G.louvain(e, sweeps=2)


def planted(groups, size, inner, outer, seed):
    """Pairs of nodes 7, 10, 13, ... in groups of ``size``, some in both directions."""
    rng = np.random.default_rng(seed)
    n = groups * size
    a = rng.integers(0, n, inner)
    pairs = np.concatenate([np.stack([a, a // size * size + rng.integers(0, size, inner)], 1), rng.integers(0, n, (outer, 2))])
    return [(int(x) * 3 + 7, int(y) * 3 + 7) for x, y in np.unique(pairs, axis=0)]


def gain_left(pairs, label):
    """The most modularity that a move of one node to a neighbour's community would bring."""
    w, k, tot = {}, {}, {}
    for a, b in pairs:
        if a != b:
            for x, y in ((a, b), (b, a)):
                w.setdefault(x, {})
                w[x][label[y]] = w[x].get(label[y], 0) + 1
                k[x] = k.get(x, 0) + 1
                tot[label[x]] = tot.get(label[x], 0) + 1
    m2 = sum(k.values())
    at = lambda x, c: w[x].get(c, 0) - (tot[c] - (k[x] if c == label[x] else 0)) * k[x] / m2
    return max(at(x, c) - at(x, label[x]) for x in w for c in w[x]) * 2 / m2


def test_louvain_of_a_graph_that_fits_a_task_takes_few_jobs_and_leaves_no_gain(spark):
    pairs = planted(30, 40, 9000, 3000, 3)
    e = edges(spark, pairs)
    spark.sparkContext.setJobGroup("louvain", "louvain")
    try:
        label = G.louvain(e)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("louvain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 10, "rounds of Spark per sweep"
    got = as_dict(label, "node", "community")
    assert set(got) == {x for p in pairs for x in p if p[0] != p[1]}
    least = {}
    for node, c in got.items():
        least[c] = min(node, least.get(c, node))
    assert all(c == node for c, node in least.items())
    assert gain_left(pairs, got) < 1e-7
    want = settled(pairs)
    q = lambda x: G.modularity(e, spark.createDataFrame(list(x.items()), "node bigint, community bigint"))
    assert q(got) >= q(want)


def test_louvain_is_the_same_in_any_order_and_partitions(spark):
    pairs = planted(8, 20, 1200, 500, 4)
    once = as_dict(G.louvain(edges(spark, pairs)), "node", "community")
    assert once == as_dict(G.louvain(edges(spark, pairs[::-1]).repartition(5)), "node", "community")


def test_louvain_of_hubs_and_weighted_pairs(spark):
    """Two hubs of 600, beyond where arrays replace dictionaries, their members tied in both directions."""
    pairs = [(h, h * 1000 + i) for h in (1, 2) for i in range(600)] + [(h * 1000 + i, h) for h in (1, 2) for i in range(600)] + [(1000 + i, 2000 + i) for i in range(50)]
    got = as_dict(G.louvain(edges(spark, pairs)), "node", "community")
    assert got == {x: 1 if x == 1 or x // 1000 == 1 else 2 for p in pairs for x in p}


@pytest.mark.parametrize("within", [0, 300])
def test_louvain_of_levels_too_large_for_a_task(spark, within):
    """Sweeps over DataFrames for all levels, or until a level has 300 pairs and a task runs the rest."""
    pairs = planted(12, 20, 2000, 500, 5)
    e = edges(spark, pairs)
    label = G.louvain(e, within=within)
    got = as_dict(label, "node", "community")
    assert set(got) == {x for p in pairs for x in p if p[0] != p[1]} and all(got[c] == c and c <= n for n, c in got.items())
    assert G.modularity(e, label) > G.modularity(e, G.louvain(e)) - 0.01


def test_louvain_without_edges(spark):
    assert G.louvain(edges(spark, [(1, 1)])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = as_dict(connected_components(spark.createDataFrame(chain + [(None, 3), (3, None)], "a bigint, b bigint")), "node", "component")
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_a_star_and_random_edges(spark):
    rng = np.random.default_rng(3)
    pairs = [(0, i) for i in range(1, 200)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (250, 2)) if a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = as_dict(connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")), "node", "component")
    assert got == {x: find(x) for x in parent}


def test_degree_summary(spark):
    d = spark.createDataFrame([(i,) for i in [1, 2, 2, 3, 100]], "v bigint")
    r = G.degree_summary(d, "v").first()
    assert (r["n"], r["p25"], r["p50"], r["p75"], r["p90"], r["p99"], r["max"]) == (5, 2, 2, 3, 3, 3, 100)


def test_graph_frame_round_trip():
    f = GraphFrame(np.array([[0, 1], [1, 2]]), np.array([0, 1, 1]), np.array([1, 1, 0]), np.array([0, 0, 2]), np.array([-1, 0, 5]), np.array([7, 8, 9]), bytes(96))
    g = GraphFrame.decode(f.encode())
    assert g.edges.tolist() == [[0, 1], [1, 2]] and g.kind3.tolist() == [-1, 0, 5] and g.pubkeys == bytes(96) and f.encode()[:4] == b"WOTB"
    for bad in (b"", b"XXXX" + bytes(12), f.encode()[:-1]):
        with pytest.raises(ValueError):
            GraphFrame.decode(bad)


def test_bloom(spark):
    keys = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    f = Bloom.build(keys, "k", 1e-3)
    g = Bloom.decode(f.encode())
    assert g.etag == f.etag and keys.filter(g.may_contain(F.col("k"))).count() == 2000
    others = spark.range(2000, 12000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    assert others.filter(g.may_contain(F.col("k"))).count() < 25
    with pytest.raises(ValueError):
        Bloom.decode(f.encode()[:-1] + b"\xff" if f.encode()[-1:] != b"\xff" else f.encode()[:-1] + b"\0")


def test_preferential_edges(spark):
    e = preferential_edges(spark, 3000, 4, 1)
    got = sorted(map(tuple, e.collect()))
    assert len(got) == len(set(got)) and all(0 <= d < s for s, d in got) and 2 * 2999 < len(got) <= 4 * 2999
    again = preferential_edges(spark, 3000, 4, 1).repartition(3)
    assert got == sorted(map(tuple, again.collect())) and got != sorted(map(tuple, preferential_edges(spark, 3000, 4, 2).collect()))
    followers = sorted((r["count"] for r in e.groupBy("dst").count().collect()), reverse=True)
    assert followers[0] > 20 * followers[len(followers) // 2]  # a heavy tail
    assert preferential_edges(spark, 1).count() == 0 == preferential_edges(spark, 0).count()


def test_seed_samples_and_keys(spark):
    p = spark.createDataFrame([(1, "A" * 64), (2, "b" * 64), (3, "x"), (4, None)], "uid bigint, pubkey string")
    assert G.resolve_seed(p, "b" * 64) == 2
    with pytest.raises(LookupError):
        G.resolve_seed(p, "c" * 64)
    assert [r["uid"] for r in G.purge_invalid(p).orderBy("uid").collect()] == [1, 2]
    n = spark.range(100).withColumnRenamed("id", "node")
    assert [r[0] for r in G.sampled_nodes(n, 5).collect()] == [r[0] for r in G.sampled_nodes(n.repartition(7), 5).collect()]
    nested = spark.createDataFrame([(1, [(2,), (3,)]), (4, None), (5, [])], "uid bigint, follows array<struct<uid: bigint>>")
    assert {(r["src"], r["dst"]) for r in G.flatten(nested).collect()} == {(1, 2), (1, 3)}


def test_schedule(spark):
    s = "uid bigint, pubkey string, uncrawled int, next_attempt bigint, last_attempt bigint, miss_count int, follower_count bigint"
    p = spark.createDataFrame([(1, "a", None, 50, 10, 2, 9), (2, "b", 1, None, None, None, 1), (3, "c", None, 500, 10, 0, 99), (4, "d", 1, 5, 1, 0, 7), (5, "e", None, None, 10, 3, 5), (6, "f", None, 40, 10, 0, 9)], s)
    assert [r["uid"] for r in G.frontier(p, 10, 100).collect()] == [4, 2, 1, 6] and [r["uid"] for r in G.frontier(p, 3, 100).collect()] == [4, 2, 1]
    done = {r["uid"]: r for r in G.mark_attempted(p, spark.createDataFrame([("a", 100, False), ("b", 100, True), ("b", 90, False)], "pubkey string, ts bigint, hit boolean")).collect()}
    assert (done[1]["next_attempt"], done[1]["miss_count"]) == (100 + 28800, 3) and (done[2]["next_attempt"], done[2]["miss_count"], done[2]["uncrawled"]) == (100 + 86400, 0, None) and done[3]["next_attempt"] == 500
    assert {r["uid"]: r["next_attempt"] for r in G.backfill_next_attempt(p).collect()}[5] == 10 + 86400
