"""Hot keys and snapshot changes against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import random

import pytest

from quern.operators import hotkeys
from quern.operators.hotkeys import key_quantiles
from quern.operators.snapshots import follows_content, profile_change_details, snapshot_changes


def brute_quantiles(rows, permille):
    out = {}
    for k in {k for k, _ in rows if k is not None}:
        v = sorted(x for kk, x in rows if kk == k and x is not None)
        out[k] = (sum(kk == k for kk, _ in rows), len(v), *[v[max(1, -(-len(v) * p // 1000)) - 1] if v else None for p in permille])
    return out


@pytest.mark.parametrize("seed, span", [(1, 10), (2, 5_000), (3, 2**40), (4, 2**62)])
def test_quantiles(spark, seed, span):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None, "cold"]), rng.choice([None] + [rng.randint(-span, span) for _ in range(5)])) for _ in range(3000)] + [("one", 7), ("none", None)]
    # a column of any name beside them must not matter
    df = spark.createDataFrame([(k, v, 0, "x") for k, v in rows], "k string, v bigint, n_rows int, bin string")
    got = {r["key"]: (r["n_rows"], r["n_values"], r["q0"], r["q500"], r["q990"], r["q1000"]) for r in key_quantiles(df, "k", "v", [0, 500, 990, 1000]).collect()}
    assert got == brute_quantiles(rows, [0, 500, 990, 1000])


def test_minimum_share_counts_null_keys_as_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 30 + [("b", 2)] * 29 + [(None, 3)] * 41, "k string, v bigint")
    assert {r["key"] for r in key_quantiles(df, "k", "v", [500], 0.3).collect()} == {"a"}
    assert {r["key"]: r["n_rows"] for r in key_quantiles(df, "k", "v", [], 0.29).collect()} == {"a": 30, "b": 29}


def test_no_rows_at_all(spark):
    df = spark.createDataFrame([], "k string, v bigint")
    assert key_quantiles(df, "k", "v", [500]).count() == 0
    assert key_quantiles(df, "k", "v", [500], 0.02).count() == 0


def test_extreme_values(spark):
    lo, hi = -(2**63), 2**63 - 1
    df = spark.createDataFrame([("a", lo), ("a", hi), ("a", 0)], "k string, v bigint")
    r = key_quantiles(df, "k", "v", [1, 500, 1000]).first()
    assert (r["q1"], r["q500"], r["q1000"]) == (lo, 0, hi)


SCHEMA = "snapshot_no int, uid bigint, kind3createdat bigint, follows array<bigint>, change string, key string"


def changes(spark, rows):
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)
    return df, snapshot_changes(df, "snapshot_no", "uid", "kind3createdat", follows_content())


def test_changes(spark):
    rows = [
        (1, 1, 5, [1, 2]), (2, 1, 5, [2, 1, 1]),  # same set
        (1, 2, 5, None), (2, 2, 5, []),  # null is the empty set
        (1, 3, None, [1]), (2, 3, 0, [1]),  # null differs from 0
        (1, 4, 5, [1]), (2, 5, 5, [1]),  # removed, added
        (1, 6, 5, [1]), (2, 6, 6, [1]),  # version
        (1, 7, 5, [1]), (2, 7, 5, [1, 9]),  # set
        (1, 8, 9, [1]), (1, 8, 3, [7]), (1, 8, None, [8]), (2, 8, 9, [1]), (2, 8, 9, [1]),  # outdated and repeated rows
        (1, None, 1, [1]), (None, 1, 1, [1]), (1, 9, 5, [None, 3]), (2, 9, 5, [3]),
        (4, 1, 5, [1, 2]),  # there is no snapshot 3
    ]
    df, c = changes(spark, rows)
    got = {(r["snapshot_no"], r["key"], r["change"]) for r in c.collect()}
    assert {x for x in got if x[0] == 2} == {(2, 3, "changed"), (2, 4, "removed"), (2, 5, "added"), (2, 6, "changed"), (2, 7, "changed")}
    assert {x for x in got if x[0] == 4} == {(4, u, "removed") for u in (2, 3, 5, 6, 7, 8, 9)}
    detail = {(r["snapshot_no"], r["uid"]): r for r in profile_change_details(df, c).collect()}
    assert (detail[2, 7]["follows_in"], detail[2, 7]["follows_out"]) == (1, 0)
    assert (detail[2, 4]["old_kind3"], detail[2, 4]["new_kind3"], detail[2, 4]["follows_out"]) == (5, None, 1)


@pytest.mark.parametrize("rows", [[], [(1, 1, 1, [1])]])
def test_nothing_to_compare(spark, rows):
    df, c = changes(spark, rows)
    assert c.count() == 0 == profile_change_details(df, c).count()


def test_changes_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randint(1, 4), rng.randint(1, 60), rng.choice([None, 1, 2, 3]), rng.choice([None, [], [1], [1, 2], [2, 1]])) for _ in range(900)]
    best = {}
    for s, u, v, f in rows:  # equal versions must agree in content here
        f = [v or 0, u % 3] if v is not None else [9]
        best[s, u] = max(best.get((s, u), (-1, ())), ((-1 if v is None else v), tuple(sorted(set(f)))))
    rows = [(s, u, v, [v or 0, u % 3] if v is not None else [9]) for s, u, v, f in rows]
    _, c = changes(spark, rows)
    want = set()
    for s in (2, 3, 4):
        a, b = {u: x for (n, u), x in best.items() if n == s - 1}, {u: x for (n, u), x in best.items() if n == s}
        want |= {(s, u, "added") for u in b.keys() - a.keys()} | {(s, u, "removed") for u in a.keys() - b.keys()} | {(s, u, "changed") for u in a.keys() & b.keys() if a[u] != b[u]}
    assert {(r["snapshot_no"], r["key"], r["change"]) for r in c.collect()} == want


@pytest.mark.parametrize("few", [0, 3, 4096])
def test_refinement_and_single_sorts_agree(spark, monkeypatch, few):
    """Whether a key is refined or sorted as it is makes no difference; one key holds most rows, values are spread wide."""
    monkeypatch.setattr(hotkeys, "FEW", few)
    rng = random.Random(few)
    data = [("hot", rng.choice([rng.randint(-5, 5), rng.randint(-10**12, 10**12), 4096, 4095, None])) for _ in range(2000)]
    data += [(rng.choice(["a", "b", None]), rng.choice([rng.randint(0, 9), None])) for _ in range(200)] + [("void", None)]
    got = {r["key"]: [r[f"q{p}"] for p in (1, 500, 900, 1000)] for r in key_quantiles(spark.createDataFrame(data, "k string, v bigint"), "k", "v", [1, 500, 900, 1000]).collect()}
    for k in ("hot", "a", "b", "void"):
        v = sorted(x for key, x in data if key == k and x is not None)
        assert got[k] == [v[max(1, -(-len(v) * p // 1000)) - 1] if v else None for p in (1, 500, 900, 1000)]
    assert len(got) == 4


def test_details_are_of_the_row_that_counts(spark):
    """Of rows with one kind3createdat the details take the one the changes compared: a row that did not change shows none."""
    rng = random.Random(5)
    rows = []
    for uid in range(300):
        pair = [[rng.randint(1, 9) for _ in range(rng.randint(0, 3))] for _ in range(2)]
        rows += [(1, uid, 7, f, "", "") for f in pair] + [(2, uid, 7, f, "", "") for f in pair]
    df = spark.createDataFrame(rows, SCHEMA)
    assert snapshot_changes(df, "snapshot_no", "uid", "kind3createdat", follows_content()).count() == 0
    df = df.unionByName(spark.createDataFrame([(2, uid, 8, [100 + uid], "", "") for uid in range(0, 300, 3)], SCHEMA))
    changes = snapshot_changes(df, "snapshot_no", "uid", "kind3createdat", follows_content())
    seen = profile_change_details(df, changes).collect()
    assert len(seen) == 100 and all((r["old_kind3"], r["new_kind3"], r["follows_in"]) == (7, 8, 1) for r in seen)
    # the old side has one of the two sets, the one with the larger hash, which leaving shows
    sets = {}
    for s, uid, _, f, *_ in rows:
        if s == 1:
            sets.setdefault(uid, []).append(set(f))
    assert all(r["follows_out"] in {len(x) for x in sets[r["uid"]]} for r in seen)
    twice = profile_change_details(df.repartition(5), changes).collect()
    assert sorted(map(tuple, seen)) == sorted(map(tuple, twice))
