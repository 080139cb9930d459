import random

import pytest

from quern.llm import topn
from quern.llm.topn import first_deliveries, top_n


@pytest.mark.parametrize("heap", [True, False])
@pytest.mark.parametrize("n", [1, 3, 50])
def test_against_brute_force(spark, monkeypatch, n, heap):
    monkeypatch.setattr(topn, "HEAP", heap and topn.HEAP)
    rng = random.Random(n)
    rows = [(rng.choice([*"aaaaaaaa", "b", None]), rng.choice([1, 2, None]), rng.choice([None, *range(5)]), i if rng.random() > 0.02 else None, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, h bigint, score bigint, ident bigint, items string")
    want = set()
    for key in {(g, h) for g, h, *_ in rows if g is not None and h is not None}:
        best = sorted(((s, i) for g, h, s, i, _ in rows if (g, h) == key and s is not None and i is not None), reverse=True)[:n]
        want |= {(*key, i, s, k + 1) for k, (s, i) in enumerate(best)}
    for parts in (1, 9):  # never a matter of order
        assert {tuple(r) for r in top_n(df.repartition(parts), ["g", "h"], "score", "ident", n).collect()} == want


def test_edges(spark):
    df = spark.createDataFrame([], "g string, score bigint, ident bigint")
    assert top_n(df, ["g"], "score", "ident", 3).count() == 0
    with pytest.raises(ValueError):
        top_n(df, ["g"], "score", "ident", 0)


def test_first_deliveries(spark):
    df = spark.createDataFrame([("e", 5, "a"), ("e", 3, None), ("f", 9, "b"), (None, 1, "c"), ("f", 9, "b")], "id string, lev bigint, v string")
    assert {tuple(r) for r in first_deliveries(df, "id", "lev", ["v"]).collect()} == {("e", 3, None), ("f", 9, "b")}


def test_both_ways_limit_before_the_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1, 1)], "g string, score bigint, ident bigint")
    plan = lambda: top_n(df, ["g"], "score", "ident", 2)._jdf.queryExecution().executedPlan().toString()
    assert topn.HEAP and plan().count("collect_top_k") >= 2
    monkeypatch.setattr(topn, "HEAP", False)
    assert "WindowGroupLimit" in plan() and "Partial" in plan()
