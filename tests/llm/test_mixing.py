import random

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing


def test_flow_takes_the_cheap_way():
    net = mixing.MinCostFlow(4)
    dear, cheap = net.arc(0, 1, 5, 9), net.arc(0, 2, 3, 1)
    net.arc(1, 3, 9)
    net.arc(2, 3, 9)
    assert net.run(0, 3) == 8 and (net.sent(dear), net.sent(cheap)) == (5, 3)


def test_plan_is_limited_by_the_smallest_source():
    plan = mixing.plan_mix({1: 1000, 2: 100}, [0.5, 0.5], [1, 4])
    assert 780 <= plan.total <= 802 and plan.routes[2, 1] == int(plan.total * 0.5)


def test_overlap_goes_where_it_is_needed():
    # records of both sources serve the one that has nothing else
    plan = mixing.plan_mix({1: 100, 3: 100}, [0.5, 0.5], [1, 1])
    assert plan.total >= 199 and plan.routes[3, 1] >= 99


def test_plan_without_anything():
    assert mixing.plan_mix({}, [1.0], [1]).routes == {} == mixing.plan_mix({0: 5}, [1.0], [1]).routes


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for source, n in (("big", 900), ("small", 60), ("other", 200), ("untargeted", 50)):
        for _ in range(n):
            i += 1
            rows.append((i, f"text {i}", source, rng.randint(1, 40), "x"))
    rows += [(i + k, f"text {k + 1}", "other", rows[k][3], "x") for k in range(1, 40)]  # equal texts elsewhere
    rows += [(9001, None, "big", 0, "x"), (None, "t", "big", 5, "x"), (9002, "u", None, 5, "x"), (9003, "", "small", 0, "x"), (9004, "v", "big", None, "x")]
    return spark.createDataFrame(rows, "doc bigint, text string, source string, n bigint, repeats string").cache()


TARGETS = [("big", 0.6, 1), ("small", 0.2, 3), ("other", 0.15, 2), ("nothing", 0.05, 5)]


def test_mix(records):
    chosen, plan = mixing.mix(records, "doc", "text", "source", "n", TARGETS)
    rows = chosen.collect()
    most = {s: r for s, _, r in TARGETS}
    uses, tokens = {}, {}
    for r in rows:
        uses[r["doc"]] = uses.get(r["doc"], 0) + r["repeats"]
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["repeats"] * r["n"]
        assert 1 <= r["repeats"] <= most[r["source"]]
    own = {r["doc"]: r["source"] for r in records.collect() if r["doc"] and r["source"]}
    assert all(own[d] in most and n <= max(most.values()) for d, n in uses.items())
    total = sum(tokens.values())
    for s, share, _ in TARGETS[:3]:
        assert tokens[s] / total == pytest.approx(share / 0.95, abs=0.02)
    assert total == pytest.approx(plan.total * 0.95, rel=0.02)
    again, _ = mixing.mix(records.repartition(5), "doc", "text", "source", "n", TARGETS)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    other, _ = mixing.mix(records, "doc", "text", "source", "n", TARGETS, seed=8)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, rows))


def test_buckets_do_not_change_the_choice(records, monkeypatch):
    a = sorted(map(tuple, mixing.mix(records, "doc", "text", "source", "n", TARGETS)[0].collect()))
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 50)
    assert sorted(map(tuple, mixing.mix(records, "doc", "text", "source", "n", TARGETS)[0].collect())) == a


def test_equal_texts_are_one_record(spark):
    df = spark.createDataFrame([(3, "t", "a", 10), (2, "t", "b", 10), (2, "t", "b", 10)], "doc bigint, text string, source string, n bigint")
    rows = mixing.mix(df, "doc", "text", "source", "n", [("a", 0.5, 1), ("b", 0.5, 1)])[0].collect()
    assert {r["doc"] for r in rows} == {2} and sum(r["repeats"] for r in rows) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc bigint, text string, source string, n bigint")
    for targets in (TARGETS, []):
        chosen, plan = mixing.mix(df, "doc", "text", "source", "n", targets)
        assert chosen.count() == 0 and plan.total == 0 and chosen.columns == ["doc", "source", "repeats", "n"]
    assert F is not None


def test_any_number_of_sources(spark):
    """A hundred sources, some of whose texts are held by several."""
    rows = [(i, f"t{i // 2 if i % 5 == 0 else i}", f"s{i % 100:02d}", 10) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc bigint, text string, source string, n bigint")
    chosen, plan = mixing.mix(df, "doc", "text", "source", "n", [(f"s{k:02d}", 0.01, 2) for k in range(100)])
    got = {r["source"]: r["t"] for r in chosen.groupBy("source").agg(F.sum(F.col("n") * F.col("repeats")).alias("t")).collect()}
    assert len(got) == 100 and max(got.values()) - min(got.values()) <= 40 and plan.total > 0
