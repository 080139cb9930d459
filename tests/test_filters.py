import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import events as E
from quern.plans.filters import Cursor, EventFilter, InvalidCursor, compile_filter, expired

A, B = "a" * 64, "b" * 64
# (lev_id, author, kind, time, tags): equal times, kinds and times about 255/256
ROWS = [
    (1, A, 2, 1700000000, []), (2, A, 256, 1700000000, []), (3, A, 255, 1700000000, []), (4, B, 1, 1700000000, []), (5, A, 1, 1700000255, []),
    (6, A, 1, 1700000255, [["e", A]]), (7, A, 1, 1700000256, []), (8, A, 1, 1700000256, [["e", A], ["t", "x"]]), (9, A, 2, 1710000000, []), (10, B, 1, 1710000000, [["t", "x"], ["p"]]),
    (11, A, 1, 1720000000, [["e", A], ["expiration", "1800000000"]]),
]


@pytest.fixture(scope="module")
def log(spark):
    rows = [(lev, f"{lev:064x}", pk, at, kind, tags, "", "") for lev, pk, kind, at, tags in ROWS]
    return spark.createDataFrame(rows, "lev_id bigint, id string, pubkey string, created_at bigint, kind bigint, tags array<array<string>>, content string, sig string").cache()


def levs(df):
    return [r["lev_id"] for r in df.collect()]


def test_scan_orders(log):
    assert levs(E.range_scan(log, ["created_at"])) == list(range(1, 12))
    assert levs(E.range_scan(log, ["kind", "created_at"])) == [4, 5, 6, 7, 8, 10, 11, 1, 9, 3, 2]
    assert levs(E.range_scan(log, ["pubkey", "created_at"])) == [1, 2, 3, 5, 6, 7, 8, 9, 11, 4, 10]
    assert levs(E.range_scan(log, ["pubkey", "kind", "created_at"])) == [5, 6, 7, 8, 11, 1, 9, 3, 2, 4, 10]


def test_reverse_bound_is_inclusive_of_ties(log):
    assert levs(E.range_scan(log, ["created_at"], [1700000256], reverse=True, limit=3)) == [8, 7, 6]


@pytest.mark.parametrize("f, want", [
    (EventFilter(), [11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1]), (EventFilter(kinds=[255, 256]), [3, 2]), (EventFilter(authors=[B]), [10, 4]), (EventFilter(authors=[B.upper()]), []),
    (EventFilter(authors=["zz", B]), [10, 4]), (EventFilter(kinds=[]), []), (EventFilter(since=1700000255, until=1700000256), [8, 7, 6, 5]), (EventFilter(tags=[("e", [A])]), [11, 8, 6]),
    (EventFilter(tags=[("e", [A]), ("t", ["x", "y"])]), [8]), (EventFilter(tags=[("p", ["x"])]), []), (EventFilter(tags=[("expiration", ["1800000000"])]), []),
    (EventFilter(kinds=[1], tags=[("expiration", ["1800000000"])]), [11]), (EventFilter(kinds=[1], now=1800000000), [10, 8, 7, 6, 5, 4]), (EventFilter(kinds=[1], now=1799999999), [11, 10, 8, 7, 6, 5, 4]),
])
def test_filters(log, f, want):
    assert levs(E.page(log, f)) == want


@pytest.mark.parametrize("f", [EventFilter(kinds=[-1]), EventFilter(since=-1), EventFilter(since=2, until=1)])
def test_invalid_filters(f):
    with pytest.raises(ValueError):
        compile_filter(f)


@pytest.mark.parametrize("value, gone", [("0", False), ("", False), (None, False), ("abc", False), (" 5", False), ("-5", False), ("+5", True), ("5", True), ("99", False), ("9" * 30, False)])
def test_expiry(spark, value, gone):
    df = spark.createDataFrame([([["expiration", value]],), ([["expiration"]],), (None,)], "tags array<array<string>>")
    assert df.filter(expired(50)).count() == int(gone)


def test_pages_make_the_whole(log):
    for n in (1, 3, 4, 11, 500):
        got, after = [], None
        while True:
            rows, after = E.read_page(log, EventFilter(), n, after)
            got += [r["lev_id"] for r in rows]
            if after is None:
                break
        assert got == list(range(11, 0, -1))


def test_two_phase_page_is_the_page(log):
    assert levs(E.late_page(log, EventFilter(kinds=[1]), 4)) == levs(E.page(log, EventFilter(kinds=[1]), 4))


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_cursor_round_trip(ts, lev):
    c = Cursor(ts, lev)
    assert Cursor.decode(c.encode()) == c and len(c.encode()) == 24


@pytest.mark.parametrize("bad", ["", "abc", "AAAA", "!" * 24])
def test_bad_cursors(bad):
    with pytest.raises(InvalidCursor):
        Cursor.decode(bad)


def test_huge_cursor(log):
    assert log.filter(Cursor(2**64 - 1, 2**64 - 1).after()).count() == 11


def test_latest_per_author(log):
    top = E.latest_per_author(log, 1, 2, now=1800000000)
    assert sorted(levs(top)) == [4, 8, 10]  # 11 has expired, after it took a place
    assert sorted(levs(E.latest_per_author(log, 1, 1, authors=[B, B, "c" * 64]))) == [10]


def test_limits():
    assert [E.clamp_limit(x) for x in (None, 0, -3, 7, 10_000)] == [100, 1, 1, 7, 500]


def test_lookup_and_missing(log):
    want = log.sparkSession.createDataFrame([(0, 9), (1, 2), (2, 99)], "ord int, lev_id bigint")
    assert levs(E.lookup(log, want, "ord")) == [9, 2]
    assert levs(E.missing(log, want)) == [99]


def test_by_author_keeps_every_row(log):
    want = log.sparkSession.createDataFrame([(0, B), (1, "none"), (2, B)], "ord int, pubkey string")
    got = {r["ord"]: r["lev_ids"] for r in E.by_author(want, log.filter(F.col("kind") == 1)).collect()}
    assert got == {0: [4, 10], 1: [], 2: [4, 10]}


def test_empty_log(spark):
    empty = spark.createDataFrame([], "lev_id bigint, id string, pubkey string, created_at bigint, kind bigint, tags array<array<string>>, content string, sig string")
    assert E.stats(empty).first().asDict() == {"event_count": 0, "max_lev_id": 0, "db_version": 1}
    assert E.page(empty, EventFilter()).count() == 0 == E.authors(empty).count()


def test_index_keys(spark):
    from quern.functions import index_keys as K

    rows = [("00" * 32, 0), ("00" * 31 + "ff", 255), ("0f" * 32, 256), ("ff" * 32, 2**63 - 1), ("ab" * 31 + "9f", 1_700_000_255)]
    df = spark.createDataFrame(rows + [(None, None)], "k string, n bigint").select("k", "n", F.unhex("k").alias("b"))
    got = df.select("k", "n", F.lower(F.hex(K.successor(F.col("b")))).alias("s"), K.number_at_end(K.key(F.col("b"), K.number_bytes(F.col("n")))).alias("back")).collect()
    for r in got:
        after = int(r["k"], 16) + 1 if r["k"] else None
        assert r["back"] == r["n"] and r["s"] == (f"{after:064x}" if after and after < 1 << 256 else None)
    order = spark.createDataFrame([(i,) for i in (256, 255, 0, 1_700_000_256, 1_700_000_255)], "n bigint").orderBy(K.number_bytes(F.col("n")))
    assert [r[0] for r in order.collect()] == [0, 255, 256, 1_700_000_255, 1_700_000_256]
    v = spark.createDataFrame([("aB",), ("a" * 64,), ("A" * 64,), ("é",), (None,)], "v string").select(F.hex(K.value_bytes(F.col("v"))))
    assert [r[0] for r in v.collect()] == ["6142", "AA" * 32, "41" * 64, "C3A9", None]
