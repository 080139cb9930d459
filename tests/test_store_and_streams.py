import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import scalars

from quern.operators import store as St
from quern.operators import tune
from quern.operators.layers import LAYERS, WEIGHTS
from quern.sources import jsonl, payloads
from quern.streaming import events as S


def test_merge(spark):
    s = "k bigint, v string, t bigint"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], s)
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 9), (3, None, 1)], s)
    assert {tuple(r) for r in St.merge(old, new, ["k"], "t").collect()} == {(1, "a", 1), (2, "d", 9), (3, None, 1)}
    assert {tuple(r) for r in St.insert_new(old, new.filter("t <> 9"), ["k"]).collect()} == {(1, "a", 1), (2, "b", 1), (3, None, 1)}


def test_runs_are_replaced_not_mixed(spark, tmp_path):
    s = St.Store(spark, f"file://{tmp_path}/store")
    assert s.unfinished() is None and s.read("score").count() == 0
    with pytest.raises(ValueError):
        s.export()
    assert s.weights(WEIGHTS) == WEIGHTS
    s.write_small("weight", s.read("weight").withColumn("value", F.when(F.col("layer") == "_bias", -9.0).otherwise(F.col("value"))))
    assert s.weights(WEIGHTS)["_bias"] == -9.0
    row = lambda run, k, x: (run, k, x, 1, 0)
    cols = "run_id bigint, pubkey string, score double, suspected int, whitelisted int"
    for run, scores in ((1, [("a", 0.9), ("b", 0.7), ("c", 0.7), ("d", 0.5)]), (2, [("z", 0.6)])):
        s.begin_run(run, 100, 7, {"_threshold": 0.5})
        assert s.unfinished()["run_id"] == run
        for _ in range(2):  # written twice, stored once
            s.write_run("score", spark.createDataFrame([row(run, k, x) for k, x in scores], cols))
        s.finish_run(run, 200, 9)
    assert s.read("score").count() == 5
    assert [(r["pubkey"], r["rank"]) for r in s.export(1).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert [tuple(r) for r in s.export().collect()] == [(2, "z", 0.6, 1)] or s.export().first()["pubkey"] == "z"
    assert s.read("suspected_spammer").count() == 4 and s.read("run").filter("status = 'done'").count() == 2
    s.begin_run(3, 1, 1, {})
    with pytest.raises(ValueError):
        s.threshold(3)


def test_review_sample_is_the_same_each_time(spark):
    df = spark.createDataFrame([(1, f"{i:064x}", 0.1, int(i % 3 == 0)) for i in range(60)], "run_id bigint, pubkey string, score double, suspected int")
    a = [r["pubkey"] for r in St.review_sample(df, 10).collect()]
    from quern.functions.text import fnv1a
    want = sorted((f"{i:064x}" for i in range(60) if i % 3), key=lambda k: (fnv1a(k.encode()), k))[:10]
    assert a == want == [r["pubkey"] for r in St.review_sample(df.repartition(7), 10).collect()]


LABELS = [("s1", 1, 1.0, 1.0), ("s2", 1, 1.0, 0.9), ("s3", 1, 0.9, 1.0), ("h1", 0, 0.0, 0.0), ("h2", 0, 0.0, 0.05), ("h3", 0, 0.05, 0.0)]


def tune_inputs(spark, rows):
    labels = spark.createDataFrame([(k, y) for k, y, _, _ in rows], "pubkey string, is_spam int")
    sig = spark.createDataFrame([(k, layer, v) for k, _, a, b in rows for layer, v in ((LAYERS[1], a), (LAYERS[2], b))], "pubkey string, layer string, value double")
    return labels, sig


def test_tune_adopts_what_fits(spark):
    verdict, w = tune.tune(*tune_inputs(spark, LABELS))
    assert verdict == "adopted" and w[LAYERS[1]] > 0 and w[LAYERS[2]] > 0 and w["_threshold"] == 0.5


@pytest.mark.parametrize("rows, why", [([], "no labels"), ([r for r in LABELS if r[1]], "one class"), (LABELS + [("odd", 1, 0.0, 0.0)], "false negatives")])
def test_tune_blocks(spark, rows, why):
    verdict, w = tune.tune(*tune_inputs(spark, rows))
    assert verdict.startswith("blocked") and why in verdict and w == WEIGHTS


def test_payloads(spark):
    import zstandard

    event = json.dumps({"id": "i", "pubkey": "p", "created_at": 5, "kind": 1, "tags": [["t", "x"]], "content": "é", "sig": "s", "more": 1}).encode()
    words = zstandard.ZstdCompressionDict(event * 20)
    packed = b"\x01" + (7).to_bytes(4, "little") + zstandard.ZstdCompressor(dict_data=words).compress(event)
    rows = [(1, b"\x00" + event), (2, packed), (3, b"\x01\x07"), (4, b"\x05abc"), (5, b""), (6, b"\x00not json"), (7, packed[:-4]), (8, None), (9, b"\x01" + (8).to_bytes(4, "little") + packed[5:])]
    d = payloads.decode_payloads(spark.createDataFrame([(a, bytearray(b) if b is not None else None) for a, b in rows], "lev_id bigint, payload binary"), {7: words.as_bytes()})
    assert {r["lev_id"] for r in d.filter("error is null").collect()} == {1, 2, 6}
    p = {r["lev_id"]: (r["bad"], r["content"], r["tags"]) for r in payloads.parse_events(d).collect()}
    assert p[1] == p[2] == (False, "é", [["t", "x"]]) and p[6][0] and p[3][0]


def test_jsonl(spark, tmp_path):
    good = [{"id": f"{i:02x}" * 32, "pubkey": "p", "created_at": t, "kind": 1, "tags": [], "content": "", "sig": ""} for i, t in ((3, 10), (1, 20), (2, 10))]
    (tmp_path / "log.jsonl").write_text("\n".join([*map(json.dumps, good), "", "{broken", '{"id": "", "pubkey": "x"}', json.dumps(good[0] | {"content": "x" * 2**20})]))
    events, skipped = jsonl.read_events(spark, f"file://{tmp_path}/log.jsonl")
    assert [r["lev_id"] for r in jsonl.assign_lev_ids(events).orderBy("created_at", "id").collect()] == [1, 2, 3] and sorted(r["why"] for r in skipped.collect()) == ["malformed", "malformed", "too long"]
    jsonl.write_jsonl(events.select("id", "created_at"), f"file://{tmp_path}/out", ["created_at", "id"])
    assert spark.read.json(f"file://{tmp_path}/out").count() == 3


EVENTS = "lev_id bigint, id string, pubkey string, created_at bigint, kind bigint, tags array<array<string>>, source string, received_at timestamp"


def write_batches(spark, path, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(lev, idn, pk, at, kind, [["p", "a" * 64]], None) for lev, idn, pk, at, kind in rows], EVENTS.rsplit(",", 1)[0])
        df.withColumn("received_at", F.timestamp_seconds("created_at")).coalesce(1).write.mode("append").parquet(path)


def test_stream_agrees_with_batch(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    write_batches(spark, path, [[(1, "a", "x", 100, 1), (2, "b", "x", 104, 1), (3, "a", "x", 105, 1)], [(4, "c", "x", 111, 1), (5, "d", "y", 200, 3), (6, "b", "x", 109, 1)]])
    stream = lambda: S.event_stream(spark, path, files=1)
    got = {(r["start"], r["end"], r["kind"], r["n"]) for r in S.catch_up(spark, S.window_counts(stream(), 5, 200)).collect()}
    assert got == set()  # nothing is final yet
    got = {(r["start"], r["n"]) for r in S.catch_up(spark, S.window_counts(stream(), 5, 10)).collect()}
    assert got >= {(100, 2)} and (105, 3) not in got and all(s + 5 <= 190 for s, _ in got)
    assert sorted(r["id"] for r in S.catch_up(spark, S.without_repeats(stream()).select("id")).collect()) == ["a", "b", "c", "d"]


def test_a_newer_list_wins_however_late(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    write_batches(spark, path, [[(1, "a", "x", 100, 3), (2, "b", "y", 500, 3)], [(3, "c", "x", 90, 3), (4, "d", "y", 500, 3), (5, "e", "x", 101, 3)]])
    got = {r["pubkey"]: r["lev_id"] for r in S.LatestLists(spark).run(S.event_stream(spark, path, files=1)).collect()}
    assert got == {"x": 5, "y": 2}
    log = S.catch_up(spark, S.accepted_versions(S.event_stream(spark, path, files=1)))
    assert {(r["pubkey"], r["created_at"], r["lev_id"]) for r in log.collect()} == {("x", 100, 1), ("x", 101, 5), ("y", 500, 2)}


def test_forward_resumes(spark, tmp_path):
    path, seen = f"file://{tmp_path}/in", []
    write_batches(spark, path, [[(1, "a", "x", 100, 1)]])
    run = lambda: S.forward(spark, S.event_stream(spark, path), lambda df, n: seen.extend(r["lev_id"] for r in df.collect()), f"file://{tmp_path}/progress").awaitTermination()
    run()
    write_batches(spark, path, [[(2, "b", "x", 101, 1)]])
    run()
    assert seen == [1, 2]
    assert [S.sync_mode(t, 100) for t in (94, 95, 96)] == ["windowed", "windowed", "realtime"]


def test_monitor(spark, tmp_path):
    from quern.streaming.monitor import News, Progress

    path, seen = f"file://{tmp_path}/in", Progress().watch(spark)
    write_batches(spark, path, [[(1, "a", "x", 100, 1), (2, "b", "x", 101, 1)]])
    news = News()
    assert [news(spark.read.parquet(path)), news(spark.read.parquet(path))] == [False, False]
    q = S.forward(spark, S.event_stream(spark, path), lambda df, n: df.count(), f"file://{tmp_path}/p")
    q.awaitTermination()
    for _ in range(50):
        if seen.rows.get(str(q.id)):
            break
        __import__("time").sleep(0.1)
    spark.streams.removeListener(seen)
    assert seen.rows[str(q.id)] == 2 and not seen.failed
    write_batches(spark, path, [[(9, "c", "x", 102, 1)]])
    assert news(spark.read.parquet(path))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4_000_000_000), st.integers(1, 31_536_000))
def test_windows_are_contiguous_and_keep_their_length(start, seconds):
    a = scalars.window_from(start, seconds)
    b = scalars.next_window(*a)
    assert b[0] == a[1] and b[1] - b[0] == seconds


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 40)), min_size=1, max_size=60), st.integers(1, 9))
def test_group_rank_is_row_number(spark, rows, width):
    from quern.operators.ranking import global_rank, group_rank

    df = spark.createDataFrame([(g, t, i) for i, (g, t) in enumerate(rows)], "g string, t int, i int")
    order = sorted((g, t, i) for i, (g, t) in enumerate(rows))
    want, seen = {}, {}
    for g, _, i in order:
        seen[g] = want[i] = seen.get(g, 0) + 1
    assert {r["i"]: r["pos"] for r in group_rank(df, ["g"], F.floor(F.col("t") / width), ["t", "i"]).collect()} == want
    assert [r["i"] for r in global_rank(df, ["g", "t", "i"]).orderBy("idx").collect()] == [i for _, _, i in order]


def test_late_deliveries_count_in_the_delay(spark, monkeypatch):
    from quern import queries_store as Q

    day, at = 86_400, 1_740_000_000
    rows = [("a", at, at + 10), ("A/ ", at, at + 20 * day), ("a", at + 30, at), ("a", None, at), ("a", 9_999_999_999, at), ("b", at, at + 10 * day), ("c", -5, at), (None, at, at)]
    log = spark.createDataFrame(rows, "source string, created_at bigint, r bigint").select("source", "created_at", F.timestamp_seconds("r").alias("received_at"))
    monkeypatch.setattr(Q, "event_log", lambda spark, d: log)
    got = [tuple(r) for r in Q.io_relay_delay_whole(spark, "").select("relay", "n", "late", "early", "mean", "most", "rejected").collect()]
    assert got == [("a", 3, 1, 1, round((10 + 20 * day - 30) / 3, 3), 20 * day, 2), ("b", 1, 0, 0, 10.0 * day, 10 * day, 0), ("c", 0, 0, 0, None, None, 1)]


def test_broken_runs_go_on_behind_their_cursor(spark, tmp_path):
    s = St.Store(spark, f"file://{tmp_path}/store")
    authors = spark.createDataFrame([(f"{i:02d}",) for i in range(25)] + [("03",), (None,)], "pubkey string")
    asked = []

    def score(part, run_id, broken=None):
        keys = sorted(r[0] for r in part.collect())
        asked.append(keys)
        if broken in keys:
            raise OSError("gone")
        return part.select(F.lit(run_id).cast("bigint").alias("run_id"), "pubkey", F.lit(0.5).alias("score"), F.lit(0).alias("suspected"), F.lit(0).alias("whitelisted"))

    with pytest.raises(OSError):
        s.run_pages(authors, lambda p, r: score(p, r, "12"), 1, 1, {"_threshold": 0.5}, page=10)
    assert s.unfinished()["last_cursor"] == "09" and s.read("score").count() == 10
    # a page that was written without its cursor being moved
    s.write_page("score", score(authors.filter("pubkey between '10' and '19'").distinct(), 1), 1, "09", "19")
    asked.clear()
    assert s.run_pages(authors, score, 2, 2, {}, page=10) == 1
    assert [k[0] for k in asked] == ["10", "20"] and s.unfinished() is None
    assert sorted(r["pubkey"] for r in s.read("score").collect()) == [f"{i:02d}" for i in range(25)]
    assert s.run_pages(authors, score, 3, 3, {}, page=100) == 2 and s.read("score").count() == 50


def test_last_good_list_stands(spark, tmp_path):
    from quern.streaming.lists import AllowList, gated

    lists = [("v1", ["A" * 64, "b" * 64, "x"]), OSError("down"), ("v2", ["not a key"]), None, ("v3", ["c" * 64])]
    now, seen = [0.0], []

    def fetch(version):
        seen.append(version)
        got = lists.pop(0)
        if isinstance(got, Exception):
            raise got
        return got and (got[0], spark.createDataFrame([(k,) for k in got[1]], "pubkey string"))

    a = AllowList(spark, fetch, every=30, retry=1, clock=lambda: now[0])
    keys = lambda: sorted(r[0][0] for r in a.keys.collect())
    with pytest.raises(RuntimeError):
        gated(AllowList(spark, lambda v: None), lambda b, e: None)(spark.range(0), 0)
    assert not a.ready and a.refresh() and a.ready and keys() == ["a", "b"]
    assert not a.refresh() and seen == [None]  # not yet due
    now[0] = 30
    assert not a.refresh() and "down" in a.error and keys() == ["a", "b"] and a.due == 31
    now[0] = 31
    assert not a.refresh() and "without keys" in a.error and a.due == 33 and a.version == "v1"
    now[0] = 33
    assert not a.refresh() and a.error is None and seen == [None, "v1", "v1", "v1"]
    now[0] = 63
    out = []
    batch = spark.createDataFrame([("1" * 64, "c" * 64, 1, "x"), ("2" * 64, "a" * 64, 1, "x")], "id string, pubkey string, kind int, content string")
    gated(a, lambda b, e: out.extend((r["pubkey"][0], r["action"]) for r in b.collect()))(batch, 0)
    assert a.version == "v3" and sorted(out) == [("a", "reject"), ("c", "accept")]
    slept = []
    with pytest.raises(RuntimeError):
        AllowList(spark, lambda v: 1 / 0, clock=lambda: sum(slept)).wait(4, slept.append)
    assert slept == [1, 2, 4]


def test_chunks_shrink_and_pages_end():
    from quern.plans.filters import InvalidCursor
    from quern.plans.paging import answer, chunked, pages

    asked = []

    def ask(chunk):
        asked.append(len(chunk))
        if len(chunk) > 3 or 13 in chunk:
            raise TimeoutError
        return sum(chunk)

    got = list(chunked(range(20), ask, 8))
    assert [x for c, _, _ in got for x in c] == list(range(20)) and sum(r for _, r, _ in got if r is not None) == sum(range(20)) - 13
    assert [list(c) for c, _, e in got if e] == [[13]] and max(asked) == 8
    turns = iter([([1], "a"), ([2], "b"), ([], None)])
    assert list(pages(lambda c: next(turns))) == [[1], [2], []]
    with pytest.raises(RuntimeError):
        list(pages(lambda c: ([1], "same")))

    def fail(e):
        raise e

    assert answer(lambda: 5) == {"data": 5}
    assert [answer(lambda e=e: fail(e))["errors"][0]["code"] for e in (InvalidCursor("x"), ValueError("x"), LookupError("x"), OSError("x"))] == ["bad_cursor", "bad_input", "not_found", "internal"]


def test_forwarding_measured_and_in_slices(spark, tmp_path):
    path = f"{tmp_path}/in"
    write_batches(spark, path, [[(i, "a", "x", 100 + i, 1) for i in range(n)] for n in (200, 100, 300)])
    sizes = []
    publish = S.in_slices(lambda b, e: sizes.append(b.count()), 60)
    stream = S.event_stream(spark, path, files=1).withColumn("received_at", F.timestamp_seconds("created_at"))
    S.forward(spark, stream, S.measured(spark, publish, f"file://{tmp_path}/progress", 250)).awaitTermination()
    assert sum(sizes) == 600 and len(sizes) == 4 + 2 + 5 and max(sizes) < 120
    lines = spark.read.json(f"file://{tmp_path}/progress").collect()
    assert [r["events"] for r in sorted(lines, key=lambda r: r["epoch"])] in ([300, 300], [500], [400]) and all(r["longest_delay"] >= r["mean_delay"] > 0 for r in lines)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/in"
    write_batches(spark, path, [[(i, f"e{i}", f"p{i}", 100, 3) for i in range(50)], [(60, "e60", "p7", 200, 3), (61, "e61", "p8", 50, 3)]])
    lists = S.LatestLists(spark, 16)
    got = {r["pubkey"]: r["lev_id"] for r in lists.run(S.event_stream(spark, path, files=1)).collect()}
    assert len(got) == 50 and got["p7"] == 60 and got["p8"] == 8
    assert len({f.rsplit("/", 1)[0] for f in lists.folders.values()}) == 2 and len(lists.folders) > 8


def test_deletions_count_for_own_events_only(spark):
    from quern.operators import events as E

    rows = [(1, "i1", "a", 1, []), (2, "i2", "b", 1, []), (3, "d", "a", 5, [["e", "i1"], ["e", "i2"], ["p", "i2"], ["e"], [None]]), (4, "n", None, 5, [["e", "i2"]]), (5, None, "a", 1, None), (6, "i1", None, 1, [])]
    log = spark.createDataFrame(rows, "lev_id bigint, id string, pubkey string, kind bigint, tags array<array<string>>")
    assert sorted(r["lev_id"] for r in E.delete_ids(log, E.deletion_requests(log)).collect()) == [2, 3, 4, 5, 6]
    batches = E.deletion_batches(spark.range(1203).select(F.col("id").cast("string").alias("id")), 100).collect()
    assert sorted(int(i) for b in batches for i in b["ids"]) == list(range(1203)) and max(len(b["ids"]) for b in batches) <= 100 and len({b["batch"] for b in batches}) == len(batches)
