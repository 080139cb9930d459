import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import keys as K
from quern.functions import scalars as S
from quern.functions import text as X
from quern.operators import analysis as A
from quern.operators import gate
from quern.operators import layers as L

LOG = "lev_id bigint, id string, pubkey string, created_at bigint, kind bigint, tags array<array<string>>, content string, source string"


def log(spark, rows):
    """rows: (author, time, content, tags)"""
    return spark.createDataFrame([(i, f"{i:064x}", a, t, 1, tags, c, None) for i, (a, t, c, tags) in enumerate(rows)], LOG)


def by_author(df, *cols):
    return {r["pubkey"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_fnv_vectors():
    assert X.fnv1a(b"") == 0xCBF29CE484222325 and X.fnv1a(b"a") == 0xAF63DC4C8601EC8C and X.fnv1a(b"foobar") == 0x85944171F73967E8
    texts = ["", "a", "foobar", "é" * 50, "x" * 1000]
    assert [int(h) for h in X.fnv1a_many(texts)] == [X.fnv1a(t.encode()) for t in texts]


def test_simhash_is_a_strict_majority():
    for shingles in (["a b c"], ["a b c", "b c d"], ["x", "y", "z"], ["same"] * 4):
        h = [X.fnv1a(s.encode()) for s in shingles]
        want = sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in h) > len(h))
        assert X.simhash_bits(shingles) == want


def test_shingles(spark):
    df = spark.createDataFrame([("",), ("a b",), ("a b c",), ("a b c d a b c",)], "t string")
    got = {r["t"]: r["s"] for r in df.select("t", X.space_shingles(F.col("t")).alias("s")).collect()}
    assert got == {"": [], "a b": ["a b"], "a b c": ["a b c"], "a b c d a b c": ["a b c", "b c d", "c d a", "d a b"]}
    assert X.word_shingles("a b") == ["a b"] and X.word_shingles("") == [""]


def test_jaccard(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [round(r[0], 3) for r in df.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.333]


def test_collapse_and_compose(spark):
    df = spark.createDataFrame([(" A b\t\nC ",), ("é",), (None,)], "t string")
    assert [r[0] for r in df.select(X.collapse(F.col("t"))).collect()] == ["a b c", "é", None]
    assert [r[0] for r in df.select(X.compose(F.col("t"))).collect()] == ["a b c", "é", ""]


def test_hosts(spark):
    t = "see HTTPS://Ex_ample.com/a?b foo:bar mailto:x@y.z http://u:p@h.org:8080#f wss://r.example ://x http://"
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(X.url_hosts(F.col("t"))).first()[0] == ["ex_ample.com", "h.org", "r.example"]


def test_graphemes(spark):
    df = spark.createDataFrame([("a\U0001F44D\U0001F3FDb é",), ("\U0001F1E9\U0001F1EA",), ("",), (None,)], "t string")
    got = [tuple(r["g"]) for r in df.select(X.grapheme_counts("t").alias("g")).collect()]
    assert got == [(5, 1, 3), (1, 1, 0), (0, 0, 0), (0, 0, 0)] or got[0][:2] == (5, 1) and got[1:] == [(1, 1, 0), (0, 0, 0), (0, 0, 0)]


def test_identifiers():
    k = "3bf0c63fcb93463407af97a5e5ee64fa883d107ef9e558472c4eb9aaaefa459d"
    npub = "npub180cvv07tjdrrgpa0j7j7tmnyl2yr6yr7l8j4s3evf6u64th6gkwsyjh6w6"
    assert K.bech32_encode("npub", bytes.fromhex(k)) == npub
    assert [K.parse_identifier(t) for t in (k, k.upper(), f" {npub}\n", npub.upper(), K.bech32_encode("nprofile", b"\x01\x01x\x00\x20" + bytes.fromhex(k)))] == [k] * 5
    for bad in (None, "", "x", npub[:-1], npub[:-1] + "q", K.bech32_encode("nsec", bytes.fromhex(k)), K.bech32_encode("npub", b"short")):
        assert K.parse_identifier(bad) is None


def test_schnorr_vectors():
    # vectors 0 and 1 of the published standard
    ok = [("F9308A019258C31049344F85F89D5229B531C845836F99B08601F113BCE036F9", "0" * 64,
           "E907831F80848D1069A5371B402410364BDF1C5F8307B0084C55F1CE2DCA821525F66A4A85EA8B71E482A74F382D2CE5EBEEE8FDB2172F477DF4900D310536C0"),
          ("DFF1D77F2A671C5F36183726DB2341BE58FEAE1DA2DECED843240F7B502BA659", "243F6A8885A308D313198A2E03707344A4093822299F31D0082EFA98EC4E6C89",
           "6896BD60EEAE296DB48A229FF71DFE071BDE413E6D43F917DC8DCF8C78DE33418906D11AC976ABCCB20B091292BFF4EA897EFCB639EA871CFA95F6DE339E4B0A")]
    for k, m, s in ok:
        assert K.schnorr_verify(k, m, s)
        assert not K.schnorr_verify(k, m, s[:-1] + ("1" if s[-1] == "0" else "0"))
    assert not K.schnorr_verify(None, "", "zz")


def test_windows():
    assert S.next_window(10, 15) == (15, 20) and S.window_from(3, 5) == (3, 8)
    now = 1_700_000_000
    assert S.window_problem(now, now + 5, now) is None
    assert [S.window_problem(*w, now) for w in ((0, 5), (5, 5), (now, now + 366 * 86400), (1, 10))] == ["unset", "empty", "duration", "start"]
    assert [S.quorum_reached(d, 10, q) for d, q in ((8, 0.8), (7, 0.8), (10, 0))] == [True, False, False]
    assert [S.query_address(u) for u in ("http://h:8080/graphql", "http://h/query", "http://h/")] == ["http://h:8080/query", "http://h/query", "http://h/query"]


def test_last_tag_wins(spark):
    df = spark.createDataFrame([([["from", "1"], ["to", "9"], ["from", "3"], ["to"]],), ([],)], "tags array<array<string>>")
    assert [tuple(r[0]) for r in df.select(S.window_of_tags(F.col("tags"))).collect()] == [(3, 9), (None, None)]


def test_clamp(spark):
    df = spark.createDataFrame([(2**40,), (-(2**40),), (7,)], "v bigint")
    assert [r[0] for r in df.select(S.clamp_i32(F.col("v"))).collect()] == [2**31 - 1, -(2**31), 7]


@pytest.mark.parametrize("times, burst, gap, analyzed, rejected", [
    ([0, 12, 24, 36, 48], True, 12, 5, 0), ([0, 15, 30, 45, 60], True, 15, 5, 0), ([0, 15, 30, 45, 61], False, 15, 5, 0), ([i * 6000 for i in range(6)], False, 6000, 6, 0),
    ([5], False, None, 1, 0), ([-1, 4102444801, 10, 20], False, 10, 2, 2), ([7, 7, 7, 7, 7], True, 0, 5, 0), ([None, 3], False, None, 1, 1)])
def test_rates(spark, times, burst, gap, analyzed, rejected):
    got = by_author(A.rates(log(spark, [("x", t, "", []) for t in times])), "burst", "tightest_gap", "analyzed", "rejected")
    assert got == {"x": (burst, gap, analyzed, rejected)}


def test_bins(spark):
    b = A.time_bins(log(spark, [("x", t, "", []) for t in (100, 3699, 3700, 20000)] + [("y", 5, "", [])]))
    assert {(r["pubkey"], r["start"], r["n"]) for r in b.collect()} == {("x", 100, 2), ("x", 3700, 1), ("x", 18100, 1)}


def test_tags(spark):
    tags = [["p", "a"], ["p"], ["e"], [], ["t", "x"], [None, "y"], ["z", "w"]]
    many = [["p", str(i)] for i in range(21)]
    got = by_author(A.tag_summary(log(spark, [("x", 1, "", tags), ("x", 2, "", [["p", "b"]]), ("y", 1, "", many), ("z", 1, "", [["t", "q"]] * 16)])), "malformed_tags", "event_refs", "mass_mention", "stuffing", "outliers")
    assert got == {"x": (3, 1, False, False, 0), "y": (0, 0, True, False, 1), "z": (0, 0, False, True, 1)}
    top = A.top_tag_values(log(spark, [("x", 1, "", [["p", "b"], ["p", "a"]]), ("x", 2, "", [["p", "c"], ["p", "c"]])]), "p")
    assert [(r["value"], r["n"]) for r in top.collect()] == [("c", 2), ("b", 1), ("a", 1)]


def test_duplicate_clusters(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    a, b, c = base + " thirteen", base + " fourteen", base + " fourteen fifteen"
    got = {(r["pubkey"], r["kind"], r["n"]) for r in A.duplicate_clusters(log(spark, [
        ("x", 1, a, []), ("x", 2, b, []), ("x", 3, c, []), ("x", 4, "unlike all the others here", []), ("y", 1, "Same  text", []), ("y", 2, "same text", []), ("z", 1, None, []), ("z", 2, "", []), ("w", 1, a, [])])).collect()}
    assert got == {("x", "near", 3), ("y", "exact", 2), ("z", "exact", 2)}
    t = by_author(A.triage(log(spark, [("x", i, a, []) for i in range(5)] + [("y", 1, "q", [])])), "event_count", "burst", "near_dup", "tag_fan_out")
    assert t == {"x": (5, True, True, False), "y": (1, False, False, False)}


def test_duplicate_layer_against_pairs(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocab, k=25)) for _ in range(12)]
    rows = [("x", i, texts[i % 12] + (" extra" if i % 5 == 0 else ""), []) for i in range(40)] + [("few", i, "same", []) for i in range(4)] + [("all", i, None, []) for i in range(5)]
    got = by_author(L.duplicate_layer(log(spark, rows)), "value")
    h = [X.simhash_bits(X.word_shingles(X.collapse_py(c))) for a, _, c, _ in rows if a == "x"]
    want = sum(any(i != j and bin(h[i] ^ h[j]).count("1") <= 3 for j in range(40)) for i in range(40)) / 40
    assert got == {"x": pytest.approx(want), "few": 0.0, "all": 1.0}
    assert len({(r["pubkey"], r["content_hash"]) for r in L.fingerprints(log(spark, rows)).collect()}) == len({X.collapse_py(c) for a, _, c, _ in rows if a == "x"}) + 1


def test_link_layer(spark):
    url = lambda h: f"look http://{h}/p http://{h}/q"
    rows = [("same", i, url("Spam.example"), []) for i in range(6)] + [("six", i, url(f"h{i}.example"), []) for i in range(6)] + [("few", 1, url("a.b"), [])] + [("p", i, "", [["p"]] * 10) for i in range(5)]
    ev = {r["pubkey"]: (r["value"], json.loads(r["evidence"])) for r in L.link_layer(log(spark, rows)).collect()}
    assert ev["same"][1]["top_domain_share"] == 1.0 and ev["same"][1]["top_domain"] == "spam.example" and ev["same"][0] == 1.0
    assert ev["six"][1]["top_domain_share"] == pytest.approx(1 / 6) and ev["six"][1]["top_domain"] == "h0.example"
    assert ev["few"][0] == 0.0 and ev["p"][0] == 1.0 and ev["p"][1]["mean_p_tags"] == 10


def test_entropy_layer(spark):
    rng = random.Random(1)
    noise = "".join(chr(rng.randint(0x100, 0x2FFF)) for _ in range(400))
    ev = {r["pubkey"]: (r["value"], json.loads(r["evidence"])) for r in L.entropy_layer(log(spark, [
        ("low", 1, "ab " * 120, []), ("short", 1, "gm", []), ("high", 1, noise, []), ("tags", 1, "#a #b #c word", []), ("none", 1, None, []), ("emoji", 1, "\U0001F44D\U0001F44D a", [])])).collect()}
    assert ev["low"][0] == 1.0 and ev["low"][1]["entropy_bits"] < 2 and ev["short"][0] == 0.0 and ev["high"][0] == 1.0
    assert ev["tags"][0] == 1.0 and ev["none"][0] == 0.0 and ev["emoji"][0] == 1.0
    assert ev["short"][1]["entropy_bits"] == pytest.approx(1.0)


def test_combine(spark):
    sig = spark.createDataFrame([("a", L.LAYERS[1], 1.0), ("a", L.LAYERS[3], 1.0), ("b", L.LAYERS[0], 1.0)], "pubkey string, layer string, value double")
    got = by_author(L.combine(L.pivot_signals(sig)), "score", "suspected")
    assert got["a"][0] == pytest.approx(1 / (1 + math.exp(0.5))) and got["a"][1] == 0 and got["b"][0] == pytest.approx(1 / (1 + math.exp(3.2)))
    assert by_author(L.combine(L.pivot_signals(sig), {"_bias": -3.5}), "score", "suspected")["a"] == (0.5, 0)  # strictly above


def test_gate(spark):
    ok, other = "a" * 64, "b" * 64
    allowed = spark.createDataFrame([(ok,)], "pubkey string")
    ids = [f"{i:064x}" for i in range(8)]
    e = spark.createDataFrame([(ids[0], ok.upper(), 4, "x"), (ids[1], other, 1, "x"), (ids[2], other, 7, "x"), (ids[3], other, 1, "é" * 131_073), (ids[4], "zz", 1, "x"), (ids[5], None, 1, "x"), ("", other, 1, "x"), (ids[7], other, 0, "é" * 131_072)],
                              "id string, pubkey string, kind bigint, content string")
    got = [(r["action"], r["reason"], r["held"], r["cause"]) for r in gate.route(e, allowed).orderBy("id", "pubkey").collect()]
    assert sorted(got, key=str) == sorted([("reject", "malformed", False, None)] * 3 + [("accept", "allowed", False, None), ("reject", "not allowed", True, "keep"), ("reject", "not allowed", False, "kind"), ("reject", "not allowed", False, "size"), ("reject", "not allowed", True, "keep")], key=str)
    k = spark.createDataFrame([(ok.upper(),), (other,), (" ",), ("short",)], "pubkey string")
    assert {r["pubkey"]: r["allowed"] for r in gate.bulk_check(k, allowed).collect()} == {ok.upper(): True, other: False, "short": True}
    assert {r["pubkey"]: r["allowed"] for r in gate.bulk_check(k, allowed, unknown=False).collect()}["short"] is False
