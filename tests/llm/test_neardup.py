import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import neardup as N

WORDS = [f"w{i}" for i in range(400)]


def edits(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        match rng.randrange(4):
            case 0: words[i] = rng.choice(WORDS)
            case 1: words.insert(i, rng.choice(WORDS))
            case 2: words.pop(i)
            case 3: words.insert(rng.randrange(len(words)), words.pop(i))
    return words


def collection(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        base = rng.sample(WORDS, 40)
        texts += [" ".join(edits(rng, base, rng.randint(0, 14))) for _ in range(rng.randint(1, 5))]
    texts += [texts[0]] * 6 + [texts[1].upper() + "!"] + ["", " ", None, "one", "one", "!!!"]
    return texts


def brute(texts, threshold, tokens):
    sets = [(i, tokens(t)) for i, t in enumerate(texts)]
    sets = [(i, s) for i, s in sets if s]
    return {(i, j) for i, a in sets for j, b in sets if i < j and len(a & b) >= threshold * len(a | b) - 1e-9}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id bigint, text string, key string")


def word_set(t):
    return set(re.findall(r"[^\W_]+", (t or "").lower()))


def shingles(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("keep", [True, False])
@pytest.mark.parametrize("threshold, build, tokens", [(0.6, N.word_set, word_set), (0.8, N.shingle_set, shingles)])
def test_pairs_against_brute_force(spark, threshold, build, tokens, keep):
    texts = collection(1)
    got = {(r["id_a"], r["id_b"]) for r in N.NearDuplicates(frame(spark, texts), build(F.col("text")), threshold, 0.98, keep_sets=keep).pairs().collect()}
    want = brute(texts, threshold, tokens)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 20


@pytest.mark.parametrize("keep", [True, False])
def test_groups(spark, keep):
    texts = collection(2)
    n = N.NearDuplicates(frame(spark, texts), N.word_set(F.col("text")), 0.6, 0.999, keep_sets=keep)
    pairs = {(r["id_a"], r["id_b"]) for r in n.pairs().collect()}
    rows = {r["id"]: r for r in n.groups().collect()}
    for i, r in rows.items():
        assert r["links"] == sum(i in p for p in pairs)
    assert set(rows) == {i for p in pairs for i in p}
    assert all(rows[a]["group_id"] == rows[b]["group_id"] for a, b in pairs)


@pytest.mark.parametrize("keep", [True, False])
def test_repeated_rows_and_null_ids(spark, keep):
    rows = [(1, "a b c"), (1, "a b c"), (2, "c b a"), (None, "a b c"), (3, "x y z")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    assert [tuple(r) for r in N.NearDuplicates(df, N.word_set(F.col("text")), 0.6, keep_sets=keep).pairs().collect()] == [(1, 2)]


def test_many_copies_are_one_class(spark):
    df = spark.range(300).select("id", F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    n = N.NearDuplicates(df, F.col("tokens"), 0.6)
    assert n.classes.count() == 1 and n.candidates().count() == 0 and n.pairs().count() == 300 * 299 // 2
    assert {(r["id"], r["links"]) for r in n.groups().collect()} == {(i, 299) for i in range(300)}


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, tokens array<string>")
    for keep in (True, False):
        n = N.NearDuplicates(df, F.col("tokens"), 0.6, keep_sets=keep)
        assert n.pairs().count() == 0 == n.groups().count()


def test_very_long_text(spark):
    rng = random.Random(3)
    words = rng.choices(WORDS, k=30_000)
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:29_900]))], "id bigint, text string")
    for keep in (True, False):
        assert N.NearDuplicates(df, N.shingle_set(F.col("text")), 0.8, keep_sets=keep).pairs().count() == 1


def test_bands_reach_the_recall():
    for threshold, recall in ((0.6, 0.95), (0.8, 0.95), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = N.choose_bands(threshold, recall)
        assert bands <= 64 and 1 - (1 - threshold**rows) ** bands >= recall
    with pytest.raises(ValueError):
        N.choose_bands(0.01, 0.999, most=4)


@pytest.mark.parametrize("keep", [True, False])
def test_least_tokens(spark, keep):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "a b"), (4, "a b")], "id bigint, text string")
    assert [tuple(r) for r in N.NearDuplicates(df, N.word_set(F.col("text")), 0.6, least=3, keep_sets=keep).pairs().collect()] == [(1, 2)]


def test_sketch_loses_no_more_than_it_says():
    """The share of pairs right at the threshold that fall below the floor, from the binomial distribution; and bands for both."""
    from math import comb

    for threshold in (0.5, 0.6, 0.8):
        p = (1 + threshold) / 2
        lost = sum(comb(N.SKETCH_BITS, k) * p**k * (1 - p) ** (N.SKETCH_BITS - k) for k in range(N._sketch_floor(threshold)))
        bands, rows = N.choose_bands(threshold, 0.95 / (1 - N.SKETCH_LOSS))
        assert lost < 2 * N.SKETCH_LOSS and (1 - (1 - threshold**rows) ** bands) * (1 - lost) >= 0.949


def test_without_sketch_nothing_is_ruled_out(spark):
    texts = [(f"{i}", " ".join(f"w{(i // 4) * 50 + j + (i % 4) * 2}" for j in range(20))) for i in range(80)]
    docs = spark.createDataFrame(texts, "id string, text string")
    pairs = lambda sketch: {tuple(r) for r in N.NearDuplicates(docs, N.word_set(F.col("text")), 0.6, sketch=sketch, recall=0.99).pairs().collect()}
    sets = {i: set(t.split()) for i, t in texts}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert pairs(False) >= pairs(True) and pairs(False) <= want and len(pairs(False)) >= 0.95 * len(want) > 0
