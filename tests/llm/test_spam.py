import random

import numpy as np
import pytest

from quern.llm import spam

SENTENCES = ["The lamp in the garden is green and the river runs past it.", "Nobody knows why the old bridge was closed in the spring.", "We moved the piano to the cellar because the roof was wet.",
             "If your relay drops too much, ask a friend about it.", "She wrote that the market would open after the rain."]
KEYS = ["cheap hosting", "casino bonus", "replica watch", "hair oil", "loan today"]


def pages():
    rng = random.Random(2)
    article = lambda n: " ".join(rng.choices(SENTENCES, k=n))
    word = lambda: "".join(rng.choices("abcdefgilmnoprstu", k=6))
    cases = [
        ", ".join(rng.choices(KEYS, k=60)), "\n".join(f"https://{word()}.example/{word()}" for _ in range(20)), " ".join(f"#{word()}" for _ in range(30)), " ".join(f"nostr:npub1{word()}{word()} @{word()}" for _ in range(12)),
        "\n".join(f"{word()} {word()} ABC-{rng.randint(10, 99)} {rng.randint(10, 99)}.90 sale" for _ in range(25)), " ".join(rng.choices(" ".join(KEYS).split(), k=200)),
        "Buy loan today now, loan today and hair oil. Looking for loan today? Best loan today, cheap hair oil, loan today online. Order hair oil hair oil today. " * 3,
        article(2) + "\n" + " * ".join(rng.choices(KEYS, k=80)), " | ".join(f"best {rng.choice(KEYS)} {word().title()}" for _ in range(40)), "\n".join(f'<a href="https://{word()}.example">{rng.choice(KEYS)}</a>' for _ in range(15)),
    ]
    fine = [article(n) for n in (1, 2, 5, 20, 60)] + [
        "\n".join(f"2025-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} 10:11:12 INFO relay {word()} stored event kind=1 in {rng.randint(1, 900)}ms" for _ in range(30)),
        article(8) + "\n#garden #river #lamp #bridge #piano", "\n".join(f"{word().title()}: {rng.choice(SENTENCES)}" for _ in range(20)), "\n".join(f"- {s}" for s in rng.choices(SENTENCES, k=20)), article(3) + " https://a.example/b",
        article(20) + "\n" + "\n".join(f"[{i}] https://{word()}.example" for i in range(5)), None, "", "  \n ", "ok", "静かな川は古い橋を渡る。明るい庭が短い夏を待つ。", "13", "...",
    ]
    return cases, fine


def test_features_are_shares():
    for t in [*pages()[0], *[x for x in pages()[1] if x]]:
        assert all(0 <= f <= 1 for f in spam.page_features(t)), t
    assert spam.page_features(None) == spam.page_features(" \n") == (0.0,) * 5


def test_cases_and_others(spark):
    cases, fine = pages()
    rng = random.Random(3)
    crowd = [" ".join(rng.choices(SENTENCES, k=rng.randint(1, 30))) for _ in range(300)]
    rows = [(i, t, rng.choice(["en", "EN", "en-XX", None, " en"]), 0.5) for i, t in enumerate(cases + fine + crowd + cases[:2])]
    df = spark.createDataFrame(rows, "doc bigint, text string, lang string, links double")
    got = {r["doc"]: r["is_spam"] for r in spam.spam_pages(df).collect()}
    wrong = [(i, t) for i, t, *_ in rows if got[i] != (i < len(cases) or i >= len(rows) - 2)]
    assert not wrong and len(got) == len(rows)


def test_japanese_keywords(spark):
    rng = random.Random(4)
    pick = lambda *of: rng.choice(of)
    sentence = lambda: f"{pick('静かな', '古い', '長い', '明るい', '寒い', '丸い')}{pick('川', '橋', '庭', '手紙', '時計', '図書館')}{pick('は', 'も', 'が')}{pick('短い', '暗い', '新しい', '珍しい')}{pick('夏', '窓', '傘', '市場', '財布')}を{pick('渡る', '待つ', '見つける', '描く', '直す')}。"
    keys = ["やすい くつ おすすめ", "かばん つうはん", "とけい さいやすね", "安い 靴 おすすめ"]
    cases = [" ".join(rng.choices(keys, k=40)), "\n".join(" ".join(rng.choices(keys, k=3)) for _ in range(20)), "cheap くつ おすすめ cheap かばん " * 25, "安い靴おすすめ通販" * 30, "やすいくつおすすめつうはん" * 30]
    fine = ["".join(sentence() for _ in range(rng.randint(1, 60))) for _ in range(200)] + ["".join(f"\n2025-01-1{i % 10} 10:11:12 INFO 中継を保存した" for i in range(30))]
    df = spark.createDataFrame([(i, t, "ja") for i, t in enumerate(cases + fine)], "doc bigint, text string, lang string")
    assert sorted(r["doc"] for r in spam.spam_pages(df).filter("is_spam").collect()) == list(range(len(cases)))
    assert all(0 <= x <= 1 for t in cases + fine for x in spam.page_features(t))


def test_a_language_of_spam_alone_or_of_one_row(spark):
    df = spark.createDataFrame([(1, ", ".join(KEYS * 20), "xx"), (2, SENTENCES[0], "yy"), (3, None, None)], "doc bigint, text string, lang string")
    assert spam.spam_pages(df).count() == 3


def test_empty(spark):
    df = spark.createDataFrame([], "doc bigint, text string, lang string")
    assert spam.spam_pages(df).count() == 0


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(1)
    x = rng.random((50, 5))
    feats = spark.createDataFrame([("en", *map(float, r)) for r in x], "page_lang string, " + ", ".join(f"{f} double" for f in spam.FEATURES))
    centre, scatter = np.full(5, 0.3), np.cov(x.T)
    got = spam.score_pages(feats, {"en": (centre, scatter)}).collect()
    z = (x - centre) / np.sqrt(np.diag(scatter))
    assert [r["distance"] for r in got] == pytest.approx([(r - centre) @ np.linalg.inv(scatter) @ (r - centre) for r in x])
    assert [r["spamward"] for r in got] == pytest.approx(list(z.sum(1) / np.sqrt((z**2).sum(1) * 5)))


def test_models_ignore_the_outliers(spark):
    """A twentieth of far rows moves neither centre nor scatter much."""
    rng = np.random.default_rng(2)
    bulk, far = rng.normal(0.3, 0.05, (1900, 5)), rng.normal(0.9, 0.02, (100, 5))
    frame = lambda x: spark.createDataFrame([("en", *map(float, r)) for r in x], "page_lang string, " + ", ".join(f"{f} double" for f in spam.FEATURES))
    (c0, s0), (c1, s1) = spam.robust_models(frame(bulk))["en"], spam.robust_models(frame(np.r_[bulk, far]))["en"]
    assert np.abs(c0 - c1).max() < 0.01 and np.abs(s0 - s1).max() < 0.002


def test_distance_and_direction_both_decide(spark):
    """On the stored pages leaving out either of the two flags other pages."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r = spam.spam_pages(docs).select("is_spam", "distance", "spamward").toPandas()
    both, far, toward = r.is_spam.sum(), (r.distance > spam.FAR).sum(), (r.spamward > spam.TOWARD).sum()
    assert 0 < both < far and both < toward


def test_no_jumps_with_size():
    """A page that grows by one piece moves by little: no count switches a feature on or off."""
    links = [f"https://a{i}.example/x" for i in range(30)]
    for make in (lambda n: "\n".join(links[:n]), lambda n: ", ".join(KEYS[i % 5] for i in range(n)), lambda n: "A lamp is in the hall. " + " ".join(links[:n])):
        seen = [spam.page_features(make(n))[1] for n in range(1, 30)]
        assert all(-0.05 < b - a < 0.16 for a, b in zip(seen, seen[1:])), seen
