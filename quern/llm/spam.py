"""Keyword-stuffed and link-list pages, as outliers of a robust Mahalanobis distance.

Each text becomes five graded features of density, repetition, entropy and function words. For every language a robust
centre and scatter are taken over all documents: medians first, then means and covariances of the rows that lie near,
taken anew until they settle, all from mergeable sums. A page is flagged if it lies far from the centre of its language
*and* the way there points to spam, that is towards more links, less in sentences, more repetition, less entropy and
fewer function words, in several of them together. Nothing else decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import Scratch

FEATURES = ["links", "outside", "repeats", "narrow", "bare"]
N = len(FEATURES)
#: quantile 0.999 of chi-square with five degrees of freedom: a page is far beyond it
FAR = 20.515
#: rows within the quantile 0.99 make up centre and scatter
NEAR = 15.086
#: a page points to spam within 60 degrees of equal deviations in all features
TOWARD = 0.5
#: every page is credited with so many words of ordinary text, so that short ones weigh little
CREDIT = 6.0
#: deviation that every feature has at least; rows of all languages that a language's own model is drawn to
WIDTH, SHARED = 0.1, 100.0
#: how often centre and scatter are taken anew
TURNS = 3
#: a run of CJK characters up to this long is a word
SHORT_RUN = 6

FUNCTION_WORDS = frozenset("""
the a an and or of to in on at for from with by is are was were be been that this these those it its as but not no than
then when while if which who what how why you your my our we i he she they there here only more too so some any all each
every between after before still does do did has have had can could will would should may might just about into over
under up down out off once one nobody someone everyone anyone please am me him her them their his us because until
el la los las un una unos unas y o de del al en con por para que se es son fue ni si como cuando donde desde hace pero
muy su sus mi tu lo le nadie ayer hay cada mejor otro otra salvo dice más está todavía
der die das den dem des ein eine einen einem eines und oder aber nicht kein keiner ist sind war hat haben seit mit von zu
zum zur im am auf aus bei für nach wenn dass ich du er sie es wir ihr mein dein noch nur viel jeden immer außer besser als
os as um uma uns umas e ou do da dos das na nos nas em com foi são não mas mais muito seu sua meu minha há ninguém ontem
ainda além outro les une et ou à au aux dans avec pour qui est sont ne pas mais très son sa mon ma ton il elle hier
personne sauf depuis encore mieux chaque trop autre car
""".split()) | {"", None}

_LINKISH = re.compile(r"<a\s[^>]*>[^<]*</a>|\[[^\]\n]*\]\([^)\n]*\)|(?:https?|wss?)://\S+|nostr:\w+|(?<!\w)@\w+|#[\w-]+")
_CUT = re.compile(r"[.!?…][ \t]+|[。！？]|[\r\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[぀-ゟ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_RUN = re.compile(r"[぀-ヿ㐀-鿿]+|[^\W\d_぀-ヿ㐀-鿿]+")
_PART = re.compile(r"[぀-ゟ]+|[^぀-ゟ]+")
_LOG = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d)")
_LABEL = re.compile(r"^\s*(?:[#>*\-–•]+\s+|\d+[.)]\s+)?(?:[^\s:]+(?: [^\s:]+){0,3}:\s+)?")
_MARKS = (",", ";", "|", "*", "•", "»", " / ", " - ")
_TAGGED = re.compile(r"(?<!\S)[A-Z]{2,}-\d+\b|(?<!\S)\d+\.\d\d(?!\S)")


def _cjk_words(text: str) -> tuple[list[str], int]:
    """Words of a piece with CJK characters, and the kana that stand between words. Runs of up to ``SHORT_RUN`` characters
    and Latin words stay whole. Longer runs are cut where kana begin or end, and the kana become "", as function words; runs
    of kana alone become character bigrams."""
    words, kana = [], 0
    for run in _RUN.findall(text):
        if len(run) <= SHORT_RUN or not _CJK.match(run):
            words.append(run)
            continue
        parts = _PART.findall(run)
        k = len(_KANA.findall(run))
        kana += k
        if k == len(run):
            words += [run[i:i + 2] for i in range(len(run) - 1)]
        else:
            words += ["" if _KANA.match(x) else x for x in parts]
    return words, kana


def _pieces(text: str) -> list[str]:
    """A text cut at line ends and behind the marks that end a sentence."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        i = m.start()
        out.append(text[at:i if text[i] in "\r\n" else i + 1])
        at = m.end()
    out.append(text[at:])
    return out


def _between(x: float, lo: float, hi: float) -> float:
    """0 up to ``lo``, 1 from ``hi`` on, in proportion between them."""
    return 0.0 if x <= lo else 1.0 if x >= hi else (x - lo) / (hi - lo)


def page_features(text: str | None) -> tuple[float, ...]:
    """(links, outside, repeats, narrow, bare), each 0 to 1; a text without words or links is all zeros.

    links: links, mentions and tags for all words and links. outside: the share of words and links that stand outside
    sentences, each piece between line ends and full stops counted by how unlike a sentence it is. repeats: share of
    content words in word pairs that recur. narrow: 1 less the entropy of content words against its maximum. bare: how
    far the share of function words falls short of 0.3. ``CREDIT`` words are added to every denominator."""
    if not text or not text.strip():
        return (0.0,) * N
    line: list = []  # the words of all pieces, None between two of them
    pieces = []
    n_links = n_all = n_function = 0
    plain = FUNCTION_WORDS.__contains__
    for chunk in _pieces(text):
        chunk = chunk.strip()
        if not chunk:
            continue
        linked, rest = 0, chunk
        if "#" in chunk or "@" in chunk or ":" in chunk or "<" in chunk or "](" in chunk:
            rest, linked = _LINKISH.subn(" ", chunk)
        phrase = None
        if not rest.isascii() and (cjk := len(_CJK.findall(rest))) >= 2:
            # characters of CJK words count in twos, kana between them as function words
            phrase = len(_KANA.findall(rest)) / cjk
            low, between = _cjk_words(rest.lower())
            n = cjk // 2 + sum(1 for w in low if w and not _CJK.match(w))
            f = min(n, between // 2)
        else:
            low = _WORD.findall(rest.lower())
            n, f = len(low), sum(map(plain, low))
        n_all += n + linked
        n_links += linked
        n_function += f
        if phrase is not None:  # kana between words do not part them
            low = [w for w in low if w]
        logged = chunk[0] in "[0123456789" and _LOG.match(chunk) is not None
        if not logged:
            line += low
            line.append(None)
        pieces.append((n, f, linked, low, rest, phrase, logged))
    words, pairs = Counter(line), Counter(zip(line, line[1:]))
    total = sum(k for w, k in words.items() if w not in FUNCTION_WORDS)
    often = {p for p, k in pairs.items() if k >= 3 and k * 200 >= total and not (plain(p[0]) or plain(p[1]))}
    hot = {w for w, k in words.items() if k >= 4 and k * 25 >= total and not plain(w)}
    outside, in_pairs = 0.0, 0
    for n, f, linked, low, rest, phrase, logged in pieces:
        if logged or not n:
            outside += linked
            continue
        own = max(1, len(low) - sum(map(plain, low)))
        held = sum(map(often.__contains__, zip(low, low[1:]))) if often else 0
        in_pairs += min(2 * held, own)
        stuffed = _between(held / own, 0.125, 0.25)
        if len(hot) > 1:
            stuffed = max(stuffed, _between(sum(map(hot.__contains__, low)) / own, 0.4, 0.6))
        last = rest.rstrip()[-1:]
        ended = last in ".!?…:\"”)" or last in "。！？"
        if phrase is not None:  # kana and an end make a sentence even of common words; without end only a short one is
            like = _between(phrase, 0.08, 0.16) * (1.0 if ended else 1 - _between(n, 24, 72))
            stuffed *= 1 - _between(phrase, 0.16, 0.32) if ended else 1.0
        else:
            like = _between(f / n, 0.0, 1 / 6)
            if like < 1 and ended:  # a short sentence may do without function words
                marks = sum(map(rest.count, _MARKS))
                like = max(like, (1 - _between(marks / n, 0.15, 0.3)) * (1 - _between(n, 16, 28)))
            if n > 2:
                like *= _between(len(set(low)) / n, 0.45, 0.6)
            if not f and _TAGGED.search(rest):
                like = 0.0
            if linked:
                like *= 1 - _between(linked / (n + linked), 0.4, 0.6)
        outside += n * (1 - like * (1 - stuffed)) + linked
    narrow = 0.0
    if total > 1:
        entropy = math.log(total) - sum(k * math.log(k) for w, k in words.items() if k > 1 and w not in FUNCTION_WORDS) / total
        narrow = (1 - entropy / math.log(total)) * total / (total + CREDIT)
    size = n_all + CREDIT
    bare = max(0.0, 0.3 - n_function / n_all) / 0.3 * n_all / size if n_all else 0.0
    return n_links / size, outside / size, min(1.0, in_pairs / (total + CREDIT)), narrow, bare


def features(df: DataFrame, text: str, lang: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``page_lang`` (two letters, or ``--``) and the features; columns of these
    names are replaced."""
    added = ["page_lang", *FEATURES]
    keep = [c for c in keep or df.columns if c not in added]

    @F.pandas_udf(", ".join(f"{f} double" for f in FEATURES))
    def run(texts: pd.Series) -> pd.DataFrame:
        known: dict[str | None, tuple[float, ...]] = {}
        for t in texts.unique():  # equal texts of a batch once
            known[t] = page_features(t if isinstance(t, str) else None)
        return pd.DataFrame([known[t] for t in texts], columns=FEATURES)

    code = F.lower(F.substring(F.trim(F.col(lang)), 1, 2))
    return df.select(*keep, F.coalesce(F.when(code.rlike("^[a-z]{2}$"), code), F.lit("--")).alias("page_lang"), run(F.col(text)).alias("_f")).select(
        *keep, "page_lang", *[F.col(f"_f.{f}").alias(f) for f in FEATURES])


Model = tuple[np.ndarray, np.ndarray]


def _table(spark: SparkSession, models: dict[str, Model]) -> DataFrame:
    """Centre and inverse scatter by language, row by row. A code has two letters or is ``--``: at most 677 rows, which is
    why the table may be broadcast."""
    rows = [(k, [float(x) for x in c], [float(x) for x in np.linalg.inv(s).ravel()], [float(x) for x in np.sqrt(np.diag(s))]) for k, (c, s) in models.items()]
    return F.broadcast(spark.createDataFrame(rows, "page_lang string, _centre array<double>, _inverse array<double>, _width array<double>"))


def score_pages(feats: DataFrame, models: dict[str, Model]) -> DataFrame:
    """``feats`` with ``distance`` (squared Mahalanobis distance from the centre of the language), ``spamward`` (cosine of
    the deviation, each feature in its own width, with equal deviations in all: 1 is straight to spam) and ``is_spam``."""
    spark = feats.sparkSession
    x = feats.join(_table(spark, models), "page_lang", "left") if models else feats.withColumn("_centre", F.lit(None).cast("array<double>")).withColumn(
        "_inverse", F.lit(None).cast("array<double>")).withColumn("_width", F.lit(None).cast("array<double>"))
    x = x.withColumn("_d", F.zip_with(F.array(*FEATURES), "_centre", lambda a, b: a - b)).withColumn("_z", F.zip_with("_d", "_width", lambda a, b: a / b))
    d, p, z, zero = F.col("_d"), F.col("_inverse"), F.col("_z"), F.lit(0.0)
    cells = F.sequence(F.lit(0), F.lit(N * N - 1))
    distance = F.aggregate(cells, zero, lambda t, i: t + F.get(d, F.floor(i / N).cast("int")) * F.get(d, i % N) * F.get(p, i))
    norm = F.sqrt(F.aggregate(z, zero, lambda t, v: t + v * v) * N)
    spamward = F.coalesce(F.try_divide(F.aggregate(z, zero, lambda t, v: t + v), norm), zero)
    out = x.withColumn("distance", F.coalesce(distance, zero)).withColumn("spamward", spamward)
    spam = (F.col("distance") > FAR) & (F.col("spamward") > TOWARD)
    return out.select(*[c for c in feats.columns if c not in ("distance", "spamward", "is_spam")], "distance", "spamward", spam.alias("is_spam"))


def robust_models(feats: DataFrame) -> dict[str, Model]:
    """Centre and scatter of each language (few, see ``_table``), from all rows.

    The start is the medians with a scatter of ``WIDTH``, widened by the quartiles. Each turn takes mean and covariance of
    the rows within ``NEAR`` of the model before. ``WIDTH`` is added to every feature, so that features that are constant
    on ordinary pages stay usable; and a language is drawn to the model of all languages by ``SHARED`` rows, so that one
    of few rows has a model too."""
    quarters = feats.groupBy("page_lang").agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 2000).alias(f) for f in FEATURES]).collect()
    models = {}
    for r in quarters:
        width = np.array([(r[f][2] - r[f][0]) / 1.349 for f in FEATURES])
        models[r["page_lang"]] = (np.array([r[f][1] for f in FEATURES]), np.diag(width**2 + WIDTH**2))
    pairs = [(i, j) for i in range(N) for j in range(i, N)]
    for _ in range(TURNS if models else 0):
        near = score_pages(feats.select("page_lang", *FEATURES), models).filter(F.col("distance") <= NEAR)
        sums = near.groupBy("page_lang").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
            *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i, j in pairs]).collect()
        moments = {}
        for r in sums:
            square = np.zeros((N, N))
            for i, j in pairs:
                square[i, j] = square[j, i] = r[f"p{i}{j}"]
            moments[r["page_lang"]] = (r["n"], np.array([r[f"s{i}"] for i in range(N)]), square)
        if not moments:
            break
        n, s, q = (sum(m[k] for m in moments.values()) for k in range(3))
        centre = s / n
        scatter = q / n - np.outer(centre, centre)
        for lang in models:
            own, s, q = moments.get(lang, (0, np.zeros(N), np.zeros((N, N))))
            c = (s + SHARED * centre) / (own + SHARED)
            spread = q - np.outer(s, s) / own if own else q
            models[lang] = (c, (spread + SHARED * scatter) / (own + SHARED) + np.eye(N) * WIDTH**2)
    return models


def spam_pages(df: DataFrame, text: str = "text", lang: str = "lang", scratch: Scratch | None = None, keep: list[str] | None = None) -> DataFrame:
    """Every document with its features, distance, direction and ``is_spam``, one row a row.

    Null, empty and blank texts are no case; texts are read whole; equal texts have equal results; a null or odd
    ``lang`` is a language of its own; an empty table gives no rows; clashing columns are replaced."""
    feats = features(df, text, lang, keep)
    if scratch is not None:
        feats = scratch.write(feats)
    return score_pages(feats, robust_models(feats))
