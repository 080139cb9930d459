"""Text and hash functions. What built-in expressions can say is a Column; the rest is an Arrow-batched UDF."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FNV-1a, 64 bits: fixed values
FNV_OFFSET, FNV_PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, 0xFFFFFFFFFFFFFFFF
# code points that start an emoji grapheme: fixed values
EMOJI = ((0x1F300, 0x1FAFF), (0x2600, 0x27BF), (0x1F1E6, 0x1F1FF), (0xFE00, 0xFE0F))
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@\s]*@)?([^/?#:@\s]+)"
# words by the default boundaries: apostrophes and full stops join what they stand in, a colon only letters ("nostr:npub1")
_W = r"[\p{L}\p{N}\p{M}_]"
_WORDS = regex.compile(rf"{_W}(?:(?:[\p{{L}}\p{{N}}\p{{M}}_'’.]|\p{{L}}:\p{{L}})*{_W})?")
_GRAPHEME = regex.compile(r"\X")


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & MASK
    return h


def fnv1a_many(texts: list[str]) -> np.ndarray:
    """FNV-1a of many short texts at once: byte columns instead of a loop for each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    h = np.full(len(raw), FNV_OFFSET, np.uint64)
    if not len(raw) or not size.max():
        return h
    flat = np.frombuffer(b"".join(raw), np.uint8)
    start = np.r_[0, np.cumsum(size)[:-1]]
    order = np.argsort(-size, kind="stable")
    live = len(raw)
    with np.errstate(over="ignore"):
        for i in range(int(size.max())):
            while live and size[order[live - 1]] <= i:
                live -= 1
            on = order[:live]
            h[on] = (h[on] ^ flat[start[on] + i]) * np.uint64(FNV_PRIME)
    return h


def collapse(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def collapse_py(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def compose(text: Column) -> Column:
    """Canonical composition, lower case, collapsed; null is the empty text."""
    @F.pandas_udf(T.StringType())
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: collapse_py(unicodedata.normalize("NFC", t)) if isinstance(t, str) else "")

    return nfc(text)


def unicode_words(text: str) -> list[str]:
    return _WORDS.findall(text)


def word_shingles(text: str, k: int = 3) -> list[str]:
    """Runs of ``k`` words; of a shorter text the text itself."""
    words = unicode_words(text)
    return [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [text]


def space_shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of ``k`` words between blanks of a collapsed text: the text itself if it has fewer, none if empty."""
    def body(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " "))
        return F.when(F.size(w) >= k, F.array_distinct(runs)).otherwise(F.array(F.array_join(w, " ")))

    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.array(F.split(text, " ")), body)[0])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are equal."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, F.lit(1.0)).otherwise(common / F.when(total == 0, F.lit(1)).otherwise(total))


def simhash_many(lists: list[list[str]]) -> np.ndarray:
    """The SimHash of each list of shingles: a bit is set if more of their hashes have it than not. All lists are hashed
    together; none may be empty."""
    if not lists:
        return np.zeros(0, np.uint64)
    sizes = np.array([len(x) for x in lists])
    h = fnv1a_many([s for x in lists for s in x])
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
    votes = np.add.reduceat(bits, np.r_[0, np.cumsum(sizes)[:-1]], axis=0, dtype=np.int32)
    return np.packbits(votes * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def simhash_bits(shingles: list[str]) -> int:
    return int(simhash_many([shingles])[0])


@F.pandas_udf(_longs("content_hash", "simhash"))
def fingerprint(text: pd.Series) -> pd.DataFrame:
    """Of the collapsed text: its FNV-1a hash, and the SimHash of its shingles of three words, both as bit patterns."""
    texts = [collapse_py(t) if isinstance(t, str) else "" for t in text]
    distinct = list(dict.fromkeys(texts))
    content, sim = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    for at in range(0, len(distinct), 1000):  # bounds the bits held at once
        part = distinct[at:at + 1000]
        content[at:at + 1000] = fnv1a_many(part).view(np.int64)
        sim[at:at + 1000] = simhash_many([word_shingles(t) for t in part]).view(np.int64)
    where = {t: i for i, t in enumerate(distinct)}
    pick = np.array([where[t] for t in texts], np.int64)
    return pd.DataFrame({"content_hash": content[pick], "simhash": sim[pick]})


@F.pandas_udf(T.LongType())
def fnv1a64(text: pd.Series) -> pd.Series:
    return pd.Series(fnv1a_many([t if isinstance(t, str) else "" for t in text]).view(np.int64))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def unsigned_hex(h: Column) -> Column:
    """Sixteen digits that sort as the unsigned number."""
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def url_hosts(text: Column) -> Column:
    """Lower-case hosts of the tokens between white space that are links with a host, in order. Read by pattern, as
    browsers do: the strict parser behind ``parse_url`` gives up at characters that are common in the wild."""
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t.contains("://"))
    return F.filter(F.transform(tokens, lambda t: F.lower(F.regexp_extract(t, HOST, 1))), lambda h: h != "")


def knee(value: Column, at: float) -> Column:
    """value / at up to 1; a knee of 0 or less turns the component off."""
    return F.least(value / F.lit(float(at)), F.lit(1.0)) if at > 0 else F.lit(0.0)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


@F.pandas_udf(T.StructType([T.StructField("bits", T.DoubleType()), T.StructField("length", T.LongType())]))
def char_entropy(text: pd.Series) -> pd.DataFrame:
    """Shannon bits a character and the number of characters; 0 and 0 for null and empty texts."""
    out = []
    for t in text:
        n = len(t) if isinstance(t, str) else 0
        out.append((math.log2(n) - sum(k * math.log2(k) for k in Counter(t).values() if k > 1) / n if n else 0.0, n))
    return pd.DataFrame(out, columns=["bits", "length"])


@F.pandas_udf(_longs("graphemes", "emoji", "words"))
def grapheme_counts(text: pd.Series) -> pd.DataFrame:
    out = []
    for t in text:
        if not isinstance(t, str):
            out.append((0, 0, 0))
            continue
        if t.isascii():
            out.append((len(_GRAPHEME.findall(t)) if "\r" in t else len(t), 0, len(_WORDS.findall(t))))
            continue
        gs = _GRAPHEME.findall(t)
        out.append((len(gs), sum(any(lo <= ord(g[0]) <= hi for lo, hi in EMOJI) for g in gs), len(_WORDS.findall(t))))
    return pd.DataFrame(out, columns=["graphemes", "emoji", "words"])
