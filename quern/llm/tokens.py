"""Token counts of texts by a public byte-level tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("quern", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text as BIGINT; 0 for null and empty texts. Equal texts of a batch are counted once."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(vocabulary).encode_ordinary
        known: dict[str, int] = {}
        out = []
        for t in texts:
            if not isinstance(t, str) or not t:
                out.append(0)
                continue
            n = known.get(t)
            if n is None:
                try:
                    n = len(encode(t))
                except UnicodeEncodeError:  # unpaired surrogates
                    n = len(encode(t.encode("utf-8", "replace").decode()))
                known[t] = n
            out.append(n)
        return pd.Series(out, dtype="int64")

    return count(text)
