"""Stored event payloads: a tag byte, then JSON or a zstd frame with a dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.schema import EVENT

RAW, ZSTD = 0x00, 0x01
MOST_BYTES = 4 * 1024 * 1024


def decode(raw: bytes, dictionaries: dict[int, bytes], made: dict | None = None) -> tuple[str | None, str | None]:
    """(JSON text, None) or (None, what is wrong)."""
    if not raw:
        return None, "empty"
    if raw[0] == RAW:
        return raw[1:].decode("utf-8", "replace"), None
    if raw[0] != ZSTD:
        return None, f"unknown tag {raw[0]}"
    if len(raw) < 5:
        return None, "truncated"
    import zstandard

    number = int.from_bytes(raw[1:5], "little")
    if number not in dictionaries:
        return None, f"no dictionary {number}"
    made = {} if made is None else made
    if number not in made:  # prepared once a worker
        made[number] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionaries[number]))
    try:
        size = zstandard.frame_content_size(raw[5:])
        if size > MOST_BYTES:
            return None, "too large"
        out = made[number].decompress(raw[5:], max_output_size=MOST_BYTES)
    except zstandard.ZstdError as e:
        return None, f"zstd: {e}"
    return (out.decode("utf-8", "replace"), None) if len(out) <= MOST_BYTES else (None, "too large")


def encode_payloads(df: DataFrame, dictionaries: dict[int, bytes], number: Column) -> DataFrame:
    """(lev_id, payload BINARY) of ``df(lev_id, raw STRING)``: where ``number`` names a dictionary a zstd frame made with it,
    else the text as it is; a null text gives a null payload."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        made = {n: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)) for n, d in dictionaries.items()}
        for b in batches:
            out = []
            for raw, n in zip(b["raw"], b["number"]):
                if raw is None:
                    out.append(None)
                elif n in made:
                    out.append(bytes([ZSTD]) + int(n).to_bytes(4, "little") + made[n].compress(raw.encode()))
                else:
                    out.append(bytes([RAW]) + raw.encode())
            yield pd.DataFrame({"lev_id": b["lev_id"], "payload": out})

    return df.select("lev_id", "raw", F.coalesce(number.cast("bigint"), F.lit(-1)).alias("number")).mapInPandas(run, "lev_id bigint, payload binary")


def decode_payloads(df: DataFrame, dictionaries: dict[int, bytes]) -> DataFrame:
    """(lev_id, raw, error) of ``df(lev_id, payload BINARY)``; bad payloads have an error and no text. The dictionaries
    are few and of some kilobytes each; they travel with the function."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict = {}
        for b in batches:
            out = [decode(bytes(p) if p is not None else b"", dictionaries, made) for p in b["payload"]]
            yield pd.DataFrame({"lev_id": b["lev_id"], "raw": [o[0] for o in out], "error": [o[1] for o in out]})

    return df.select("lev_id", "payload").mapInPandas(run, "lev_id bigint, raw string, error string")


def parse_events(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``lev_id``, the event's fields, ``raw`` and ``bad``, which marks text that is no event; unknown fields are ignored."""
    e = df.withColumn("_e", F.from_json(raw, EVENT, {"mode": "PERMISSIVE"}))
    return e.select("lev_id", "_e.*", F.col(raw).alias("raw"), (F.col("_e").isNull() | F.col("_e.id").isNull() | F.col("_e.pubkey").isNull()).alias("bad"))
