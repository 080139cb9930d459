"""Binary frames: the columnar graph frame, and the Bloom filter frame."""

from __future__ import annotations

import hashlib
import math
import os
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the formats
GRAPH_MAGIC, GRAPH_VERSION = b"WOTB", 1
BLOOM_MAGIC, BLOOM_VERSION, BLOOM_MOST = b"DFBF", 1, 1 << 30


@dataclass
class GraphFrame:
    """Parallel arrays; ``edges`` has two node indices a row, ``pubkeys`` 32 bytes a node."""

    edges: np.ndarray
    in_degree: np.ndarray
    out_degree: np.ndarray
    community: np.ndarray
    kind3: np.ndarray
    updated: np.ndarray
    pubkeys: bytes

    def encode(self) -> bytes:
        n = len(self.in_degree)
        head = GRAPH_MAGIC + struct.pack("<III", GRAPH_VERSION, n, len(self.edges))
        unsigned = [self.edges.reshape(-1), self.in_degree, self.out_degree, self.community]
        return head + b"".join(a.astype("<u4").tobytes() for a in unsigned) + b"".join(a.astype("<i4").tobytes() for a in (self.kind3, self.updated)) + self.pubkeys

    @staticmethod
    def decode(data: bytes) -> GraphFrame:
        if len(data) < 16 or data[:4] != GRAPH_MAGIC:
            raise ValueError("no graph frame")
        version, n, m = struct.unpack_from("<III", data, 4)
        if version != GRAPH_VERSION or len(data) != 16 + 8 * m + 52 * n:
            raise ValueError("wrong version or length")
        at, parts = 16, []
        for count, kind in ((2 * m, "<u4"), (n, "<u4"), (n, "<u4"), (n, "<u4"), (n, "<i4"), (n, "<i4")):
            parts.append(np.frombuffer(data, kind, count, at))
            at += 4 * count
        return GraphFrame(parts[0].reshape(-1, 2), *parts[1:], data[at:])


def frame_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows with their index, clamped times and key, and edge rows as indices. ``nodes`` is (node, idx, in_degree,
    out_degree, community, kind3createdat, last_db_update, pubkey)."""
    fit = lambda c: F.greatest(F.least(F.coalesce(c, F.lit(0)), F.lit(2**31 - 1)), F.lit(-(2**31))).cast("int")
    n = nodes.select("idx", "in_degree", "out_degree", "community", fit("kind3createdat").alias("kind3"), fit("last_db_update").alias("updated"), "pubkey")
    i = nodes.select("node", "idx")
    e = edges.join(i.select(F.col("node").alias("src"), F.col("idx").alias("a")), "src").join(i.select(F.col("node").alias("dst"), F.col("idx").alias("b")), "dst").select("a", "b")
    return n, e


def export_frame(nodes: DataFrame, edges: DataFrame) -> GraphFrame:
    """The frame of a whole graph, for a viewer that takes at most 2^24 nodes and 2^27 edges (1 GB); larger graphs are
    refused before any row is fetched."""
    n, e = frame_tables(nodes, edges)
    if n.count() > 1 << 24 or e.count() > 1 << 27:
        raise ValueError("a frame holds at most 2^24 nodes and 2^27 edges")
    t, g = n.orderBy("idx").toArrow(), e.orderBy("a", "b").toArrow()
    keys = b"".join(bytes.fromhex(k) if k and len(k) == 64 else bytes(32) for k in t.column("pubkey").to_pylist())
    col = lambda x: t.column(x).to_numpy()
    return GraphFrame(np.column_stack([g.column("a").to_numpy(), g.column("b").to_numpy()]), col("in_degree"), col("out_degree"), col("community"), col("kind3"), col("updated"), keys)


@dataclass
class Bloom:
    """A Bloom filter over keys; position i is a 64-bit hash of (i, key) mod bits. (Steps of a second
    hash are cheaper, but in a small filter they share factors with its size and let far too many keys through.)"""

    bits: int
    hashes: int
    rate: float
    words: np.ndarray

    @staticmethod
    def sized(n: int, rate: float) -> tuple[int, int]:
        bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        return -(-bits // 64) * 64, max(1, round(bits / max(n, 1) * math.log(2)))

    @staticmethod
    def positions(key, bits: int, hashes: int):
        return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.xxhash64(i, F.lower(key)), F.lit(bits)))

    @staticmethod
    def build(keys: DataFrame, column: str, rate: float = 1e-6) -> Bloom:
        """Words of the filter are or-ed together by the cluster; the driver gets ``bits / 64`` of them."""
        keys = keys.select(F.col(column).alias("k")).filter(F.col("k").isNotNull()).distinct()
        n = keys.count()
        bits, hashes = Bloom.sized(n, rate)
        if bits // 8 > BLOOM_MOST:
            raise ValueError("the filter would exceed 1 GiB")
        at = keys.select(F.explode(Bloom.positions(F.col("k"), bits, hashes)).alias("p"))
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("p", F.lit(64)).cast("int"))
        got = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[got.column("w").to_numpy()] = got.column("v").to_numpy()
        return Bloom(bits, hashes, rate, words.view(np.uint64))

    def may_contain(self, key):
        """Column: false for certain, true but for the rate. The words are shipped once to each worker; their size is
        known from ``bits``."""
        words = self.words

        @F.pandas_udf(T.BooleanType())
        def test(p):
            import pandas as pd

            m = np.stack(p.to_numpy()) if len(p) else np.zeros((0, 1), np.int64)
            return pd.Series((words[m // 64] >> (m % 64).astype(np.uint64) & np.uint64(1)).all(axis=1))

        return test(Bloom.positions(key, self.bits, self.hashes))

    def encode(self) -> bytes:
        body = struct.pack(">QQ", self.bits, self.hashes) + self.words.astype(">u8").tobytes()
        return BLOOM_MAGIC + struct.pack(">Bd", BLOOM_VERSION, self.rate) + hashlib.sha256(body).digest() + struct.pack(">Q", len(body)) + body

    @property
    def etag(self) -> str:
        return self.encode()[13:45].hex()

    @staticmethod
    def decode(data: bytes) -> Bloom:
        if data[:4] != BLOOM_MAGIC or len(data) < 53:
            raise ValueError("no Bloom frame")
        version, rate = struct.unpack_from(">Bd", data, 4)
        (size,) = struct.unpack_from(">Q", data, 45)
        if version != BLOOM_VERSION or size > BLOOM_MOST or len(data) < 53 + size:
            raise ValueError("wrong version or length")
        body = data[53:53 + size]
        if hashlib.sha256(body).digest() != data[13:45]:
            raise ValueError("damaged Bloom frame")
        bits, hashes = struct.unpack_from(">QQ", body)
        return Bloom(bits, hashes, rate, np.frombuffer(body, ">u8", offset=16).astype(np.uint64))

    def save(self, path: str) -> None:
        """Written beside and renamed, so a reader never sees half a file."""
        with open(path + ".part", "wb") as f:
            f.write(self.encode())
        os.replace(path + ".part", path)


def node_index(nodes: DataFrame, order: str) -> DataFrame:
    """Index 0, 1, ... by ``order`` for graphs small enough to be drawn."""
    return nodes.withColumn("idx", F.row_number().over(Window.orderBy(order)) - 1)
