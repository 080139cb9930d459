"""A seeded graph in which popular nodes are followed more, every edge made by itself.

Link ``k`` of node ``i`` draws an earlier node ``j``. With even odds it leads there, else it copies one of the links of ``j``,
which may be a copy in turn. So a node is copied as often as it is linked already, and the number of followers has a
heavy tail. All draws are hashes of (seed, node, link): an edge is followed to its end without any other edge having
been made, so the graph is made in parallel and does not depend on how it is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def link_ends(node: np.ndarray, link: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """Where each link leads: a node below ``node``; node 0 has none and gives -1."""
    with np.errstate(over="ignore"):
        base = _mixed(np.uint64(seed) + np.uint64(0x632BE59BD9B4E019))
        i, k = node.astype(np.uint64).copy(), link.astype(np.uint64).copy()
        end = np.full(len(i), -1, np.int64)
        open_ = np.flatnonzero(i > 0)
        while open_.size:  # half of them end each turn
            h = _mixed(_mixed(base ^ i[open_]) + k[open_])
            j = (h >> np.uint64(11)) % i[open_]
            done = (h & np.uint64(1) == 0) | (j == 0)
            end[open_[done]] = j[done].astype(np.int64)
            i[open_], k[open_] = j, _mixed(h) % np.uint64(m)
            open_ = open_[~done]
    return end


def preferential_edges(spark: SparkSession, n: int, m: int = 6, seed: int = 1) -> DataFrame:
    """(src, dst) of ``n`` nodes with up to ``m`` links each to earlier nodes; repeated links are one edge."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            node, link = np.repeat(b["id"].to_numpy(), m), np.tile(np.arange(m), len(b))
            out = pd.DataFrame({"src": node, "dst": link_ends(node, link, m, seed)})
            yield out[out["dst"] >= 0].drop_duplicates()  # a node is whole within its batch

    return spark.range(n).mapInPandas(run, "src bigint, dst bigint")
