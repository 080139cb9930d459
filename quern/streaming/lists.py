"""An allow-list that is fetched again from time to time, while a stream is gated by it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.gate import route, well_formed
from quern.session import Scratch


class AllowList:
    """The last good list. ``fetch(version)`` gives None where nothing is newer than ``version``, else (version, DataFrame
    with ``pubkey``); it may raise.

    A fetched list is read to its end, checked and written before it takes the place of the old one. A fetch that fails, or
    brings no well-formed key, leaves the old list in place and is tried again after ``retry`` seconds, doubling up to
    ``every``; a good one is asked again after ``every`` seconds. The list is a table in the shared folder, so a batch that
    is computed again sees the list it began with; the last two versions are kept for that."""

    def __init__(self, spark: SparkSession, fetch: Callable[[str | None], tuple[str, DataFrame] | None], every: float = 30.0, retry: float = 1.0, clock: Callable[[], float] = time.time):
        self.fetch, self.every, self.retry, self.clock = fetch, every, retry, clock
        self.scratch = Scratch(spark)
        self.version: str | None = None
        self.keys: DataFrame | None = None
        self.before: DataFrame | None = None
        self.error: str | None = None
        self.failures, self.due = 0, 0.0

    @property
    def ready(self) -> bool:
        return self.keys is not None

    def refresh(self) -> bool:
        """Fetches if it is time to; true where a new list took its place."""
        if self.clock() < self.due:
            return False
        try:
            got = self.fetch(self.version)
            if got is not None:
                version, df = got
                new = self.scratch.write(df.select(F.lower("pubkey").alias("pubkey")).filter(well_formed(F.col("pubkey"))).distinct())
                if new.isEmpty():
                    raise ValueError("a list without keys")
                if self.before is not None:
                    self.scratch.drop(self.before)
                self.before, self.keys, self.version = self.keys, new, version
        except Exception as e:  # whatever is wrong with a source, the last good list stands
            self.error, self.failures = f"{type(e).__name__}: {e}", self.failures + 1
            self.due = self.clock() + min(self.every, self.retry * 2 ** (self.failures - 1))
            return False
        self.error, self.failures, self.due = None, 0, self.clock() + self.every
        return got is not None

    def wait(self, most: int = 10, sleep: Callable[[float], None] = time.sleep) -> None:
        """Tries until there is a list; after ``most`` failures it raises."""
        while not self.ready:
            self.refresh()
            if not self.ready:
                if self.failures >= most:
                    raise RuntimeError(f"no list: {self.error}")
                sleep(max(0.0, self.due - self.clock()))


def gated(allow: AllowList, publish: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``forward``: each micro-batch is routed by the list as it is then (``gate.route``) and handed on. Before there is a
    list the batch fails, and is read again."""
    def run(batch: DataFrame, epoch: int) -> None:
        allow.refresh()
        if not allow.ready:
            raise RuntimeError(f"no list yet: {allow.error}")
        publish(route(batch, allow.keys), epoch)

    return run
