"""Watching streams: progress of queries, and news in a log that others write."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Rows, batches and rates of every stream of a session, by query id. Only the last ``keep`` rates are kept."""

    def __init__(self, keep: int = 100):
        self.keep, self.lock = keep, threading.Lock()
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.rates: dict[str, list[float]] = {}
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802 (names are Spark's)
        with self.lock:
            self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self.lock:
            k = str(p.id)
            self.rows[k] = self.rows.get(k, 0) + p.numInputRows
            self.batches[k] = self.batches.get(k, 0) + 1
            self.rates[k] = [*self.rates.get(k, []), p.processedRowsPerSecond or 0.0][-self.keep:]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            with self.lock:
                self.failed[str(event.id)] = event.exception

    def watch(self, spark: SparkSession) -> Progress:
        spark.streams.addListener(self)
        return self


class News:
    """True on each call that finds a higher ``lev_id`` than the call before; the first call only takes note."""

    def __init__(self):
        self.last: int | None = None

    def __call__(self, events: DataFrame) -> bool:
        now = events.agg(F.coalesce(F.max("lev_id"), F.lit(0))).first()[0]
        news, self.last = self.last is not None and now > self.last, max(now, self.last or 0)
        return news
