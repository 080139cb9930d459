"""The event stream: windows with lateness, removal of repeats, telemetry, latest lists, forwarding with progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.graph import latest_lists
from quern.session import Scratch

WINDOW_S, LATE_S, REALTIME_S = 5, 10, 5
AHEAD_S = 86_400
#: folders of the kept lists, by hash of the author
BUCKETS = 64


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """New files under ``path`` as a stream, with ``ts`` from ``created_at``; ``files`` bounds a micro-batch."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # streams read folders
        r, path = r.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(path).withColumn("ts", F.timestamp_seconds("created_at"))


def window_counts(stream: DataFrame, seconds: int = WINDOW_S, late: int = LATE_S) -> DataFrame:
    """Events by tumbling window and kind. A window is half open, so an event on a border counts once; it is final when
    the stream has passed its end by ``late`` seconds. Events that claim to be a day or more ahead of their delivery are
    not in a window: a single one would close all windows before it. ``outside_counts`` has them."""
    return (stream.filter(in_time()).withWatermark("ts", f"{late} seconds").groupBy(F.window("ts", f"{seconds} seconds"), "kind").agg(F.count(F.lit(1)).alias("n"))
            .select(F.unix_seconds("window.start").alias("start"), F.unix_seconds("window.end").alias("end"), "kind", "n"))


def in_time() -> Column:
    """An event with a time that is at most a day ahead of its delivery."""
    ahead = F.col("created_at") <= F.unix_seconds(F.col("received_at").cast("timestamp")) + AHEAD_S
    return F.col("created_at").isNotNull() & F.coalesce(ahead, F.lit(False))


def outside_counts(events: DataFrame) -> DataFrame:
    """What ``window_counts`` has in no window, by kind: events without a time, or without delivery, and those ahead of it."""
    out = events.filter(~in_time())
    none = F.col("created_at").isNull() | F.col("received_at").isNull()
    return out.groupBy("kind").agg(F.count_if(none).alias("without_time"), F.count_if(~none).alias("ahead"))


def without_repeats(stream: DataFrame, late: str = "60 days") -> DataFrame:
    """The first delivery of each id among those received within ``late`` of each other; the state is bounded by it. The
    time of delivery decides, as the claimed time of an event may be anything."""
    on = stream.withColumn("received", F.col("received_at").cast("timestamp"))
    return on.withWatermark("received", late).dropDuplicatesWithinWatermark(["id"]).drop("received")


def sliding_rates(stream: DataFrame, seconds: int = 10, every: int = 1, late: int = LATE_S) -> DataFrame:
    """Events a second over the trailing ``seconds``, every ``every`` seconds."""
    w = stream.filter("ts is not null").withWatermark("ts", f"{late} seconds").groupBy(F.window("ts", f"{seconds} seconds", f"{every} seconds")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.unix_seconds("window.end").alias("at"), "n", (F.col("n") / seconds).alias("rate"))


def telemetry(events: DataFrame) -> DataFrame:
    """Totals by kind and relay, with the delay of delivery; the same expression serves a stream or a table."""
    lag = F.unix_seconds(F.col("received_at").cast("timestamp")) - F.col("created_at")
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source").isNull()).alias("unknown_source"), F.count_if(lag > 3600).alias("late"), F.max(lag).alias("longest"))


def catch_up(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote: a table, its progress in the checkpoint."""
    scratch = Scratch(spark)
    out = f"{scratch.base}/stream"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{scratch.base}/progress").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(out)
    last = {}

    def keep(batch: DataFrame, epoch: int) -> None:
        last["df"] = scratch.write(batch)

    q = df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{scratch.base}/progress").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return last.get("df", spark.createDataFrame([], df.schema))


def forward(spark: SparkSession, stream: DataFrame, publish: Callable[[DataFrame, int], None], progress: str | None = None, realtime: bool = False):
    """Hands every micro-batch to ``publish`` at least once; progress is the checkpoint, from which a restart resumes.
    Catch-up ends when all is read, realtime goes on."""
    at = progress or f"{Scratch(spark).base}/forward"
    w = stream.writeStream.foreachBatch(publish).option("checkpointLocation", at)
    return (w.trigger(processingTime="1 second") if realtime else w.trigger(availableNow=True)).start()


def measured(spark: SparkSession, publish: Callable[[DataFrame, int], None], path: str, every: int = 250) -> Callable[[DataFrame, int], None]:
    """``publish`` with its progress appended to ``path`` as lines of JSON, once ``every`` or more events have gone out since
    the last line: events, newest ``created_at``, mean and longest delay from delivery to publication in seconds."""
    since = {"events": 0, "sum": 0.0, "longest": 0.0, "newest": None}

    def run(batch: DataFrame, epoch: int) -> None:
        publish(batch, epoch)
        lag = F.unix_millis(F.current_timestamp()) / 1000 - F.unix_millis(F.col("received_at").cast("timestamp")) / 1000
        n, total, longest, newest = batch.agg(F.count(F.lit(1)), F.sum(lag), F.max(lag), F.max("created_at")).first()
        since.update(events=since["events"] + n, sum=since["sum"] + (total or 0.0), longest=max(since["longest"], longest or 0.0), newest=max(filter(None, (since["newest"], newest)), default=None))
        if since["events"] >= every:
            row = (epoch, since["events"], since["newest"], since["sum"] / since["events"], since["longest"])
            spark.createDataFrame([row], "epoch bigint, events bigint, newest bigint, mean_delay double, longest_delay double").coalesce(1).write.mode("append").json(path)
            since.update(events=0, sum=0.0, longest=0.0, newest=None)

    return run


def in_slices(publish: Callable[[DataFrame, int], None], most: int) -> Callable[[DataFrame, int], None]:
    """Hands a micro-batch on in slices of about ``most`` rows, one after the other, so that a slow receiver is given no more
    at a time; nothing is dropped. A row's slice depends on its ``lev_id`` only."""
    def run(batch: DataFrame, epoch: int) -> None:
        slices = max(1, -(-batch.count() // most))
        for i in range(slices):
            publish(batch.filter(F.pmod(F.xxhash64("lev_id"), F.lit(slices)) == i) if slices > 1 else batch, epoch)

    return run


def sync_mode(window_end: int, now: int) -> str:
    return "realtime" if window_end > now - REALTIME_S else "windowed"


class LatestLists:
    """The newest follow list of each author, kept by merging micro-batches. A newer list wins however late it comes, so
    no watermark applies; an older one never does, and of equal times the first to arrive stays. Lists are kept in
    ``BUCKETS`` folders by hash of the author, and a batch writes only those anew that it has lists for."""

    COLUMNS = "pubkey string, lev_id bigint, created_at bigint, tags array<array<string>>"

    def __init__(self, spark: SparkSession, buckets: int = BUCKETS):
        self.spark, self.scratch, self.buckets = spark, Scratch(spark), buckets
        self.folders: dict[int, str] = {}

    def _read(self, buckets: list[int]) -> DataFrame:
        paths = [self.folders[b] for b in buckets if b in self.folders]
        return self.spark.read.schema(self.COLUMNS).parquet(*paths) if paths else self.spark.createDataFrame([], self.COLUMNS)

    @property
    def state(self) -> DataFrame:
        return self._read(sorted(self.folders))

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        bucket = F.pmod(F.xxhash64("pubkey"), F.lit(self.buckets)).cast("int")
        new = self.scratch.write(latest_lists(batch).withColumn("bucket", bucket))
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
        if touched:
            both = self._read(touched).unionByName(new.drop("bucket")).withColumn("kind", F.lit(3))
            self.scratch.n += 1
            path = f"{self.scratch.base}/{self.scratch.n}"
            latest_lists(both).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(path)
            old = {b: self.folders[b] for b in touched if b in self.folders}
            self.folders.update({b: f"{path}/bucket={b}" for b in touched})
            for folder in old.values():
                self.scratch.drop_path(folder)
        self.scratch.drop(new)

    def run(self, stream: DataFrame) -> DataFrame:
        q = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.scratch.base}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.state


def accepted_versions(stream: DataFrame, kind: int = 3) -> DataFrame:
    """(pubkey, created_at, lev_id) of every list that is newer than all before it from its author: a change log, kept by
    a state of two numbers an author in Spark's state store. Older lists and equal times are passed over, however late
    or early they come; the list itself is looked up by ``lev_id``."""
    rows = stream.filter((F.col("kind") == kind) & F.col("pubkey").isNotNull() & F.col("created_at").isNotNull()).select("pubkey", "created_at", "lev_id")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        before = best
        for b in batches:
            at = int(b["created_at"].max())
            first = int(b.loc[b["created_at"] == at, "lev_id"].min())
            if best is None or at > best[0] or (best is not before and at == best[0] and first < best[1]):
                best = (at, first)
        if best is not before:
            state.update(best)
            yield pd.DataFrame({"pubkey": [key[0]], "created_at": [best[0]], "lev_id": [best[1]]})

    return rows.groupBy("pubkey").applyInPandasWithState(step, "pubkey string, created_at bigint, lev_id bigint", "created_at bigint, lev_id bigint", "append", GroupStateTimeout.NoTimeout)
