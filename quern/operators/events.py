"""The event log's queries: pages, newest per author, authors, counts, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from quern.plans.filters import Cursor, EventFilter, compile_filter, expired

DEFAULT_LIMIT, MOST_ROWS, MOST_AUTHORS, MOST_PER_AUTHOR = 100, 500, 1000, 500
API = ["id", "pubkey", "created_at", "kind", "tags", "content", "sig"]


def clamp_limit(limit: int | None, default: int = DEFAULT_LIMIT, most: int = MOST_ROWS) -> int:
    return max(1, min(limit if limit is not None else default, most))


def matching(events: DataFrame, f: EventFilter, after: Cursor | None = None) -> DataFrame:
    out = events.filter(compile_filter(f))
    return out.filter(after.after()) if after else out


def page(events: DataFrame, f: EventFilter, limit: int | None = None, after: Cursor | None = None, columns: list[str] | None = None) -> DataFrame:
    """Newest first, then by descending ``lev_id``: each task keeps its ``limit`` best rows, then they are merged."""
    rows = matching(events, f, after).select("lev_id", *(columns or API))
    return rows.orderBy(F.desc("created_at"), F.desc("lev_id")).limit(clamp_limit(limit))


def read_page(events: DataFrame, f: EventFilter, limit: int | None = None, after: str | None = None) -> tuple[list[Row], str | None]:
    """The rows of a page and the cursor of its last row, which is set when the page is full."""
    n = clamp_limit(limit)
    rows = page(events, f, n, Cursor.decode(after) if after else None).collect()
    return rows, Cursor(rows[-1]["created_at"], rows[-1]["lev_id"]).encode() if len(rows) == n else None


def late_page(events: DataFrame, f: EventFilter, limit: int | None = None) -> DataFrame:
    """The same page in two phases: the order is settled on narrow columns, then the wide ones are fetched for those
    rows only (at most ``MOST_ROWS``, hence the broadcast)."""
    keys = matching(events, f).select("lev_id", "created_at").orderBy(F.desc("created_at"), F.desc("lev_id")).limit(clamp_limit(limit))
    wide = events.select("lev_id", *API).join(F.broadcast(keys.select("lev_id")), "lev_id", "left_semi")
    return wide.orderBy(F.desc("created_at"), F.desc("lev_id"))


def latest_per_author(events: DataFrame, kind: int, per_author: int, authors: list[str] | None = None, now: int | None = None, since: int | None = None) -> DataFrame:
    """The ``per_author`` newest events of a kind for each author, then without those expired (so there may be fewer).
    Authors without events give no row; an author named twice counts once. Spark limits each author's rows before the
    shuffle, so a prolific author sends no more than that from a task."""
    rows = events.filter((F.col("kind") == kind) & F.col("pubkey").isNotNull() & F.col("created_at").isNotNull())
    if authors is not None:
        rows = rows.filter(F.col("pubkey").isin(sorted(set(authors))) if authors else F.lit(False))
    if since is not None:
        rows = rows.filter(F.col("created_at") >= since)
    w = Window.partitionBy("pubkey").orderBy(F.desc("created_at"), F.desc("lev_id"))
    top = rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= min(per_author, MOST_PER_AUTHOR))
    return top.filter(~expired(now)) if now is not None else top


def authors(events: DataFrame, after: str | None = None, limit: int = MOST_ROWS) -> DataFrame:
    """Distinct authors in ascending order, behind ``after``."""
    a = events.select("pubkey").filter("pubkey is not null")
    if after is not None:
        a = a.filter(F.col("pubkey") > after)
    return a.distinct().orderBy("pubkey").limit(limit)


def stats(events: DataFrame, db_version: int = 1) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("event_count"), F.coalesce(F.max("lev_id"), F.lit(0)).alias("max_lev_id")).withColumn("db_version", F.lit(db_version))


def range_scan(events: DataFrame, columns: list[str], start: list | None = None, reverse: bool = False, limit: int = 0) -> DataFrame:
    """Rows in the order of ``columns`` from ``start`` on (inclusive, also in reverse), ``limit`` 0 for all of them."""
    rows = events
    if start is not None:
        bound = F.lit(True)
        for c, v in reversed(list(zip(columns, start))):
            past = F.col(c) < v if reverse else F.col(c) > v
            bound = past | ((F.col(c) == v) & bound)
        rows = rows.filter(bound)
    order = [F.desc(c) if reverse else F.asc(c) for c in [*columns, *(() if "lev_id" in columns else ("lev_id",))]]
    rows = rows.orderBy(*order)
    return rows.limit(limit) if limit else rows


def lookup(events: DataFrame, wanted: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Rows by ``lev_id``, in the order of ``wanted`` where it has an ``ordinal``."""
    out = wanted.join(events, "lev_id")
    return out.orderBy(ordinal) if ordinal else out


def missing(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ``lev_id`` that the log lacks: an integrity error if there are any."""
    return wanted.select("lev_id").distinct().join(events.select("lev_id"), "lev_id", "left_anti")


def by_author(wanted: DataFrame, events: DataFrame, most: int = MOST_PER_AUTHOR) -> DataFrame:
    """``wanted(ord, pubkey)`` with the list of event numbers of each author, of more than ``most`` the highest; empty lists
    where there are none; every row of ``wanted`` stays. The bound is part of the answer, as of ``latest_per_author``."""
    w = Window.partitionBy("pubkey").orderBy(F.desc("lev_id"))
    kept = events.select("pubkey", "lev_id").withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= most)
    groups = kept.groupBy("pubkey").agg(F.sort_array(F.collect_list("lev_id")).alias("lev_ids"))
    return wanted.join(groups, "pubkey", "left").select("ord", "pubkey", F.coalesce("lev_ids", F.array().cast("array<bigint>")).alias("lev_ids"))


def distinct_events(events: DataFrame) -> DataFrame:
    """One row an event id: its first delivery."""
    row = F.struct("lev_id", *[F.col(c) for c in events.columns if c not in ("id", "lev_id")])
    return events.filter("id is not null").groupBy("id").agg(F.min_by(row, "lev_id").alias("r")).select("id", "r.*")


def newest_replaceable(events: DataFrame, kind: int) -> DataFrame:
    """The newest record of each (author, ``d`` tag) of a kind that replaces itself; no tag counts as the empty one."""
    d = F.coalesce(F.get(F.get(F.filter("tags", lambda t: F.coalesce((F.get(t, F.lit(0)) == "d") & (F.size(t) >= 2), F.lit(False))), F.lit(0)), F.lit(1)), F.lit(""))
    rows = events.filter((F.col("kind") == kind) & F.col("pubkey").isNotNull() & F.col("created_at").isNotNull()).withColumn("d", d)
    return rows.groupBy("pubkey", "d").agg(F.max_by(F.struct("lev_id", "created_at"), F.struct("created_at", "lev_id")).alias("r")).select("pubkey", "d", "r.*")


def named_events(events: DataFrame, kind: int) -> DataFrame:
    """(pubkey, id): the event ids that events of a kind name in their ``e`` tags, with the author who names them."""
    t = events.filter(F.col("kind") == kind).select("pubkey", F.explode("tags").alias("t"))
    return t.filter((F.get("t", F.lit(0)) == "e") & (F.size("t") >= 2)).select("pubkey", F.get("t", F.lit(1)).alias("id")).filter("id is not null")


def deletion_requests(events: DataFrame) -> DataFrame:
    """(pubkey, id) named by deletion requests (kind 5); a request counts for events of its own author only."""
    return named_events(events, 5).filter("pubkey is not null")


def delete_ids(events: DataFrame, gone: DataFrame) -> DataFrame:
    """``events`` without those named in ``gone``, by ``id``, and by ``pubkey`` too where ``gone`` has one."""
    return events.join(gone.distinct(), gone.columns, "left_anti")


def deletion_batches(gone: DataFrame, batch: int = 500) -> DataFrame:
    """(batch, ids): distinct ids in batches of at most ``batch``, for a store that deletes by id; ids are ranked within
    slices of their hash, so that no task sorts them all. A batch that a store refuses may be cut in two and tried again."""
    ids = gone.select("id").filter("id is not null").distinct()
    ids = ids.withColumn("slice", F.spark_partition_id())
    ranked = ids.withColumn("k", F.row_number().over(Window.partitionBy("slice").orderBy("id")) - 1)
    return ranked.groupBy("slice", F.floor(F.col("k") / batch).alias("part")).agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.concat_ws("-", "slice", "part").alias("batch"), "ids")
