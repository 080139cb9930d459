"""Behaviour of each author: kinds, tags, rates, bursts, duplicates, and the flags made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.components import connected_components
from quern.session import Scratch

SANE_UNTIL = 4_102_444_800
BURST_EVENTS, BURST_SECONDS, BIN_SECONDS = 5, 60, 3600
SLICE_SECONDS = 21_600
MANY_TAGS, MANY_MENTIONS, MANY_TOPICS, TOP = 20, 20, 15, 10


def sane_time(c="created_at") -> F.Column:
    return F.coalesce(F.col(c).between(0, SANE_UNTIL), F.lit(False))


def kind_histogram(events: DataFrame) -> DataFrame:
    """Kind and count, most frequent first; kinds that are null, negative or beyond 2^53 are left out."""
    return events.filter(F.col("kind").between(0, 2**53 - 1)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def tag_rows(events: DataFrame) -> DataFrame:
    """One row a tag: name, value, and whether it is malformed (no name; or no value, except for event references)."""
    t = events.select("lev_id", "pubkey", F.posexplode("tags").alias("pos", "tag"))
    t = t.select("lev_id", "pubkey", "pos", F.get("tag", F.lit(0)).alias("name"), F.get("tag", F.lit(1)).alias("value"))
    bad = F.col("name").isNull() | ((F.col("name") != "e") & F.col("value").isNull())
    return t.withColumn("malformed", bad)


def tag_summary(events: DataFrame) -> DataFrame:
    """For each author: malformed tags, event references, and the mass-mention and stuffing flags."""
    per_event = tag_rows(events).groupBy("pubkey", "lev_id").agg(
        F.count_if("malformed").alias("malformed"), F.count_if(~F.col("malformed")).alias("tags"), F.count_if((F.col("name") == "e") & ~F.col("malformed")).alias("refs"),
        F.count_if((F.col("name") == "p") & ~F.col("malformed")).alias("p"), F.count_if((F.col("name") == "t") & ~F.col("malformed")).alias("t"))
    return per_event.groupBy("pubkey").agg(
        F.sum("malformed").alias("malformed_tags"), F.sum("refs").alias("event_refs"), F.max(F.col("p") > MANY_MENTIONS).alias("mass_mention"), F.max(F.col("t") > MANY_TOPICS).alias("stuffing"),
        F.count_if((F.col("tags") > MANY_TAGS) | (F.col("p") > MANY_MENTIONS) | (F.col("t") > MANY_TOPICS)).alias("outliers"))


def top_tag_values(events: DataFrame, name: str, n: int = TOP) -> DataFrame:
    """The ``n`` most frequent values of a tag over all events; equal counts in the order first seen."""
    t = tag_rows(events).filter((F.col("name") == name) & ~F.col("malformed"))
    seen = t.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("lev_id", "pos")).alias("first"))
    return seen.orderBy(F.desc("n"), "first").limit(n).select("value", "n")


def rates(events: DataFrame, window_s: int = BURST_SECONDS, least: int = BURST_EVENTS) -> DataFrame:
    """For each author: sane and rejected times, tightest gap, and whether ``least`` events lie within ``window_s``
    seconds. Authors with fewer than two sane times have no gap and no burst.

    ``least`` events lie within a window if the event ``least - 1`` places on is at most ``window_s`` later. Time is cut
    into slices longer than the window, and each event joins its slice and the one before, so that a busy author is
    sorted slice by slice; gaps longer than a slice come from the first and last times of the slices."""
    slice_s = max(SLICE_SECONDS, window_s + 1)
    sane = events.filter(sane_time() & F.col("pubkey").isNotNull()).select("pubkey", "created_at", "lev_id")
    home = F.floor(F.col("created_at") / slice_s)
    copies = sane.select("pubkey", "created_at", "lev_id", home.alias("home"), F.explode(F.array(home, home - 1)).alias("slice"))
    w = Window.partitionBy("pubkey", "slice").orderBy("created_at", "lev_id")
    t = F.col("created_at")
    near = copies.select("pubkey", "slice", "home", "created_at", (t - F.lag(t).over(w)).alias("gap"), (t - F.lag(t, least - 1).over(w)).alias("span"))
    own = F.when(F.col("home") == F.col("slice"), t)
    slices = near.groupBy("pubkey", "slice").agg(F.min("gap").alias("gap"), F.max(F.col("span") <= window_s).alias("b"), F.count(own).alias("n"), F.min(own).alias("lo"), F.max(own).alias("hi"))
    far = F.col("lo") - F.max("hi").over(Window.partitionBy("pubkey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    good = slices.withColumn("far", far).groupBy("pubkey").agg(F.sum("n").alias("analyzed"), F.min(F.least("gap", "far")).alias("tightest_gap"), F.max("b").alias("b"))
    every = events.filter("pubkey is not null").groupBy("pubkey").agg(F.count_if(~sane_time()).alias("rejected"))
    return every.join(good, "pubkey", "left").select(
        "pubkey", F.coalesce("analyzed", F.lit(0)).alias("analyzed"), "rejected", "tightest_gap", F.coalesce(F.col("b"), F.lit(False)).alias("burst"))


def time_bins(events: DataFrame, bin_s: int = BIN_SECONDS) -> DataFrame:
    """Counts in bins of ``bin_s`` seconds anchored at each author's first sane time; authors need two, empty bins have
    no row."""
    sane = events.filter(sane_time() & F.col("pubkey").isNotNull()).select("pubkey", "created_at")
    first = sane.groupBy("pubkey").agg(F.min("created_at").alias("origin"), F.count(F.lit(1)).alias("all")).filter("all >= 2")
    # counts by second shrink a busy author before the join
    b = sane.groupBy("pubkey", "created_at").agg(F.count(F.lit(1)).alias("n")).join(first, "pubkey")
    start = F.col("origin") + F.floor((F.col("created_at") - F.col("origin")) / bin_s) * bin_s
    return b.groupBy("pubkey", start.alias("start")).agg(F.sum("n").alias("n"))


def window_metadata(events: DataFrame) -> DataFrame:
    return events.filter("pubkey is not null").groupBy("pubkey").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def duplicate_clusters(window: DataFrame, threshold: float = 0.8, k: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """Clusters of equal and similar contents within each author's window: (pubkey, cluster, kind, n), kind 'exact' or
    'near', cluster the smallest ``lev_id`` in it; single events have no row.

    Events of one author with one normal form are a class. Two classes at the threshold share a shingle among the first
    ``size - ceil(threshold * size) + 1`` of each in any fixed order, so only these are joined; sizes rule out pairs that
    cannot reach the threshold, the others are compared in full, components close the relation."""
    scratch = scratch or Scratch(window.sparkSession)
    base = window.select("pubkey", "lev_id", X.compose(F.col("content")).alias("key"))
    sets = base.groupBy("pubkey", "key").agg(F.min("lev_id").alias("node"), F.count(F.lit(1)).alias("n")).withColumn("sh", X.space_shingles(F.col("key"), k))
    ordered = F.array_sort(F.transform("sh", lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    classes = scratch.write(sets.select("pubkey", "node", "n", F.transform(ordered, lambda x: x["g"]).alias("sh"), F.size("sh").alias("size")))
    some = F.slice("sh", F.lit(1), (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int"))
    s = classes.filter("size > 0").select("pubkey", "node", "size", F.explode(some).alias("g"))
    a, b = s.alias("a"), s.alias("b")
    small = F.least("a.size", "b.size") >= threshold * F.greatest("a.size", "b.size") - 1e-9
    pairs = a.join(b, (F.col("a.pubkey") == F.col("b.pubkey")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.node") < F.col("b.node")) & small).select(
        F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    side = lambda x: classes.select(F.col("node").alias(x), F.col("sh").alias(f"s{x}"))
    common = F.size(F.array_intersect("sa", "sb"))
    edges = pairs.join(side("a"), "a").join(side("b"), "b").filter(common >= threshold * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b")
    parts = connected_components(edges, scratch)
    whole = classes.join(parts, "node", "left").select("pubkey", F.coalesce("component", "node").alias("cluster"), "n")
    return whole.groupBy("pubkey", "cluster").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys")).filter("n >= 2").select(
        "pubkey", "cluster", F.when(F.col("keys") == 1, "exact").otherwise("near").alias("kind"), "n")


def triage(window: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Event count and the three flags of each author's window."""
    meta = window_metadata(window).select("pubkey", "n")
    fan = tag_summary(window).select("pubkey", (F.col("mass_mention") | F.col("stuffing")).alias("fan"))
    dup = duplicate_clusters(window, scratch=scratch).select("pubkey").distinct().withColumn("dup", F.lit(True))
    burst = rates(window).select("pubkey", "burst")
    no = F.lit(False)
    return meta.join(burst, "pubkey", "left").join(dup, "pubkey", "left").join(fan, "pubkey", "left").select(
        "pubkey", F.col("n").alias("event_count"), F.coalesce("burst", no).alias("burst"), F.coalesce("dup", no).alias("near_dup"), F.coalesce("fan", no).alias("tag_fan_out"))


def ranked_triage(table: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """The triage table by any of its columns, either way; ties by key."""
    if column not in table.columns:
        raise ValueError(f"no column {column}")
    return table.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), "pubkey")
