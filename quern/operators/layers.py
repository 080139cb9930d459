"""Scoring layers of an author and their logistic combination.

Each layer is a grouped DataFrame (pubkey, layer, value, evidence) over a window of at most 100 events an author.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X

LAYERS = ["L0_whitelist", "L1_near_duplicate", "L3_content_entropy", "L4_link_mention"]
# fixed values: the default configuration
WEIGHTS = {"_bias": -4.0, "_threshold": 0.5, "L0_whitelist": 0.8, "L1_near_duplicate": 2.0, "L3_content_entropy": 1.5, "L4_link_mention": 1.5}
HAMMING, SHINGLE, LEAST_EVENTS = 3, 3, 5
ENTROPY_LOW, ENTROPY_HIGH, LEAST_LENGTH, EMOJI_KNEE, TOPIC_KNEE = 2.0, 5.5, 200, 0.5, 0.3
URL_KNEE, HOST_KNEE, P_KNEE, T_KNEE = 0.8, 0.7, 10.0, 8.0


def allow_layer(authors: DataFrame, allowed: DataFrame, absent: float = 1.0) -> DataFrame:
    """1 for authors that are not allowed. An unknown state counts as allowed: absence must be certain to count."""
    return authors.join(allowed.select("pubkey").distinct().withColumn("w", F.lit(True)), "pubkey", "left").select(
        "pubkey", F.lit(LAYERS[0]).alias("layer"), F.when(F.col("w"), 0.0).otherwise(float(absent)).alias("value"),
        F.to_json(F.struct(F.coalesce("w", F.lit(False)).alias("whitelisted"))).alias("evidence"))


def similar_events(window: DataFrame) -> DataFrame:
    """(pubkey, a, b): pairs of an author's events whose SimHashes differ in at most ``HAMMING`` bits.

    Of four bands of 16 bits one is equal then, so an equi-join on (author, band) finds every pair; equal hashes are
    compared once, as a class with its size."""
    h = window.select("pubkey", "lev_id", X.fingerprint("content").alias("f")).select("pubkey", "lev_id", "f.content_hash", "f.simhash")
    return h


def _near_hashes(h: DataFrame) -> DataFrame:
    """(pubkey, simhash, n, near): classes of equal SimHash and the number of close hashes other than themselves."""
    c = h.groupBy("pubkey", "simhash").agg(F.count(F.lit(1)).alias("n"), F.min("lev_id").alias("node"))
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("simhash", 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("v")) for i in range(4)])
    e = c.select("pubkey", "simhash", "node", F.explode(bands).alias("b")).select("pubkey", "simhash", "node", "b.band", "b.v")
    a, b = e.alias("a"), e.alias("b")
    on = (F.col("a.pubkey") == F.col("b.pubkey")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.node") != F.col("b.node"))
    close = a.join(b, on & (X.hamming(F.col("a.simhash"), F.col("b.simhash")) <= HAMMING)).select(F.col("a.pubkey").alias("pubkey"), F.col("a.simhash").alias("simhash"), F.col("b.node").alias("other"), F.col("a.node").alias("node")).distinct()
    return c, close


def duplicate_layer(window: DataFrame) -> DataFrame:
    """Share of an author's events with a near copy; 0 below ``LEAST_EVENTS``."""
    h = similar_events(window)
    c, close = _near_hashes(h)
    linked = close.select("pubkey", "simhash").distinct().withColumn("linked", F.lit(True))
    each = c.join(linked, ["pubkey", "simhash"], "left").groupBy("pubkey").agg(
        F.sum("n").alias("n"), F.sum(F.when((F.col("n") > 1) | F.col("linked"), F.col("n")).otherwise(0)).alias("in"))
    value = F.when(F.col("n") < LEAST_EVENTS, 0.0).otherwise(F.col("in") / F.col("n"))
    return each.select("pubkey", F.lit(LAYERS[1]).alias("layer"), value.alias("value"), F.to_json(F.struct(F.col("in").alias("clustered"), F.col("n").alias("events"))).alias("evidence"))


def fingerprints(window: DataFrame) -> DataFrame:
    """Distinct content hashes of each author with enough events, with the SimHash of the first event that has it."""
    h = similar_events(window)
    enough = h.groupBy("pubkey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_EVENTS).select("pubkey")
    return h.join(enough, "pubkey", "left_semi").groupBy("pubkey", "content_hash").agg(F.min_by("simhash", "lev_id").alias("simhash"))


def _author_text(window: DataFrame) -> DataFrame:
    """The collapsed contents of a window joined by blanks, newest first; a window has at most 100 events."""
    t = F.sort_array(F.collect_list(F.struct(-F.col("created_at"), -F.col("lev_id"), X.collapse(F.coalesce("content", F.lit(""))).alias("t"))))
    return window.groupBy("pubkey").agg(F.array_join(F.transform(t, lambda s: s["t"]), " ").alias("t"))


def entropy_layer(window: DataFrame) -> DataFrame:
    """Bits a character of all contents together, and the densities of emoji and topics; the strongest of the three."""
    texts = _author_text(window)
    one = F.lit(1)
    counts = texts.select("pubkey", X.char_entropy("t").alias("e"), X.grapheme_counts("t").alias("g"), F.size(F.filter(F.split("t", " "), lambda x: x.startswith("#"))).alias("topics"))
    j = counts.select(
        "pubkey", F.col("e.bits").alias("h"), F.col("e.length").alias("length"),
        (F.col("g.emoji") / F.greatest("g.graphemes", one)).alias("emoji"), (F.col("topics") / F.greatest("g.words", one)).alias("topic"))
    clamp = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    low = F.when(F.col("length") < LEAST_LENGTH, 0.0).otherwise(clamp((ENTROPY_LOW + 1.0) - F.col("h")))
    high = clamp((F.col("h") - (ENTROPY_HIGH - 0.5)) / 0.5)
    value = clamp(F.greatest(low, high, X.knee(F.col("emoji"), EMOJI_KNEE), X.knee(F.col("topic"), TOPIC_KNEE)))
    return j.select("pubkey", F.lit(LAYERS[2]).alias("layer"), value.alias("value"),
                    F.to_json(F.struct(F.col("h").alias("entropy_bits"), F.col("emoji").alias("emoji_density"), F.col("topic").alias("hashtag_density"))).alias("evidence"))


def link_layer(window: DataFrame) -> DataFrame:
    """Share of events with links, share of the commonest host, mean mentions and topics; the strongest of the four."""
    named = lambda n: F.size(F.filter(F.coalesce("tags", F.array().cast("array<array<string>>")), lambda t: F.coalesce(F.get(t, F.lit(0)) == n, F.lit(False))))
    e = window.select("pubkey", "lev_id", F.array_distinct(X.url_hosts(F.coalesce("content", F.lit("")))).alias("hosts"), named("p").alias("p"), named("t").alias("t"))
    base = e.groupBy("pubkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("hosts") > 0).alias("with_url"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    hosts = e.select("pubkey", F.explode("hosts").alias("host")).groupBy("pubkey", "host").agg(F.count(F.lit(1)).alias("k"))
    # most events first, then the smallest host
    top = hosts.groupBy("pubkey").agg(F.max("k").alias("k"), F.min_by("host", F.struct(-F.col("k"), F.col("host"))).alias("host"))
    j = base.join(top, "pubkey", "left")
    url, share = F.col("with_url") / F.col("n"), F.when(F.col("with_url") > 0, F.col("k") / F.col("with_url")).otherwise(0.0)
    p, t = F.col("p") / F.col("n"), F.col("t") / F.col("n")
    value = F.when(F.col("n") < LEAST_EVENTS, 0.0).otherwise(F.greatest(X.knee(url, URL_KNEE), X.knee(share, HOST_KNEE), X.knee(p, P_KNEE), X.knee(t, T_KNEE)))
    return j.select("pubkey", F.lit(LAYERS[3]).alias("layer"), value.alias("value"), F.to_json(F.struct(
        url.alias("url_ratio"), F.coalesce("host", F.lit("")).alias("top_domain"), share.alias("top_domain_share"), p.alias("mean_p_tags"), t.alias("mean_t_tags"))).alias("evidence"))


def pivot_signals(signals: DataFrame) -> DataFrame:
    """One row an author with a column for each layer, 0 where it has no signal."""
    wide = signals.groupBy("pubkey").pivot("layer", LAYERS).agg(F.max("value"))
    return wide.fillna(0.0, LAYERS)


def combine(wide: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``score`` = sigmoid(bias + weights . layers) in fixed order; suspected strictly above the threshold."""
    w = WEIGHTS | (weights or {})
    z = F.lit(w["_bias"])
    for layer in LAYERS:
        z = z + F.lit(w[layer]) * F.col(layer)
    return wide.withColumn("score", X.sigmoid(z)).withColumn("suspected", (F.col("score") > w["_threshold"]).cast("int"))


#: a layer turns an author window into (pubkey, layer, value, evidence); further ones may be passed to ``signals``
WINDOW_LAYERS = (duplicate_layer, entropy_layer, link_layer)


def signals(window: DataFrame, allowed: DataFrame, window_layers=WINDOW_LAYERS) -> DataFrame:
    out = allow_layer(window.select("pubkey").distinct(), allowed)
    for layer in window_layers:
        out = out.unionByName(layer(window))
    return out
