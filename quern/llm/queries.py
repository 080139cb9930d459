"""Queries of the training-data problems and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.llm import abuse, mixing, neardup, packing, spam, topn
from quern.llm.tokens import VOCABULARY, token_count
from quern.session import Scratch
from quern.sources.tables import canonical_source, table


# 2: near-duplicate events -------------------------------------------------------------------------------------------
def _notes(spark, d):
    notes = table(spark, d, "seed_events").filter("kind = 1 and content is not null").select("id", "content")
    return neardup.NearDuplicates(notes, neardup.word_set(F.col("content")), threshold=0.6, least=12)


def p2_found(spark, d):
    return _notes(spark, d).pairs()


def p2_groups(spark, d):
    """One row a note that has a near duplicate: its class, its group and its number of links."""
    return _notes(spark, d).groups()


def p2_document_groups(spark, d):
    """The same for documents, on shingles of five words at 0.8."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return neardup.NearDuplicates(docs, neardup.shingle_set(F.col("text")), threshold=0.8, keep_sets=False).groups()


# 4: newest events of every author and kind --------------------------------------------------------------------------
def _newest(spark, d, n):
    rows = table(spark, d, "seed_events").filter("pubkey is not null and kind is not null and created_at is not null")
    events = topn.first_deliveries(rows, "id", "lev_id", ["pubkey", "kind", "created_at"])
    return topn.top_n(events, ["pubkey", "kind"], "created_at", "lev_id", n)


def p4_found(spark, d):
    return _newest(spark, d, 3).select("pubkey", "kind", "lev_id")


def p4_ranked(spark, d):
    """The ten newest, with their ranks."""
    return _newest(spark, d, 10)


# 5: abusive content -------------------------------------------------------------------------------------------------
ABUSIVE = 0.5


def _scored_deliveries(spark, d):
    events = table(spark, d, "seed_events")
    terms = abuse.lexicon_terms(table(spark, d, "abuse_lexicon"))
    weights = abuse.fit_weights(events.select("id", "content"), table(spark, d, "abuse_labels"), terms)
    return abuse.score_texts(events.select("id", "source", "content"), "content", terms, weights).select("id", "source", "abuse_score", "abuse_kind")


def p5_found(spark, d):
    return _scored_deliveries(spark, d).filter(F.col("abuse_score") >= ABUSIVE).filter("id is not null").select("id").distinct()


def p5_scores(spark, d):
    """The score and kind of every event, the worst of its deliveries."""
    best = _scored_deliveries(spark, d).filter("id is not null").groupBy("id").agg(F.max(F.struct("abuse_score", "abuse_kind")).alias("b"))
    return best.select("id", "b.abuse_score", "b.abuse_kind")


def p5_source_rates(spark, d):
    """For each relay, by its proper spelling, its distinct events and how many of them are abusive."""
    s = _scored_deliveries(spark, d).filter("id is not null").withColumn("relay", canonical_source(F.col("source")))
    each = s.groupBy("relay", "id").agg(F.max((F.col("abuse_score") >= ABUSIVE).cast("int")).alias("bad"))
    return each.groupBy("relay").agg(F.count(F.lit(1)).alias("events"), F.sum("bad").alias("abusive")).withColumn("rate", F.col("abusive") / F.col("events"))


# 8: keyword-stuffed and link-list pages -----------------------------------------------------------------------------
def _pages(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return spam.spam_pages(docs, scratch=Scratch(spark), keep=["doc_id", "source"])


def p8_found(spark, d):
    return _pages(spark, d).filter("is_spam").select("doc_id")


def p8_scores(spark, d):
    """Features, distance and direction of every document."""
    return _pages(spark, d).drop("source")


# 6: containers of each capacity -------------------------------------------------------------------------------------
def _token_sizes(spark, d, *columns):
    return table(spark, d, "documents").select("doc_id", *columns, token_count(F.col("text"), VOCABULARY).alias("n_tokens"))


def _packs(spark, d):
    rows = table(spark, d, "pack_capacity").filter("capacity_tokens > 0").select("pack_name", "capacity_tokens").distinct().collect()
    sized = Scratch(spark).write(_token_sizes(spark, d))
    return [(r["pack_name"], r["capacity_tokens"], *packing.pack(sized, "doc_id", "n_tokens", r["capacity_tokens"])) for r in sorted(rows)]


def p6_containers(spark, d):
    """For each pack the container of every document, piece by piece where one is larger than the capacity."""
    parts = [placed.select("doc_id", F.lit(name).alias("pack_name"), "piece", "start", "length", "container") for name, _, placed, _ in _packs(spark, d)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p6_fill(spark, d):
    """For each pack: containers, fewest any packing needs, tokens, the share of space that is filled; the program's
    fractional containers, columns and knapsack steps, containers of its rounding and of a packing longest first."""
    rows = []
    for name, capacity, _, plan in _packs(spark, d):
        tokens = sum(k * sum(length * n for length, n in used.items()) for k, used in plan.fillings)
        rows.append((name, capacity, plan.containers, plan.bound, tokens, tokens / (plan.containers * capacity) if plan.containers else None,
                     plan.value, plan.columns, plan.steps, plan.rounded, plan.greedy, plan.by))
    return spark.createDataFrame(rows, "pack_name string, capacity_tokens int, containers bigint, fewest bigint, tokens bigint, filled double, program_value double, columns int, steps int, rounded bigint, longest_first bigint, packed_by string")


def p6_audit(spark, d):
    """For each pack: documents placed, containers over their capacity, documents cut though they fit, and documents whose
    pieces do not add up to their tokens."""
    sized = Scratch(spark).write(_token_sizes(spark, d))
    placed = Scratch(spark).write(p6_containers(spark, d))
    packs = table(spark, d, "pack_capacity").select("pack_name", "capacity_tokens").distinct()
    full = placed.filter("length > 0").groupBy("pack_name", "container").agg(F.sum("length").alias("held")).join(packs, "pack_name")
    over = full.groupBy("pack_name").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull"))
    docs = placed.groupBy("pack_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("held")).join(sized, "doc_id").join(packs, "pack_name")
    each = docs.groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).alias("cut_in_vain"), F.count_if(F.col("held") != F.col("n_tokens")).alias("wrong_size"))
    return each.join(over, "pack_name").select("pack_name", "documents", "overfull", "cut_in_vain", "wrong_size")


# 7: a mixture of sources --------------------------------------------------------------------------------------------
def _mixed(spark, d):
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, d, "mix_targets").filter("source is not null and target_share > 0").collect()]
    spelt = F.regexp_replace(F.lower(F.trim("source")), "[- ]", "_")
    sized = _token_sizes(spark, d, "text", spelt.alias("source"))
    return targets, *mixing.mix(sized, "doc_id", "text", "source", "n_tokens", targets)


def p7_selection(spark, d):
    """The chosen documents, the source each counts for and its repeats."""
    return _mixed(spark, d)[1]


def p7_shares(spark, d):
    """Target and reached share of each source."""
    targets, chosen, _ = _mixed(spark, d)
    chosen = Scratch(spark).write(chosen)
    got = chosen.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    want = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    total = chosen.agg(F.sum(F.col("repeats") * F.col("n_tokens"))).first()[0] or 0
    tokens = F.coalesce("tokens", F.lit(0))
    return want.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), "most_repeats",
        (tokens / F.lit(float(total)) if total else F.lit(0.0)).alias("actual_share"))


def p7_audit(spark, d):
    """For each source that has a target and documents: whether its share, among those that have documents, is met to a
    hundredth; its documents used too often, and those whose text is chosen under another number too."""
    targets, chosen, _ = _mixed(spark, d)
    chosen = Scratch(spark).write(chosen)
    want = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    texts = table(spark, d, "documents").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    kept = chosen.join(texts, "doc_id").join(want, "source")
    copies = kept.select("doc_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    each = kept.join(copies, ["h1", "h2"]).groupBy("source").agg(
        F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.max("target_share").alias("target"), F.count_if(F.col("repeats") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("copies") > 1).alias("copies"))
    each = Scratch(spark).write(each)
    tokens, target = each.agg(F.sum("tokens"), F.sum("target")).first()
    met = F.abs(F.col("tokens") / F.lit(float(tokens or 1)) - F.col("target") / F.lit(float(target or 1))) < 0.01
    return each.select("source", met.alias("met"), "too_often", "copies")


QUERIES = {f.__name__: f for f in (
    p2_found, p2_groups, p2_document_groups, p4_found, p4_ranked, p5_found, p5_scores, p5_source_rates, p6_containers, p6_fill, p6_audit, p7_selection, p7_shares, p7_audit,
    p8_found, p8_scores)}

_NEWEST = """
    WITH e AS (SELECT id, min(lev_id) AS lev_id, arg_min(pubkey, lev_id) AS pubkey, arg_min(kind, lev_id) AS kind, arg_min(created_at, lev_id) AS created_at
               FROM seed_events WHERE pubkey IS NOT NULL AND kind IS NOT NULL AND created_at IS NOT NULL GROUP BY id),
    r AS (SELECT *, row_number() OVER (PARTITION BY pubkey, kind ORDER BY created_at DESC, lev_id DESC) AS rn FROM e)"""

ORACLE = {
    "p4_found": _NEWEST + " SELECT pubkey, kind, lev_id FROM r WHERE rn <= 3",
    "p4_ranked": _NEWEST + " SELECT pubkey, kind, lev_id, created_at, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 10",
    # what any right answer shows
    "p6_audit": "SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS overfull, 0 AS cut_in_vain, 0 AS wrong_size FROM (SELECT DISTINCT pack_name FROM pack_capacity)",
    "p7_audit": """SELECT source, true AS met, 0 AS too_often, 0 AS copies FROM mix_targets WHERE target_share > 0 AND source IN
        (SELECT regexp_replace(lower(trim(source)), '[- ]', '_', 'g') FROM documents WHERE text IS NOT NULL AND text <> '')""",
}
