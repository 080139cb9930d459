"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("pubkey", T.StringType()), T.StructField("created_at", T.LongType()),
    T.StructField("kind", T.LongType()), T.StructField("tags", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("content", T.StringType()), T.StructField("sig", T.StringType()),
])

PROFILE = "uid bigint, pubkey string, kind3_created_at bigint, last_db_update bigint, last_attempt bigint, next_attempt bigint, miss_count int, follower_count bigint, uncrawled int"

#: the scoring store: table -> (columns, key)
STORE = {
    "run": ("run_id bigint, started_at bigint, finished_at bigint, max_lev_id_start bigint, max_lev_id_end bigint, last_cursor string, config_json string, status string", ["run_id"]),
    "pubkey": ("pubkey string", ["pubkey"]),
    "score": ("run_id bigint, pubkey string, score double, suspected int, whitelisted int", ["run_id", "pubkey"]),
    "signal": ("run_id bigint, pubkey string, layer string, value double, evidence string", ["run_id", "pubkey", "layer"]),
    "fingerprint": ("run_id bigint, pubkey string, content_hash bigint, simhash bigint", ["run_id", "pubkey", "content_hash"]),
    "backpropagation": ("pubkey string, is_spam int, source string", ["pubkey"]),
    "weight": ("layer string, value double", ["layer"]),
    "suspected_spammer": ("run_id bigint, pubkey string, score double, rank bigint", ["run_id", "pubkey"]),
    "review_queue": ("run_id bigint, pubkey string, score double", ["run_id", "pubkey"]),
}
