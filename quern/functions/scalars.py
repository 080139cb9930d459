"""Small scalar rules: windows in time, kinds by name, quorums, formats, relay addresses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: days from year 1 to 1970, by which windows that start at year 1 are shifted
DAYS_BEFORE_EPOCH = 719_162
# fixed values: names of common kinds
KIND_NAMES = {
    0: "User Metadata", 1: "Short Text Note", 2: "Recommend Relay", 3: "Follows", 4: "Encrypted Direct Messages", 5: "Event Deletion Request", 6: "Repost", 7: "Reaction",
    1984: "Reporting", 9735: "Zap", 10002: "Relay List Metadata", 30023: "Long-form Content",
}


def truncate_time(ts: Column, seconds: int) -> Column:
    """Start of the window of ``seconds`` that holds ``ts``, windows counted from the first of January of year 1."""
    shift = DAYS_BEFORE_EPOCH * 86_400
    return (F.floor((ts + shift) / seconds) * seconds - shift).cast("bigint")


def next_window(start: int, end: int) -> tuple[int, int]:
    return end, end + (end - start)


def window_from(start: int, seconds: int) -> tuple[int, int]:
    return start, start + seconds


def window_problem(start: int | None, end: int | None, now: int) -> str | None:
    """What is wrong with a sync window; None if nothing is."""
    year = 365 * 86_400
    if not start or not end:
        return "unset"
    if start >= end:
        return "empty"
    if end - start < 1 or end - start > year:
        return "duration"
    return "start" if not now - 10 * year <= start <= now + year else None


def tag_value(tags: Column, name: str) -> Column:
    """The value of the last tag of a name, null if there is none."""
    values = F.filter(tags, lambda t: F.coalesce((F.get(t, F.lit(0)) == name) & (F.size(t) >= 2), F.lit(False)))
    return F.get(F.try_element_at(values, F.lit(-1)), F.lit(1))


def window_of_tags(tags: Column) -> Column:
    """``from`` and ``to`` of a progress record as seconds."""
    return F.struct(tag_value(tags, "from").try_cast("bigint").alias("start"), tag_value(tags, "to").try_cast("bigint").alias("end"))


def kind_name(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, kind.cast("int")), F.concat(F.lit("Kind "), kind.cast("string")))


def quorum_reached(done: int, n: int, share: float) -> bool:
    return share > 0 and done >= math.ceil(n * share)


def clamp_i32(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(2**31 - 1)), F.lit(-(2**31))).cast("int")


def with_commas(c: Column) -> Column:
    return F.format_number(c, 0)


def round3(c: Column) -> Column:
    return F.round(c, 3)


def short_key(c: Column) -> Column:
    return F.substring(c, 1, 8)


def query_address(url: str) -> str:
    """The query endpoint of a graph server, from its address or that of its other endpoint."""
    if url.endswith("/query"):
        return url
    return url.removesuffix("/graphql").rstrip("/") + "/query"


def relay_form(c: Column) -> Column:
    """The form under which relay addresses are the same."""
    return F.regexp_replace(F.lower(F.trim(c)), "/+$", "")
