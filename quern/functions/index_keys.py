"""Index keys as bytes that sort as their typed parts do, for stores that only compare bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_bytes(value: Column) -> Column:
    """A tag's value in an index: 64 lower-case hex digits are 32 bytes, any other text its UTF-8 bytes."""
    return F.when(value.rlike("^[0-9a-f]{64}$"), F.unhex(value)).otherwise(F.encode(value, "UTF-8"))


def number_bytes(number: Column) -> Column:
    """Eight bytes, the highest first, so that bytes compare as numbers do; for numbers from 0 on, others give null."""
    return F.when(number >= 0, F.unhex(F.lpad(F.hex(number.cast("bigint")), 16, "0")))


def key(*parts: Column) -> Column:
    """The parts one after the other; of parts of unlike length only the last may vary. Null if any part is."""
    return F.concat(*parts)


def number_at_end(key: Column) -> Column:
    """The number in the last eight bytes of a key, such as its ``created_at``."""
    return F.conv(F.hex(F.substring(key, -8, 8)), 16, 10).cast("bigint")


def successor(key: Column) -> Column:
    """The next key of the same length, with carry; null behind the last one (all bits set) and for an empty key."""
    h = F.hex(key)
    digit = F.regexp_extract(h, "([0-9A-E])F*$", 1)
    stem = F.regexp_extract(h, "^(.*)[0-9A-E]F*$", 1)
    following = F.concat(stem, F.translate(digit, "0123456789ABCDE", "123456789ABCDEF"), F.repeat(F.lit("0"), F.length(h) - F.length(stem) - 1))
    return F.when(digit != "", F.unhex(following))
