"""Event filters, compiled to column predicates, and the page cursor."""

from __future__ import annotations

import base64
import binascii
import logging
import re
import struct
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
HEX32 = re.compile("[0-9a-fA-F]{64}")
#: lists up to this long become an IN predicate that reaches the scan; longer ones should be joined
IN_LIST = 2_000


class InvalidCursor(ValueError):
    """The cursor is not 16 bytes of base64."""


@dataclass(frozen=True)
class Cursor:
    """The last row of a page, in the order newest first, then by descending ``lev_id``."""

    created_at: int
    lev_id: int

    def encode(self) -> str:
        return base64.b64encode(struct.pack("<QQ", self.created_at, self.lev_id)).decode()

    @staticmethod
    def decode(text: str) -> Cursor:
        try:
            raw = base64.b64decode(text, validate=True)
        except (binascii.Error, ValueError) as e:
            raise InvalidCursor(text) from e
        if len(raw) != 16:
            raise InvalidCursor(text)
        return Cursor(*struct.unpack("<QQ", raw))

    def after(self) -> Column:
        """Rows strictly behind the cursor. Fields beyond BIGINT are compared as decimals."""
        big = lambda v: F.lit(str(v)).cast("decimal(20,0)") if v >= 2**63 else F.lit(v)
        ts, lev = big(self.created_at), big(self.lev_id)
        return (F.col("created_at") < ts) | ((F.col("created_at") == ts) & (F.col("lev_id") < lev))


@dataclass(frozen=True)
class EventFilter:
    """Unset fields match everything, an empty list matches nothing. ``tags`` is (name, values): all names must be
    present with one of their values. ``now`` drops events that have expired by then."""

    ids: list[str] | None = None
    authors: list[str] | None = None
    kinds: list[int] | None = None
    tags: list[tuple[str, list[str]]] = field(default_factory=list)
    since: int | None = None
    until: int | None = None
    now: int | None = None

    def validate(self) -> EventFilter:
        for name in ("since", "until"):
            if (v := getattr(self, name)) is not None and v < 0:
                raise ValueError(f"{name} must not be negative")
        if any(k < 0 for k in self.kinds or ()):
            raise ValueError("kinds must not be negative")
        if self.since is not None and self.until is not None and self.since > self.until:
            raise ValueError("since is after until")
        return self


def _keys(values: list[str]) -> list[str]:
    """Distinct well-formed keys; others are skipped with a warning. Stored keys are lower case and compared as such."""
    good = [v for v in dict.fromkeys(values) if HEX32.fullmatch(v)]
    for bad in set(values) - set(good):
        log.warning("skipped a key that is not 32 bytes of hex: %.80s", bad)
    return good


def _member(column: str, values: list) -> Column:
    return F.col(column).isin(values) if values else F.lit(False)


def tag_matches(name: str, values: list[str]) -> Column:
    """Some tag is [name, one of values, ...]."""
    return F.exists("tags", lambda t: (F.size(t) >= 2) & F.coalesce(F.get(t, F.lit(0)) == name, F.lit(False)) & F.coalesce(F.get(t, F.lit(1)).isin(list(values)), F.lit(False))) if values else F.lit(False)


def expired(now: int) -> Column:
    """Some tag ["expiration", t] with a whole t, neither 0 nor later than ``now``. A text that is no number never
    expires."""
    def due(t: Column) -> Column:
        text = F.get(t, F.lit(1))
        when = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("decimal(20,0)"))
        return F.coalesce((F.get(t, F.lit(0)) == "expiration") & (when != 0) & (when <= now), F.lit(False))

    return F.coalesce(F.exists("tags", due), F.lit(False))


def compile_filter(f: EventFilter) -> Column:
    """One predicate; Catalyst pushes its simple parts to the scan."""
    f.validate()
    if f.tags and not (f.ids is not None or f.authors is not None or f.kinds is not None) and not any(len(n.encode()) == 1 for n, _ in f.tags):
        return F.lit(False)  # a query by tags alone needs one that is indexed, of one byte
    parts = [F.col("created_at").isNotNull()]
    if f.ids is not None:
        parts.append(_member("id", _keys(f.ids)))
    if f.authors is not None:
        parts.append(_member("pubkey", _keys(f.authors)))
    if f.kinds is not None:
        parts.append(_member("kind", list(dict.fromkeys(f.kinds))))
    if f.since is not None:
        parts.append(F.col("created_at") >= f.since)
    if f.until is not None:
        parts.append(F.col("created_at") <= f.until)
    parts += [F.coalesce(tag_matches(n, v), F.lit(False)) for n, v in f.tags]
    if f.now is not None:
        parts.append(~expired(f.now))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out
