"""Asking a source in chunks that shrink where it refuses, and answers that carry their errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

from quern.plans.filters import InvalidCursor

T, R = TypeVar("T"), TypeVar("R")


def chunked(items: Sequence[T], ask: Callable[[Sequence[T]], R], size: int = 250, refused: tuple[type[Exception], ...] = (Exception,)) -> Iterator[tuple[Sequence[T], R | None, Exception | None]]:
    """(chunk, answer, None) for all ``items`` in their order, ``size`` at a time; a chunk that is refused is cut in two and
    asked again, down to single items, which then come as (chunk, None, error). The size in use is halved with every
    refusal and doubles again, up to ``size``, with every answer."""
    at, now = 0, size
    while at < len(items):
        chunk = items[at:at + now]
        try:
            yield chunk, ask(chunk), None
        except refused as e:
            if len(chunk) > 1:
                now = max(1, len(chunk) // 2)
                continue
            yield chunk, None, e
        at += len(chunk)
        now = min(size, now * 2)


def pages(ask: Callable[[str | None], tuple[list[R], str | None]], cursor: str | None = None) -> Iterator[list[R]]:
    """Pages until there is no cursor; a cursor that comes twice in a row means a page that is stuck, which raises."""
    while True:
        rows, after = ask(cursor)
        yield rows
        if after is None:
            return
        if after == cursor:
            raise RuntimeError(f"the page after {cursor!r} leads to itself")
        cursor = after


def answer(run: Callable[[], R]) -> dict:
    """``{"data": …}`` or ``{"data": None, "errors": [{"message", "code"}]}``; the codes are bad_cursor, bad_input, not_found and
    internal."""
    try:
        return {"data": run()}
    except Exception as e:
        code = "bad_cursor" if isinstance(e, InvalidCursor) else "not_found" if isinstance(e, LookupError) else "bad_input" if isinstance(e, ValueError) else "internal"
        return {"data": None, "errors": [{"message": str(e), "code": code}]}
