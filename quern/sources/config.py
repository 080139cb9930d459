"""Lists of addresses in configuration files."""

from __future__ import annotations

import re


def listed(text: str, key: str) -> list[str]:
    """Items of the plain list under ``key`` in a YAML text, without quotes and comments."""
    out, depth = [], None
    for line in text.splitlines():
        bare = re.sub(r"(?:^|\s)#.*$", "", line).rstrip()
        if not bare:
            continue
        indent = len(bare) - len(bare.lstrip())
        if depth is not None:
            item = re.match(r"\s*-\s+(.*)$", bare)
            if item and indent >= depth:
                out.append(item[1].strip().strip("'\""))
                continue
            break
        if re.match(rf"\s*{re.escape(key)}\s*:\s*$", bare):
            depth = indent
    return out


def form(url: str) -> str:
    return re.sub("/+$", "", url.strip().lower())


def merged(existing: list[str], new: list[str], replace: bool = False) -> list[str]:
    """Existing addresses and the new ones, once each by form, in the spelling first met. ``replace`` drops existing
    addresses except unencrypted ones, which no discovery would bring back."""
    kept = [u for u in existing if not replace or form(u).startswith("ws://")]
    first: dict[str, str] = {}
    for u in [*kept, *new]:
        first.setdefault(form(u), u)
    return list(first.values())


def secure(urls: list[str]) -> list[str]:
    return [u for u in urls if form(u).startswith("wss://")]


def load_verdict(edges: int, seconds: float, target_edges: int = 30_000_000, limit_s: float = 30.0) -> tuple[float, bool]:
    """Seconds that ``target_edges`` would take at this rate, and whether that is within the limit."""
    at = seconds * target_edges / edges if edges else float("inf")
    return at, at <= limit_s
