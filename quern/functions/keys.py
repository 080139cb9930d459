"""Keys in text form: hex, the bech32 forms, and Schnorr signatures over secp256k1."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the bech32 and secp256k1 standards
CHARSET = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = [0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3]
P = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEFFFFFC2F
N = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141
G = (0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8)


def _polymod(values: list[int]) -> int:
    c = 1
    for v in values:
        top = c >> 25
        c = (c & 0x1FFFFFF) << 5 ^ v
        for i in range(5):
            c ^= GENERATOR[i] if top >> i & 1 else 0
    return c


def _spread(hrp: str) -> list[int]:
    return [ord(x) >> 5 for x in hrp] + [0] + [ord(x) & 31 for x in hrp]


def _regroup(data, of: int, to: int, pad: bool) -> bytes | None:
    acc = bits = 0
    out = bytearray()
    for v in data:
        acc = acc << of | v
        bits += of
        while bits >= to:
            bits -= to
            out.append(acc >> bits & (1 << to) - 1)
    if pad and bits:
        out.append(acc << (to - bits) & (1 << to) - 1)
    elif not pad and (bits >= of or acc & (1 << bits) - 1):
        return None
    return bytes(out)


def bech32_decode(text: str) -> tuple[str, bytes] | None:
    at = text.rfind("1")
    if at < 1 or at + 7 > len(text) or any(c not in CHARSET for c in text[at + 1:]):
        return None
    data = [CHARSET.index(c) for c in text[at + 1:]]
    if _polymod(_spread(text[:at]) + data) != 1:
        return None
    raw = _regroup(data[:-6], 5, 8, False)
    return None if raw is None else (text[:at], raw)


def bech32_encode(hrp: str, raw: bytes) -> str:
    data = list(_regroup(raw, 8, 5, True))
    check = _polymod(_spread(hrp) + data + [0] * 6) ^ 1
    return hrp + "1" + "".join(CHARSET[d] for d in data + [check >> 5 * (5 - i) & 31 for i in range(6)])


def parse_identifier(text: str | None) -> str | None:
    """The 64 hex digits behind a hex key, an ``npub`` or an ``nprofile``; None for anything else, secret keys included."""
    t = (text or "").strip().lower()
    if re.fullmatch("[0-9a-f]{64}", t):
        return t
    if not t.startswith(("npub1", "nprofile1")) or (found := bech32_decode(t)) is None:
        return None
    hrp, raw = found
    if hrp == "npub":
        return raw.hex() if len(raw) == 32 else None
    while len(raw) >= 2:  # type, length, value
        kind, size = raw[0], raw[1]
        if kind == 0 and size == 32 and len(raw) >= 34:
            return raw[2:34].hex()
        raw = raw[2 + size:]
    return None


@F.pandas_udf(T.StringType())
def identifier(text: pd.Series) -> pd.Series:
    return text.map(lambda t: parse_identifier(t) if isinstance(t, str) else None)


def _add(a, b):
    if a is None or b is None:
        return b or a
    if a[0] == b[0] and a[1] != b[1]:
        return None
    m = 3 * a[0] * a[0] * pow(2 * a[1], -1, P) if a == b else (b[1] - a[1]) * pow(b[0] - a[0], -1, P)
    x = (m * m - a[0] - b[0]) % P
    return x, (m * (a[0] - x) - a[1]) % P


def _times(p, k: int):
    out = None
    while k:
        out = _add(out, p) if k & 1 else out
        p, k = _add(p, p), k >> 1
    return out


def _lift(x: int):
    if x >= P:
        return None
    c = (pow(x, 3, P) + 7) % P
    y = pow(c, (P + 1) // 4, P)
    return None if y * y % P != c else (x, y if y % 2 == 0 else P - y)


def _tagged(tag: str, data: bytes) -> int:
    t = hashlib.sha256(tag.encode()).digest()
    return int.from_bytes(hashlib.sha256(t + t + data).digest(), "big")


def schnorr_verify(key: str, message: str, sig: str) -> bool:
    """A 64-byte signature over a 32-byte message by an x-only key, all in hex."""
    try:
        k, m, s = bytes.fromhex(key), bytes.fromhex(message), bytes.fromhex(sig)
    except (ValueError, TypeError):
        return False
    if (len(k), len(m), len(s)) != (32, 32, 64):
        return False
    r, t = int.from_bytes(s[:32], "big"), int.from_bytes(s[32:], "big")
    p = _lift(int.from_bytes(k, "big"))
    if p is None or r >= P or t >= N:
        return False
    e = _tagged("BIP0340/challenge", s[:32] + k + m) % N
    out = _add(_times(G, t), _times(p, N - e))
    return out is not None and out[1] % 2 == 0 and out[0] == r


def event_id(pubkey: str, created_at: int, kind: int, tags: list, content: str) -> str:
    body = json.dumps([0, pubkey, created_at, kind, tags, content], separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(T.BooleanType())
def signature_ok(pubkey: pd.Series, ident: pd.Series, sig: pd.Series) -> pd.Series:
    return pd.Series([isinstance(s, str) and schnorr_verify(k, i, s) for k, i, s in zip(pubkey, ident, sig)], dtype=bool)


def hex_to_bytes(c: Column) -> Column:
    """Null instead of an error for what is no hex."""
    return F.try_to_binary(F.lower(c), F.lit("hex"))
