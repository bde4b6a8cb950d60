"""Deterministic identifiers and hash splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of name-based identifiers for URLs.
_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def hashed_id(prefix: str, source: Column, length: int = 32) -> Column:
    """prefix and the first hexadecimal digits of the source's sha256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(source, 256), 1, length))


def uuid5(name: Column) -> Column:
    """Name-based identifier (version 5, URL namespace) as 36 characters."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def hash_share(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first eight bytes of sha256(seed:key)."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hash_split(key: Column, seed: str, ratios: dict[str, float], explicit: Column | None = None) -> Column:
    """The split whose cumulative ratio first exceeds the key's share; an explicit split wins. Keys are never divided."""
    share, passed, out = hash_share(key, seed), 0.0, None
    *first, last = ratios
    for name in first:
        passed += ratios[name]
        out = F.when(share < passed, name) if out is None else out.when(share < passed, name)
    out = F.lit(last) if out is None else out.otherwise(last)
    return out if explicit is None else F.coalesce(explicit, out)
