"""Hash families of the sketches.

``portable`` takes bucket and sign from the two halves of one md5, so that any SQL
engine can rebuild a sketch; ``native`` uses xxhash64 and is faster.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILIES = ("portable", "native")


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))


def _number(digest: Column, first: int) -> Column:
    return F.conv(F.substring(digest, first, 15), 16, 10).cast("long")


def hash_pair(row: Column, key: Column, family: str = "portable", seed: int = 0) -> Column:
    """Struct ``hi, lo`` of two independent non-negative numbers for a key and a row.
    Seed 0 hashes ``row:key``, another seed ``seed:row:key``."""
    parts = [row, key] if seed == 0 else [F.lit(seed), row, key]
    if family == "portable":
        digest = _digest(*parts)
        return F.struct(_number(digest, 1).alias("hi"), _number(digest, 17).alias("lo"))
    if family == "native":
        whole = F.xxhash64(*parts)
        return F.struct(F.shiftrightunsigned(whole, 20).alias("hi"), whole.bitwiseAND(F.lit((1 << 20) - 1)).alias("lo"))
    raise ValueError(f"family must be one of {FAMILIES}")


def sign(lo: Column) -> Column:
    """+1 or -1 by parity."""
    return F.lit(1) - F.lit(2) * lo.bitwiseAND(F.lit(1))


def signs(row: Column, key: Column, k: int, family: str = "portable", seed: int = 0) -> Column:
    """``k`` signs of a key that are independent of each other; the first is that of
    ``hash_pair``. With k = 4 any of them may be multiplied."""
    if k < 1:
        raise ValueError("k must be positive")
    more = (sign(hash_pair(F.concat_ws("/", row.cast("string"), F.lit(str(i))), key, family, seed)["lo"]) for i in range(1, k))
    return F.array(sign(hash_pair(row, key, family, seed)["lo"]), *more)


def unit_hash(seed: Column | int, *parts: Column) -> Column:
    """A 60-bit number for one unit of a stream."""
    return _number(_digest(F.lit(seed) if isinstance(seed, int) else seed, *parts), 1)


def trailing_zeros(h: Column) -> Column:
    """Zero bits below the lowest one bit: at least k with chance 2**-k."""
    return F.bit_count(h.bitwiseAND(-h) - 1)
