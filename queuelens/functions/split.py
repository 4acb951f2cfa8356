"""Deterministic train/valid/test assignment by job.

The bucket is the 64-bit integer hash of the job id (multiply-xorshift, as
DuckDB's ``hash`` of a UBIGINT) modulo 100, read as unsigned. Spark's 64-bit
products raise on overflow, so a product modulo 2^64 is put together from 16-
and 32-bit limbs, all of them plain column arithmetic inside the generated code.
Every row of a job lands in the same split; the expression is per row, so
assigning splits needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Split boundaries on the 0..99 bucket (80/10/10).
TRAIN_BELOW = 80
VALID_BELOW = 90

# The multiplier of the hash and its halves.
MULTIPLIER = 0xD6E8FEB86659FD93
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_M16, _M32 = 0xFFFF, 0xFFFFFFFF


def _times_multiplier(hi: Column, lo: Column) -> tuple[Column, Column]:
    """32-bit halves of (hi, lo) * MULTIPLIER modulo 2^64; no step passes 2^63."""
    def low_product(x: Column, by: int) -> Column:         # x * by modulo 2^32
        upper = F.shiftleft((F.shiftright(x, 16) * by).bitwiseAND(_M16), 16)
        return (x.bitwiseAND(_M16) * by + upper).bitwiseAND(_M32)

    p, q = lo.bitwiseAND(_M16) * _LOW, F.shiftright(lo, 16) * _LOW        # below 2^48 each
    low = F.shiftleft(q.bitwiseAND(_M16), 16) + p.bitwiseAND(_M32)
    carried = F.shiftright(p, 32) + F.shiftright(q, 16) + F.shiftright(low, 32)
    return (carried + low_product(lo, _HIGH) + low_product(hi, _LOW)).bitwiseAND(_M32), low.bitwiseAND(_M32)


def hash_halves(key: Column) -> tuple[Column, Column]:
    """Upper and lower 32 bits of the hash of a bigint key, as non-negative bigints."""
    key = key.cast("bigint")
    hi = F.shiftrightunsigned(key, 32)
    lo = key.bitwiseAND(_M32).bitwiseXOR(hi)
    for _ in range(2):
        hi, lo = _times_multiplier(hi, lo)
        lo = lo.bitwiseXOR(hi)
    return hi, lo


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """Unsigned hash of the key modulo ``buckets`` (below 2^30)."""
    hi, lo = hash_halves(key)
    return (((hi % buckets) * (2**32 % buckets) + lo) % buckets).cast("int")


def split_label(key: Column) -> Column:
    b = hash_bucket(key)
    return (
        F.when(b < TRAIN_BELOW, F.lit("train"))
        .when(b < VALID_BELOW, F.lit("valid"))
        .otherwise(F.lit("test"))
    )


def split_label_sql(key: str) -> str:
    """The rule as DuckDB SQL text (oracle side), on DuckDB's own hash."""
    b = f"(abs(hash({key}::UBIGINT)) % 100)"
    return (
        f"CASE WHEN {b} < {TRAIN_BELOW} THEN 'train' "
        f"WHEN {b} < {VALID_BELOW} THEN 'valid' ELSE 'test' END"
    )
