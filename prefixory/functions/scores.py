"""Numeric functions: decay, hashing, popularity laws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as DOUBLE, of a timestamp with or without time zone (UTC session)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def decay(dt: Column, half_life: float) -> Column:
    """0.5^(dt / half_life); 1 where dt is not positive; 0 for a half-life that is not."""
    if half_life <= 0:
        return F.when(dt <= 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(dt <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), dt / F.lit(float(half_life))))


def ring_hash(key: Column) -> Column:
    """The first 32 bits of the key's MD5 as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def zipf_count(rank: Column, scale: float = 1e7, exponent: float = 1.07, jitter: Column | None = None) -> Column:
    base = F.lit(scale) * F.pow(rank.cast("double"), F.lit(-exponent))
    return F.greatest(F.lit(1).cast("bigint"), F.floor(base if jitter is None else base * jitter).cast("bigint"))
