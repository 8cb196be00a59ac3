"""Deterministic per-key draws for synthetic data.

A Lehmer (MINSTD) step ``x -> x * 48271 mod (2^31 - 1)`` keeps every
intermediate below 2^47, so it is exact in BIGINT arithmetic in Spark and
in any SQL engine; a draw depends only on (key, salt), never on the
partitioning, unlike ``rand()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647
MULTIPLIER = 48271
SALT_STRIDE = 7919


def seed(key: Column, salt: int | Column) -> Column:
    """Map (key, salt) into [1, 2^31 - 2]; key and salt must be >= 0."""
    s = F.lit(salt) if isinstance(salt, int) else salt
    return ((key.cast("bigint") + s.cast("bigint") * F.lit(SALT_STRIDE)) % F.lit(MODULUS - 1)
            + F.lit(1))


def step(x: Column, rounds: int = 1) -> Column:
    for _ in range(rounds):
        x = x * F.lit(MULTIPLIER) % F.lit(MODULUS)
    return x


def draw_int(key: Column, salt: int | Column, lo: int, hi: int) -> Column:
    """Uniform-ish integer in [lo, hi] for (key, salt)."""
    return (F.lit(lo) + step(seed(key, salt), 2) % F.lit(hi - lo + 1)).cast("bigint")


def draw_sql(key_sql: str, salt: int | str, lo: int, hi: int) -> str:
    """The same draw as SQL text (for oracle queries)."""
    s = f"((({key_sql}) + cast({salt} as bigint) * {SALT_STRIDE}) % {MODULUS - 1} + 1)"
    x = f"(({s} * {MULTIPLIER} % {MODULUS}) * {MULTIPLIER} % {MODULUS})"
    return f"({lo} + {x} % {hi - lo + 1})"
