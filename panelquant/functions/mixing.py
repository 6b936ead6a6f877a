"""Reproducible draws from integer keys, in plain arithmetic that any engine repeats exactly."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

MOD = 2147483647
STEP = (7919, 104729, 1299709, 15485863)


def mix(*keys, seed: int = 42) -> Column:
    """Integer in [0, MOD) from integer key columns (three quadratic rounds)."""
    parts = [F.pmod(col(k).cast("bigint"), F.lit(MOD)) * s for k, s in zip(keys, STEP)]
    x = F.pmod(reduce(lambda a, b: a + b, parts, F.lit(seed).cast("bigint")), F.lit(MOD))
    for _ in range(3):
        x = F.pmod(x * x + x * 48271 + 11, F.lit(MOD))
    return x


def unit(*keys, seed: int = 42) -> Column:
    """Uniform in (0, 1)."""
    return (mix(*keys, seed=seed) + 0.5) / float(MOD)


def normal(*keys, seed: int = 42) -> Column:
    """Standard normal from two draws; the last key must leave its successor free."""
    *rest, last = keys
    u, v = unit(*keys, seed=seed), unit(*rest, col(last) + 1, seed=seed)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def sql_mix(*keys: str, seed: int = 42) -> str:
    x = f"(({' + '.join([str(seed)] + [f'(CAST({k} AS BIGINT) % {MOD}) * {s}' for k, s in zip(keys, STEP)])}) % {MOD})"
    return x


def sql_rounds(source: str, x: str, name: str) -> str:
    """Adds ``name`` from the start value x, one nested select per round."""
    out = f"SELECT *, {x} AS zz0 FROM ({source})"
    for i in range(3):
        out = f"SELECT *, (zz{i} * zz{i} + zz{i} * 48271 + 11) % {MOD} AS zz{i + 1} FROM ({out})"
    return f"SELECT * EXCLUDE (zz0, zz1, zz2, zz3), zz3 AS {name} FROM ({out})"
