"""Pair statistics of many series without joining every pair row by row.

Series are hashed into blocks; each block pair meets in one task per time chunk and is reduced
with matrix products. A series is shipped once per block pair, never once per partner.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERIES_PER_BLOCK = 256


def block_count(df: DataFrame, asset: str = "asset", per_block: int = SERIES_PER_BLOCK) -> int:
    n = df.agg(F.approx_count_distinct(asset)).first()[0]
    return max(1, math.ceil(n / per_block))


def block_pairs(df: DataFrame, blocks: int, asset: str = "asset") -> DataFrame:
    """Adds (bi, bj), bi <= bj, for every block pair the series takes part in."""
    b = F.pmod(F.xxhash64(asset), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return (
        df.withColumn("_b", b).withColumn("_o", other)
        .withColumn("bi", F.least("_b", "_o")).withColumn("bj", F.greatest("_b", "_o"))
        .drop("_o")
    )


def pair_moments(df: DataFrame, keys: list[str], chunk, asset: str = "asset", ts: str = "ts",
                 value: str = "r", blocks: int | None = None) -> DataFrame:
    """Per (keys, a <= b): n, sums, sums of squares and of products over dates where both exist.

    ``chunk`` is an expression that bounds the dates of one task (for example the year)."""
    blocks = block_count(df, asset) if blocks is None else blocks
    src = block_pairs(
        df.select(*keys, F.col(asset).alias("asset"), F.col(ts).alias("ts"),
                  F.col(value).cast("double").alias("r"), (F.expr(chunk) if isinstance(chunk, str) else chunk).alias("_c")),
        blocks,
    )
    kt = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kt[k]}" for k in keys)
    at = kt[asset]
    schema += (", " if keys else "") + (
        f"a {at}, b {at}, n double, sa double, sb double, saa double, sbb double, sab double, saabb double"
    )

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = pdf["bi"].iat[0], pdf["bj"].iat[0]
        wide = pdf.pivot(index="ts", columns="asset", values="r")
        home = pdf.drop_duplicates("asset").set_index("asset")["_b"]
        left = [c for c in wide.columns if home[c] == bi]
        right = [c for c in wide.columns if home[c] == bj]
        x, y = wide[left].to_numpy(float), wide[right].to_numpy(float)
        mx, my = ~np.isnan(x), ~np.isnan(y)
        x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
        mx, my = mx.astype(float), my.astype(float)
        mats = {
            "n": mx.T @ my, "sa": x.T @ my, "sb": mx.T @ y,
            "saa": (x * x).T @ my, "sbb": mx.T @ (y * y),
            "sab": x.T @ y, "saabb": (x * x).T @ (y * y),
        }
        la, rb = np.array(left, dtype=object), np.array(right, dtype=object)
        ia, ib = np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij")
        a, b = la[ia.ravel()], rb[ib.ravel()]
        keep = a <= b if bi == bj else np.ones(len(a), bool)
        swap = a > b
        out = pd.DataFrame({m: v.ravel() for m, v in mats.items()})
        out["a"], out["b"] = np.where(swap, b, a), np.where(swap, a, b)
        for p, q in (("sa", "sb"), ("saa", "sbb")):
            pv, qv = out[p].to_numpy(), out[q].to_numpy()
            out[p], out[q] = np.where(swap, qv, pv), np.where(swap, pv, qv)
        out = out[keep & (out["n"].to_numpy() > 0)]
        for k in keys:
            out[k] = pdf[k].iat[0]
        return out[[*keys, "a", "b", "n", "sa", "sb", "saa", "sbb", "sab", "saabb"]]

    parts = src.groupBy(*keys, "bi", "bj", "_c").applyInPandas(part, schema)
    return parts.groupBy(*keys, "a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab", "saabb")]
    )
