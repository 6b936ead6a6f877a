"""Mean reversion and cointegration of price pairs (M9)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.adf import adf
from ..functions.columns import by_time
from ..functions.gram import block_count, block_pairs

FIELDS = ("n bigint, cointegrated boolean, p_value double, hedge_ratio_beta double, intercept_alpha double, "
          "current_spread_zscore double, half_life_days double, theta double")


def ou_half_life(series: DataFrame, value: str = "value") -> DataFrame:
    """AR(1) fit of each series read as a mean-reverting process; slope outside (0, 1) gives 999 days."""
    d = series.withColumn("_l", F.lag(value).over(by_time()))
    x = F.when(F.col("_l").isNotNull(), F.col(value))
    g = d.groupBy("asset").agg(
        F.regr_slope(value, "_l").alias("b"), F.regr_intercept(value, "_l").alias("a"),
        (F.var_pop(x) - F.regr_slope(value, "_l") * F.covar_pop(x, "_l")).alias("rv"),
        F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    ok = (F.col("b") > 0) & (F.col("b") < 1)
    speed = -F.ln(F.when(ok, F.col("b")))
    year = 252.0 ** 0.5
    return g.select(
        "asset", F.coalesce(speed * 252, F.lit(0.0)).alias("theta"),
        F.when(ok, F.col("a") / F.nullif(1 - F.col("b"), F.lit(0.0))).otherwise(F.col("m")).alias("mu"),
        F.when(ok, F.sqrt(F.greatest("rv", F.lit(0.0))) * year).otherwise(F.col("s") * year).alias("sigma"),
        F.coalesce(F.lit(math.log(2.0)) / speed, F.lit(999.0)).alias("half_life_days"))


def _pair(a: np.ndarray, b: np.ndarray, alpha: float, min_rows: int) -> dict:
    n = len(a)
    out = {"n": n, "cointegrated": False, "p_value": 1.0}
    if n < min_rows or not b.std() > 0:
        return out
    da, db = a - a.mean(), b - b.mean()
    beta = float(da @ db / (db @ db))
    inter = float(a.mean() - beta * b.mean())
    res = a - inter - beta * b
    if not res.std() > 1e-12 * max(1.0, abs(a).max()):
        return out
    _, p, _ = adf(res)
    x, y = res[:-1], res[1:]
    dx = x - x.mean()
    slope = float(dx @ (y - y.mean()) / (dx @ dx))
    inside = 0 < slope < 1
    speed = -math.log(slope) if inside else math.nan
    return out | {
        "cointegrated": bool(p < alpha), "p_value": float(p), "hedge_ratio_beta": beta, "intercept_alpha": inter,
        "current_spread_zscore": float((res[-1] - res.mean()) / res.std(ddof=1)),
        "half_life_days": math.log(2) / speed if inside else 999.0, "theta": speed * 252 if inside else 0.0}


def cointegration(pairs: DataFrame, key: str = "pair", alpha: float = 0.05, min_rows: int = 60) -> DataFrame:
    """Two-step test of each pair; ``pairs`` holds (key, ts, a, b), one row per date."""
    kt = dict(pairs.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.dropna(subset=["a", "b"]).sort_values("ts")
        rec = {key: pdf[key].iat[0]} | _pair(d["a"].to_numpy(float), d["b"].to_numpy(float), alpha, min_rows)
        return pd.DataFrame([rec], columns=[key, *[f.split()[0] for f in FIELDS.split(", ")]])

    return pairs.select(key, "ts", "a", "b").groupBy(key).applyInPandas(run, f"`{key}` {kt}, {FIELDS}")


def scan_pairs(prices: DataFrame, price: str = "close", alpha: float = 0.05, min_rows: int = 60, per_block: int = 16,
               only_cointegrated: bool = True) -> DataFrame:
    """Every unordered pair of assets. Series are hashed into small blocks; a task holds the series of two
    blocks and tests their pairs, so a series travels once per block and no pair rows are built."""
    blocks = max(4, block_count(prices, per_block=per_block))
    src = block_pairs(prices.select("asset", "ts", F.col(price).cast("double").alias("p")), blocks)
    cols = ["asset_a", "asset_b", *[f.split()[0] for f in FIELDS.split(", ")]]
    at = dict(prices.dtypes)["asset"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = pdf["bi"].iat[0], pdf["bj"].iat[0]
        wide = pdf.pivot(index="ts", columns="asset", values="p").sort_index()
        home = pdf.drop_duplicates("asset").set_index("asset")["_b"]
        v = {c: wide[c].to_numpy(float) for c in wide.columns}
        out = []
        for x in v:
            for y in v:
                same = home[x] == home[y]
                if x < y and (same if bi == bj else not same):
                    ok = ~(np.isnan(v[x]) | np.isnan(v[y]))
                    rec = _pair(v[x][ok], v[y][ok], alpha, min_rows)
                    if rec["cointegrated"] or not only_cointegrated:
                        out.append({"asset_a": x, "asset_b": y} | rec)
        return pd.DataFrame(out, columns=cols)

    return src.groupBy("bi", "bj").applyInPandas(run, f"asset_a {at}, asset_b {at}, {FIELDS}")
