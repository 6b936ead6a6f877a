"""Time-series analytics (M3) and price factors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, clip, full, rolling_pair_sums, rolling_slope, trailing, when_full
from ..functions.dist import chi2_sf_odd
from .pit import valid_at

WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def _current(c: str):
    """The value on the last row of the series, on every row."""
    return F.last(c).over(by_time().rowsBetween(*WHOLE))


def momentum_skip(returns: DataFrame, value: str = "lr", periods=(21, 63, 126, 252), skip: int = 21) -> DataFrame:
    """Sum of log returns over each period without the latest ``skip`` rows: current value, annualised,
    and the share of the asset's own history strictly below it."""
    d, outs = returns, []
    for p in periods:
        if p > skip:
            w = by_time().rowsBetween(-(p - 1), -skip)
            d = d.withColumn(f"m_{p}", when_full(F.sum(value).over(w), value, p - skip, w))
        else:
            d = d.withColumn(f"m_{p}", F.lit(None).cast("double"))
    for p in periods:
        d = d.withColumn(f"c_{p}", _current(f"m_{p}"))
        years = (p - skip) / 252.0
        below = F.avg(F.when(F.col(f"m_{p}").isNotNull(), (F.col(f"m_{p}") < F.col(f"c_{p}")).cast("double")))
        cur = F.max(f"c_{p}")
        outs.append(F.struct(F.lit(p).cast("bigint").alias("period"), cur.alias("momentum"),
                             (cur / years if years > 0 else F.lit(None).cast("double")).alias("annualised"),
                             F.when(cur.isNotNull(), below * 100).alias("percentile")).alias(f"o_{p}"))
    g = d.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), *outs)
    return g.select("asset", "n", F.explode(F.array(*[f"o_{p}" for p in periods])).alias("o")).select(
        "asset", "o.*", "n").where(F.col("n") >= F.col("period")).drop("n")


def hurst_rs(prices: DataFrame, price: str = "close", min_window: int = 100) -> DataFrame:
    """Rescaled-range exponent: mean R/S over non-overlapping chunks for lags 2..min_window-1, slope in logs.
    A group is one asset's dates, bounded by the calendar."""
    def rs(x: np.ndarray, lag: int) -> float:
        k = len(x) // lag
        size, extra = divmod(len(x), k)  # the first `extra` chunks hold one more value
        vals = []
        for part in (x[: extra * (size + 1)].reshape(extra, size + 1), x[extra * (size + 1):].reshape(k - extra, size)):
            if part.size:
                dev = part - part.mean(1, keepdims=True)
                c = dev.cumsum(1)
                s = part.std(1)
                vals.append(((c.max(1) - c.min(1))[s > 0] / s[s > 0]))
        v = np.concatenate(vals)
        return float(v.mean()) if len(v) else np.nan

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("ts")["p"].to_numpy(float)
        h = r2 = None
        label, warn = "Insufficient data", "Not enough data points"
        if len(p) >= min_window:
            x = np.diff(np.log(p))
            pts = [(lag, rs(x, lag)) for lag in range(2, min_window) if len(x) >= lag]
            pts = [(a, b) for a, b in pts if b == b and b > 0]
            if len(pts) < 10:
                label, warn = "Insufficient valid lags", "Poor R/S fit"
            else:
                lx, ly = np.log(np.array(pts)).T
                dx, dy = lx - lx.mean(), ly - ly.mean()
                h = float(dx @ dy / (dx @ dx))
                r2 = float(1 - ((dy - h * dx) ** 2).sum() / (dy @ dy))
                label = "Mean-reverting" if h < 0.45 else "Trending" if h > 0.55 else "Random walk"
                warn = "Poor fit (R² < 0.9)" if r2 < 0.9 else ""
        return pd.DataFrame([{"asset": pdf["asset"].iat[0], "h_exponent": h, "r_squared": r2,
                              "interpretation": label, "warning": warn}])

    return prices.select("asset", "ts", F.col(price).alias("p")).groupBy("asset").applyInPandas(
        one, "asset string, h_exponent double, r_squared double, interpretation string, warning string")


def autocorrelation(returns: DataFrame, value: str = "lr", lags=(1, 5, 10, 21)) -> DataFrame:
    """Biased autocorrelations and the Ljung-Box test at the largest lag (odd)."""
    top = max(lags)
    d = returns.withColumn("_x", F.col(value) - F.avg(value).over(full()))
    for k in range(1, top + 1):
        d = d.withColumn(f"_l{k}", F.lag("_x", k).over(by_time()))
    g = d.groupBy("asset").agg(
        F.count("_x").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("c0"),
        *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"c{k}") for k in range(1, top + 1)])
    g = g.where(F.col("n") >= 2 * top)
    rho = {k: F.col(f"c{k}") / F.nullif("c0", F.lit(0.0)) for k in range(1, top + 1)}
    q = sum((rho[k] * rho[k] / (F.col("n") - k) for k in range(1, top + 1)), F.lit(0.0)) * F.col("n") * (F.col("n") + 2)
    g = g.select("asset", *[rho[k].alias(f"acf_{k}") for k in lags], q.alias("lb_statistic"))
    g = g.withColumn("lb_pvalue", chi2_sf_odd("lb_statistic", top))
    return g.withColumn("significant", F.col("lb_pvalue") < 0.05)


def ma_regime(prices: DataFrame, price: str = "close", short: int = 50, long: int = 200) -> DataFrame:
    """Trend label by the long average, and the rows since the label last changed."""
    n = F.row_number().over(by_time())
    d = prices.select("asset", "ts", F.col(price).alias("p"), n.alias("n"))
    for name, k in (("ma_short", short), ("ma_long", long)):
        d = d.withColumn(name, when_full(F.avg("p").over(trailing(k)), "p", k, trailing(k)))
    d = d.withColumn("up", F.coalesce((F.col("p") > F.col("ma_long")).cast("int"), F.lit(0)))
    d = d.withColumn("flip", F.when(F.col("up") != F.lag("up").over(by_time()), F.col("n")))
    g = d.groupBy("asset").agg(
        F.max("n").alias("rows"), F.max("flip").alias("flip"), F.max_by("p", "ts").alias("p"),
        F.max_by(F.struct("ma_short", "ma_long"), "ts").alias("m"))
    known = F.col("rows") >= long
    return g.select(
        "asset",
        F.when(~known, "Unknown").when(F.col("p") > F.col("m.ma_long"), "uptrend").otherwise("downtrend").alias("current_regime"),
        F.when(known, F.col("m.ma_short")).alias("ma_short"), F.when(known, F.col("m.ma_long")).alias("ma_long"),
        F.when(~known, 0).otherwise(F.coalesce(F.col("rows") - F.col("flip") + 1, F.col("rows"))).cast("bigint").alias("days_in_current_regime"),
        F.when(known & (F.col("m.ma_long") > 0), F.col("p") / F.col("m.ma_long")).alias("price_to_ma200_ratio"))


def vol_regime(returns: DataFrame, value: str = "lr", window: int = 21) -> DataFrame:
    d = returns.withColumn("v", when_full(F.stddev_samp(value).over(trailing(window)), value, window, trailing(window)))
    d = d.withColumn("c", _current("v"))
    pct = F.avg(F.when(F.col("v").isNotNull(), (F.col("v") < F.col("c")).cast("double"))) * 100
    g = d.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("current_vol"), pct.alias("vol_percentile"))
    p = F.col("vol_percentile")
    return g.select(
        "asset", "current_vol", (F.col("current_vol") * F.sqrt(F.lit(252.0))).alias("current_vol_annualised"),
        F.when(F.col("n") < window, "Unknown").when(p < 25, "low").when(p > 75, "high").otherwise("normal").alias("vol_regime"),
        "vol_percentile")


def score_timeseries(prices: DataFrame, returns: DataFrame) -> DataFrame:
    """M3: 50 + half of the 252-row momentum percentile's distance from 50, +-10 by trend."""
    mom = momentum_skip(returns, periods=(252,)).select("asset", "percentile")
    d = ma_regime(prices).select("asset", "current_regime").join(mom, "asset", "left")
    tilt = F.when(F.col("current_regime") == "uptrend", 10.0).when(F.col("current_regime") == "downtrend", -10.0).otherwise(0.0)
    score = clip(50.0 + F.coalesce((F.col("percentile") - 50) / 2, F.lit(0.0)) + tilt, 0, 100)
    return d.select("asset", score.alias("score"), "percentile", "current_regime")


def factor_momentum(prices: DataFrame, as_of: list, price: str = "close") -> DataFrame:
    """12-month momentum without the last month and 6-month momentum, by row offsets."""
    w = by_time()
    p = F.col(price)
    d = prices.select(
        "asset", "ts", F.row_number().over(w).alias("n"),
        F.when(F.lag(p, 251).over(w) > 0, F.lag(p, 20).over(w) / F.lag(p, 251).over(w) - 1).alias("momentum_12m_skip1"),
        F.when(F.lag(p, 125).over(w) > 0, p / F.lag(p, 125).over(w) - 1).alias("momentum_6m"))
    known = F.col("n") >= 252
    return valid_at(d, as_of).select(
        "as_of", "asset", F.when(known, F.col("momentum_12m_skip1")).alias("momentum_12m_skip1"),
        F.when(known, F.col("momentum_6m")).alias("momentum_6m"))


def factor_low_risk(returns: DataFrame, as_of: list, value: str = "lr") -> DataFrame:
    """Negated 30-row volatility, 252-row beta to the equal-weight market and downside volatility."""
    year = F.sqrt(F.lit(252.0))
    market = returns.groupBy("ts").agg(F.avg(value).alias("mkt"))
    d = returns.join(market, "ts")
    w30 = trailing(30)
    d = rolling_pair_sums(d, value, "mkt", 252)
    down = F.when(F.col(value) < 0, F.col(value))
    d = d.select(
        "asset", "ts", F.row_number().over(by_time()).alias("n"),
        F.when(F.count(value).over(w30) > 5, -F.stddev_samp(value).over(w30) * year).alias("volatility_30d"),
        F.when(F.count(down).over(w30) > 3, -F.stddev_samp(down).over(w30) * year).alias("downside_volatility"),
        (-rolling_slope()).alias("b"))
    return valid_at(d, as_of).select(
        "as_of", "asset", "volatility_30d", F.when(F.col("n") >= 252, F.col("b")).alias("beta"), "downside_volatility")
