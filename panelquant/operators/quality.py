"""Data-quality checks over a price panel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.adf import adf
from ..functions.columns import by_time

PRICE_COLUMNS = ["close", "adj_close", "open", "high", "low"]


def dq_missing(df: DataFrame, columns: list[str], threshold: float = 0.05) -> DataFrame:
    """Null count and share per asset and column, flagged above the threshold."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    g = df.groupBy("asset").agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    long = g.unpivot(["asset", "n_rows"], columns, "column", "missing_count")
    share = F.col("missing_count") / F.col("n_rows")
    return long.select("asset", "column", "missing_count", share.alias("missing_pct"), (share > threshold).alias("flag"))


def dq_duplicate_dates(df: DataFrame) -> DataFrame:
    """Dates that occur more than once, with the number of repeats (2nd and later rows)."""
    return df.groupBy("asset", "ts").agg((F.count(F.lit(1)) - 1).alias("repeats")).where("repeats > 0")


def dq_impossible_values(df: DataFrame, prices: list[str] = PRICE_COLUMNS, volume: str = "volume") -> DataFrame:
    """Rows with a negative price per column and with zero volume."""
    return df.groupBy("asset").agg(
        *[F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in prices],
        F.count_if(F.col(volume) == 0).alias("zero_volume"),
    ).withColumn("has_impossible", sum((F.col(f"negative_{c}") for c in prices), F.col("zero_volume")) > 0)


def dq_outliers(returns: DataFrame, value: str = "r", z: float = 5.0) -> DataFrame:
    """Returns further than z standard deviations from the asset's mean."""
    stats = returns.groupBy("asset").agg(
        F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    usable = stats.where((F.col("n") >= 2) & (F.col("s") > 0))
    return returns.join(usable, "asset").groupBy("asset").agg(
        F.count_if(F.abs((F.col(value) - F.col("m")) / F.col("s")) > z).alias("outliers"))


def dq_timestamp_gaps(df: DataFrame, max_gap_days: int = 5) -> DataFrame:
    """Dates that follow their predecessor by more than max_gap_days."""
    gap = F.datediff("ts", F.lag("ts").over(by_time()))
    return df.select("asset", "ts", gap.cast("bigint").alias("gap_days")).where(F.col("gap_days") > max_gap_days)


def source_quality(df: DataFrame, keys: list[str], ts: str, values: list[str], max_gap_days: int | None = None) -> DataFrame:
    """One row for any source: n_rows, missing values, repeated (keys, date) rows, gaps of over ``max_gap_days`` and whether it passes
    (no repeats).

    Rows are first counted by keys and date, so a key with very many rows is added up before it is put in order."""
    missing = sum((F.count_if(F.col(v).isNull()) for v in values), F.lit(0))
    day = df.groupBy(*keys, F.col(ts).cast("date").alias("_day")).agg(F.count(F.lit(1)).alias("k"), missing.alias("m"))
    wide = F.lit(0)
    if max_gap_days is not None:
        day = day.withColumn("gap", F.datediff("_day", F.lag("_day").over(by_time(keys, "_day"))))
        wide = F.count_if(F.col("gap") > max_gap_days)
    g = day.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("repeated"), wide.cast("bigint").alias("gaps"))
    return g.withColumn("passed", (F.col("repeated") == 0).cast("int"))


def dq_stationarity(returns: DataFrame, value: str = "r", alpha: float = 0.05, min_rows: int = 30) -> DataFrame:
    """ADF test of each asset's returns (one row per date, so a group is bounded by the calendar)."""
    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")["v"].dropna().to_numpy()
        stat = p = None
        if len(x) >= min_rows:
            stat, p, _ = adf(x)
        return pd.DataFrame([{"asset": pdf["asset"].iat[0], "n": len(x), "adf_stat": stat, "p_value": p,
                              "stationary": bool(p is not None and p < alpha)}])

    return returns.select("asset", "ts", F.col(value).alias("v")).groupBy("asset").applyInPandas(
        test, "asset string, n bigint, adf_stat double, p_value double, stationary boolean")


def dq_quality_score(bars: DataFrame, returns: DataFrame, with_fundamentals: DataFrame, columns: list[str]) -> DataFrame:
    """One universe row: score = 100 - penalties clipped to 0..100; errors fail the report.

    Penalties: missing 5, duplicates 20, impossible values 20, gaps 2, outliers 1,
    non-stationary 3 per asset, and 5 for an asset without statements."""
    assets = bars.select("asset").distinct()
    missing = dq_missing(bars, columns).groupBy("asset").agg(F.bool_or("flag").alias("missing"))
    dup = dq_duplicate_dates(bars).select("asset").distinct().withColumn("dup", F.lit(True))
    bad = dq_impossible_values(bars).select("asset", F.col("has_impossible").alias("bad"))
    gaps = dq_timestamp_gaps(bars).select("asset").distinct().withColumn("gaps", F.lit(True))
    outl = dq_outliers(returns).select("asset", (F.col("outliers") > 0).alias("outl"))
    stat = dq_stationarity(returns).select("asset", (~F.col("stationary")).alias("unstable"))
    fund = with_fundamentals.select("asset").distinct().withColumn("fund", F.lit(True))
    j = assets
    for part in (missing, dup, bad, gaps, outl, stat, fund):
        j = j.join(part, "asset", "left")
    flag = {c: F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("missing", "dup", "bad", "gaps", "outl", "unstable")}
    no_fund = F.when(F.col("fund").isNull(), 1).otherwise(0)
    errors = flag["dup"] + flag["bad"]
    warns = flag["missing"] + flag["gaps"] + flag["outl"] + flag["unstable"] + no_fund
    penalty = (5.0 * flag["missing"] + 20.0 * errors + 2.0 * flag["gaps"] + 1.0 * flag["outl"]
               + 3.0 * flag["unstable"] + 5.0 * no_fund)
    total = j.agg(F.count(F.lit(1)).alias("tickers"), F.sum(errors).alias("errors"),
                  F.sum(warns).alias("warnings"), F.sum(penalty).alias("p"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.col("p")))
    return total.select("tickers", "errors", "warnings", score.alias("data_quality_score"),
                        ((F.col("errors") == 0) & (score >= 50)).alias("passed"))
