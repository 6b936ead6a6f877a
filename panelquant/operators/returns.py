"""Return series and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_time, col, running, safe_corr, sample_kurtosis, sample_skew


def log_returns(prices: DataFrame, price: str = "close", dropna: bool = True) -> DataFrame:
    """ln(p_t / p_t-1); a price of zero or less counts as missing."""
    p = F.when(F.col(price) > 0, F.col(price))
    d = prices.withColumn("_p", p)
    out = d.select("asset", "ts", F.ln(F.col("_p") / F.lag("_p").over(by_time())).alias("lr"))
    return out.dropna() if dropna else out


def arithmetic_returns(prices: DataFrame, price: str = "close", dropna: bool = True) -> DataFrame:
    """p_t / p_t-1 - 1 with missing prices padded forward."""
    d = prices.withColumn("_p", F.last(price, ignorenulls=True).over(running()))
    out = d.select("asset", "ts", (F.col("_p") / F.nullif(F.lag("_p").over(by_time()), F.lit(0.0)) - 1).alias("r"))
    return out.dropna() if dropna else out


def running_product(factor, window) -> Column:
    """Product over a window as exp of summed logs, exact about zeros and signs."""
    f = col(factor)
    logs = F.sum(F.ln(F.nullif(F.abs(f), F.lit(0.0)))).over(window)
    zeros = F.sum((f == 0).cast("int")).over(window)
    neg = F.sum((f < 0).cast("int")).over(window)
    mag = F.exp(F.coalesce(logs, F.lit(0.0)))
    return F.when(zeros > 0, F.lit(0.0)).otherwise(F.when(neg % 2 == 1, -mag).otherwise(mag))


def cumulative_return(returns: DataFrame, value: str, method: str = "arithmetic") -> DataFrame:
    if method == "log":
        out = F.exp(F.sum(value).over(running())) - 1
    elif method == "arithmetic":
        out = running_product(1 + F.col(value), running()) - 1
    else:
        raise ValueError("method must be 'arithmetic' or 'log'")
    return returns.withColumn("cumulative", out)


def rolling_return(prices: DataFrame, window: int, method: str = "log", price: str = "close") -> DataFrame:
    prev = F.lag(price, window).over(by_time())
    if method == "log":
        out = F.ln(F.col(price) / prev)
    elif method == "arithmetic":
        out = (F.col(price) - prev) / prev
    else:
        raise ValueError("method must be 'arithmetic' or 'log'")
    return prices.select("asset", "ts", out.alias("rolling_return"))


def annualised_return(returns: DataFrame, value: str = "r", periods: int = 252, keys=("asset",)) -> DataFrame:
    """(prod(1 + r)) ** (periods / n) - 1."""
    n = F.count(value)
    total = F.product(1 + F.col(value))
    return returns.groupBy(*keys).agg(
        n.alias("n"), F.when(n > 0, F.pow(total, F.lit(float(periods)) / n) - 1).alias("annualised_return"))


def compare_return_methods(returns: DataFrame, arith: str = "r", log: str = "lr") -> DataFrame:
    """Mean, deviation, bias-corrected skew and kurtosis of both methods and their correlation."""
    aggs = [safe_corr(arith, log).alias("correlation")]
    for name, c in (("Arithmetic", arith), ("Logarithmic", log)):
        aggs += [F.struct(F.lit(name).alias("method"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                          sample_skew(c).alias("skewness"), sample_kurtosis(c).alias("kurtosis")).alias(f"_{name}")]
    g = returns.groupBy("asset").agg(*aggs)
    return g.select("asset", F.explode(F.array("_Arithmetic", "_Logarithmic")).alias("s"), "correlation").select(
        "asset", "s.*", "correlation")
