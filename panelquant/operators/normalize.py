"""Normalisation of series over time and of cross-sections.

Series operators use windows (a series is bounded by the calendar). Cross-section operators use
partial aggregates and distributed ranks, because one date may hold any number of assets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, full, rounded, running, sample_kurtosis, sample_skew, unpivot
from ..functions.dist import norm_ppf
from ..functions.ranking import average_rank, group_quantiles, value_counts, value_ladder
from ..sources.files import cut

XS = ["ts", "characteristic"]


# -- one series over time ---------------------------------------------------------------------
def zscore_normalise(df: DataFrame, value: str, winsorise: bool = True, limits=(-3.0, 3.0), out="z") -> DataFrame:
    m, s = F.avg(value).over(full()), F.stddev_samp(value).over(full())
    z = (F.col(value) - m) / F.nullif(s, F.lit(0.0))
    z = F.when(s.isNull() | (s == 0), F.lit(0.0)).otherwise(z)
    return df.withColumn("_z", z).withColumn(out, clip("_z", *limits) if winsorise else F.col("_z")).drop("_z")


def minmax_normalise(df: DataFrame, value: str, low: float = 0.0, high: float = 1.0, out="scaled") -> DataFrame:
    lo, hi = F.min(value).over(full()), F.max(value).over(full())
    x = (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)) * (high - low) + low
    return df.withColumn(out, F.when(hi == lo, F.lit(float(low))).otherwise(x))


def normalise_to_score(df: DataFrame, value: str, low: float = 0.0, high: float = 100.0) -> DataFrame:
    return minmax_normalise(df, value, low, high, out="score")


def rank_normalise(df: DataFrame, value: str, out="pct_rank") -> DataFrame:
    """Average-tie percentile rank times 100."""
    rank = F.rank().over(Window.partitionBy("asset").orderBy(F.col(value).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy("asset", value))
    n = F.count(value).over(full())
    return df.withColumn(out, F.when(F.col(value).isNotNull(), (rank + (ties - 1) / 2.0) / n * 100))


def robust_normalise(df: DataFrame, value: str, out="robust") -> DataFrame:
    """(x - median) / IQR; IQR 0 falls back to the deviation, deviation 0 to zero."""
    s = df.groupBy("asset").agg(
        F.percentile(value, [0.25, 0.5, 0.75]).alias("_q"), F.stddev_samp(value).alias("_s"))
    iqr = F.col("_q")[2] - F.col("_q")[0]
    d = F.col(value) - F.col("_q")[1]
    x = F.when(iqr != 0, d / F.nullif(iqr, F.lit(0.0))).when(
        F.col("_s").isNull() | (F.col("_s") == 0), F.lit(0.0)).otherwise(d / F.nullif(F.col("_s"), F.lit(0.0)))
    return df.join(s, "asset").withColumn(out, x).drop("_q", "_s")


def expanding_zscore(df: DataFrame, value: str, out="z") -> DataFrame:
    """z against the history up to the row itself, from two rows on."""
    m, s = F.avg(value).over(running()), F.stddev_samp(value).over(running())
    return df.withColumn(out, (F.col(value) - m) / F.nullif(s, F.lit(0.0)))


def row_zscore(df: DataFrame, value: str, out="z") -> DataFrame:
    """z across assets on each date; NULL where the deviation is zero."""
    s = df.groupBy("ts").agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(s, "ts").withColumn(out, (F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")


def compare_normalisation(df: DataFrame, value: str) -> DataFrame:
    """Summary statistics of the six variants of each series."""
    d = df.select("asset", "ts", F.col(value).alias("Original"))
    d = zscore_normalise(d, "Original", winsorise=False, out="Z-Score")
    d = zscore_normalise(d, "Original", out="Z-Score Winsorised")
    d = minmax_normalise(d, "Original", out="MinMax")
    d = rank_normalise(d, "Original", out="Rank")
    d = robust_normalise(d, "Original", out="Robust")
    names = ["Original", "Z-Score", "Z-Score Winsorised", "MinMax", "Rank", "Robust"]
    long = unpivot(d, ["asset"], names, "method", "x")
    g = long.groupBy("asset", "method").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.percentile("x", [0.25, 0.5, 0.75]).alias("_q"), F.max("x").alias("max"),
        sample_skew("x").alias("skew"), sample_kurtosis("x").alias("kurtosis"))
    return g.select("asset", "method", "count", "mean", "std", "min", F.col("_q")[0].alias("q25"),
                    F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "max", "skew", "kurtosis")


# -- cross-sections: (ts, asset, characteristic, value) ------------------------------------------
def _with_moments(df: DataFrame, value: str = "value") -> DataFrame:
    s = df.groupBy(*XS).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(s, XS)


def _z(value: str = "value", mean: str = "_m", deviation: str = "_s"):
    return F.when(F.col(deviation) == 0, F.when(F.col(value).isNotNull(), F.lit(0.0))).otherwise(
        (F.col(value) - F.col(mean)) / F.nullif(deviation, F.lit(0.0)))


def _out(df: DataFrame) -> DataFrame:
    return df.select("ts", "asset", "characteristic", "score")


def xs_zscore(df: DataFrame) -> DataFrame:
    return _out(_with_moments(df).withColumn("score", _z()))


def xs_rank(df: DataFrame) -> DataFrame:
    r = average_rank(df, XS)
    return _out(r.withColumn("score", (F.col("rank") - 0.5) / F.col("n") * 100))


def xs_winsorized_zscore(df: DataFrame, lower_pct: float = 0.01, upper_pct: float = 0.99) -> DataFrame:
    q = group_quantiles(df, XS, {"lo": lower_pct, "hi": upper_pct})
    c = df.join(q, XS, "left").withColumn("_v", F.when(
        F.col("value").isNotNull(), F.least(F.greatest("value", "lo"), F.col("hi"))))
    return _out(_with_moments(c, "_v").withColumn("score", _z("_v")))


def xs_robust_zscore(df: DataFrame, scale_factor: float = 1.4826) -> DataFrame:
    """(x - median) / (scale * MAD); NULL where the MAD is zero."""
    med = group_quantiles(df, XS, {"med": 0.5})
    d = df.join(med, XS, "left").withColumn("_dev", F.abs(F.col("value") - F.col("med")))
    mad = group_quantiles(d.select(*XS, "asset", F.col("_dev").alias("value")), XS, {"mad": 0.5})
    z = (F.col("value") - F.col("med")) / F.nullif(F.col("mad") * scale_factor, F.lit(0.0))
    return _out(d.join(mad, XS, "left").withColumn("score", z))


def xs_normal_score(df: DataFrame) -> DataFrame:
    r = average_rank(df, XS).withColumn("_u", F.col("rank") / (F.col("n") + 1))
    return _out(r.withColumn("score", norm_ppf("_u")))


TREATMENTS = {
    "cross_sectional_zscore": xs_zscore,
    "rank": xs_rank,
    "winsorized_zscore": xs_winsorized_zscore,
    "robust_zscore": xs_robust_zscore,
    "normal_score": xs_normal_score,
}


def apply_normalization(df: DataFrame, names, digits: int | None = None, **params) -> DataFrame:
    """One or several treatments by name; several come back stacked with a treatment column. ``digits`` rounds the scores."""
    for n in [names] if isinstance(names, str) else names:
        if n not in TREATMENTS:
            raise ValueError(f"unknown normalization {n!r}; known: {sorted(TREATMENTS)}")
    if isinstance(names, str):
        out = TREATMENTS[names](df, **params)
        return out if digits is None else rounded(out, digits)
    return _stacked(df, list(names), digits, **params)


def _value_scores(counts: DataFrame, names: list[str], digits: int | None, lower_pct: float, upper_pct: float, scale_factor: float) -> DataFrame:
    """One row per (ts, characteristic, distinct value) with a column of scores for each treatment.

    Equal values of a cross-section have equal scores, so all statistics come from the counts of values. Moments are taken around the
    median, which is within a deviation of the mean: sums lose no digits, and a constant cross-section has a deviation of exactly zero."""
    ladder = cut(value_ladder(counts, XS, counts=counts))
    quantiles = cut(group_quantiles(counts, XS, {"lo": lower_pct, "med": 0.5, "hi": upper_pct}, ladder=ladder))  # a row per cross-section
    d = ladder.join(quantiles, XS).withColumn("_v", F.least(F.greatest("value", "lo"), F.col("hi")))
    d = d.withColumn("_dev", F.abs(F.col("value") - F.col("med")))

    def moments(x: str, mean: str, deviation: str) -> list:
        off, n = F.col(x) - F.col("med"), F.sum("cnt")
        total, square = F.sum(off * F.col("cnt")), F.sum(off * off * F.col("cnt"))
        spread = F.greatest(square - total * total / n, F.lit(0.0))
        return [(F.first("med") + total / n).alias(mean), F.sqrt(spread / F.nullif(n - 1, F.lit(0))).alias(deviation)]

    stats = d.groupBy(*XS).agg(*moments("value", "_m", "_s"), *moments("_v", "_mw", "_sw"))
    if "robust_zscore" in names:
        devs = cut(d.groupBy(*XS, F.col("_dev").alias("value")).agg(F.sum("cnt").alias("cnt")))
        stats = stats.join(group_quantiles(devs, XS, {"mad": 0.5}, ladder=value_ladder(devs, XS, counts=devs)), XS)
    rank = F.col("before") + (F.col("cnt") + 1) / 2.0
    forms = {
        "cross_sectional_zscore": lambda: _z(), "rank": lambda: (rank - 0.5) / F.col("n") * 100,
        "winsorized_zscore": lambda: _z("_v", "_mw", "_sw"),
        "robust_zscore": lambda: (F.col("value") - F.col("med")) / F.nullif(F.col("mad") * scale_factor, F.lit(0.0)),
        "normal_score": lambda: norm_ppf(rank / (F.col("n") + 1)),
    }
    score = lambda n: forms[n]() if digits is None else F.round(forms[n](), digits)
    return d.join(cut(stats), XS).select(*XS, "value", *[score(n).alias(n) for n in names])


def _stacked(df: DataFrame, names: list[str], digits: int | None = None, lower_pct: float = 0.01, upper_pct: float = 0.99,
             scale_factor: float = 1.4826) -> DataFrame:
    """All treatments from the counts of values: each distinct value of a cross-section is scored once, and one join gives the
    scores to the rows. A row without a value has scores of NULL; rows without a date or characteristic are left out."""
    scores = _value_scores(cut(value_counts(df, XS)), names, digits, lower_pct, upper_pct, scale_factor)
    rows = df.dropna(subset=XS).join(scores, ["value", *XS], "left")
    return unpivot(rows, ["ts", "asset", "characteristic"], names, "treatment", "score").select("ts", "asset", "characteristic", "score", "treatment")
