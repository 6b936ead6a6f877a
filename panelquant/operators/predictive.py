"""Predictive regressions of forward returns on factor scores, and robustness across treatments.

All dates and treatments are rows of one job: normal equations are additive per date, so a training
window is a window sum over per-date moments.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, div, safe_corr
from ..functions.linear import merged_columns, moment_columns, moment_names, ols_from_moments, solve_stack, stacked
from ..functions.ranking import average_rank

# Characteristics of each factor.
FACTOR_CHARS = {
    "value": ["earnings_yield", "book_to_market", "cash_flow_yield"],
    "quality": ["roe", "roce", "earnings_stability", "leverage"],
    "momentum": ["momentum_12m_skip1", "momentum_6m"],
    "low_risk": ["volatility_30d", "beta", "downside_volatility"],
}
FACTORS = list(FACTOR_CHARS)
KEYS = ["treatment", "ts"]
BASELINE = "cross_sectional_zscore"


def characteristics(frames: list[DataFrame]) -> DataFrame:
    """Factor frames (as_of, asset, columns...) to (ts, asset, characteristic, value)."""
    out = None
    for f in frames:
        names = [c for c in f.columns if c not in ("as_of", "asset")]
        one = f.withColumnRenamed("as_of", "ts").unpivot(["ts", "asset"], names, "characteristic", "value")
        out = one if out is None else out.unionByName(one)
    return out


def factor_composite(scores: DataFrame, factors: dict[str, list[str]] | None = None) -> DataFrame:
    """(treatment, ts, asset, <factor>...): mean of the available characteristics of each factor."""
    factors = factors or FACTOR_CHARS
    return scores.groupBy(*KEYS, "asset").agg(*[
        F.avg(F.when(F.col("characteristic").isin(cs), F.col("score"))).alias(n) for n, cs in factors.items()])


def regression_panel(composite: DataFrame, fwd: DataFrame) -> DataFrame:
    """Joined with forward returns (as_of, asset, fwd) as y; complete rows only."""
    y = fwd.select(F.col("as_of").alias("ts"), "asset", F.col("fwd").alias("y"))
    return composite.join(y, ["ts", "asset"]).dropna(subset=[*FACTORS, "y"])


def xs_regression(panel: DataFrame, xs=FACTORS, keys=KEYS) -> DataFrame:
    """OLS of one cross-section per key: needs k + 1 rows and at least three."""
    m = panel.groupBy(*keys).agg(*moment_columns("y", list(xs)))
    d = ols_from_moments(m, list(keys), list(xs), max(3, len(xs) + 1), full=False)
    return d.where(F.col("alpha").isNotNull())


def fama_macbeth(panel: DataFrame, xs=FACTORS) -> DataFrame:
    """Coefficient series in long form: (treatment, ts, factor, coef)."""
    d = xs_regression(panel, xs)
    return d.select(*KEYS, F.lit(None).cast("double").alias("_"), F.col("alpha").alias("const"), *[F.col(f"b_{x}").alias(x) for x in xs]).drop("_").unpivot(
        KEYS, ["const", *xs], "factor", "coef")


def oos_models(panel: DataFrame, xs=FACTORS, window_days: int = 252, min_dates: int = 3) -> DataFrame:
    """(treatment, ts, dropped, coefficients, y_bar) trained on the dates in [ts - window, ts). ``dropped`` is
    'none' for the full model, else the factor left out. NULL coefficients stand for left-out factors."""
    xs, k = list(xs), len(xs)
    per = panel.groupBy(*KEYS).agg(*moment_columns("y", xs)).where("_n > 0")
    w = Window.partitionBy("treatment").orderBy(F.unix_date("ts")).rangeBetween(-window_days, -1)
    d = per.select(*KEYS, F.count(F.lit(1)).over(w).alias("_dates"), *merged_columns(k, w, Window.partitionBy("treatment")))
    d = d.where((F.col("_dates") >= min_dates) & (F.col("_n") >= k + 2))
    schema = "treatment string, ts date, dropped string, y_bar double, c0 double, " + ", ".join(f"c_{x} double" for x in xs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, mean, c = stacked(pdf, k)
            for drop in ["none", *xs]:
                use = [i for i, x in enumerate(xs) if x != drop]
                coef, *_ = solve_stack(n, mean, c, use)
                out = pdf[KEYS].assign(dropped=drop, y_bar=mean[:, -1], c0=coef[:, 0])
                for i, x in enumerate(xs):
                    out[f"c_{x}"] = coef[:, 1 + use.index(i)] if i in use else None
                yield out

    return d.select(*KEYS, *moment_names(k)).mapInPandas(run, schema)


def oos_prediction(panel: DataFrame, models: DataFrame, xs=FACTORS, target: str | None = None) -> DataFrame:
    """Per test row: y, full and base prediction and training mean, for each left-out factor or one."""
    full = models.where("dropped = 'none'").select(*KEYS, "y_bar", *[F.col(c).alias(f"f_{c}") for c in ["c0", *[f"c_{x}" for x in xs]]])
    base = models.where(F.col("dropped") == target if target else F.col("dropped") != "none")
    d = panel.join(full, KEYS).join(base.drop("y_bar"), KEYS)
    yf = sum((F.col(f"f_c_{x}") * F.col(x) for x in xs), F.col("f_c0"))
    yb = sum((F.coalesce(F.col(f"c_{x}") * F.col(x), F.lit(0.0)) for x in xs), F.col("c0"))
    return d.select(*KEYS, "asset", F.col("dropped").alias("factor"), "y", yf.alias("y_hat_full"), yb.alias("y_hat_base"), F.col("y_bar").alias("y_bar_train"))


def oos_incremental(pred: DataFrame, keys=("treatment", "factor")) -> DataFrame:
    """Out-of-sample R2 of full and base models and their difference per key."""
    g = pred.groupBy(*keys).agg(
        F.sum(F.pow(F.col("y") - F.col("y_hat_full"), 2.0)).alias("sse_full"), F.sum(F.pow(F.col("y") - F.col("y_hat_base"), 2.0)).alias("sse_base"),
        F.sum(F.pow(F.col("y") - F.col("y_bar_train"), 2.0)).alias("sst"), F.count(F.lit(1)).alias("n_test_obs"))
    ok = F.when(F.col("sst") > 1e-12, F.col("sst"))
    return g.withColumns({"r2_oos_full": 1 - F.col("sse_full") / ok, "r2_oos_base": 1 - F.col("sse_base") / ok,
                          "delta_r2": (F.col("sse_base") - F.col("sse_full")) / ok})


def newey_west_se(series: DataFrame, keys=("treatment", "factor"), value: str = "coef", small_sample: bool = False) -> DataFrame:
    """Mean and HAC standard error of the mean with Bartlett weights; under three values NULL.

    The number of lags is int(4 (T / 100)^(2/9)) with T counting dates without a value too. Each value meets the ones up to
    that many places before it by a join on (key, place), so the lags follow the data and no column is made per lag."""
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    d = series.withColumn("_t", F.count(F.lit(1)).over(whole)).where(F.col(value).isNotNull())
    d = d.select(*keys, "_t", (F.col(value) - F.avg(value).over(whole)).alias("_u"), F.col(value).alias("_v"),
                 F.row_number().over(by_time(keys)).alias("_at"), F.floor(4 * F.pow(F.col("_t") / 100.0, F.lit(2.0 / 9))).cast("int").alias("_lags"))
    base = d.groupBy(*keys).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean_coeff"), F.sum(F.col("_u") * F.col("_u")).alias("_s0"))
    later = d.where("_lags > 0").select(*keys, F.col("_u").alias("_w"), "_lags", "_at", F.explode(F.sequence(F.lit(1), "_lags")).alias("_k"))
    later = later.select(*keys, "_w", (F.col("_at") - F.col("_k")).alias("_at"), (2 * (1 - F.col("_k") / (F.col("_lags") + 1.0))).alias("_bartlett"))
    cross = later.join(d.select(*keys, "_at", "_u"), [*keys, "_at"]).groupBy(*keys).agg(F.sum(F.col("_bartlett") * F.col("_w") * F.col("_u")).alias("_s"))
    g = base.join(cross, keys, "left")
    var = (F.col("_s0") + F.coalesce("_s", F.lit(0.0))) / (F.col("n") * F.col("n"))
    if small_sample:
        var = var * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0))
    return g.select(*keys, "n", "mean_coeff", F.when(F.col("n") >= (2 if small_sample else 3), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("nw_se"))


def coefficient_significance(series: DataFrame, keys=("treatment", "factor"), value: str = "coef") -> DataFrame:
    """Newey-West t with the small-sample factor, 95 % interval and whether it excludes zero."""
    d = newey_west_se(series, keys, value, small_sample=True).where("n >= 2")
    m, se = F.col("mean_coeff"), F.col("nw_se")
    d = d.withColumns({"nw_t_stat": div(m, se), "ci_lower": m - 1.96 * se, "ci_upper": m + 1.96 * se})
    return d.withColumn("significant", (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0))


def _vs_baseline(df: DataFrame, keys: list[str], cols: list[str], baseline: str) -> DataFrame:
    b = df.where(F.col("treatment") == baseline).select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    return df.join(b, keys)


def sign_stability(delta: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Share of dates on which a treatment's delta R2 has the baseline's sign; delta is (treatment, factor, ts, delta_r2)."""
    d = _vs_baseline(delta.select("treatment", "factor", "ts", F.signum("delta_r2").alias("s")), ["factor", "ts"], ["s"], baseline)
    return d.groupBy("treatment", "factor").agg(F.avg((F.col("s") == F.col("b_s")).cast("double")).alias("same_sign"))


def _means(delta: DataFrame) -> DataFrame:
    return delta.groupBy("treatment", "factor").agg(F.avg("delta_r2").alias("m"))


def magnitude_change(delta: DataFrame, baseline: str = BASELINE) -> DataFrame:
    d = _vs_baseline(_means(delta), ["factor"], ["m"], baseline).where(F.col("treatment") != baseline)
    a = F.abs(F.col("m") - F.col("b_m"))
    return d.select("treatment", "factor", a.alias("abs_change"), div(a, F.abs("b_m")).alias("rel_change"))


def experiment_grid(panel: DataFrame, xs=FACTORS, window_days: int = 252, min_dates: int = 3) -> DataFrame:
    """(treatment, ts, factor, delta_r2) of a regression panel at any pace: out-of-sample R2 lost without each factor, per decision date."""
    pred = oos_prediction(panel, oos_models(panel, xs, window_days, min_dates), xs)
    return oos_incremental(pred, ("treatment", "factor", "ts")).select("treatment", "ts", "factor", "delta_r2")


def robustness_summary(delta: DataFrame) -> DataFrame:
    """Range and deviation of the mean delta R2 across treatments."""
    g = _means(delta).where("m is not null").groupBy("factor").agg(F.min("m").alias("min"), F.max("m").alias("max"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("std"))
    return g.select("factor", "min", "max", (F.col("max") - F.col("min")).alias("range"), "std")


def rank_robustness(composite: DataFrame, xs=FACTORS) -> DataFrame:
    """Mean Spearman correlation, over factors, of the assets' mean scores between treatments."""
    long = composite.unpivot([*KEYS, "asset"], list(xs), "factor", "x").groupBy("treatment", "factor", "asset").agg(F.avg("x").alias("x")).where("x is not null")
    r = average_rank(long, ["treatment", "factor"], "x", out="rk", n="nn").select("treatment", "factor", "asset", "rk")
    one = r.groupBy("factor", "asset").agg(F.collect_list(F.struct("treatment", "rk")).alias("t"))  # one entry per treatment
    pairs = F.flatten(F.transform("t", lambda a: F.transform("t", lambda b: F.struct(
        a["treatment"].alias("treatment_a"), b["treatment"].alias("treatment_b"), a["rk"].alias("x"), b["rk"].alias("y")))))
    d = one.select("factor", F.explode(pairs).alias("p")).select("factor", "p.*")
    g = d.groupBy("factor", "treatment_a", "treatment_b").agg(safe_corr("x", "y").alias("c"))
    return g.groupBy("treatment_a", "treatment_b").agg(F.avg("c").alias("rank_correlation"))


def predictive_robustness(r2: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """(treatment[, factor], r2, delta_from_baseline), against the same factor of the baseline treatment."""
    keys = [c for c in ("factor",) if c in r2.columns]
    base = r2.where(F.col("treatment") == baseline).select(*keys, F.col("r2").alias("_b"))
    if not keys:
        return r2.select("treatment", "r2", (F.col("r2") - base.agg(F.max("_b").alias("b")).scalar()).alias("delta_from_baseline"))
    return r2.join(base, keys, "left").select("treatment", *keys, "r2", (F.col("r2") - F.col("_b")).alias("delta_from_baseline"))


def robustness_report(sections: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(section, key, metric, value) of several diagnostics."""
    out = None
    for name, (df, keys) in sections.items():
        vals = [c for c, t in df.dtypes if c not in keys and t in ("double", "bigint", "boolean")]
        one = df.select(F.lit(name).alias("section"), F.concat_ws("|", *keys).alias("key"), *[F.col(c).cast("double").alias(c) for c in vals]).unpivot(
            ["section", "key"], vals, "metric", "value")
        out = one if out is None else out.unionByName(one)
    return out


def turnover(weights: DataFrame, key: list[str], split: str = "split") -> DataFrame:
    """Half the absolute weight change from one split to the next over the union of assets; first is 0.

    Every weight counts for its own split and, negated, for the following one, so no outer join is needed."""
    w = Window.partitionBy(*key).orderBy(split) if key else Window.partitionBy(F.lit(1)).orderBy(split)
    splits = weights.select(*key, split).distinct()
    nxt = splits.select(*key, split, F.lead(split).over(w).alias("_next"), F.lag(split).over(w).isNull().alias("_first"))
    d = weights.join(nxt, [*key, split])
    moves = d.select(*key, "asset", F.explode(F.array(F.struct(F.col(split).alias("s"), F.col("w").alias("v")),
                                                      F.struct(F.col("_next").alias("s"), (-F.col("w")).alias("v")))).alias("m")).where("m.s is not null")
    net = moves.groupBy(*key, F.col("m.s").alias(split), "asset").agg(F.sum("m.v").alias("v")).groupBy(*key, split).agg((F.sum(F.abs("v")) / 2).alias("t"))
    return net.join(nxt.select(*key, split, "_first"), [*key, split]).select(*key, split, F.when(F.col("_first"), 0.0).otherwise(F.col("t")).alias("turnover"))
