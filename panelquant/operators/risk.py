"""Risk measures (M5), tail risk, stress tests and matrix diagnostics."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, clip, div, full, rolling_pair_sums, rolling_slope, running, safe_corr, spread, trailing, when_full, with_params
from ..functions.dist import t4_ppf
from ..functions.gram import block_count, block_pairs, pair_moments
from ..functions.ranking import average_rank
from ..sources.files import cut
from .timeseries import _current

YEAR = 252.0 ** 0.5
RISK_FREE = 0.04 / 252.0


def volatility(returns: DataFrame, value: str = "r", window: int | None = None, annualise: bool = True) -> DataFrame:
    """Deviation of the whole series, the latest rolling one and its percentile (mean rank) in its history."""
    k = YEAR if annualise else 1.0
    if window is None:
        return returns.groupBy("asset").agg((F.stddev_samp(value) * k).alias("volatility"))
    w = trailing(window)
    d = returns.withColumn("v", when_full(F.stddev_samp(value).over(w) * k, value, window, w)).withColumn("c", _current("v"))
    below, upto = F.count_if(F.col("v") < F.col("c")), F.count_if(F.col("v") <= F.col("c"))
    g = d.groupBy("asset").agg(
        (F.stddev_samp(value) * k).alias("volatility"), F.max("c").alias("current_rolling_vol"),
        F.count("v").alias("_n"), below.alias("_b"), upto.alias("_u"))
    pct = (F.col("_b") + F.col("_u") + F.when(F.col("_b") < F.col("_u"), 1).otherwise(0)) / 2.0 / F.nullif("_n", F.lit(0))
    return g.select("asset", "volatility", "current_rolling_vol",
                    F.when(F.col("current_rolling_vol").isNotNull(), pct).alias("percentile_of_current_vol"))


def _downside(value: str, mar: float) -> Column:
    low = F.least(F.col(value) - mar, F.lit(0.0))
    n = F.count(value)
    return F.when(F.count_if(F.col(value) - mar < 0) > 1, F.sqrt(F.sum(low * low) / F.nullif(n - 1, F.lit(0)))).otherwise(0.0)


def downside_deviation(returns: DataFrame, value: str = "r", mar: float = 0.0, annualise: bool = True) -> DataFrame:
    return returns.groupBy("asset").agg((_downside(value, mar) * (YEAR if annualise else 1.0)).alias("downside_dev"))


def sharpe_ratio(returns: DataFrame, value: str = "r", risk_free: float = RISK_FREE, keys=("asset",)) -> DataFrame:
    g = returns.groupBy(*keys).agg(((F.avg(value) - risk_free) * 252).alias("annualised_return"),
                                   (F.stddev_samp(value) * YEAR).alias("annualised_vol"))
    return g.withColumn("sharpe_ratio", F.coalesce(div("annualised_return", "annualised_vol"), F.lit(0.0)))


def sortino_ratio(returns: DataFrame, value: str = "r", risk_free: float = RISK_FREE, mar: float = 0.0) -> DataFrame:
    g = returns.groupBy("asset").agg(((F.avg(value) - risk_free) * 252).alias("a"), (_downside(value, mar) * YEAR).alias("downside_dev"))
    return g.select("asset", F.coalesce(div("a", "downside_dev"), F.lit(0.0)).alias("sortino_ratio"), "downside_dev")


def max_drawdown(prices: DataFrame, price: str = "close") -> DataFrame:
    """Deepest fall from a running peak, with peak, trough and recovery dates (ties: the first)."""
    p = F.col(price)
    d = prices.select("asset", "ts", p.alias("p"), F.max(p).over(running()).alias("peak"))
    new = F.lag("peak").over(by_time()).isNull() | (F.col("peak") > F.lag("peak").over(by_time()))
    d = d.withColumn("peak_ts", F.last(F.when(new, F.col("ts")), ignorenulls=True).over(running()))
    low = F.struct(((F.col("p") - F.col("peak")) / F.col("peak")).alias("dd"), "ts", "peak_ts", "peak")
    d = d.withColumn("low", F.min(low).over(full()))
    back = F.min(F.when((F.col("ts") >= F.col("low.ts")) & (F.col("p") >= F.col("low.peak")), F.col("ts")))
    g = d.groupBy("asset").agg(F.max("low").alias("low"), back.alias("recovery_date"), F.max("ts").alias("last"))
    end = F.coalesce("recovery_date", "last")
    return g.select("asset", F.col("low.dd").alias("max_drawdown"), F.col("low.peak_ts").alias("start_date"),
                    F.col("low.ts").alias("trough_date"), "recovery_date", end.alias("end_date"),
                    F.datediff(end, F.col("low.peak_ts")).cast("bigint").alias("duration_days"))


def value_at_risk(returns: DataFrame, value: str = "r", levels=(0.95, 0.99), method: str = "historical", keys=("asset",)) -> DataFrame:
    """VaR and CVaR per level; CVaR is never below VaR; under two rows gives 0.02 / 0.03."""
    keys = list(keys)
    if method == "historical":
        cut = returns.groupBy(*keys).agg(F.percentile(value, [1 - a for a in levels]).alias("_q"), F.count(value).alias("_n"))
        j = returns.join(cut, keys)
        g = j.groupBy(*keys).agg(F.max("_n").alias("n"), *[
            F.struct(F.lit(a).alias("level"), (-F.max(F.col("_q")[i])).alias("var"),
                     (-F.avg(F.when(F.col(value) <= F.col("_q")[i], F.col(value)))).alias("cvar")).alias(f"l{i}")
            for i, a in enumerate(levels)])
    elif method == "parametric":
        nd, out = NormalDist(), []
        m, s = F.avg(value), F.stddev_samp(value)
        for i, a in enumerate(levels):
            z = nd.inv_cdf(1 - a)
            out.append(F.struct(F.lit(a).alias("level"), (-(m + z * s)).alias("var"),
                                (-(m - s * nd.pdf(z) / (1 - a))).alias("cvar")).alias(f"l{i}"))
        g = returns.groupBy(*keys).agg(F.count(value).alias("n"), *out)
    else:
        raise ValueError(f"unknown VaR method: {method}")
    g = g.select(*keys, "n", F.explode(F.array(*[f"l{i}" for i in range(len(levels))])).alias("l")).select(*keys, "n", "l.*")
    few = F.col("n") < 2
    return g.select(*keys, "level", F.when(few, 0.02).otherwise(F.col("var")).alias("var"),
                    F.when(few, 0.03).otherwise(F.greatest("var", F.coalesce("cvar", "var"))).alias("cvar"), F.lit(method).alias("method"))


def beta(returns: DataFrame, benchmark: DataFrame, value: str = "r", window: int = 252) -> DataFrame:
    """Slope on the benchmark, R2, residual volatility and the latest rolling slope."""
    j = returns.join(benchmark, "ts").select("asset", "ts", F.col(value).alias("x"), F.col("bm").alias("y"))
    j = rolling_pair_sums(j, "x", "y", window).withColumn("roll", F.when(F.col("r_n") >= window, rolling_slope(1e-12)))
    g = j.groupBy("asset").agg(
        F.covar_samp("x", "y").alias("c"), F.var_samp("y").alias("v"), F.var_samp("x").alias("vx"), safe_corr("x", "y").alias("rho"),
        F.count(F.lit(1)).alias("n"), F.max_by("roll", "ts").alias("rolling_beta"))
    b = F.coalesce(div("c", "v"), F.lit(1.0))
    g = g.withColumn("beta", b)
    res = F.col("vx") - 2 * F.col("beta") * F.col("c") + F.col("beta") * F.col("beta") * F.col("v")
    return g.select("asset", "beta", (F.col("rho") * F.col("rho")).alias("r_squared"),
                    (F.sqrt(F.greatest(res, F.lit(0.0))) * YEAR).alias("residual_vol"), "rolling_beta", "n")


def risk_summary(metrics: DataFrame) -> DataFrame:
    """0-100 risk from volatility, max_drawdown and beta (higher is riskier)."""
    v = clip(F.coalesce("volatility", F.lit(0.0)) / 0.4 * 100, 0, 100)
    d = clip(-F.coalesce("max_drawdown", F.lit(0.0)) / 0.5 * 100, 0, 100)
    b = clip((F.coalesce("beta", F.lit(1.0)) - 0.5) / 1.5 * 100, 0, 100)
    out = metrics.withColumns({"volatility_score": v, "drawdown_score": d, "beta_score": b})
    return out.withColumn("risk_score", 0.4 * F.col("volatility_score") + 0.4 * F.col("drawdown_score") + 0.2 * F.col("beta_score"))


def risk_metrics(prices: DataFrame, returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All single-asset risk figures in one row per asset. The benchmark needs more than ten dates."""
    r = returns.groupBy("asset").agg(
        (F.stddev_samp("r") * YEAR).alias("volatility"), (_downside("r", 0.0) * YEAR).alias("downside_dev"),
        ((F.avg("r") - RISK_FREE) * 252).alias("_a"))
    v95 = value_at_risk(returns, levels=(0.95,)).select("asset", F.col("var").alias("var_95"), F.col("cvar").alias("cvar_95"))
    b = beta(returns, benchmark).select("asset", F.when(F.col("n") > 10, F.col("beta")).otherwise(1.0).alias("beta"))
    d = max_drawdown(prices).select("asset", "max_drawdown", "duration_days")
    j = r.join(d, "asset").join(v95, "asset").join(b, "asset", "left")
    return j.withColumn("beta", F.coalesce("beta", F.lit(1.0))).withColumn(
        "sharpe_ratio", F.coalesce(div("_a", "volatility"), F.lit(0.0))).withColumn(
        "sortino_ratio", F.coalesce(div("_a", "downside_dev"), F.lit(0.0))).drop("_a")


def score_risk(prices: DataFrame, returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """M5: 100 - risk score."""
    return risk_summary(risk_metrics(prices, returns, benchmark)).withColumn("score", 100 - F.col("risk_score"))


# -- tails ------------------------------------------------------------------------------------
def complete_dates(returns: DataFrame, keys=()) -> DataFrame:
    """Rows of the dates on which every asset (of the key group) has a return."""
    keys = list(keys)
    n = returns.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_k"))
    if keys:
        total = returns.select(*keys, "asset").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        good = n.join(total, keys).where("_k = _n").select(*keys, "ts")
    else:
        total = returns.select("asset").distinct().agg(F.count(F.lit(1)).alias("_n"))
        good = n.where(F.col("_k") == total.scalar()).select("ts")
    return returns.join(good, [*keys, "ts"], "left_semi")


def copula_rank_correlation(returns: DataFrame, chunk: Column, value: str = "r", nu: float = 4.0, floor: float | None = 1e-6) -> DataFrame:
    """Correlation (a <= b) of the t quantiles of pseudo-observations (rank - 0.5) / n; at least 30
    complete dates. The t with four degrees of freedom has a closed quantile. Eigenvalues stay at or above ``floor``, the diagonal at one."""
    if nu != 4.0:
        raise ValueError("only four degrees of freedom have a closed-form quantile")
    r = average_rank(complete_dates(returns), ["asset"], value).where("n >= 30")
    q = r.withColumn("q", t4_ppf((F.col("rank") - 0.5) / F.col("n")))
    m = correlation(pair_moments(q, [], chunk, value="q"))
    if floor is None:
        return m
    raised = eigen_floor(m.withColumnRenamed("corr", "value").withColumn("_g", F.lit(0)), "_g", floor)
    return raised.select("a", "b", F.col("value").alias("corr"))


def lowest_eigenvalue(matrix: DataFrame, group: str, enough: float = float("inf"), steps: int = 60, tol: float = 1e-9) -> dict:
    """A lower bound of the smallest eigenvalue of each group's symmetric matrix (group, a <= b, value), to a part in 1 / tol of its scale.

    Lanczos steps: the matrix stays a table, each step joins it with a vector and adds up products, and only two numbers a group come to
    the driver. The smallest eigenvalue of the small tridiagonal matrix, less its residual, bounds the wanted one; groups stop once
    that bound has converged or lies above ``enough``."""
    off = matrix.where("a <> b").select(group, F.col("b").alias("a"), F.col("a").alias("b"), "value")
    full = cut(matrix.select(group, "a", "b", "value").unionByName(off))
    size = full.where("a = b").groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("value")).alias("scale"))
    # A start vector with a part in every direction, from a hash, so every rerun takes the same steps.
    start = full.where("a = b").select(group, F.col("a").alias("at"), (F.pmod(F.xxhash64("a"), F.lit(1000003)) / 1000003.0 + 0.5).alias("v"))
    norm = start.groupBy(group).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_l"))
    v = cut(start.join(norm, group).select(group, "at", (F.col("v") / F.col("_l")).alias("v"), F.lit(0.0).alias("u")))
    sizes = {r[group]: (r["n"], max(r["scale"] / r["n"], 1e-300)) for r in size.collect()}
    alpha: dict = {g: [] for g in sizes}
    beta: dict = {g: [] for g in sizes}
    bound: dict = {}
    for _ in range(steps):
        w = full.join(v.select(group, F.col("at").alias("b"), "v"), [group, "b"]).groupBy(group, F.col("a").alias("at")).agg(
            F.sum(F.col("value") * F.col("v")).alias("w"))
        w = cut(w.join(v, [group, "at"]))
        a_of = dict(w.groupBy(group).agg(F.sum(F.col("w") * F.col("v"))).collect())
        table = matrix.sparkSession.createDataFrame(
            [(g, float(a), beta[g][-1] if beta[g] else 0.0) for g, a in a_of.items()], f"`{group}` {dict(matrix.dtypes)[group]}, _a double, _b double")
        w = cut(w.join(table, group).select(group, "at", (F.col("w") - F.col("_a") * F.col("v") - F.col("_b") * F.col("u")).alias("w"), "v"))
        b_of = dict(w.groupBy(group).agg(F.sqrt(F.sum(F.col("w") * F.col("w")))).collect())
        for g, a in a_of.items():
            alpha[g].append(a)
            e, s = np.linalg.eigh(np.diag(alpha[g]) + np.diag(beta[g], 1) + np.diag(beta[g], -1))
            rest = b_of[g] * abs(s[-1, 0])
            beta[g].append(b_of[g])
            if rest <= tol * sizes[g][1] or e[0] - rest > enough or len(alpha[g]) >= sizes[g][0]:
                bound[g] = float(e[0] - rest)
        open_ = [(g, b_of[g]) for g in a_of if g not in bound]
        if not open_:
            break
        table = matrix.sparkSession.createDataFrame(open_, f"`{group}` {dict(matrix.dtypes)[group]}, _b double")
        v = cut(w.join(table, group).select(group, "at", (F.col("w") / F.col("_b")).alias("v"), F.col("v").alias("u")))
    for g in sizes:
        if g not in bound:  # not converged: what is certain
            e, s = np.linalg.eigh(np.diag(alpha[g]) + np.diag(beta[g][:-1], 1) + np.diag(beta[g][:-1], -1))
            bound[g] = float(e[0] - beta[g][-1] * abs(s[-1, 0]))
    return bound


def eigen_floor(matrix: DataFrame, group: str, floor: float = 1e-6, steps: int = 60) -> DataFrame:
    """(group, a, b, value) with no eigenvalue below ``floor``: matrices that have one are shrunk toward their mean variance times the
    identity, just far enough. A correlation matrix keeps its unit diagonal."""
    matrix = cut(matrix.select(group, "a", "b", "value"))
    lowest = lowest_eigenvalue(matrix, group, floor, steps)
    mean = dict(matrix.where("a = b").groupBy(group).agg(F.avg("value")).collect())
    share = {g: (floor - e) / (mean[g] - e) if e < floor < mean[g] else 0.0 for g, e in lowest.items()}
    rows = [(g, s, mean[g]) for g, s in share.items()]
    table = matrix.sparkSession.createDataFrame(rows, f"`{group}` {dict(matrix.dtypes)[group]}, _s double, _m double")
    own = F.when(F.col("a") == F.col("b"), F.col("_s") * F.col("_m")).otherwise(0.0)
    value = F.when(F.col("_s") == 0, F.col("value")).otherwise((1 - F.col("_s")) * F.col("value") + own)
    return matrix.join(table, group).select(group, "a", "b", value.alias("value"))


def correlation(m: DataFrame, keys=()) -> DataFrame:
    n = F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    c = F.col("sab") - F.col("sa") * F.col("sb") / n
    rho = F.when(F.col("a") == F.col("b"), 1.0).otherwise(c / F.nullif(F.sqrt(va * vb), F.lit(0.0)))
    return m.select(*keys, "a", "b", rho.alias("corr"))


def joint_tail_risk(returns: DataFrame, weights: DataFrame, portfolio: str = "candidate", drop: float = -0.05) -> DataFrame:
    """99 % VaR and CVaR of each portfolio over the observed joint dates, and the share of dates on
    which at least half of the assets fall below ``drop``."""
    d = cut(complete_dates(returns).select("asset", "ts", "r"))
    crash = d.groupBy("ts").agg((F.count_if(F.col("r") < drop) >= F.count(F.lit(1)) / 2).cast("double").alias("c"))
    total = weights.groupBy(portfolio).agg(F.sum("w").alias("_t"))
    w = weights.join(total, portfolio).where("_t > 0").select(portfolio, "asset", (F.col("w") / F.col("_t")).alias("w"))
    dates = d.select("ts").distinct().count()
    path = spread(w, portfolio, growth=dates).join(d, "asset").groupBy(portfolio, "ts").agg(F.sum(F.col("w") * F.col("r")).alias("r"))
    v = value_at_risk(path, levels=(0.99,), keys=(portfolio,))
    p = crash.agg(F.avg("c").alias("p"))
    return v.select(portfolio, F.col("var").alias("var_99"), F.col("cvar").alias("cvar_99"), p.scalar().alias("joint_crash_probability"))


def lower_tail_dependence(returns: DataFrame, level: float = 0.05, value: str = "r", blocks: int | None = None) -> DataFrame:
    """(a < b, n, both, dependence): on how many of the dates with both assets both are in their own lower tail, over ``level`` of them.

    A tail is what lies at or below the asset's own quantile. Each asset becomes a bitmap of its tail dates and one of its dates, 64 trading
    dates a word. Blocks of assets meet once per stretch of the calendar and are counted by bitwise and, so no date is joined with
    itself. Pairs without a common date have no row."""
    d = returns.select("asset", "ts", F.col(value).alias("r")).where("r is not null")
    low = d.groupBy("asset").agg(F.percentile("r", level).alias("_q"))
    cal = d.select("ts").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit("all")).orderBy("ts")) - 1)  # one row a date
    bit = F.expr("shiftleft(1L, _i % 64)")
    words = d.join(low, "asset").join(cal, "ts").groupBy("asset", F.floor(F.col("_i") / 64).cast("int").alias("word")).agg(
        F.bit_or(bit).alias("seen"), F.coalesce(F.bit_or(F.when(F.col("r") <= F.col("_q"), bit)), F.lit(0).cast("long")).alias("tail"))
    words = cut(words)
    src = block_pairs(words, block_count(words) if blocks is None else blocks).withColumn("_c", F.floor(F.col("word") / 64))
    kind = dict(words.dtypes)["asset"]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = pdf["bi"].iat[0], pdf["bj"].iat[0]
        names, at = np.unique(pdf["asset"].to_numpy(), return_inverse=True)
        home = np.empty(len(names), np.int64)
        home[at] = pdf["_b"].to_numpy()
        place = pdf["word"].to_numpy() % 64
        maps = []
        for c in ("seen", "tail"):
            m = np.zeros((64, len(names)), np.uint64)
            m[place, at] = pdf[c].to_numpy(np.int64).view(np.uint64)
            maps.append(m)
        left, right = np.flatnonzero(home == bi), np.flatnonzero(home == bj)
        common = [sum(np.bitwise_count(w[left][:, None] & w[right][None, :]).astype(np.int64) for w in m) for m in maps]
        a, b = (g.ravel() for g in np.meshgrid(names[left], names[right], indexing="ij"))
        swap = a > b
        out = pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "n": common[0].ravel(), "both": common[1].ravel()})
        keep = (out["n"] > 0) & (a != b)
        return out[keep & ~swap] if bi == bj else out[keep]

    parts = src.groupBy("bi", "bj", "_c").applyInPandas(count, f"a {kind}, b {kind}, n bigint, both bigint")
    g = parts.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("both").alias("both"))
    return g.withColumn("dependence", F.col("both") / (F.col("n") * level))


def evt_peaks_over_threshold(returns: DataFrame, value: str = "r", threshold: float = 0.95, level: float = 0.99) -> DataFrame:
    """Generalised-Pareto tail of losses: threshold, shape and scale by the method of moments, VaR, ES.
    Short series and few exceedances fall back to empirical quantiles (x1.25 and x1.2)."""
    loss = returns.select("asset", (-F.col(value)).alias("x")).where("x is not null")
    cut = loss.groupBy("asset").agg(F.percentile("x", [threshold, level]).alias("_q"), F.count("x").alias("n"))
    over = F.when(F.col("x") > F.col("_q")[0], F.col("x") - F.col("_q")[0])
    g = loss.join(cut, "asset").groupBy("asset").agg(
        F.max("n").alias("n"), F.max(F.col("_q")[0]).alias("u"), F.max(F.col("_q")[1]).alias("q"),
        F.count(over).alias("k"), F.avg(over).alias("m"), F.var_samp(over).alias("s2"),
        F.avg(F.when(F.col("x") >= F.col("_q")[1], F.col("x"))).alias("tail"))
    ratio = F.col("m") * F.col("m") / F.nullif("s2", F.lit(0.0))
    g = g.withColumns({"xi": 0.5 * (1 - ratio), "beta": 0.5 * F.col("m") * (ratio + 1)})
    p = (F.col("n") / F.nullif("k", F.lit(0))) * (1 - level)
    var = F.col("u") + F.col("beta") / F.nullif("xi", F.lit(0.0)) * (F.pow(p, -F.col("xi")) - 1)
    status = F.when(F.col("n") < 100, "insufficient_data").when(F.col("k") < 10, "insufficient_exceedances").otherwise("success")
    g = g.withColumn("status", status).withColumn("_v", F.coalesce(var, F.col("q")))
    es = F.when(F.col("xi").isNull() | (F.col("xi") == 0), F.col("tail")).when(
        F.col("xi") < 1, (F.col("_v") + F.col("beta") - F.col("xi") * F.col("u")) / F.nullif(1 - F.col("xi"), F.lit(0.0))).otherwise(F.col("_v") * 1.5)
    ok = F.col("status") == "success"
    return g.select(
        "asset", "status", F.when(ok, F.col("u")).alias("threshold_u"), F.when(ok, F.col("xi")).alias("shape_xi"),
        F.when(ok, F.col("beta")).alias("scale_beta"), F.when(ok, F.col("_v")).otherwise(F.col("q")).alias("evt_var"),
        F.when(ok, es).when(F.col("n") < 100, F.col("q") * 1.25).otherwise(F.col("q") * 1.2).alias("evt_cvar"),
        F.col("k").alias("n_exceedances"))


# Market shock of each named scenario.
STRESS_SCENARIOS = [
    ("2008_global_financial_crisis", "2008 Lehman Collapse & Subprime Liquidity Freeze", -0.42),
    ("2020_covid_liquidity_shock", "March 2020 Global Pandemic Shock", -0.32),
    ("2022_inflation_rate_surge", "2022 Rapid Fed Tightening & Multiple Compression", -0.22),
    ("tech_sector_meltdown", "Concentrated Tech & Growth De-rating", -0.35),
]


def portfolio_beta(weights: DataFrame, betas: DataFrame, portfolio: str = "portfolio") -> DataFrame:
    """Weighted beta per portfolio; an unknown beta counts as 1."""
    return weights.join(betas.select("asset", "beta"), "asset", "left").groupBy(portfolio).agg(
        F.sum(F.col("w") * F.coalesce("beta", F.lit(1.0))).alias("pb"))


def scenario_stress(weights: DataFrame, betas: DataFrame, portfolio: str = "portfolio", floor: float = -0.35) -> DataFrame:
    d = with_params(portfolio_beta(weights, betas, portfolio), STRESS_SCENARIOS, ["scenario", "scenario_name", "shock"])
    loss = F.col("pb") * F.col("shock")
    return d.select(portfolio, "scenario", "scenario_name", loss.alias("projected_portfolio_loss"), (loss > floor).alias("portfolio_survival"))


def reverse_stress(weights: DataFrame, betas: DataFrame, portfolio: str = "portfolio", max_loss: float = -0.20) -> DataFrame:
    """Market fall that brings each portfolio to the loss."""
    d = portfolio_beta(weights, betas, portfolio)
    t = F.when(F.col("pb") == 0, max_loss).otherwise(max_loss / F.nullif("pb", F.lit(0.0)))
    d = d.withColumn("market_drawdown_trigger", t)
    a = F.abs("market_drawdown_trigger")
    return d.select(portfolio, F.lit(max_loss).alias("target_portfolio_loss"), F.col("pb").alias("portfolio_weighted_beta"),
                    "market_drawdown_trigger", F.when(a < 0.15, "HIGH").when(a < 0.25, "MODERATE").otherwise("LOW").alias("vulnerability_rating"))


# -- matrices: (group, a, b, value) with a <= b ----------------------------------------------------
def square(pdf: pd.DataFrame, value: str = "value") -> tuple[list, np.ndarray]:
    """Dense symmetric matrix of one group from its a <= b entries."""
    names = sorted(set(pdf["a"]) | set(pdf["b"]))
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
    m[i, j] = pdf[value].to_numpy(float)
    m[j, i] = pdf[value].to_numpy(float)
    return names, m


def eigenvalue_spectrum(cov: DataFrame, group: str) -> DataFrame:
    """(group, rank, eigenvalue), largest first; one finished matrix per group."""
    gt = dict(cov.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.linalg.eigvalsh(square(pdf)[1])[::-1]
        return pd.DataFrame({group: pdf[group].iat[0], "rank": np.arange(1, len(e) + 1), "eigenvalue": e})

    return cov.groupBy(group).applyInPandas(run, f"`{group}` {gt}, rank bigint, eigenvalue double")


def condition_number(cov: DataFrame, group: str) -> DataFrame:
    """Ratio of the extreme absolute eigenvalues (the 2-norm condition of a symmetric matrix)."""
    e = F.abs("eigenvalue")
    return eigenvalue_spectrum(cov, group).groupBy(group).agg(
        F.coalesce(F.max(e) / F.nullif(F.min(e), F.lit(0.0)), F.lit(float("inf"))).alias("condition_number"))


def effective_rank(cov: DataFrame, group: str, floor: float = 1e-10) -> DataFrame:
    """exp of the entropy of the eigenvalue shares; no positive eigenvalue gives 0."""
    s = eigenvalue_spectrum(cov, group).withColumn("v", F.when(F.col("eigenvalue") > floor, F.col("eigenvalue")))
    # sum(p ln p) with p = v / S equals sum(v ln v) / S - ln S
    tot = F.sum("v")
    h = F.log(tot) - F.sum(F.col("v") * F.log("v")) / tot
    return s.groupBy(group).agg(F.coalesce(F.exp(h), F.lit(0.0)).alias("effective_rank"))


def participation_ratio(cov: DataFrame, group: str) -> DataFrame:
    """trace^2 over the squared Frobenius norm, equal to the eigenvalue form for a covariance."""
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    tr = F.sum(F.when(F.col("a") == F.col("b"), F.col("value")).otherwise(0.0))
    return cov.groupBy(group).agg(F.coalesce(tr * tr / F.nullif(F.sum(twice * F.col("value") * F.col("value")), F.lit(0.0)), F.lit(0.0)).alias("participation_ratio"))
