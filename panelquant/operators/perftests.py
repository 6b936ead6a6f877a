"""Significance tests on performance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_shuffle, col, div
from ..functions.dist import norm_cdf, norm_ppf
from ..functions.gram import block_count, block_pairs, pair_moments
from ..functions.mixing import mix, unit
from ..functions.ranking import running_extreme, value_ladder
from .returns import running_product

GAMMA = 0.57721566490153286  # Euler-Mascheroni
REPLICATES_PER_TASK = 4096


def jobson_korkie_memmel(returns: DataFrame, chunk, asset: str = "asset", value: str = "r", min_rows: int = 10) -> DataFrame:
    """z and two-sided p for equal Sharpe ratios of every pair of strategies, from pair moments alone."""
    m = pair_moments(returns, [], chunk, asset=asset, value=value).where("a < b")
    n = F.col("n")
    d = m.withColumns({
        "ma": F.col("sa") / n, "mb": F.col("sb") / n,
        "va": (F.col("saa") - F.col("sa") * F.col("sa") / n) / F.nullif(n - 1, F.lit(0.0)),
        "vb": (F.col("sbb") - F.col("sb") * F.col("sb") / n) / F.nullif(n - 1, F.lit(0.0)),
        "c": (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.nullif(n - 1, F.lit(0.0))})
    sa, sb = F.sqrt("va"), F.sqrt("vb")
    ma, mb, va, vb, c = (F.col(x) for x in ("ma", "mb", "va", "vb", "c"))
    theta = (2 * va * vb - 2 * sa * sb * c + 0.5 * ma * ma * vb + 0.5 * mb * mb * va
             - ma * mb / F.nullif(sa * sb, F.lit(0.0)) * c * c) / n
    d = d.withColumn("theta", theta)
    ok = (n >= min_rows) & (va > 0) & (vb > 0) & (F.col("theta") > 0)
    d = d.withColumn("z", F.coalesce(F.when(ok, (sb * ma - sa * mb) / F.sqrt("theta")), F.lit(0.0)))
    return d.select(F.col("a").alias("strategy_a"), F.col("b").alias("strategy_b"), n.cast("bigint").alias("n"),
                    F.col("z").alias("z_stat"), F.when(ok, 2 * (1 - norm_cdf(F.abs("z")))).otherwise(1.0).alias("p_value"))


def bootstrap_index(n: Column, frame: DataFrame, replicates: int, block_length: float, seed: int = 42) -> DataFrame:
    """(rep, pos, src): stationary-bootstrap source positions. A block starts at position 0 and wherever a
    draw falls under 1 / block_length; its start is uniform and it wraps around. ``frame`` is one row
    that defines ``n``."""
    d = frame.select(n.cast("bigint").alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    d = d.withColumn("pos", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    start = (F.col("pos") == 0) | (unit("rep", "pos", F.lit(1), seed=seed) < 1.0 / block_length)
    origin = F.pmod(mix("rep", "pos", F.lit(2), seed=seed), F.col("n"))
    w = Window.partitionBy("rep").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_s", F.last(F.when(start, F.struct(F.col("pos").alias("p"), origin.alias("o"))), ignorenulls=True).over(w))
    return d.select("rep", "pos", F.pmod(F.col("_s.o") + F.col("pos") - F.col("_s.p"), F.col("n")).alias("src"))


def positions(returns: DataFrame, asset: str = "asset", value: str = "r") -> DataFrame:
    """(asset, src, r) with positions 0.. in time order."""
    w = Window.partitionBy(asset).orderBy("ts")
    return returns.select(F.col(asset).alias("asset"), (F.row_number().over(w) - 1).cast("bigint").alias("src"), F.col(value).alias("r"))


def _resampled(returns: DataFrame, replicates: int, block_length: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Per (rep, asset) mean and deviation; all strategies share one index, so pairs stay paired."""
    pos = positions(returns)
    size = pos.agg((F.max("src") + 1).alias("n"))
    idx = bootstrap_index(F.col("n"), size, replicates, block_length, seed)
    return pos, by_shuffle(idx).join(pos, "src").groupBy("rep", "asset").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"))


def stationary_bootstrap(returns: DataFrame, replicates: int = 1000, block_length: float = 10.0, seed: int = 42) -> DataFrame:
    """Mean and deviation of every resample of every strategy (on dates that all strategies share)."""
    return _resampled(returns, replicates, block_length, seed)[1]


def bootstrap_sharpe_diff(returns: DataFrame, replicates: int = 1000, block_length: float = 10.0, seed: int = 42, min_rows: int = 10,
                          blocks: int | None = None) -> DataFrame:
    """Share of resamples whose centred Sharpe difference is at least the observed one, per pair.

    Strategies are dealt into blocks. A pair of blocks meets once for each stretch of replicates, as two matrices (replicate by strategy),
    and gives counts per pair; only those are added up by shuffle."""
    pos, boot = _resampled(returns, replicates, block_length, seed)
    sr = F.coalesce(div("mean", "std"), F.lit(0.0))
    base = pos.groupBy("asset").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count("r").alias("k"))
    base = base.select("asset", sr.alias("seen"), "k")
    rows = boot.select("rep", "asset", sr.alias("sr")).join(base, "asset")
    blocks = block_count(base) if blocks is None else blocks
    src = block_pairs(rows, blocks).withColumn("_c", F.floor(F.col("rep") / REPLICATES_PER_TASK))
    kind = dict(rows.dtypes)["asset"]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = pdf["bi"].iat[0], pdf["bj"].iat[0]
        one = pdf.drop_duplicates("asset").sort_values("asset")
        names, home, seen, k = (one[c].to_numpy() for c in ("asset", "_b", "seen", "k"))
        wide = pdf.pivot(index="rep", columns="asset", values="sr").reindex(columns=names).to_numpy(float)
        left, right = np.flatnonzero(home == bi), np.flatnonzero(home == bj)
        want = seen[left][:, None] - seen[right][None, :]
        hits = np.zeros(want.shape, np.int64)
        for row in wide:  # one replicate at a time: a matrix of pairs, no array over replicates and pairs
            hits += np.abs(row[left][:, None] - row[right][None, :] - want) >= np.abs(want)
        a, b = (g.ravel() for g in np.meshgrid(left, right, indexing="ij"))
        swap = names[a] > names[b]
        out = pd.DataFrame({"a": np.where(swap, names[b], names[a]), "b": np.where(swap, names[a], names[b]), "hits": hits.ravel(), "reps": len(wide),
                            "diff": np.where(swap, -want.ravel(), want.ravel()), "k": np.maximum(k[a], k[b])})
        return out[~swap & (a != b)] if bi == bj else out

    parts = src.groupBy("bi", "bj", "_c").applyInPandas(count, f"a {kind}, b {kind}, hits bigint, reps bigint, diff double, k bigint")
    g = parts.groupBy("a", "b").agg((F.sum("hits") / F.sum("reps")).alias("p"), F.max("diff").alias("diff"), F.max("k").alias("k"))
    few = F.col("k") < min_rows
    return g.select(F.col("a").alias("strategy_a"), F.col("b").alias("strategy_b"),
                    F.when(few, 1.0).otherwise(F.col("p")).alias("p_value"), F.when(few, 0.0).otherwise(F.col("diff")).alias("sharpe_diff"))


def multiple_comparison(tests: DataFrame, family: list[str], p: str = "p", method: str = "benjamini_hochberg", out: str = "p_adjusted") -> DataFrame:
    """Adjusted p-values within each family: bonferroni, benjamini_hochberg (bh, fdr_bh) or holm.
    Missing p-values stay missing. Families of any size: the order statistics come from a value ladder."""
    ladder = value_ladder(tests, family, p)
    n = F.col("n")
    if method == "bonferroni":
        adj = ladder.withColumn(out, F.least(F.lit(1.0), F.col(p) * n))
    elif method in ("benjamini_hochberg", "bh", "fdr_bh"):
        raw = ladder.withColumn("_raw", F.least(F.lit(1.0), F.col(p) * n / (F.col("before") + F.col("cnt"))))
        adj = running_extreme(raw, family, p, "_raw", out, from_top=True)
    elif method == "holm":
        raw = ladder.withColumn("_raw", F.least(F.lit(1.0), F.col(p) * (n - F.col("before"))))
        adj = running_extreme(raw, family, p, "_raw", out, from_top=False)
    else:
        raise ValueError(f"unknown correction method: {method}")
    return tests.join(adj.select(*family, p, out), [*family, p], "left").withColumn("significant", F.coalesce(F.col(out) < 0.05, F.lit(False)))


def expected_max_sharpe(n_trials, variance) -> Column:
    """Expected largest Sharpe ratio of n trials under the null; one trial or no variance gives 0."""
    n, v = col(n_trials), col(variance)
    top = 1 - 1e-15
    p1, p2 = F.least(1 - 1 / F.nullif(n.cast("double"), F.lit(0.0)), F.lit(top)), F.least(1 - 1 / (F.nullif(n.cast("double"), F.lit(0.0)) * math.e), F.lit(top))
    return F.when((n > 1) & (v > 0), F.sqrt(F.greatest(v, F.lit(0.0))) * ((1 - GAMMA) * norm_ppf(p1) + GAMMA * norm_ppf(p2))).otherwise(0.0)


def deflated_sharpe(df: DataFrame, sharpe="sharpe", n_trials="n_trials", variance="variance", n_obs="n_obs", skew="skew", kurt="kurtosis") -> DataFrame:
    """Probability that the Sharpe ratio exceeds the expected maximum of the trials (Pearson kurtosis)."""
    s = F.col(sharpe)
    d = df.withColumn("expected_max_sharpe", expected_max_sharpe(n_trials, variance))
    den = 1 - F.col(skew) * s + (F.col(kurt) - 1) / 4 * s * s
    d = d.withColumn("_den", den)
    ok = (F.col(n_obs) >= 3) & (F.col("_den") > 0)
    d = d.withColumn("_z", F.when(ok, (s - F.col("expected_max_sharpe")) * F.sqrt(F.col(n_obs) - 1.0) / F.sqrt("_den")))
    return d.withColumn("dsr_probability", F.coalesce(norm_cdf("_z"), F.lit(0.0))).drop("_den", "_z")


def strategy_moments(returns: DataFrame, strategy: str = "strategy", value: str = "r", excess: float = 0.0) -> DataFrame:
    """Per-period Sharpe, population skew and Pearson kurtosis of each strategy with the trial count and variance."""
    e = F.col(value) - excess
    g = returns.groupBy(strategy).agg(F.count(value).alias("n_obs"), F.coalesce(div(F.avg(e), F.stddev_samp(e)), F.lit(0.0)).alias("sharpe"),
                                      F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurtosis"))
    t = g.agg(F.struct(F.count(F.lit(1)).alias("k"), F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("v")).alias("t"))
    return g.withColumn("_t", t.scalar()).withColumn("n_trials", F.col("_t.k")).withColumn("variance", F.col("_t.v")).drop("_t")


def qualification_dsr(returns: DataFrame, strategy: str = "strategy", value: str = "r", n_trials: int = 10, benchmark_sr: float = 0.0) -> DataFrame:
    """Deflated Sharpe ratio with the square-root-of-log null and a haircut; under 30 rows gives zeros."""
    year = 252.0 ** 0.5
    if n_trials > 1:
        z = math.sqrt(2 * math.log(n_trials))
        null = (z + (1 - 0.5772156649) / z) / year
    else:
        null = benchmark_sr / year
    cut = min(0.30 * math.log(n_trials), 1.5)
    r = F.col(value)
    g = returns.groupBy(strategy).agg(F.count(r).alias("n"), F.coalesce(div(F.avg(r), F.stddev_samp(r)), F.lit(0.0)).alias("s"),
                                      F.skewness(r).alias("skewness"), (F.kurtosis(r) + 3).alias("kurtosis"))
    var = F.greatest(1 - F.col("skewness") * F.col("s") + (F.col("kurtosis") - 1) / 4 * F.col("s") * F.col("s"), F.lit(0.001))
    g = g.withColumn("_z", (F.col("s") - null) * F.sqrt(F.greatest(F.col("n") - 1.0, F.lit(0.0))) / F.sqrt(var))
    few = F.col("n") < 30
    return g.select(strategy, F.when(few, 0.0).otherwise(F.col("s") * year).alias("observed_sharpe"),
                    F.when(few, 0.0).otherwise(norm_cdf("_z")).alias("deflated_sharpe_ratio"),
                    F.when(few, 0.0).otherwise(F.greatest(F.col("s") * year - cut, F.lit(-2.0))).alias("haircut_sharpe"),
                    "skewness", "kurtosis", F.lit(cut).alias("trials_penalty"))


# Stage of each verdict.
STAGES = {"PASS": "Scale / Multi-Asset Deployment", "CONDITIONAL PASS": "Paper Trading / Small Capital Testing",
          "OVERFIT": "Reject & Redesign Alpha", "FAILED": "Reject"}


def qualification_verdict(path: DataFrame, strategy: str = "strategy", value: str = "r", bm: str = "bm", n_trials: int = 10) -> DataFrame:
    """Verdict ladder on deflated Sharpe, Sharpe, information ratio and the path's own largest drawdown."""
    year = 252.0 ** 0.5
    act = F.col(value) - F.coalesce(bm, F.lit(0.0))
    so_far = Window.partitionBy(strategy).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("_w", running_product(1 + F.col(value), so_far)).withColumn("_dd", F.col("_w") / F.max("_w").over(so_far) - 1)
    a = path.groupBy(strategy).agg(F.coalesce(div(F.avg(act) * 252, F.stddev_samp(act) * year), F.lit(0.0)).alias("information_ratio"),
                                   F.min("_dd").alias("max_drawdown"))
    d = qualification_dsr(path, strategy, value, n_trials).join(a, strategy)
    dsr, sr = F.col("deflated_sharpe_ratio"), F.col("observed_sharpe")
    status = (F.when(dsr < 0.50, "OVERFIT").when((sr < 0.40) | (F.col("information_ratio") < 0), "FAILED")
              .when(F.abs("max_drawdown") > 0.35, "FAILED").when(dsr < 0.85, "CONDITIONAL PASS").otherwise("PASS"))
    stages = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    d = d.withColumn("qualification_status", status)
    return d.withColumn("deployment_stage", stages[F.col("qualification_status")]).withColumn("reasons", F.array(_reason()))


def _reason() -> Column:
    """Why a strategy got its verdict, with the figure that decided."""
    dsr, deep = F.col("deflated_sharpe_ratio") * 100, F.abs("max_drawdown") * 100
    status = F.col("qualification_status")
    return (F.when(status == "OVERFIT", F.format_string("Deflated Sharpe ratio of %.1f%% is below 50%%: likely an effect of the trials", dsr))
            .when((status == "FAILED") & ((F.col("observed_sharpe") < 0.40) | (F.col("information_ratio") < 0)),
                  F.format_string("Too little return for its risk: Sharpe %.2f, information ratio %.2f", "observed_sharpe", "information_ratio"))
            .when(status == "FAILED", F.format_string("Largest drawdown of %.1f%% is beyond 35%%", deep))
            .when(status == "CONDITIONAL PASS", F.format_string("Deflated Sharpe ratio of %.1f%% asks for more dates out of sample", dsr))
            .otherwise(F.format_string("Deflated Sharpe ratio of %.1f%% holds after costs and trials", dsr)))
