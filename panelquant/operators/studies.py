"""Estimator-stability and method-benchmark studies over purged splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_shuffle, div
from ..sources.files import cut
from . import allocation as al
from . import perftests as pt
from . import risk as rk
from .predictive import turnover

RF = 0.04 / 252.0
METHODS = {"equal_weight": "Equal Weight", "naive_markowitz": "Naive Markowitz", "lw_shrinkage_only": "LW-Shrinkage-Only Markowitz",
           "regularised_markowitz": "Regularised Markowitz", "hrp": "HRP"}


def split_returns(returns: DataFrame, splits: DataFrame, min_train: int = 50, min_test: int = 10) -> DataFrame:
    """(path_id, role, ts, asset, r) of the train and test dates of splits that are long enough."""
    n = splits.groupBy("path_id").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b")).where(
        (F.col("a") >= min_train) & (F.col("b") >= min_test)).select("path_id")
    s = splits.where(F.col("role").isin("train", "test")).join(n, "path_id", "left_semi")
    return returns.select("ts", "asset", "r").join(s, "ts")


def split_weights(tagged: DataFrame, candidates: DataFrame, chunk: str, views: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights, covariances) per split. Markowitz arms take the best of the candidate table under the split's
    own mean and covariance; weights are (path_id, method, asset, w)."""
    train = tagged.where("role = 'train'").drop("role")
    m = cut(al.centred_moments(train, ["path_id"], chunk, complete=True))
    sample, lw = al.sample_covariance(m, ["path_id"]), al.ledoit_wolf(m, ["path_id"]).drop("shrinkage")
    covs = cut(sample.withColumn("estimator", F.lit("sample")).unionByName(lw.withColumn("estimator", F.lit("lw"))))
    sample, lw = (covs.where(F.col("estimator") == e).drop("estimator") for e in ("sample", "lw"))
    mu = cut(train.groupBy("path_id", "asset").agg((F.avg("r") * 252).alias("mu")))
    paths = mu.select("path_id").distinct()
    # The list of splits is a parameter-sized array, repeated next to every candidate row.
    cand = candidates.withColumn(
        "path_id", F.explode(paths.agg(F.collect_list("path_id").alias("p")).scalar()))

    def best(cov: DataFrame, mean: DataFrame, method: str) -> DataFrame:
        top = al.candidate_portfolio_scoring(cand, mean, cov, keys=["path_id"]).where("best").select("path_id", "candidate")
        return by_shuffle(cand).join(top, ["path_id", "candidate"]).select("path_id", F.lit(method).alias("method"), "asset", "w")

    even = mu.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("path_id"))).select("path_id", F.lit("equal_weight").alias("method"), "asset", "w")
    mu_reg = mu
    if views is not None:
        bl = al.black_litterman(lw, views, "path_id")
        mu_reg = bl.select("path_id", "asset", "mu")
    corr = rk.correlation(m, ["path_id"])
    hrp = al.hrp_weights(sample, corr, "path_id").select("path_id", F.lit("hrp").alias("method"), "asset", "w")
    naive = cut(best(sample, mu, "naive_markowitz"))
    shrunk = cut(best(lw, mu, "lw_shrinkage_only"))
    # Without views the regularised arm has the same inputs as the shrinkage arm.
    reg = shrunk.withColumn("method", F.lit("regularised_markowitz")) if views is None else best(lw, mu_reg, "regularised_markowitz")
    out = even.unionByName(naive).unionByName(shrunk).unionByName(reg).unionByName(hrp)
    return cut(out), covs


def path_returns(tagged: DataFrame, weights: DataFrame) -> DataFrame:
    """(path_id, method, ts, r) over the test dates."""
    test = tagged.where("role = 'test'").select("path_id", "ts", "asset", "r")
    return test.join(weights, ["path_id", "asset"]).groupBy("path_id", "method", "ts").agg(F.sum(F.col("w") * F.col("r")).alias("r"))


def excess_sharpe(paths: DataFrame, keys: list[str], rf: float = RF, population: bool = False) -> DataFrame:
    s = F.stddev_pop("r") if population else F.stddev_samp("r")
    return paths.groupBy(*keys).agg((F.coalesce(div(F.avg("r") - rf, s), F.lit(0.0)) * 252.0 ** 0.5).alias("sharpe"))


def estimator_stability_study(returns: DataFrame, splits: DataFrame, candidates: DataFrame, chunk: str) -> DataFrame:
    """One row per split: condition numbers, effective ranks, turnover, test Sharpe and weight distances of the
    sample, Ledoit-Wolf and hierarchical arms."""
    tagged = cut(split_returns(returns, splits))
    weights, covs = split_weights(tagged, candidates, chunk)
    arms = {"naive_markowitz": "sample", "lw_shrinkage_only": "lw", "hrp": "hrp"}
    w = weights.where(F.col("method").isin(list(arms)))

    def flat(df: DataFrame, key: str, names: dict, value: str, prefix: str) -> DataFrame:
        return df.groupBy("path_id").agg(*[F.max(F.when(F.col(key) == k, F.col(value))).alias(f"{prefix}_{v}") for k, v in names.items()])

    spec = cut(rk.eigenvalue_spectrum(covs.withColumn("g", F.concat_ws(":", "path_id", "estimator")), "g"))
    v = F.when(F.col("eigenvalue") > 1e-10, F.col("eigenvalue"))
    tot = F.sum(v)
    diag = spec.groupBy("g").agg((F.max(F.abs("eigenvalue")) / F.nullif(F.min(F.abs("eigenvalue")), F.lit(0.0))).alias("cond"),
                                 F.exp(F.log(tot) - F.sum(v * F.log(v)) / tot).alias("erank"))
    diag = diag.select(F.split("g", ":")[0].cast("bigint").alias("path_id"), F.split("g", ":")[1].alias("estimator"), "cond", "erank")
    est = {"sample": "sample", "lw": "lw"}
    turn = flat(turnover(w.select("method", "path_id", "asset", "w"), ["method"], "path_id"), "method", arms, "turnover", "turnover")
    sharpe = flat(excess_sharpe(path_returns(tagged, w), ["path_id", "method"]), "method", arms, "sharpe", "oos_sharpe")
    side = w.groupBy("path_id", "asset").agg(*[F.sum(F.when(F.col("method") == k, F.col("w")).otherwise(0.0)).alias(a) for k, a in arms.items()])
    dist = side.groupBy("path_id").agg(*[F.sqrt(F.sum(F.pow(F.col(a) - F.col(b), 2.0))).alias(f"weight_diff_l2_{a}_{b}") for a, b in (("sample", "lw"), ("hrp", "sample"), ("hrp", "lw"))])
    ends = tagged.groupBy("path_id").agg(F.max(F.when(F.col("role") == "test", F.col("ts"))).alias("test_end"))
    out = ends
    for part in (flat(diag, "estimator", est, "cond", "cond"), flat(diag, "estimator", est, "erank", "erank"), turn, sharpe, dist):
        out = out.join(part, "path_id")
    return out


def benchmark_paths(returns: DataFrame, splits: DataFrame, candidates: DataFrame, chunk: str, views: DataFrame | None = None) -> DataFrame:
    """(path_id, method, ts, r) of the five methods on every split."""
    tagged = cut(split_returns(returns, splits))
    weights, _ = split_weights(tagged, candidates, chunk, views)
    return path_returns(tagged, weights)


def ensemble(paths: DataFrame) -> DataFrame:
    """Mean over the overlapping paths per method and date."""
    return paths.groupBy("method", "ts").agg(F.avg("r").alias("r"))


def pair_tests(ens: DataFrame, chunk: str, replicates: int = 500) -> DataFrame:
    """z test and bootstrap of every method pair, with Bonferroni and Benjamini-Hochberg adjustment."""
    e = cut(ens.withColumnRenamed("method", "asset"))
    z = pt.jobson_korkie_memmel(e, chunk).select("strategy_a", "strategy_b", "z_stat")
    b = pt.bootstrap_sharpe_diff(e, replicates).select("strategy_a", "strategy_b", F.col("p_value").alias("bootstrap_p"))
    sr = cut(excess_sharpe(e, ["asset"], population=True))
    d = z.join(b, ["strategy_a", "strategy_b"]).withColumn("family", F.lit("all"))
    for side in ("a", "b"):
        d = d.join(sr.select(F.col("asset").alias(f"strategy_{side}"), F.col("sharpe").alias(f"sharpe_{side}")), f"strategy_{side}")
    d = cut(d)
    d = pt.multiple_comparison(d, ["family"], "bootstrap_p", "bonferroni", "bonferroni_p").drop("significant")
    return pt.multiple_comparison(d, ["family"], "bootstrap_p", "bh", "bh_p").drop("family")


def best_method_dsr(ens: DataFrame, n_obs: int | None = None) -> DataFrame:
    """Deflated Sharpe ratio of the method with the highest ensemble Sharpe; n is an explicit argument."""
    m = ens.groupBy("method").agg(F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurtosis"), F.count("r").alias("n"))
    d = cut(excess_sharpe(ens, ["method"], population=True).join(m, "method"))
    t = d.agg(F.struct(F.count(F.lit(1)).alias("k"), F.var_samp("sharpe").alias("v"), F.max_by("method", "sharpe").alias("best")).alias("t"))
    d = d.withColumn("_t", t.scalar()).where(F.col("method") == F.col("_t.best"))
    d = d.select(F.col("method").alias("best_method"), "sharpe", F.col("_t.k").alias("n_trials"), F.col("_t.v").alias("variance"),
                 (F.lit(n_obs) if n_obs else F.col("n")).alias("n_obs"), "skew", "kurtosis")
    return pt.deflated_sharpe(d)


def findings_headline(tests: DataFrame, baseline: str = METHODS["equal_weight"]) -> DataFrame:
    """One row: how many pairs differ at 5 % after adjustment, and which methods win them (the higher Sharpe).

    Winners come in order of their Sharpe ratio, each with the methods it beats; where the best method doesn't beat the ``baseline``, that is said.
    The table has one row per pair of methods."""
    ahead = F.col("sharpe_a") >= F.col("sharpe_b")
    pairs = tests.select(
        F.when(ahead, F.col("strategy_a")).otherwise(F.col("strategy_b")).alias("winner"), F.when(ahead, F.col("strategy_b")).otherwise(F.col("strategy_a")).alias("loser"),
        F.greatest("sharpe_a", "sharpe_b").alias("s"), "bh_p", "significant")
    top = F.max(F.struct("s", "winner")).alias("best")
    all_of = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("significant").alias("n_significant"), top)
    beaten = F.concat("loser", F.format_string(" (p=%.4f)", F.col("bh_p")))
    wins = pairs.where("significant").groupBy("winner").agg(F.max("s").alias("s"), F.array_join(F.array_sort(F.collect_list(beaten)), ", ").alias("l"))
    text = F.concat("winner", F.lit(" significantly outperforms "), "l")
    told = wins.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), text.alias("t")))), lambda x: x["t"]), ". ").alias("told"))
    best = all_of.select(F.col("best.winner").alias("_w"))
    versus = pairs.where((F.col("loser") == baseline) & (F.col("winner") == best.scalar())).agg(
        F.max(F.struct(F.col("significant").alias("beats"), "bh_p")).alias("base"))
    d = all_of.withColumn("told", told.scalar()).withColumn("base", versus.scalar())
    p = F.format_string(" (p=%.4f)", F.col("base.bh_p"))
    open_ = F.col("base").isNotNull() & ~F.col("base.beats")
    none = F.concat(F.lit("No two methods differ at the 5% level after Benjamini-Hochberg correction. The best point estimate is "), F.col("best.winner"),
                    F.format_string(" (Sharpe %.2f)", F.col("best.s")), F.when(open_, F.concat(F.lit(f", not significantly better than {baseline}"), p)).otherwise(F.lit("")), F.lit("."))
    one = F.concat("told", F.lit(". No other pair differs after correction."))
    many = F.concat("told", F.lit("."), F.when(open_, F.concat(F.lit(" Even "), F.col("best.winner"), F.lit(f" doesn't beat {baseline} after correction"), p, F.lit("."))).otherwise(F.lit("")))
    return d.select("n_pairs", "n_significant", F.col("best.winner").alias("best_method"),
                    F.when(F.col("n_significant") == 0, none).when(F.col("n_significant") == 1, one).otherwise(many).alias("headline"))


def findings_track1(study: DataFrame) -> DataFrame:
    """(metric, arm, value): averages of the estimator study's columns over its splits, how much shrinkage lowers the condition number
    (percent), and 1 for the arm with the lowest turnover."""
    names = [c for c, t in study.dtypes if t == "double"]
    g = study.agg(*[F.avg(c).alias(c) for c in names])
    turn = [c for c in names if c.startswith("turnover_")]
    lower = F.when(F.col("cond_sample") > 0, (1 - F.col("cond_lw") / F.col("cond_sample")) * 100)
    g = g.withColumn("cond_reduction_pct", lower).withColumns({f"lowest_{c}": (F.col(c) == F.least(*turn)).cast("double") for c in turn})
    long = g.unpivot([], [c for c in g.columns], "name", "value")
    arm = F.regexp_extract("name", r"_(sample|lw|hrp)$", 1)
    return long.select(F.regexp_replace("name", r"_(sample|lw|hrp)$", "").alias("metric"), arm.alias("arm"), "value")


def findings_tables(paths: DataFrame) -> DataFrame:
    """Mean, deviation and coefficient of variation of the path Sharpe ratios per method."""
    s = excess_sharpe(paths, ["path_id", "method"])
    g = s.groupBy("method").agg(F.avg("sharpe").alias("mean_oos_sharpe"), F.stddev_samp("sharpe").alias("std_oos_sharpe"))
    return g.withColumn("cv", div("std_oos_sharpe", F.abs("mean_oos_sharpe")))
