"""Score integration, ablation, model comparison and sensitivity.

Scores are long: (entity columns, module, score); an entity is an asset or an asset on a date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, clip, div, safe_corr
from ..functions.mixing import normal
from ..functions.ranking import average_rank

MODULES = ["M1", "M2", "M3", "M4", "M5", "M6"]
ENTITY = ["asset", "ts"]


def wide_scores(scores: DataFrame, entity=ENTITY, modules=MODULES) -> DataFrame:
    return scores.groupBy(*entity).agg(*[F.max(F.when(F.col("module") == m, F.col("score"))).alias(m) for m in modules])


def clip_scores(scores: DataFrame) -> DataFrame:
    """Drop missing scores and clip the rest to 0..100."""
    ok = F.col("score").isNotNull() & ~F.isnan("score")
    return scores.where(ok).withColumn("score", clip("score", 0, 100))


def module_correlation(scores: DataFrame, entity=ENTITY, min_rows: int = 5, high: float = 0.7) -> DataFrame:
    """Spearman correlation of every module pair over the entities that have both."""
    one = scores.where("score is not null").groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct("module", "score"))).alias("s"))
    # At most one entry per module, so the pairs of an entity are bounded by the module list.
    pairs = F.flatten(F.transform("s", lambda x: F.transform(
        F.filter("s", lambda y: y["module"] > x["module"]),
        lambda y: F.struct(x["module"].alias("module_a"), y["module"].alias("module_b"), x["score"].alias("x"), y["score"].alias("y")))))
    d = one.select(*entity, F.explode(pairs).alias("p")).select(*entity, "p.*")
    keys = ["module_a", "module_b"]
    d = average_rank(d, keys, "x", out="rx", n="n")
    d = average_rank(d, keys, "y", out="ry", n="n2")
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_corr("rx", "ry").alias("correlation")).where(F.col("n") >= min_rows)
    return g.withColumn("high", F.abs("correlation") > high)


def module_weights(scores: DataFrame, scheme: str = "equal") -> DataFrame:
    """(module, weight) over the modules present: equal, or inverse to the deviation of the scores;
    any other scheme falls back to equal."""
    g = scores.groupBy("module").agg(F.stddev_samp("score").alias("s"))
    raw = 1.0 / (F.col("s") + 1e-8) if scheme == "vol_adjusted" else F.lit(1.0)
    g = g.select("module", raw.alias("raw"))
    return g.select("module", (F.col("raw") / g.agg(F.sum("raw").alias("t")).scalar()).alias("weight"))


def composite_score(scores: DataFrame, weights: DataFrame, entity=ENTITY) -> DataFrame:
    """Weighted mean over the modules an entity has (weights rescaled to those)."""
    j = scores.join(weights, "module")
    return j.groupBy(*entity).agg(F.count("score").alias("n_modules"), div(F.sum(F.col("weight") * F.col("score")), F.sum("weight")).alias("composite"))


def risk_adjusted_score(df: DataFrame, composite: str = "composite", risk: str = "risk", lam: float = 0.3) -> DataFrame:
    """composite x (1 - lambda (100 - risk) / 100); a high risk score means low risk."""
    pen = lam * (100.0 - F.col(risk)) / 100.0
    return df.withColumn("penalty", pen).withColumn("adjusted", F.col(composite) * (1 - F.col("penalty")))


def composite_ci(wide: DataFrame, entity, modules, risk: str, key: list[str], replicates: int = 1000, noise: float = 10.0,
                 level: float = 0.90, lam: float = 0.3, seed: int = 42, weights: DataFrame | None = None) -> DataFrame:
    """Percentile interval of the adjusted score under noise on every module score. Draws depend only
    on (entity key, replicate, module), so a rerun repeats them. ``key`` holds one or two integer columns.
    ``weights`` (module, weight) are rescaled to the modules that an entity has; without them all count alike."""
    d = wide
    if weights is not None:  # one entry per module
        d = d.withColumn("_weights", weights.agg(F.map_from_entries(F.collect_list(F.struct("module", "weight")))).scalar())
    share = lambda m: F.coalesce(F.col("_weights")[m], F.lit(0.0)) if weights is not None else F.lit(1.0)
    d = d.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    d = d.withColumns({f"_z{i}": normal(*key, F.col("_r") * 16 + 2 * i, seed=seed) for i, _ in enumerate(modules)})
    total, count = F.lit(0.0), F.lit(0.0)
    for i, m in enumerate(modules):
        noisy = F.least(F.greatest(F.col(m) + noise * F.col(f"_z{i}"), F.lit(0.0)), F.lit(100.0))
        total = total + F.when(F.col(m).isNotNull(), share(m) * noisy).otherwise(0.0)
        count = count + F.when(F.col(m).isNotNull(), share(m)).otherwise(0.0)
    adj = total / F.nullif(count, F.lit(0.0)) * (1 - lam * (100.0 - F.col(risk)) / 100.0)
    tail = (1 - level) / 2
    g = d.select(*entity, adj.alias("_a")).groupBy(*entity).agg(F.percentile("_a", [tail, 1 - tail]).alias("_q"))
    return g.select(*entity, F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"))


def integrate(scores: DataFrame, entity=ENTITY, risk_module: str = "M5", scheme: str = "equal", lam: float = 0.3,
              key: dict[str, Column] | None = None, modules=MODULES, replicates: int = 1000) -> DataFrame:
    """Clip, weigh, combine and risk-adjust; fewer than three modules raises a warning flag. ``correlated`` lists the module pairs
    that measure the same thing over all entities. ``key`` (integer columns of an entity) adds the noise interval."""
    s = clip_scores(scores)
    weights = module_weights(s, scheme)
    c = composite_score(s, weights, entity)
    alike = module_correlation(s, entity).where("high").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", "module_a", "module_b"))), ", "))  # module pairs
    risk = s.where(F.col("module") == risk_module).select(*entity, F.col("score").alias("risk"))
    d = risk_adjusted_score(c.join(risk, list(entity), "left").withColumn("risk", F.coalesce("risk", F.lit(50.0))), lam=lam)
    if key:
        wide = wide_scores(s, entity, modules).withColumns({**key, "_risk": F.coalesce(risk_module, F.lit(50.0))})
        d = d.join(composite_ci(wide, list(entity), modules, "_risk", list(key), replicates, lam=lam, weights=weights), list(entity))
    return d.withColumn("correlated", alike.scalar()).withColumn("warning", F.when(F.col("n_modules") < 3, F.concat(
        F.lit("Only "), F.col("n_modules").cast("string"), F.lit(" modules produced valid scores"))).otherwise(""))


def walkforward_score(wide: DataFrame) -> DataFrame:
    """mean(M1..M4) x (1 - 0.25 (100 - M5) / 100), clipped; a missing module counts as 50."""
    m = {k: F.coalesce(F.col(k), F.lit(50.0)) for k in ("M1", "M2", "M3", "M4", "M5")}
    raw = (m["M1"] + m["M2"] + m["M3"] + m["M4"]) / 4
    return wide.withColumn("score", clip(raw * (1 - 0.25 * (100 - m["M5"]) / 100), 0, 100))


def mean_aggregator(modules: dict[str, Column]) -> Column:
    """Mean of the module columns that have a value."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in modules.values()), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in modules.values()), F.lit(0))
    return total / F.nullif(n, F.lit(0))


def risk_aggregator(modules: dict[str, Column], risk: Column, lam: float = 0.3) -> Column:
    """The mean of the modules less the penalty of the risk score; an unknown risk counts as 50."""
    return mean_aggregator(modules) * (1 - lam * (100.0 - F.coalesce(risk, F.lit(50.0))) / 100.0)


def module_ablation(wide: DataFrame, modules=MODULES, aggregator: Callable[..., Column] = mean_aggregator, risk: str | None = None) -> DataFrame:
    """Mean absolute change of the composite when a module is left out, also as a share; one pass.

    With ``risk`` the aggregator gets that column as its second argument. It stays when a module is left out, also its own."""
    cols = {m: F.col(m) for m in modules}
    more = () if risk is None else (F.col(risk),)
    d = wide.withColumn("_full", aggregator(cols, *more))
    change = {m: F.abs(F.col("_full") - aggregator({k: c for k, c in cols.items() if k != m}, *more)) for m in modules}
    g = d.agg(F.avg(F.abs("_full")).alias("_f"), *[F.avg(c).alias(m) for m, c in change.items()])
    long = g.unpivot(["_f"], list(modules), "module", "score_change")
    return long.select("module", "score_change", F.coalesce(div("score_change", "_f"), F.lit(0.0)).alias("pct_change"))


def _rank_all(value: str) -> Column:
    """Min rank, largest first, of a table with one row per module or parameter."""
    return F.rank().over(Window.partitionBy("_all").orderBy(F.desc(value))).cast("bigint")


def rank_modules(ablation: DataFrame, high: float = 0.5, medium: float = 0.1) -> DataFrame:
    d = ablation.withColumn("score_impact", F.abs("score_change")).withColumn("_all", F.lit(1)).withColumn("rank", _rank_all("score_impact"))
    label = F.when(F.col("score_impact") > high, "Critical component, highly unique information.").when(
        F.col("score_impact") > medium, "Valuable component, adds some unique information.").otherwise(
        "Redundant component, provides little unique information.")
    return d.withColumn("interpretation", label).drop("_all")


def model_a(prices: DataFrame, info: DataFrame, price: str = "close") -> DataFrame:
    """Half one-year momentum by row offset, half -(PE - 15) / 5; missing parts count 0."""
    w = by_time()
    p = prices.select("asset", "ts", F.col(price).alias("p"), F.lag(price, 251).over(w).alias("q"))
    m = p.groupBy("asset").agg(F.max_by(F.struct("p", "q"), "ts").alias("l"))
    mom = F.coalesce(F.col("l.p") / F.nullif(F.col("l.q"), F.lit(0.0)) - 1, F.lit(0.0))
    pe = F.coalesce(-(F.col("trailing_pe") - 15) / 5.0, F.lit(0.0))
    return m.join(info.select("asset", "trailing_pe"), "asset", "left").select("asset", (0.5 * mom + 0.5 * pe).alias("score"))


def model_b(scores: DataFrame, entity=ENTITY) -> DataFrame:
    s = scores.where(F.col("module").isin("M1", "M2", "M3", "M4")).groupBy(*entity).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"))
    return s


def _with_module(base: DataFrame, scores: DataFrame, module: str, entity) -> DataFrame:
    m = scores.where(F.col("module") == module).select(*entity, F.col("score").alias(module))
    return base.join(m, list(entity), "left").withColumn(module, F.coalesce(module, F.lit(0.0)))


def model_c(scores: DataFrame, entity=ENTITY, lam: float = 0.5) -> DataFrame:
    d = _with_module(model_b(scores, entity), scores, "M5", entity)
    return d.select(*entity, (F.col("score") - lam * F.col("M5")).alias("score"))


def model_d(scores: DataFrame, entity=ENTITY, multiplier: float = 1.0) -> DataFrame:
    d = _with_module(_with_module(model_c(scores, entity), scores, "M6", entity), scores, "M7", entity)
    return d.select(*entity, (F.col("score") + multiplier * F.col("M6") + F.col("M7")).alias("score"))


def compare_models(returns: DataFrame, benchmark: DataFrame, model: str = "model", value: str = "r") -> DataFrame:
    """Sharpe without risk-free, information ratio, drawdown, return and volatility per model."""
    from .returns import running_product

    w = by_time(model).rowsBetween(Window.unboundedPreceding, 0)
    d = returns.join(benchmark, "ts").withColumn("wealth", running_product(1 + F.col(value), w))
    d = d.withColumn("dd", F.col("wealth") / F.max("wealth").over(w) - 1).withColumn("act", F.col(value) - F.col("bm"))
    year = 252.0 ** 0.5
    g = d.groupBy(model).agg(
        (F.avg(value) * 252).alias("annual_return"), (F.stddev_samp(value) * year).alias("annual_volatility"),
        (F.avg("act") * 252).alias("_a"), (F.stddev_samp("act") * year).alias("_t"), F.min("dd").alias("max_drawdown"))
    return g.select(model, F.coalesce(div("annual_return", "annual_volatility"), F.lit(0.0)).alias("sharpe_ratio"),
                    F.coalesce(div("_a", "_t"), F.lit(0.0)).alias("information_ratio"), "max_drawdown", "annual_return", "annual_volatility")


def full_sensitivity(data: DataFrame, grid: dict[str, list[float]], score: Callable[[str, float | None], Column]) -> DataFrame:
    """Score of every parameter value, its change from the baseline, and the slope to the previous value.
    ``score(name, value)`` is an aggregate; all grid points are computed in one pass over the data."""
    points = [(n, float(v)) for n, vs in grid.items() for v in vs]
    g = data.agg(score("baseline", None).alias("_base"), *[score(n, v).alias(f"s{i}") for i, (n, v) in enumerate(points)])
    rows = F.array(*[F.struct(F.lit(n).alias("param"), F.lit(v).alias("param_value"), F.col(f"s{i}").alias("output_score"))
                     for i, (n, v) in enumerate(points)])
    d = g.select("_base", F.explode(rows).alias("p")).select("_base", "p.*")
    w = Window.partitionBy("param").orderBy("param_value")
    slope = (F.col("output_score") - F.lag("output_score").over(w)) / F.nullif(F.col("param_value") - F.lag("param_value").over(w), F.lit(0.0))
    return d.select("param", "param_value", "output_score",
                    F.coalesce(div(F.col("output_score") - F.col("_base"), "_base"), F.lit(0.0)).alias("pct_change_from_baseline"),
                    F.coalesce(slope, F.lit(0.0)).alias("sensitivity"))


def parameter_sweep(data: DataFrame, name: str, values: list[float], score: Callable[[str, float | None], Column]) -> DataFrame:
    return full_sensitivity(data, {name: values}, score)


def rank_parameters(sweep: DataFrame) -> DataFrame:
    g = sweep.groupBy("param").agg(F.coalesce(div(F.stddev_samp("output_score"), F.avg(F.abs("output_score"))), F.lit(0.0)).alias("sensitivity_score"))
    return g.withColumn("_all", F.lit(1)).withColumn("rank", _rank_all("sensitivity_score")).drop("_all")
