"""Learned models on MLlib: a return meta-model and a regime mixture."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, safe_corr, trailing, when_full
from ..functions.ranking import gapless_rank
from ..sources.files import cut


def _pipeline(features: list[str], kind: str, seed: int = 42, trees: int = 100, depth: int = 4) -> Pipeline:
    reg = {
        "gbdt": lambda: GBTRegressor(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.05, seed=seed),
        "random_forest": lambda: RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth + 1, seed=seed),
        "ridge": lambda: LinearRegression(featuresCol="x", labelCol="y", regParam=1.0, elasticNetParam=0.0),
    }[kind]()
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"),
                            RobustScaler(inputCol="raw", outputCol="x", withCentering=True), reg])


def _ic(df: DataFrame) -> float:
    v = df.agg(safe_corr("prediction", "y")).first()[0]
    return 0.0 if v is None or v != v else float(v)


def meta_model_fit(data: DataFrame, features: list[str], kind: str = "gbdt", splits: DataFrame | None = None, trees: int = 100, min_rows: int = 30):
    """Scaler and regressor on (features, y) with a ridge baseline. Returns (model, metrics row frame);
    under ``min_rows`` complete rows there is no fit (None). ``splits`` adds a purged-validation score."""
    d = cut(data.dropna(subset=[*features, "y"]))
    spark = data.sparkSession
    n = d.count()
    if n < min_rows:
        return None, spark.createDataFrame([("insufficient_data", n, None, None, None)], "status string, n bigint, ic_primary double, ic_baseline double, ic_cv double")
    model, base = _pipeline(features, kind, trees=trees).fit(d), _pipeline(features, "ridge").fit(d)
    ic, ic_base, ic_cv = _ic(model.transform(d)), _ic(base.transform(d)), None
    if splits is not None and n > 50:
        scores = []
        for path in [r[0] for r in splits.select("path_id").distinct().orderBy("path_id").collect()]:  # one entry per validation path
            s = d.join(splits.where(F.col("path_id") == path).select("ts", "role"), "ts")
            train, test = s.where("role = 'train'"), s.where("role = 'test'")
            if len(train.take(21)) > 20 and len(test.take(6)) > 5:
                scores.append(_ic(_pipeline(features, kind, trees=trees // 2, depth=3).fit(train).transform(test)))
        ic_cv = sum(scores) / len(scores) if scores else None
    return model, spark.createDataFrame([("fitted", n, ic, ic_base, ic_cv if ic_cv is not None else ic)],
                                        "status string, n bigint, ic_primary double, ic_baseline double, ic_cv double")


def meta_model_predict(model, data: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Forecast, logistic(15 y) and clip(50 + 500 y); without a model the row mean, 0 and 0.5."""
    if model is None:
        n = sum((F.col(c).isNotNull().cast("int") for c in features), F.lit(0))
        mean = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in features), F.lit(0.0)) / F.nullif(n, F.lit(0))
        return data.select(*keys, F.lit(0.0).alias("expected_excess_return"), F.lit(0.5).alias("outperformance_prob"), mean.alias("composite_score"))
    p = model.transform(data.fillna(0.0, subset=features))
    y = F.col("prediction")
    return p.select(*keys, y.alias("expected_excess_return"), (1 / (1 + F.exp(-15 * y))).alias("outperformance_prob"), clip(50 + 500 * y, 0, 100).alias("composite_score"))


def permuted(df: DataFrame, column: str, key: list[str], seed: int = 42) -> DataFrame:
    """``df`` with one column permuted over all its rows: the value at a place of one random order goes to the row at that place of another."""
    def draw(name: str):
        return F.xxhash64(F.lit(seed), F.lit(name), *key)

    target = gapless_rank(df.drop(column).withColumn("_h", draw("rows")), "_h", *key, out="_place").drop("_h")
    source = gapless_rank(df.select(column, draw(column).alias("_h"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]),
                          "_h", *[f"_k{i}" for i in range(len(key))], out="_place").select("_place", column)
    return target.join(source, "_place").select(*df.columns)


def permutation_importance(model, data: DataFrame, features: list[str], key: list[str], seed: int = 42) -> DataFrame:
    """Mean squared change of the forecast when one column is permuted over all rows, as shares."""
    d = cut(data.fillna(0.0, subset=features).select(*key, *features))
    base = cut(model.transform(d).select(*key, F.col("prediction").alias("p0")))
    out = None
    for f in features:
        one = model.transform(permuted(d, f, key, seed)).join(base, key).agg(
            F.avg(F.pow(F.col("prediction") - F.col("p0"), 2.0)).alias("importance")).withColumn("feature", F.lit(f))
        out = one if out is None else out.unionByName(one)
    out = cut(out)
    t = out.agg(F.sum("importance").alias("t")).scalar()
    return out.select("feature", F.when(t > 0, F.col("importance") / t).otherwise(F.col("importance")).alias("importance"))


def regime_features(bm: DataFrame, macro: DataFrame, columns: list[str], window: int = 21) -> DataFrame:
    """Market return, annualised rolling deviation and macro columns, filled forward then backward."""
    d = bm.where("bm is not null").join(macro.select("ts", *columns), "ts", "left").withColumn("_k", F.lit("m"))
    w = trailing(window, "_k")
    d = d.withColumn("realized_vol", when_full(F.stddev_samp("bm").over(w) * 252.0 ** 0.5, "bm", window, w))
    past = Window.partitionBy("_k").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_k").orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    filled = [F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(ahead)).alias(c) for c in columns]
    return d.select("ts", F.col("bm").alias("mkt_return"), "realized_vol", *filled).dropna()


def regime_mixture_fit(features: DataFrame, columns: list[str], states: int = 3, seed: int = 42, min_rows: int = 60):
    """Gaussian mixture with states in order of their mean volatility (second column). Returns
    (model, order) or (None, None) for a short series."""
    d = features.dropna(subset=columns)
    if len(d.take(min_rows)) < min_rows:
        return None, None
    va = VectorAssembler(inputCols=columns, outputCol="x")
    model = Pipeline(stages=[va, GaussianMixture(featuresCol="x", k=states, seed=seed, maxIter=100)]).fit(d)
    means = [g.mean for g in model.stages[-1].gaussians]
    at = 1 if len(columns) > 1 else 0
    return model, sorted(range(states), key=lambda k: means[k][at])


STATE_NAMES = ["prob_growth", "prob_normal", "prob_stress"]


def regime_posterior(model, order, features: DataFrame, states: int = 3) -> DataFrame:
    """Ordered state probabilities and the most likely one; uniform without a model."""
    names = STATE_NAMES if states == 3 else [f"prob_state_{i}" for i in range(states)]
    if model is None:
        return features.select("ts", *[F.lit(1.0 / states).alias(n) for n in names], F.lit(names[0]).alias("dominant_regime"))
    p = model.transform(features).withColumn("_p", vector_to_array("probability"))
    d = p.select("ts", *[F.col("_p")[k].alias(n) for k, n in zip(order, names)])
    arr = F.array(*names)
    at = F.array_position(arr, F.array_max(arr)).cast("int")
    return d.withColumn("dominant_regime", F.element_at(F.array(*[F.lit(n) for n in names]), at))


def regime_transitions(posterior: DataFrame, states: int = 3) -> DataFrame:
    """(state_from, state_to, n, probability) between consecutive dates, for every pair of states; a state that is never left has no probabilities."""
    names = STATE_NAMES if states == 3 else [f"prob_state_{i}" for i in range(states)]
    nxt = F.lead("dominant_regime").over(Window.partitionBy(F.lit(1)).orderBy("ts"))
    t = posterior.select(F.col("dominant_regime").alias("state_from"), nxt.alias("state_to")).where("state_to is not null")
    c = t.groupBy("state_from", "state_to").agg(F.count(F.lit(1)).alias("n"))
    cells = posterior.sparkSession.createDataFrame([(a, b) for a in names for b in names], "state_from string, state_to string")
    full = cells.join(c, ["state_from", "state_to"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("probability", F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("state_from")), F.lit(0)))


def regime_means(model, order, features: DataFrame, columns: list[str], states: int = 3) -> DataFrame:
    """(state, feature, fitted_mean, observed_mean, n): the mixture's means in order of volatility, and those of the dates that each state
    dominates. Without a model there are no rows."""
    schema = "state string, feature string, fitted_mean double"
    names = STATE_NAMES if states == 3 else [f"prob_state_{i}" for i in range(states)]
    spark = features.sparkSession
    rows = [] if model is None else [
        (n, c, float(model.stages[-1].gaussians[k].mean[i])) for n, k in zip(names, order) for i, c in enumerate(columns)]
    fitted = spark.createDataFrame(rows, schema)
    d = features.join(regime_posterior(model, order, features, states).select("ts", F.col("dominant_regime").alias("state")), "ts")
    seen = d.unpivot(["state"], columns, "feature", "x").groupBy("state", "feature").agg(F.avg("x").alias("observed_mean"), F.count("x").alias("n"))
    return fitted.join(seen, ["state", "feature"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
