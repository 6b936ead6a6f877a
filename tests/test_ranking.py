"""Ranks and quantiles of groups of very different sizes."""

import numpy as np
from pyspark.sql import functions as F

from panelquant.functions.ranking import average_rank, group_quantiles, value_ladder
from panelquant.operators import normalize as nz
from panelquant.streaming.kill_switch import write_audit_batch


def test_large_and_small_groups(spark):
    n = 60_000
    x = F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.pmod(F.hash("id"), F.lit(1 << 30)).cast("double"))  # half of all rows hold one value
    big = spark.range(n).select(F.lit("big").alias("g"), x.alias("value"))
    small = spark.createDataFrame([("small", v) for v in (3.0, 1.0, 1.0, None)], "g string, value double")
    df = big.union(small)
    for per_bucket in (500, 20_000):
        from panelquant.functions.ranking import value_ladder
        ladder = value_ladder(df, ["g"], per_bucket=per_bucket)
        got = average_rank(df, ["g"], ladder=ladder).toPandas()
        for _, part in got.groupby("g"):
            want = part["value"].rank(method="average")
            assert np.allclose(part["rank"], want, equal_nan=True)
        q = {r.g: (r.lo, r.mid) for r in group_quantiles(df, ["g"], {"lo": 0.1, "mid": 0.75}, ladder=ladder).collect()}
        for g, part in got.groupby("g"):
            assert np.allclose(q[g], part["value"].dropna().quantile([0.1, 0.75]))


def test_cut_points_are_estimated_once(spark):
    """Both readers of the cut points must see the same ones, in whatever order partial estimates arrive."""
    df = spark.range(0, 200_000, 1, 16).select(F.lit("g").alias("g"), F.pmod(F.hash("id"), F.lit(1 << 30)).cast("double").alias("value"))
    ladder = value_ladder(df, ["g"], per_bucket=1000)
    assert "percentile_approx" not in ladder._jdf.queryExecution().optimizedPlan().toString()
    got = average_rank(df, ["g"], ladder=ladder).toPandas()
    assert np.array_equal(got["rank"], got["value"].rank(method="average"))


def test_ladder_counts_and_places_values_once(spark):
    """Hundreds of buckets in the order of the values; what is joined and sorted comes from stored buckets, not from the rows again."""
    df = spark.range(0, 100_000, 1, 8).select(F.lit("g").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(100_003)) - 50_000).cast("double").alias("value"))
    ladder = value_ladder(df, ["g"], per_bucket=250)
    assert "Range (" not in ladder._jdf.queryExecution().executedPlan().toString()
    got = ladder.toPandas().sort_values("value")
    assert np.array_equal(got["before"], np.arange(100_000)) and (got["n"] == 100_000).all()
    assert got["_b"].is_monotonic_increasing and got["_b"].nunique() > 256 and got["_b"].value_counts().max() < 2000


def test_stacked_treatments_score_each_value_once(spark):
    """Same scores as the treatments one by one, for ties, empty values, a constant cross-section and a lone row; the rows are read and joined once."""
    x = (F.when(F.col("id") % 4 == 0, F.pmod(F.hash("id"), F.lit(40)) * 0.1).when(F.col("id") % 4 == 1, F.when(F.col("id") % 3 > 0, F.rand(1) + 1e6))
         .when(F.col("id") % 4 == 2, F.lit(0.1)).when(F.col("id") == 3, F.lit(5.0)))
    group = F.when((F.col("id") % 4 == 3) & (F.col("id") > 3), F.lit("empty")).otherwise(F.concat(F.lit("g"), F.col("id") % 4))
    df = spark.range(0, 2000, 1, 4).select(F.lit("2020-01-31").cast("date").alias("ts"), F.col("id").alias("asset"), group.alias("characteristic"), x.alias("value"))
    out = nz.apply_normalization(df, list(nz.TREATMENTS))
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    got = out.toPandas().pivot(index="asset", columns="treatment", values="score")
    assert len(got) == 2000
    for name in nz.TREATMENTS:
        want = nz.apply_normalization(df, name).toPandas().set_index("asset")["score"].reindex(got.index)
        assert np.allclose(got[name], want, rtol=1e-6, atol=1e-9, equal_nan=True), name
    assert (got["cross_sectional_zscore"][2::4] == 0).all()
    rounded = nz.apply_normalization(df, list(nz.TREATMENTS), digits=2).toPandas().pivot(index="asset", columns="treatment", values="score")
    assert np.allclose(rounded, got, atol=0.00500001, equal_nan=True) and np.allclose(rounded, rounded.round(2), atol=1e-12, equal_nan=True)


def test_replayed_audit_batch(spark, tmp_path):
    d = spark.createDataFrame([("a", 0.5, 0.2), ("b", 0.1, 0.4)], "asset string, target_weight double, previous_weight double")
    for batch in (0, 1, 1):
        write_audit_batch(d, batch, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 4
