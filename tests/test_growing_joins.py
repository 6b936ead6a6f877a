"""Tables that explode or joins make large: never broadcast, and dealt to tasks by their rows."""

import numpy as np
from pyspark.sql import functions as F

from panelquant.functions import columns
from panelquant.operators import allocation as al
from panelquant.operators import backtest as bt
from panelquant.operators import perftests as pt
from panelquant.operators import risk as rk
from panelquant.sources.panels import Panels

from .helpers import day


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _exploded(spark):
    """Two assets of 40 candidates at three dates, as a few rows that explode."""
    dates = F.array(*[F.lit(day(i)) for i in (0, 2, 4)])
    w = spark.range(80).select(F.floor(F.col("id") / 2).alias("candidate"), F.concat(F.lit("A"), F.col("id") % 2).alias("asset"), F.lit(0.5).alias("w"))
    return w.withColumn("ts", F.explode(dates))


def _returns(spark, n=6):
    return spark.createDataFrame([(f"A{a}", day(i), 0.01 * (i + a) - 0.02) for i in range(n) for a in range(2)], "asset string, ts date, r double")


def test_targets_are_not_broadcast(spark):
    t = bt.normalise_targets(_exploded(spark), ["candidate"])
    assert "BroadcastHashJoin" not in _plan(t)
    plan, growth = bt.holding_growth(t, _returns(spark), ["candidate"])
    assert plan.count() == 240
    liquidity = spark.createDataFrame([("A0", day(1), 2e6, 0.1)], "asset string, ts date, adv double, vol double")
    got = bt.portfolio_path(_exploded(spark), _returns(spark), liquidity, ["candidate"]).toPandas()
    assert len(got) == 240 and set(got.groupby("candidate").size()) == {6}
    one = got[got.candidate == 0].sort_values("ts")
    r = _returns(spark).toPandas().pivot(index="ts", columns="asset", values="r").to_numpy()
    gross = []
    for i in range(0, 6, 2):
        value = (np.cumprod(1 + r[i:i + 2], axis=0) * 0.5).sum(1)
        gross += [value[0] - 1, value[1] / value[0] - 1]
    assert np.allclose(one.r_gross, gross)


def test_candidates_are_not_broadcast(spark):
    w = _exploded(spark).withColumnRenamed("ts", "path_id")
    cov = spark.createDataFrame([(day(i), a, b, v) for i in (0, 2, 4) for a, b, v in (("A0", "A0", 0.04), ("A0", "A1", 0.0), ("A1", "A1", 0.04))],
                                "path_id date, a string, b string, value double")
    mu = spark.createDataFrame([(day(i), a, 0.1) for i in (0, 2, 4) for a in ("A0", "A1")], "path_id date, asset string, mu double")
    d = al.candidate_portfolio_scoring(w, mu, cov, max_weight=0.6, keys=["path_id"])
    for line in _plan(d).splitlines():  # the matrices and means may be; what has candidates may not
        assert "BroadcastHashJoin" not in line or "candidate" not in line
    got = d.toPandas()
    assert len(got) == 120 and np.allclose(got.expected_volatility, 0.02 ** 0.5) and set(got[got.best].candidate) == {0}


def test_resamples_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in _plan(pt.stationary_bootstrap(_returns(spark), 10))


def test_tasks_follow_the_rows_that_a_join_makes(spark, monkeypatch):
    monkeypatch.setattr(columns, "GROWN_ROWS", 1000)
    w = _exploded(spark).select("candidate", "asset", "w").distinct()
    assert columns.spread(w, "candidate", growth=300).rdd.getNumPartitions() == 24
    got = rk.joint_tail_risk(_returns(spark, 300), w).toPandas()
    path = _returns(spark, 300).groupBy("ts").agg(F.avg("r").alias("r")).toPandas()["r"]
    q = path.quantile(0.01)
    assert len(got) == 40 and np.allclose(got.var_99, -q) and np.allclose(got.cvar_99, max(-q, -path[path <= q].mean()))


def test_parts_and_customers_are_not_broadcast(spark):
    p = Panels(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in _plan(p.trades())
    assert p.trades().count() == p.table("lineitem").count()
