"""Known values of single operators."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelquant.functions import dist
from panelquant.functions.adf import adf, mackinnon_p
from panelquant.functions.linear import t_two_sided
from panelquant.functions.ranking import average_rank, group_quantiles
from panelquant.operators import decisions as dc
from panelquant.operators import normalize as nz
from panelquant.operators import perftests as pt
from panelquant.operators import pit
from panelquant.operators import quality as q
from panelquant.operators import regress as rg
from panelquant.operators import returns as rt
from panelquant.operators import risk as rk
from panelquant.operators import text as tx

from .helpers import day, panel, pdf, rng, series


def test_normal_functions(spark):
    xs = [-8.0, -3.1, -1.0, -0.2, 0.0, 0.4, 1.96, 5.5]
    ps = [1e-12, 1e-4, 0.03, 0.2, 0.5, 0.77, 0.999]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(dist.norm_cdf("x").alias("v")).toPandas()["v"]
    assert np.allclose(got, [NormalDist().cdf(x) for x in xs], rtol=1e-9, atol=1e-15)
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(dist.norm_ppf("p").alias("v")).toPandas()["v"]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], rtol=1e-12)


def test_t4_and_tails(spark):
    r = spark.range(1).select(dist.t4_ppf(F.lit(0.975)).alias("t"), dist.chi2_sf_odd(F.lit(32.6706), 21).alias("c")).first()
    assert r.t == pytest.approx(2.7764451052, abs=1e-8)
    assert r.c == pytest.approx(0.05, abs=1e-5)
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert t_two_sided(2.200985160, 11) == pytest.approx(0.05, abs=1e-8)


def test_log_returns(spark):
    out = pdf(rt.log_returns(series(spark, [100, 110, 121])), "ts")["lr"]
    assert out.tolist() == pytest.approx([math.log(1.1)] * 2)
    assert out.sum() == pytest.approx(math.log(1.21))
    assert pdf(rt.log_returns(series(spark, [100, 0, 50, 75])), "ts")["lr"].tolist() == pytest.approx([math.log(1.5)])


def test_zscore_and_constant(spark):
    z = pdf(nz.zscore_normalise(series(spark, [1, 2, 3, 4, 5]), "close"), "ts")["z"]
    assert z.tolist() == pytest.approx([-1.2649110641, -0.6324555320, 0, 0.6324555320, 1.2649110641])
    assert set(pdf(nz.zscore_normalise(series(spark, [7, 7, 7]), "close"))["z"]) == {0.0}
    big = pdf(nz.zscore_normalise(series(spark, [0.0] * 30 + [1000]), "close"))["z"]
    assert big.abs().max() <= 3


def test_drawdown(spark):
    r = rk.max_drawdown(series(spark, [100, 110, 90, 60, 80, 115])).first()
    assert r.max_drawdown == pytest.approx(-50 / 110)
    assert (r.start_date, r.trough_date, r.recovery_date, r.duration_days) == (day(1), day(3), day(5), 4)


def test_cvar_not_below_var(spark):
    d = panel(spark, {"A": rng(1).normal(0, 0.02, 400), "B": rng(2).standard_t(3, 400) * 0.01})
    out = pdf(rk.value_at_risk(d))
    assert (out["cvar"] >= out["var"]).all()


def test_quality_checks(spark):
    d = spark.createDataFrame([("A", day(0), 100.0), ("A", day(0), 101.0), ("A", day(9), None)], "asset string, ts date, close double")
    assert q.dq_duplicate_dates(d).first().repeats == 1
    assert q.dq_missing(d, ["close"]).first().flag
    assert [r.gap_days for r in q.dq_timestamp_gaps(d).collect()] == [9]


def test_statement_lag(spark):
    import datetime as dt

    s = spark.createDataFrame([("A", "income_stmt", dt.date(2024, 12, 31), "Net Income", 1000.0)], "asset string, stmt string, period_end date, item string, value double")
    out = pit.pit_statements(s, ["2025-01-15", "2025-02-20"]).collect()
    assert [r.as_of for r in out] == [dt.date(2025, 2, 20)]


def test_universe(spark):
    rows = [(a, day(i), p, v) for a, p, v in (("LIQUID", 50.0, 100000), ("PENNY", 2.0, 100000), ("ILLIQUID", 50.0, 100)) for i in range(100)]
    d = spark.createDataFrame(rows, "asset string, ts date, close double, volume bigint")
    gone = spark.createDataFrame([], "asset string, delisted date")
    out = pit.investable_universe(d, gone, [day(99)], min_adv=500000.0).collect()
    assert [r.asset for r in out] == ["LIQUID"]


def test_corrections(spark):
    ps = [0.0, 0.01, 0.04, 0.06, 0.15, 0.8]
    d = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "family string, idx int, p double")
    for method, want in (("bonferroni", [0, 0.06, 0.24, 0.36, 0.9, 1]), ("bh", [0, 0.03, 0.08, 0.09, 0.18, 0.8]), ("holm", [0, 0.05, 0.16, 0.18, 0.3, 0.8])):
        got = pdf(pt.multiple_comparison(d, ["family"], method=method), "idx")["p_adjusted"]
        assert got.tolist() == pytest.approx(want), method


def test_distributed_ranks_match_pandas(spark):
    g = rng(3)
    d = pd.DataFrame({"k": g.integers(0, 3, 3000), "value": np.where(g.random(3000) < 0.3, 1.0, g.integers(0, 200, 3000) / 7.0)})
    d.loc[g.random(3000) < 0.05, "value"] = np.nan
    src = spark.createDataFrame([(i, int(k), None if v != v else float(v)) for i, (k, v) in enumerate(zip(d.k, d.value))], "i int, k int, value double")
    got = pdf(average_rank(src, ["k"]), "i")["rank"]
    assert np.allclose(got, d.groupby("k")["value"].rank(), equal_nan=True)
    qs = pdf(group_quantiles(src, ["k"], {"a": 0.01, "b": 0.5, "c": 0.99}), "k")
    want = d.groupby("k")["value"].quantile([0.01, 0.5, 0.99]).unstack()
    assert np.allclose(qs[["a", "b", "c"]], want)


def test_adf():
    g = rng(5)
    walk = g.normal(size=500).cumsum()
    assert adf(g.normal(size=500))[1] < 1e-6
    assert adf(walk)[1] > 0.05
    assert mackinnon_p(-2.86) == pytest.approx(0.05, abs=2e-3)


def test_stationarity_groups(spark):
    g = rng(6)
    out = pdf(q.dq_stationarity(panel(spark, {"noise": g.normal(size=300), "walk": g.normal(size=300).cumsum(), "short": g.normal(size=10)})), "asset")
    assert dict(zip(out.asset, out.stationary)) == {"noise": True, "short": False, "walk": False}


def test_ols_and_huber(spark):
    g = rng(7)
    n = 120
    x = g.normal(size=(n, 4))
    y = 0.01 + x @ [1.0, 0.5, -0.3, 0.0] + g.normal(size=n) * 0.1
    y_out = y.copy()
    y_out[:5] += 5
    rows = [("A", day(i), float(y[i]), *map(float, x[i])) for i in range(n)] + [("B", day(i), float(y_out[i]), *map(float, x[i])) for i in range(n)]
    d = spark.createDataFrame(rows, "asset string, month date, y double, mkt_rf double, smb double, hml double, wml double")
    o = pdf(rg.factor_loadings(d), "asset").iloc[0]
    a = np.column_stack([np.ones(n), x])
    want = np.linalg.lstsq(a, y, rcond=None)[0]
    assert np.allclose([o.alpha, o.b_mkt_rf, o.b_smb, o.b_hml, o.b_wml], want, atol=1e-9)
    s2 = ((y - a @ want) ** 2).sum() / (n - 5)
    assert o.t_b_smb == pytest.approx(want[2] / math.sqrt(s2 * np.linalg.inv(a.T @ a)[2, 2]), rel=1e-6)
    h = pdf(rg.factor_loadings_robust(d), "asset").iloc[1]
    assert abs(h.alpha - 0.01) < 0.03 < abs(pdf(rg.factor_loadings(d), "asset").iloc[1].alpha - 0.01)


def test_sentiment(spark):
    d = spark.createDataFrame([(1, "Record profit exceeded plans; board announced a share repurchase"), (2, ""), (3, "nothing here"), (4, None)], "doc_id int, text string")
    out = pdf(tx.text_sentiment(d), "doc_id")
    assert out.sentiment_score.tolist() == pytest.approx([3 / 5, 0, 0, 0])
    assert out.prob_neu.tolist() == pytest.approx([0.4, 0.34, 0.70, 0.34])
    assert pdf(tx.text_events(d), "doc_id").events.iloc[0].tolist() == ["capital_return"]


def test_ewma_matches_pandas(spark):
    x = rng(8).normal(size=900)
    out = pdf(tx.ewma(series(spark, x, col="x"), "x", 0.85, "e"), "ts")["e"]
    assert np.allclose(out, pd.Series(x).ewm(alpha=0.15).mean())


def test_kill_switch_latches(spark):
    d = spark.createDataFrame([("p", day(0), 0.01, 0.0), ("p", day(1), -0.06, -0.06), ("p", day(2), 0.05, -0.01)], "portfolio string, ts date, pnl double, drawdown double")
    assert [r.action for r in dc.kill_switch(d).orderBy("ts").collect()] == ["PROCEED", "HALT_TRADING", "HALT_TRADING_LIQUIDATE"]


def test_pre_trade(spark):
    d = spark.createDataFrame([("p", "A", 0.5), ("p", "B", 0.6)], "portfolio string, asset string, w double")
    r = dc.pre_trade_checks(d).first()
    assert not r.passed and len(r.violations) == 2


def test_deflated_sharpe_monotone(spark):
    d = spark.createDataFrame([(1.0, n, 0.04, 100, 0.0, 3.0) for n in (1, 2, 10, 100)], "sharpe double, n_trials int, variance double, n_obs int, skew double, kurtosis double")
    out = pdf(pt.deflated_sharpe(d), "n_trials")
    assert out.expected_max_sharpe.iloc[0] == 0
    assert out.dsr_probability.is_monotonic_decreasing
