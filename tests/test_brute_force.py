"""Operators without portable SQL, against direct computation on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelquant.operators import allocation as al
from panelquant.operators import backtest as bt
from panelquant.operators import crossval as cv
from panelquant.operators import pairs as pr
from panelquant.operators import perftests as pt
from panelquant.operators import risk as rk
from panelquant.functions.gram import pair_moments

from .helpers import day, panel, pdf, rng


def returns(spark, n=120, k=5, seed=0):
    x = rng(seed).normal(0.001, 0.02, size=(n, k)) + rng(seed + 1).normal(0, 0.01, size=(n, 1))
    names = [f"A{i}" for i in range(k)]
    return x, names, panel(spark, {a: x[:, i] for i, a in enumerate(names)})


@pytest.mark.parametrize("blocks", [1, 3])
def test_pair_moments_blocks(spark, blocks):
    x, names, d = returns(spark)
    out = pdf(pair_moments(d, [], F.month("ts"), blocks=blocks), "a", "b")
    assert len(out) == 15 and (out.n == 120).all()
    for r in out.itertuples():
        i, j = names.index(r.a), names.index(r.b)
        assert r.sab == pytest.approx(float(x[:, i] @ x[:, j]), rel=1e-10)
        assert r.sa == pytest.approx(x[:, i].sum(), abs=1e-10) and r.sbb == pytest.approx((x[:, j] ** 2).sum())


def dense(out, col="value"):
    n = sorted(set(out.a) | set(out.b))
    m = np.zeros((len(n), len(n)))
    for r in out.to_dict("records"):
        i, j = n.index(r["a"]), n.index(r["b"])
        m[i, j] = m[j, i] = r[col]
    return m


def test_ledoit_wolf(spark):
    x, _, d = returns(spark)
    got = dense(pdf(al.covariance(d, F.month("ts"), "ledoit_wolf")))
    c = x - x.mean(0)
    n, p = c.shape
    emp = c.T @ c / n
    mu = np.trace(emp) / p
    delta_ = ((c.T @ c) ** 2).sum() / n**2
    beta = (((c**2).T @ (c**2)).sum() / n - delta_) / (p * n)
    delta = (delta_ - 2 * mu * np.trace(emp) + p * mu**2) / p
    s = min(beta, delta) / delta
    assert np.allclose(got, ((1 - s) * emp + s * mu * np.eye(p)) * 252)


def test_matrix_diagnostics(spark):
    m = np.diag([4.0, 1.0, 1.0])
    rows = [("g", i, j, float(m[i, j])) for i in range(3) for j in range(i, 3)] + [("z", 0, 0, 0.0), ("z", 0, 1, 0.0), ("z", 1, 1, 0.0)]
    d = spark.createDataFrame(rows, "g string, a int, b int, value double")
    assert pdf(rk.condition_number(d, "g"), "g").condition_number.iloc[0] == pytest.approx(4)
    p = np.array([4, 1, 1]) / 6
    er = pdf(rk.effective_rank(d, "g"), "g").effective_rank
    assert er.tolist() == pytest.approx([math.exp(-(p * np.log(p)).sum()), 0.0])
    assert pdf(rk.participation_ratio(d, "g"), "g").participation_ratio.tolist() == pytest.approx([36 / 18, 0.0])


def test_black_litterman(spark):
    rows = [("g", f"A{i}", f"A{j}", 0.04 if i == j else 0.0) for i in range(3) for j in range(i, 3)]
    cov = spark.createDataFrame(rows, "g string, a string, b string, value double")
    views = spark.createDataFrame([("g", "A0", 0.18, None), ("g", "A1", 0.10, None), ("g", "A2", 0.05, None)], "g string, asset string, q double, w_mkt double")
    out = pdf(al.black_litterman(cov, views, "g"), "asset")
    s = np.eye(3) * 0.04
    pi, ts = 2.5 * s @ np.full(3, 1 / 3), 0.05 * s
    om = np.diag(np.diag(ts)) / 0.5
    want = np.linalg.inv(np.linalg.inv(ts) + np.linalg.inv(om)) @ (np.linalg.inv(ts) @ pi + np.linalg.inv(om) @ np.array([0.18, 0.10, 0.05]))
    assert np.allclose(out.mu, want) and out.mu.is_monotonic_decreasing


def test_hrp(spark):
    _, _, d = returns(spark)
    m = al.centred_moments(d.withColumn("g", F.lit("g")), ["g"], F.month("ts"))
    w = pdf(al.hrp_weights(al.sample_covariance(m, ["g"]), rk.correlation(m, ["g"]), "g"))
    assert w.w.sum() == pytest.approx(1) and (w.w > 0).all()
    two = spark.createDataFrame([("g", "A", "A", 1.0, 1.0), ("g", "A", "B", 0.0, 0.0), ("g", "B", "B", 3.0, 1.0)], "g string, a string, b string, value double, corr double")
    w = pdf(al.hrp_weights(two.drop("corr"), two.drop("value"), "g"), "asset").w
    assert w.tolist() == pytest.approx([0.75, 0.25])


def test_scan_pairs_equals_pairwise(spark):
    g = rng(9)
    base = g.normal(size=400).cumsum() + 50
    data = {"X": base, "Y": 2 * base + g.normal(size=400), "Z": g.normal(size=400).cumsum() + 80, "W": g.normal(size=400).cumsum() + 60}
    d = panel(spark, data, "close")
    out = pdf(pr.scan_pairs(d, only_cointegrated=False), "asset_a", "asset_b")
    assert len(out) == 6
    rows = [(f"{a}{b}", day(i), float(data[a][i]), float(data[b][i])) for a in data for b in data if a < b for i in range(400)]
    one = pdf(pr.cointegration(spark.createDataFrame(rows, "pair string, ts date, a double, b double")), "pair")
    assert np.allclose(out.p_value, one.p_value)
    hit = out[(out.asset_a == "X") & (out.asset_b == "Y")].iloc[0]
    assert hit.cointegrated and hit.hedge_ratio_beta == pytest.approx(0.5, abs=0.02)


def test_portfolio_path_equals_day_loop(spark):
    x, names, d = returns(spark, n=60, k=3, seed=4)
    reb = [0, 20, 41]
    target = {0: [0.5, 0.3, 0.2], 20: [0.2, 0.2, 0.6], 41: [0.1, 0.8, 0.1]}
    rows = [("p", day(t), names[i], target[t][i]) for t in reb for i in range(3)]
    t = spark.createDataFrame(rows, "portfolio string, ts date, asset string, w double")
    liq = spark.createDataFrame([(a, day(i), 2e6 * (j + 1), 0.02) for j, a in enumerate(names) for i in range(60)], "asset string, ts date, adv double, vol double")
    out = pdf(bt.portfolio_path(t, d, liq, ["portfolio"], capital=1e6), "ts")
    aum, w, values, cost = 1e6, np.zeros(3), [], 0.0
    for i in range(60):
        if i in target:
            new = np.array(target[i])
            for j in range(3):
                trade = abs(new[j] - w[j]) * aum
                c = trade * (5 + 0.3 * 0.02 * math.sqrt(min(trade / (2e6 * (j + 1)), 1)) * 1e4) / 1e4 if trade else 0
                aum -= c
                cost += c
            w = new
        r = float(w @ x[i])
        aum *= 1 + r
        values.append(aum)
        w = w * (1 + x[i]) / (1 + r)
    assert np.allclose(out.value, values, rtol=1e-10)
    assert out.cost.sum() == pytest.approx(cost)


def test_purge_and_embargo(spark):
    idx = pd.bdate_range("2020-01-02", "2020-06-30").append(pd.bdate_range("2020-07-23", "2020-12-31"))
    d = spark.createDataFrame([(t.date(),) for t in idx], "ts date")
    out = pdf(cv.purged_cv_splits(d, 6, horizon_days=10, embargo_days=5, combinatorial=True), "path_id", "ts")
    assert out.path_id.nunique() == 15 and len(out) == 15 * len(idx)
    for _, g in out.groupby("path_id"):
        test = [t for t, r in zip(g.ts, g.role) if r == "test"]
        for t, r in zip(g.ts, g.role):
            if r == "train":
                assert not any(0 <= (s - t).days <= 10 for s in test)
    few = cv.purged_cv_splits(d.limit(15)).groupBy("role").count().toPandas()
    assert dict(zip(few.role, few["count"])) == {"train": 15, "test": 15}


def test_tests_on_identical_series(spark):
    x = rng(11).normal(0.001, 0.01, 300)
    d = panel(spark, {"A": x, "B": x, "C": x + 0.01})
    j = pdf(pt.jobson_korkie_memmel(d, F.month("ts")), "strategy_a", "strategy_b")
    assert j.p_value.iloc[0] == 1.0 and j.p_value.iloc[1] < 0.01
    b = pdf(pt.bootstrap_sharpe_diff(d, 100), "strategy_a", "strategy_b")
    assert b.p_value.iloc[0] == 1.0 and b.p_value.iloc[1] < 0.05


def test_bootstrap_index_is_stationary(spark):
    one = spark.createDataFrame([(500,)], "n bigint")
    idx = pdf(pt.bootstrap_index(F.col("n"), one, 20, 10.0), "rep", "pos")
    assert len(idx) == 10000 and idx.src.between(0, 499).all()
    step = ((idx.src.diff() % 500) == 1)[idx.pos > 0].mean()
    assert 0.85 < step < 0.95
