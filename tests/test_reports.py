"""Findings, verdicts, validators, regimes and grids on small fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from panelquant.operators import models as ml
from panelquant.operators import normalize as nz
from panelquant.operators import perftests as pt
from panelquant.operators import pit
from panelquant.operators import predictive as pv
from panelquant.operators import scores as sc
from panelquant.operators import studies as st
from pyspark.sql import functions as F

from .helpers import day, panel, rng

PAIRS = "strategy_a string, strategy_b string, sharpe_a double, sharpe_b double, bh_p double, significant boolean"


def headline(spark, rows):
    return st.findings_headline(spark.createDataFrame(rows, PAIRS)).first()


def test_headline_without_a_significant_pair(spark):
    r = headline(spark, [("Equal Weight", "HRP", 0.5, 0.9, 0.4, False), ("HRP", "Naive Markowitz", 0.9, 0.3, 0.2, False)])
    assert (r.n_significant, r.best_method) == (0, "HRP")
    assert "HRP (Sharpe 0.90), not significantly better than Equal Weight (p=0.4000)." in r.headline


def test_headline_with_one_pair(spark):
    r = headline(spark, [("Naive Markowitz", "HRP", 0.2, 0.9, 0.01, True), ("Equal Weight", "HRP", 0.5, 0.9, 0.4, False)])
    assert r.headline == "HRP significantly outperforms Naive Markowitz (p=0.0100). No other pair differs after correction."


def test_headline_groups_by_winner(spark):
    rows = [("Naive Markowitz", "HRP", 0.2, 0.9, 0.01, True), ("HRP", "LW", 0.9, 0.4, 0.03, True), ("Equal Weight", "HRP", 0.5, 0.9, 0.4, False),
            ("LW", "Naive Markowitz", 0.4, 0.2, 0.02, True)]
    r = headline(spark, rows)
    assert r.n_significant == 3 and r.headline == (
        "HRP significantly outperforms LW (p=0.0300), Naive Markowitz (p=0.0100). LW significantly outperforms Naive Markowitz (p=0.0200). "
        "Even HRP doesn't beat Equal Weight after correction (p=0.4000).")
    beats = headline(spark, [*rows[:2], ("Equal Weight", "HRP", 0.5, 0.9, 0.02, True)])
    assert "Equal Weight (p=0.0200)" in beats.headline and "Even" not in beats.headline
    best_is_equal = headline(spark, [("Equal Weight", "HRP", 1.5, 0.9, 0.02, True), ("HRP", "LW", 0.9, 0.4, 0.03, True)])
    assert best_is_equal.best_method == "Equal Weight" and "Even" not in best_is_equal.headline


def test_track1_averages(spark):
    d = pd.DataFrame({"path_id": [0, 1], "cond_sample": [10.0, 20.0], "cond_lw": [5.0, 7.0], "turnover_sample": [0.2, 0.4], "turnover_lw": [0.2, 0.2], "turnover_hrp": [0.0, 0.1]})
    got = {(r.metric, r.arm): r.value for r in st.findings_track1(spark.createDataFrame(d)).collect()}
    assert got["cond", "sample"] == 15 and got["cond", "lw"] == 6 and got["cond_reduction_pct", ""] == pytest.approx(60)
    assert got["turnover", "hrp"] == pytest.approx(0.05) and got["lowest_turnover", "hrp"] == 1 and got["lowest_turnover", "lw"] == 0


def test_verdicts_say_why(spark):
    g = rng(3)
    n = 400
    data = {"good": g.normal(0.003, 0.008, n), "flat": g.normal(0.0, 0.01, n), "deep": np.where(np.arange(n) % 2, 0.03, 0.0)}
    data["deep"][100:160] = -0.02
    df = panel(spark, data).withColumnsRenamed({"asset": "strategy"}).withColumn("bm", F.lit(0.0))
    got = {r.strategy: r for r in pt.qualification_verdict(df, n_trials=2).collect()}
    assert got["good"].qualification_status == "PASS" and "holds after costs" in got["good"].reasons[0]
    assert got["flat"].qualification_status in ("OVERFIT", "FAILED") and got["flat"].reasons[0]
    assert got["deep"].qualification_status == "FAILED" and got["deep"].reasons[0].startswith("Largest drawdown of ")


def test_validators_find_faults(spark):
    c = spark.createDataFrame([(day(i), f"a{j}", "x", float(i * j)) for i in range(4) for j in range(6)], "ts date, asset string, characteristic string, value double")
    early = F.col("ts") < F.lit(day(2))
    overall = lambda d: d.withColumn("score", F.col("value") - d.agg(F.avg("value").alias("m")).scalar())
    assert not pit.validate_purity(overall, c.where(early), c.where(~early)).first().passed
    assert pit.validate_purity(lambda d: nz.xs_zscore(d), c.where(early), c.where(~early)).first().passed
    p = panel(spark, {"A": rng(1).normal(size=40)}, "close")
    mutate = lambda d: d.withColumn("close", F.col("close") + 1)
    ahead = lambda d: d.withColumn("z", F.col("close") - d.agg(F.avg("close").alias("m")).scalar())
    assert not pit.validate_lookahead(ahead, p, str(day(20)), mutate).first().passed
    assert pit.validate_lookahead(lambda d: d, p, str(day(20)), mutate).first().passed
    t = spark.createDataFrame([("one", "A", 1.0), ("one", "B", 2.0), ("two", "A", 1.0), ("two", "B", 2.5)], "treatment string, asset string, value double")
    assert not any(r.identical for r in pit.validate_treatment_equiv(t, ["asset"], "value").collect())
    same = t.withColumn("value", F.when(F.col("asset") == "B", 2.0).otherwise(F.col("value")))
    assert all(r.identical for r in pit.validate_treatment_equiv(same, ["asset"], "value").collect())


def test_ablation_with_a_risk_score(spark):
    wide = spark.createDataFrame([(80.0, 40.0, None, 20.0), (60.0, 60.0, 90.0, None)], "M1 double, M2 double, M3 double, risk double")
    got = {r.module: r.score_change for r in sc.module_ablation(wide, ["M1", "M2", "M3"], sc.risk_aggregator, "risk").collect()}
    pen = [1 - 0.3 * 0.8, 1 - 0.3 * 0.5]
    assert got["M1"] == pytest.approx(np.mean([abs(60 - 40) * pen[0], abs(70 - 75) * pen[1]]))
    assert got["M3"] == pytest.approx(np.mean([0, abs(70 - 60) * pen[1]]))


def test_regime_states(spark):
    g = rng(5)
    vol = np.repeat([0.1, 0.3, 0.9], 60)
    rows = [(day(i), float(g.normal(0, v / 10)), float(v + g.normal(0, 0.01)), 1.0) for i, v in enumerate(vol)]
    f = spark.createDataFrame(rows, "ts date, mkt_return double, realized_vol double, spread double")
    fit = ml.regime_mixture_fit(f, ["mkt_return", "realized_vol"])
    post = ml.regime_posterior(*fit, f)
    t = {(r.state_from, r.state_to): (r.n, r.probability) for r in ml.regime_transitions(post).collect()}
    assert len(t) == 9 and sum(n for n, _ in t.values()) == 179
    a, b, c = ml.STATE_NAMES
    assert t[a, b] == (1, pytest.approx(1 / 60)) and t[a, c] == (0, 0.0) and t[c, a] == (0, 0.0) and t[c, c] == (59, 1.0)
    means = {(r.state, r.feature): r for r in ml.regime_means(*fit, f, ["mkt_return", "realized_vol"]).collect()}
    for state, v in zip(ml.STATE_NAMES, (0.1, 0.3, 0.9), strict=True):
        m = means[state, "realized_vol"]
        assert m.fitted_mean == pytest.approx(v, abs=0.01) and m.observed_mean == pytest.approx(v, abs=0.01) and m.n == 60
    assert ml.regime_means(None, None, f, ["realized_vol"]).count() == 0
    one = ml.regime_transitions(post.where(F.col("dominant_regime") == a))
    assert one.where("probability is null").count() == 6


def test_predictive_robustness_of_each_factor(spark):
    r2 = spark.createDataFrame([(t, f, x) for t, f, x in (("cross_sectional_zscore", "a", 0.1), ("rank", "a", 0.3), ("cross_sectional_zscore", "b", 0.2), ("rank", "b", 0.1))],
                               "treatment string, factor string, r2 double")
    got = {(r.treatment, r.factor): r.delta_from_baseline for r in pv.predictive_robustness(r2).collect()}
    assert got["rank", "a"] == pytest.approx(0.2) and got["rank", "b"] == pytest.approx(-0.1)


@pytest.mark.parametrize("pace", ["weekly", "daily"])
def test_grids_pick_the_row_that_holds(spark, pace):
    rows = [("A", dt.date(2020, 1, 2), 1.0), ("A", dt.date(2020, 1, 15), 2.0), ("A", dt.date(2020, 1, 16), 3.0), ("B", dt.date(2019, 12, 1), 4.0), ("C", dt.date(2020, 3, 1), 5.0)]
    df = spark.createDataFrame(rows, "asset string, ts date, v double")
    first, last = dt.date(2020, 1, 1), dt.date(2020, 2, 11)
    all_days = [first + dt.timedelta(i) for i in range((last - first).days + 1)]
    grid = [d for d in all_days if (d.weekday() == 0 if pace == "weekly" else d.weekday() < 5)]
    got = {(r.asset, r.as_of): r.v for r in pit.valid_at(df, pit.Grid(first, last, pace)).collect()}
    by_list = {(r.asset, r.as_of): r.v for r in pit.valid_at(df, grid).collect()}
    assert got == by_list and len(got) > 9
