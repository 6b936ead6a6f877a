"""Portfolio paths, Newey-West lags and dates taken from the data, against plain loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelquant.operators import backtest as bt
from panelquant.operators import predictive as pv
from panelquant.plans import QUERIES


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_sparse_targets_against_a_day_loop(spark):
    rng = random.Random(3)
    days, assets = 30, "ABC"
    rets = {(day(d), a): rng.uniform(-0.05, 0.06) for d in range(days) for a in assets}
    del rets[day(10), "B"]  # no bar on a rebalance date
    del rets[day(14), "A"]
    targets = {day(0): {"A": 0.5, "B": 0.5}, day(10): {"A": 1.0}, day(20): {"B": 0.3, "C": 0.7}}  # B goes and comes back
    t = spark.createDataFrame([("p", d, a, w) for d, ws in targets.items() for a, w in ws.items()], "pf string, ts date, asset string, w double")
    r = spark.createDataFrame([(d, a, x) for (d, a), x in rets.items()], "ts date, asset string, r double")
    liq = spark.createDataFrame([(day(d), a, 2e6 + d, 0.02) for d in (0, 9, 15) for a in assets], "ts date, asset string, adv double, vol double")

    value, want, turnover, trades = {}, [], {}, {}
    for n in range(days):
        if day(n) in targets:
            total = sum(value.values()) or 1.0
            drift = {a: v / total for a, v in value.items()}
            ws = targets[day(n)]
            trades[day(n)] = {a: ws.get(a, 0.0) - drift.get(a, 0.0) for a in sorted({*ws, *drift})}
            turnover[day(n)] = sum(map(abs, trades[day(n)].values())) / 2
            value = dict(ws)
        before = sum(value.values())
        value = {a: v * (1 + rets.get((day(n), a), 0.0)) for a, v in value.items()}
        want.append(sum(value.values()) / before - 1)
    plan, growth = bt.holding_growth(bt.normalise_targets(t, ["pf"]), r, ["pf"])
    got = {(x.period, x.asset): x.dw for x in bt.rebalance_trades(plan, growth, ["pf"]).collect()}
    assert got == pytest.approx({(d, a): w for d, ws in trades.items() for a, w in ws.items()})
    path = sorted(bt.portfolio_path(t, r, liq, ["pf"]).collect(), key=lambda x: x.ts)
    assert [x.ts for x in path] == [day(n) for n in range(days)]
    assert [x.r_gross for x in path] == pytest.approx(want)
    # liquidity of day 9 serves the rebalance of day 10, that of day 15 the one of day 20
    adv = {day(0): 2e6, day(10): 2e6 + 9, day(20): 2e6 + 15}
    aum, impact = 1e7, {}
    for n in range(days):
        if day(n) in trades:
            impact[day(n)] = 0.0
            for a, w in sorted(trades[day(n)].items()):
                q = abs(w) * aum
                one = spark.createDataFrame([(q, adv[day(n)], 0.02)], "q double, adv double, vol double").select(bt.impact_bps(F.col("q"), F.col("adv"), F.col("vol"))).first()[0]
                impact[day(n)] += q * one / 10000
                aum -= q * 5.0 / 10000 + q * one / 10000
        aum *= 1 + want[n]
    assert path[-1].value == pytest.approx(aum)


def newey_west(values, length):
    y = [v for v in values if v is not None]
    mean, lags = sum(y) / len(y), int(4 * (length / 100) ** (2 / 9))
    u = [v - mean for v in y]
    total = sum(a * a for a in u) + sum(2 * (1 - k / (lags + 1)) * sum(a * b for a, b in zip(u[k:], u)) for k in range(1, lags + 1))
    return lags, mean, math.sqrt(max(0.0, total)) / len(y)


@pytest.mark.parametrize("length", [25_000, 300, 3])
def test_newey_west_lags_follow_the_data(spark, length):
    rng, x, values = random.Random(length), 0.0, []
    for n in range(length):
        x = 0.6 * x + rng.gauss(0, 1)
        values.append(None if n % 17 == 5 else x)
    rows = spark.createDataFrame([("t", "f", day(n), v) for n, v in enumerate(values)], "treatment string, factor string, ts date, coef double")
    lags, mean, se = newey_west(values, length)
    assert (lags > 12) == (length == 25_000)
    got = pv.newey_west_se(rows).first()
    assert got.mean_coeff == pytest.approx(mean) and got.nw_se == pytest.approx(se)


def test_years_come_from_the_data(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    trades = spark.read.parquet(f"{sf}/lineitem.parquet")
    later = trades.limit(50).withColumn("l_shipdate", F.lit("2003-03-03").cast(trades.schema["l_shipdate"].dataType))
    trades.union(later).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{sf}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["pit_price_history"](spark, str(tmp_path))
    assert got.where("as_of = '2003-12-31' and ts = '2003-03-03'").count() > 0
    assert QUERIES["align_business_days"](spark, str(tmp_path)).agg(F.max("ts")).first()[0] == "2003-12-31"


def test_scores_do_not_see_later_statements(spark):
    from panelquant.operators import fundamentals as fd

    prices = spark.createDataFrame([("A", dt.date(2001, 3, 1), 1.0)], "asset string, ts date, close double")
    rows = [("A", "income_stmt", d, "Net Income", v) for d, v in ((dt.date(2000, 12, 31), 1.0), (dt.date(2001, 1, 15), 2.0), (dt.date(2001, 1, 16), 3.0))]
    s = spark.createDataFrame(rows, "asset string, stmt string, period_end date, item string, value double")
    assert sorted(r.value for r in fd.published(s, prices).collect()) == [1.0, 2.0]  # public 45 days after the period
