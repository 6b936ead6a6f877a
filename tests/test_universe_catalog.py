"""A universe that changes, registered sources, the cost fold and the statement store, against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from panelquant.functions import linear, ranking
from panelquant.functions.columns import safe_corr
from panelquant.operators import backtest as bt
from panelquant.operators import fundamentals as fd
from panelquant.operators import models, perftests, pit, predictive, quality, regress, returns, risk, scores
from panelquant.operators import universe as un
from panelquant.sources import catalog
from panelquant.sources.files import scratch
from pyspark.sql import functions as F

from .helpers import day, panel, pdf, rng


def sparse(spark, spans, seed=1, share=0.6, level=0.0, n=200):
    """Bars of assets with (first, last) positions; some dates have no bar, first and last always have one."""
    g = rng(seed)
    rows = []
    for a, (lo, hi) in spans.items():
        for i in range(lo, hi + 1):
            if i in (lo, hi) or g.random() < share:
                rows.append((a, day(i), float(level + g.normal())))
    return rows, spark.createDataFrame(rows, "asset string, ts date, r double")


SPANS = {"A": (0, 199), "B": (0, 199), "LATE": (60, 199), "GONE": (0, 120), "BRIEF": (80, 110)}


def filled(rows):
    dates = sorted({t for _, t, _ in rows})
    held = {(a, t): r for a, t, r in rows}
    out = {}
    for a in {a for a, _, _ in rows}:
        own = [t for x, t, _ in rows if x == a]
        out[a] = {t: held.get((a, t), 0.0) for t in dates if min(own) <= t <= max(own)}
    return dates, out


@pytest.mark.parametrize("blocks", [1, 3])
def test_dated_covariance(spark, blocks):
    rows, df = sparse(spark, SPANS)
    got = {(r.a, r.b): r for r in un.dated_covariance(df, F.month("ts"), blocks=blocks).collect()}
    _, full = filled(rows)
    assert len(got) == 15
    for (a, b), r in got.items():
        both = sorted(full[a].keys() & full[b].keys())
        x, y = [full[a][t] for t in both], [full[b][t] for t in both]
        assert r.n == len(both)
        assert r.value == pytest.approx(np.cov(x, y)[0, 1] * 252, rel=1e-9)
        assert r.corr == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-9)


def test_dated_covariance_of_a_high_level(spark):
    g = rng(4)
    data = {a: 1e6 + g.normal(size=300) for a in "ABC"}
    got = un.dated_covariance(panel(spark, data), F.month("ts"), periods=1.0)
    for r in got.collect():
        assert r.value == pytest.approx(np.cov(data[r.a] - 1e6, data[r.b] - 1e6)[0, 1], abs=1e-8)


def test_pairs_never_listed_together(spark):
    _, df = sparse(spark, {"A": (0, 50), "B": (60, 120)})
    assert {(r.a, r.b) for r in un.dated_covariance(df, F.month("ts")).collect()} == {("A", "A"), ("B", "B")}


def test_segments_and_delistings(spark):
    rows, df = sparse(spark, SPANS)
    gone = spark.createDataFrame([("B", day(150)), ("A", day(500))], "asset string, delisted date")
    kept = [(a, t, r) for a, t, r in rows if a != "B" or t <= day(150)]
    dates, full = filled(kept)
    want, last = [], None
    for t in dates:
        members = frozenset(a for a in full if t in full[a])
        if members != last:
            want.append([t, t, 0, len(members)])
        last = members
        want[-1][1], want[-1][2] = t, want[-1][2] + 1
    got = pdf(un.universe_segments(df, gone), "segment")
    assert got[["first_date", "last_date", "n_dates", "n_assets"]].values.tolist() == want
    assert got.segment.tolist() == list(range(len(want)))


def test_dated_bootstrap_stays_in_segments(spark):
    """Each bar names its segment in its value, so a resample from elsewhere would show in the mean."""
    rows, df = sparse(spark, SPANS, share=1.0)
    dates = {r.ts: r.segment for r in un.segment_dates(df, un.listing(df)).collect()}
    tagged = df.join(spark.createDataFrame(list(dates.items()), "ts date, s int"), "ts").select("asset", "ts", F.pow(F.lit(1000.0), "s").alias("r"))
    got = un.dated_bootstrap(tagged, replicates=5)
    sizes = pd.Series(dates).value_counts()
    for r in got.collect():
        own = sorted({dates[t] for a, t, _ in rows if a == r.asset})
        assert r.n == sum(sizes[s] for s in own)
        assert r["mean"] * r.n == pytest.approx(sum(sizes[s] * 1000.0 ** s for s in own), rel=1e-9)
    moments = un.dated_bootstrap(df, replicates=300).groupBy("asset").agg(F.avg("mean").alias("m"), F.avg("std").alias("s")).collect()
    for r in moments:
        own = [x for a, _, x in rows if a == r.asset]
        assert r.m == pytest.approx(np.mean(own), abs=0.12) and r.s == pytest.approx(np.std(own), rel=0.15)


def test_dated_backtest_sells_what_is_delisted(spark):
    g = rng(2)
    n, cut_at = 500, 430
    data = {"A": g.normal(0.001, 0.01, n), "B": g.normal(0.001, 0.01, cut_at), "NEW": g.normal(0.001, 0.01, n)}
    rows = [(a, day(i), float(x)) for a, v in data.items() for i, x in enumerate(v) if a != "NEW" or i >= 405]
    df = spark.createDataFrame(rows, "asset string, ts date, r double")
    folds = spark.createDataFrame([(0, day(i), "train" if i < 400 else "test") for i in range(n)], "fold long, ts date, role string")
    bm = spark.createDataFrame([(day(i), 0.0) for i in range(n)], "ts date, bm double")
    score = lambda t: t.groupBy("fold", "asset").agg(F.lit(1.0).alias("score"))
    (got,) = un.dated_backtest(df, folds, score, bm).collect()
    ends = [max(i for i in range(400, n) if day(i).month == m and day(i).year == y) for y, m in sorted({(day(i).year, day(i).month) for i in range(400, n)})]
    starts = sorted({400, *ends})
    wealth, weights = 1.0, {}
    for i in range(400, n):
        if i in starts:
            live = [a for a in "AB" if a == "A" or i < cut_at]  # NEW wasn't listed when the fold began
            weights = {a: wealth / len(live) for a in live}
        for a in weights:
            weights[a] *= 1 + (data[a][i] if i < len(data[a]) else 0.0)
        wealth = sum(weights.values())
    assert got.n == 100 and got.total_return == pytest.approx(wealth - 1, rel=1e-9)


def test_catalog_versions(spark):
    store = catalog.Catalog(spark, scratch(spark, "catalog"))
    assert store.manifest().count() == 0
    one = spark.createDataFrame([(" aa ", day(1), 1.0), ("aa", day(2), 2.0), ("bb", day(1), 3.0)], "asset string, ts date, close double")
    two = spark.createDataFrame([("AA", day(2), 2.5), ("AA", day(3), None)], "asset string, ts date, close double")
    check = lambda d: quality.source_quality(d, ["asset"], "ts", ["close"], 5)
    assert store.load("prices", one, lag_days=2, check=check) == 1
    assert store.append("prices", two, check) == 2
    assert store.load("macro", one.withColumnRenamed("asset", "series"), "series") == 1
    rows = lambda d: sorted((r.asset, r.ts, r.close) for r in d.collect())
    old = [("AA", day(1), 1.0), ("AA", day(2), 2.0), ("BB", day(1), 3.0)]
    assert rows(store.read("prices", 1)) == rows(store.read("prices", 1, ["asset", "ts"])) == old
    assert rows(store.read("prices", keys=["asset", "ts"])) == [("AA", day(1), 1.0), ("AA", day(2), 2.5), ("AA", day(3), None), ("BB", day(1), 3.0)]
    assert store.read("prices").count() == 5
    assert rows(store.known("prices", day(3), 1)) == [("AA", day(1), 1.0), ("BB", day(1), 3.0)]
    found = {(r.version, r["check"]): r.value for r in store.quality("prices").collect()}
    assert found[1, "n_rows"] == 3 and found[2, "missing"] == 1 and found[1, "passed"] == 1
    extent = {(r.source, r.version): (r.kind, r.n_rows, r.n_entities, r.first_date, r.last_date) for r in store.manifest().collect()}
    assert extent["prices", 2] == ("append", 2, 1, day(2), day(3)) and len(extent) == 3
    assert store.load("prices", two, lag_days=2) == 3 and rows(store.read("prices", 1)) == old
    assert store.read("prices").count() == 2
    with pytest.raises(ValueError):
        store.read("prices", 9)
    with pytest.raises(ValueError):
        store.append("news", two)
    with pytest.raises(ValueError):
        store.append("prices", two.withColumn("more", F.lit(1)))


def test_source_quality(spark):
    rows = [("A", day(0), 1.0), ("A", day(0), None), ("A", day(9), 1.0), ("B", day(1), 2.0), ("B", day(5), 2.0)]
    df = spark.createDataFrame(rows, "asset string, ts date, v double")
    assert quality.source_quality(df, ["asset"], "ts", ["v"], 5).first().asDict() == {"n_rows": 5, "missing": 1, "repeated": 1, "gaps": 1, "passed": 0}
    assert quality.source_quality(df.limit(0), ["asset"], "ts", ["v"]).first().asDict() == {"n_rows": 0, "missing": 0, "repeated": 0, "gaps": 0, "passed": 1}


def fold_by_hand(trades, capital=1e7, linear=5.0):
    out = {}
    for key in sorted({t[0] for t in trades}):
        wealth, grown = capital, None
        for period in sorted({t[1] for t in trades if t[0] == key}):
            of = sorted(t for t in trades if t[0] == key and t[1] == period)
            wealth = wealth * grown if grown is not None else wealth
            cost = impact = 0.0
            for _, _, _, dw, adv, vol, growth in of:
                size = abs(dw) * wealth
                hit = size * 0.3 * vol * math.sqrt(min(size / max(adv, 1e4), 1.0))
                paid = size * linear / 1e4 + hit
                wealth, cost, impact, grown = wealth - paid, cost + paid, impact + hit, growth
            out[key, period] = (wealth, cost, impact, sum(abs(t[3]) for t in of) / 2)
    return out


def test_cost_fold(spark):
    g = random.Random(1)
    trades = [(k, day(30 * m), f"a{i}", g.uniform(-0.2, 0.2) * (i > 0), g.uniform(0, 1e8), g.uniform(0, 0.05), 0.9 + 0.05 * m + 0.01 * k)
              for k in range(7) for m in range(5) for i in range(9) if (k, m) != (2, 1)]
    df = spark.createDataFrame(trades, "portfolio long, period date, asset string, dw double, adv double, vol double, growth double").repartition(5)
    want = fold_by_hand(trades)
    got = {(r.portfolio, r.period): tuple(r)[2:] for r in bt.cost_fold(df, ["portfolio"]).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12)
    assert bt.cost_fold(df.limit(0), ["portfolio"]).count() == 0


def test_cost_fold_of_a_million_trades(spark):
    df = spark.range(1_000_000).select(
        F.lit("one").alias("portfolio"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("period"),
        F.format_string("a%07d", "id").alias("asset"), F.lit(1e-6).alias("dw"), F.lit(5e7).alias("adv"), F.lit(0.02).alias("vol"), F.lit(1.0).alias("growth"))
    got = pdf(bt.cost_fold(df, ["portfolio"]), "period")
    assert len(got) == 100 and (got.start.diff().dropna() < 0).all()
    assert got.cost.sum() == pytest.approx(1e7 - got.start.iloc[-1], rel=1e-9) and got.turnover.iloc[0] == pytest.approx(0.005)


def states_by_hand(rows, as_of, aliases, lag=45, keep=8):
    out = {}
    for t in as_of:
        for asset in {r[0] for r in rows}:
            known = [r for r in rows if r[0] == asset and r[1] + dt.timedelta(lag) <= t]
            if not known:
                continue
            state = {}
            for c, names in aliases.items():
                first = next((n for n in names if any(r[2] == n for r in known)), None)
                values = [r[3] for r in sorted((r for r in known if r[2] == first), key=lambda r: r[1]) if r[3] is not None]
                state[c] = values[-keep:]
            if any(r[2] in n for r in known for n in aliases.values()):
                out[t, asset] = state
    return out


def test_statement_states(spark):
    g = random.Random(3)
    aliases = {"net": ["Net Income", "Net Income Common"], "eps": ["EPS"], "debt": ["Debt"]}
    ends = [dt.date(2000 + i // 4, 3 * (i % 4) + 1, 28) for i in range(20)]
    rows = []
    for asset in ("A", "B", "C"):
        for i, end in enumerate(ends):
            for item in ("Net Income", "Net Income Common", "EPS", "Other"):
                if (item == "Net Income" and i < 6 and asset != "C") or g.random() < 0.2:
                    continue  # the preferred name is published later than its stand-in
                rows.append((asset, end, item, None if g.random() < 0.25 else float(i)))
    df = spark.createDataFrame(rows, "asset string, period_end date, item string, value double").withColumn("stmt", F.lit("s"))
    as_of = [dt.date(2000, 1, 1) + dt.timedelta(37 * k) for k in range(60)]
    got = pit.valid_at(fd.statement_states(df, aliases), as_of, "asset", "known_from")
    assert {(r.as_of, r.asset): {c: list(r[c]) for c in aliases} for r in got.collect()} == states_by_hand(rows, as_of, aliases)


def test_correlations_of_constant_columns(spark):
    n = 40
    g = rng(5)
    x = spark.createDataFrame([("A", day(i), 1.0, float(v), float(v), 2.0) for i, v in enumerate(g.normal(size=n))], "asset string, ts date, flat double, x double, fwd double, bm double")
    pairs = x.agg(safe_corr("flat", "x").alias("a"), safe_corr("x", "fwd").alias("b"), safe_corr(F.when(F.col("x") > 99, F.col("x")), "x").alias("c")).first()
    assert pairs.a is None and pairs.c is None and pairs.b == pytest.approx(1.0)
    assert returns.compare_return_methods(x, "flat", "x").first().correlation is None
    assert pit.leakage_reverse_corr(x, "flat", "x", 1).first().passed
    assert pit.validate_target_independence(x, "flat", "fwd").first().passed
    assert risk.beta(x.drop("bm"), x.select("ts", "bm"), "x").first().r_squared is None
    s = x.select("asset", "ts", F.explode(F.array(F.struct(F.lit("M1").alias("m"), F.lit(100.0).alias("v")), F.struct(F.lit("M2").alias("m"), F.col("x").alias("v")))).alias("s"))
    found = scores.module_correlation(s.select("asset", "ts", F.col("s.m").alias("module"), F.col("s.v").alias("score")), ["asset", "ts"])
    assert found.first().correlation is None and found.first().n == n
    c = spark.createDataFrame([(t, day(0), a, 1.0) for t in ("t1", "t2") for a in ("A", "B")], "treatment string, ts date, asset string, value_factor double")
    assert all(r.rank_correlation is None for r in predictive.rank_robustness(c, ["value_factor"]).collect())


def test_regression_of_a_high_level(spark):
    """Levels of a million under unit noise: coefficients and errors keep eight digits."""
    g = rng(11)
    x = g.normal(size=(240, 2))
    y = 3 + x @ [0.5, -2.0] + g.normal(size=240)
    rows = [("A", day(i), float(1e6 + y[i]), float(1e6 + x[i, 0]), float(1e6 + x[i, 1])) for i in range(240)]
    df = spark.createDataFrame(rows, "asset string, month date, y double, f1 double, f2 double").repartition(7)
    a = np.column_stack([np.ones(240), x])
    coef, res, *_ = np.linalg.lstsq(a, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * res[0] / 237)
    got = regress.factor_loadings(df, ["f1", "f2"]).first()
    assert [got.b_f1, got.b_f2] == pytest.approx(coef[1:], abs=1e-8)
    assert [got.t_b_f1, got.t_b_f2] == pytest.approx(coef[1:] / se[1:], rel=1e-7)
    assert got.r2 == pytest.approx(1 - res[0] / np.var(y) / 240, abs=1e-8)
    roll = pdf(regress.rolling_factor_loadings(df, ["f1", "f2"], window=36), "month")
    for i, r in enumerate(roll.itertuples()):
        want = np.linalg.lstsq(a[i:i + 36], y[i:i + 36], rcond=None)[0]
        assert [r.b_f1, r.b_f2] == pytest.approx(want[1:], abs=1e-7)
    assert len(roll) == 205


def test_stacks_with_singular_systems():
    g = rng(12)
    a = g.normal(size=(50, 9, 4))
    a[::5, :, 3] = a[::5, :, 0] * 2  # determined by another
    a[1::5, :, 2] = 7.0  # constant
    y = g.normal(size=(50, 9))
    data = np.concatenate([a, y[..., None]], axis=2)
    mean = data.mean(1)
    c = np.einsum("nri,nrj->nij", data - mean[:, None], data - mean[:, None]) / 9
    coef, se, r2 = linear.solve_stack(np.full(50, 9.0), mean, c)
    for i in range(50):
        design = np.column_stack([np.ones(9), a[i]])
        fit = design @ np.linalg.lstsq(design, y[i], rcond=1e-10)[0]
        assert design @ coef[i] == pytest.approx(fit, abs=1e-8)
        assert r2[i] == pytest.approx(1 - ((y[i] - fit) ** 2).sum() / ((y[i] - y[i].mean()) ** 2).sum(), abs=1e-8)
    low, good = linear.cholesky_stack(np.einsum("nki,nkj->nij", a[2::5], a[2::5]))
    assert good.all() and low == pytest.approx(np.linalg.cholesky(np.einsum("nki,nkj->nij", a[2::5], a[2::5])))


def test_lower_tail_dependence(spark):
    rows, df = sparse(spark, SPANS, seed=6)
    got = {(r.a, r.b): r for r in risk.lower_tail_dependence(df, 0.1, blocks=2).collect()}
    held = {a: {t: r for x, t, r in rows if x == a} for a in SPANS}
    low = {a: {t for t, r in v.items() if r <= np.quantile(list(v.values()), 0.1)} for a, v in held.items()}
    for a in SPANS:
        for b in SPANS:
            n = len(held[a].keys() & held[b].keys())
            if a < b and n:
                assert (got[a, b].n, got[a, b].both) == (n, len(low[a] & low[b]))
                assert got[a, b].dependence == pytest.approx(len(low[a] & low[b]) / (0.1 * n))
    assert len(got) == 10


@pytest.mark.parametrize("blocks", [1, 3])
def test_bootstrap_pairs_by_blocks(spark, blocks):
    g = rng(7)
    df = panel(spark, {f"s{i}": g.normal(0.01 * i, 1, 40) for i in range(7)})
    per = {(r.rep, r.asset): r["mean"] / r["std"] for r in perftests.stationary_bootstrap(df, 60).collect()}
    base = {r.asset: r.m / r.s for r in df.groupBy("asset").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s")).collect()}
    got = perftests.bootstrap_sharpe_diff(df, 60, blocks=blocks).collect()
    assert len(got) == 21
    for r in got:
        a, b = r.strategy_a, r.strategy_b
        want = base[a] - base[b]
        assert a < b and r.sharpe_diff == pytest.approx(want)
        assert r.p_value == pytest.approx(np.mean([abs(per[k, a] - per[k, b] - want) >= abs(want) for k in range(60)]))


def test_bootstrap_of_five_thousand_strategies(spark):
    df = spark.range(5000).select(F.format_string("s%04d", "id").alias("asset"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).select(
        "asset", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")).alias("ts"), F.sin(F.xxhash64("asset", "k") / 1e15).alias("r"))
    got = perftests.bootstrap_sharpe_diff(df, 3)
    n, low, high = got.agg(F.count(F.lit(1)), F.min("p_value"), F.max("p_value")).first()
    assert n == 5000 * 4999 // 2 and 0 <= low <= high <= 1


def matrix_rows(name, m):
    return [(name, f"x{i:02d}", f"x{j:02d}", float(m[i, j])) for i in range(len(m)) for j in range(i, len(m))]


def test_eigenvalue_floor(spark):
    g = rng(9)
    x = g.normal(size=(5, 12))
    short = np.corrcoef(x, rowvar=False)  # rank 4 of 12
    good = np.cov(g.normal(size=(400, 8)), rowvar=False)
    one = np.array([[0.5]])
    df = spark.createDataFrame(matrix_rows("short", short) + matrix_rows("good", good) + matrix_rows("one", one), "g string, a string, b string, value double")
    low = risk.lowest_eigenvalue(df, "g")
    assert low["good"] == pytest.approx(np.linalg.eigvalsh(good)[0], rel=1e-6) and low["one"] == pytest.approx(0.5) and abs(low["short"]) < 1e-6
    got = risk.eigen_floor(df, "g").toPandas()
    new = risk.square(got[got.g == "short"])[1]
    assert np.linalg.eigvalsh(new)[0] >= 1e-6 - 1e-9 and np.diag(new) == pytest.approx(np.ones(12))
    assert np.abs(new - short).max() < 1e-4
    assert risk.square(got[got.g == "good"])[1] == pytest.approx(good, abs=0)


def test_permutation_of_a_column(spark):
    n = 10_007
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("x"), (F.col("id") % 3).alias("y")).repartition(7)
    got = models.permuted(df, "x", ["k"]).toPandas()
    assert sorted(got.x) == list(range(n)) and sorted(got.k) == list(range(n)) and (got.y == got.k % 3).all()
    assert (got.x == got.k).sum() < 10 and abs(np.corrcoef(got.x, got.k)[0, 1]) < 0.04
    ranks = ranking.gapless_rank(df, F.col("k").desc()).toPandas()
    assert (ranks["rank"] == n - 1 - ranks.k).all()
    assert models.permuted(df.limit(0), "x", ["k"]).count() == 0
