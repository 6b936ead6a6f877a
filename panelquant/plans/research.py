"""Predictive regressions, robustness, studies, learned models and decision tables."""

import datetime as dt
import re

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import crossval as cv
from ..operators import decisions as dc
from ..operators import fundamentals as fd
from ..operators import models as ml
from ..operators import normalize as nz
from ..operators import pit
from ..operators import predictive as pv
from ..operators import risk as rk
from ..operators import scores as sc
from ..operators import studies as st
from ..operators import timeseries as tsr
from ..sources.files import cut, stored
from .assets import LOW, MOM, QUALITY, VALUE
from .panel import _SPAN, FWD, MONTHS_SQL, XS, months
from .regressions import _wide, moments_sql, ols_sql
from .registry import query
from .shared_sql import VIEWS

# -- one job over treatments, dates and factors ---------------------------------------------------
_frames = {"value_v": VALUE, "quality_v": QUALITY, "momentum_v": MOM, "low_risk_v": LOW}
VIEWS["rchars"] = " UNION ALL ".join(f"SELECT as_of AS ts, asset, '{c}' AS characteristic, {c} AS value FROM {v}" for v, cs in _frames.items() for c in cs)


def _treated_sql() -> str:
    pre = []
    for name, (with_part, body) in XS.items():
        if with_part and with_part not in pre:
            pre.append(with_part)
    parts = " UNION ALL ".join(f"SELECT '{n}' AS treatment, ts, asset, characteristic, score FROM ({b})" for n, (_, b) in XS.items())
    return f"WITH {', '.join(pre)} {parts}".replace("FROM chars", "FROM rchars")


def _avg(names: list[str]) -> str:
    return "avg(CASE WHEN characteristic IN (" + ", ".join(f"'{c}'" for c in names) + ") THEN score END)"


VIEWS["composite_v"] = "SELECT treatment, ts, asset, " + ", ".join(f"{_avg(cs)} AS {f}" for f, cs in pv.FACTOR_CHARS.items()) + f" FROM ({_treated_sql()}) GROUP BY ALL"
VIEWS["rpanel"] = f"SELECT c.*, f.fwd AS y FROM composite_v c JOIN (WITH {FWD} SELECT * FROM fwd) f ON f.as_of = c.ts AND f.asset = c.asset WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in pv.FACTORS)
VIEWS["xsreg"] = ols_sql(f"SELECT treatment, ts, {moments_sql('y', pv.FACTORS)} FROM rpanel GROUP BY ALL HAVING count(*) >= 5", 4)
VIEWS["fm_v"] = " UNION ALL ".join(f"SELECT treatment, ts, '{n}' AS factor, c{i} AS coef FROM xsreg" for i, n in enumerate(["const", *pv.FACTORS]))


def _dates_of(p, pace: str):
    return months(p) if pace == "monthly" else pit.Grid(*(dt.date(y, *md) for y, md in zip(p.years(), ((1, 1), (12, 31)), strict=True)), pace)


def _composite(p, pace: str = "monthly"):
    def build():
        q, d = p.statements("quarter"), _dates_of(p, pace)
        raw = pv.characteristics([fd.factor_value(q, p.closes(), d), fd.factor_quality(q, d),
                                  tsr.factor_momentum(p.closes(), d), tsr.factor_low_risk(p.returns(), d)])
        return pv.factor_composite(nz.apply_normalization(cut(raw), list(nz.TREATMENTS)))
    return stored(p.spark, (p.path, "composite", pace), build)


def _rpanel(p, pace: str = "monthly"):
    return stored(p.spark, (p.path, "rpanel", pace), lambda: pv.regression_panel(_composite(p, pace), pit.forward_returns(p.closes(), _dates_of(p, pace), 21)))


def _pred(p):
    return stored(p.spark, (p.path, "oos"), lambda: pv.oos_prediction(_rpanel(p), cut(pv.oos_models(_rpanel(p)))))


def _fm(p):
    return pv.fama_macbeth(_rpanel(p))


def _delta(p):
    return pv.oos_incremental(_pred(p), ("treatment", "factor", "ts"))


K = "treatment, D(ts) AS ts"


@query("factor_composite", f"SELECT {K}, asset, " + ", ".join(f"R6({x}) AS {x}" for x in pv.FACTORS) + " FROM composite_v")
def _(p):
    return rounded(_composite(p))


@query("xs_regression", f"SELECT {K}, CAST(a0_0 AS BIGINT) AS n, R5(r2) AS r2, R5(c0) AS alpha, " + ", ".join(f"R5(c{i + 1}) AS b_{x}" for i, x in enumerate(pv.FACTORS)) + " FROM xsreg")
def _(p):
    return rounded(pv.xs_regression(_rpanel(p)), 5)


@query("fama_macbeth", f"SELECT {K}, factor, R5(coef) AS coef FROM fm_v")
def _(p):
    return rounded(_fm(p), 5)


def _oos_sql(drop: str | None) -> str:
    xs = [x for x in pv.FACTORS if x != drop]
    sums = moments_sql("y", xs)
    names = [c.split(" AS ")[-1].strip() for c in sums.split(", ")]
    win = ", ".join(f"sum({n}) OVER w AS {n}" for n in names)
    src = f"""SELECT * FROM (SELECT treatment, ts, count(*) OVER w AS nd, {win} FROM (SELECT treatment, ts, date_diff('day', DATE '1970-01-01', ts) AS dn, {sums} FROM rpanel GROUP BY ALL)
WINDOW w AS (PARTITION BY treatment ORDER BY dn RANGE BETWEEN 252 PRECEDING AND 1 PRECEDING)) WHERE nd >= 3 AND a0_0 >= {len(pv.FACTORS) + 2}"""
    return ols_sql(src, len(xs))


VIEWS["oos_full"] = _oos_sql(None)
for _f in pv.FACTORS:
    VIEWS[f"oos_no_{_f}"] = _oos_sql(_f)


def _hat(xs, alias: str) -> str:
    return f"{alias}.c0 + " + " + ".join(f"{alias}.c{i + 1} * p.{x}" for i, x in enumerate(xs))


VIEWS["oos_v"] = " UNION ALL ".join(
    f"SELECT p.treatment, p.ts, p.asset, '{d}' AS factor, p.y, {_hat(pv.FACTORS, 'f')} AS yf, {_hat([x for x in pv.FACTORS if x != d], 'b')} AS yb, f.g0 / f.a0_0 AS yt "
    f"FROM rpanel p JOIN oos_full f ON p.treatment = f.treatment AND p.ts = f.ts JOIN oos_no_{d} b ON p.treatment = b.treatment AND p.ts = b.ts" for d in pv.FACTORS)
INC = "sum(pow(y - yf, 2)) AS sf, sum(pow(y - yb, 2)) AS sb, sum(pow(y - yt, 2)) AS st, count(*) AS n"
VIEWS["oos_inc"] = f"SELECT *, 1 - sf / st AS rf, 1 - sb / st AS rb, (sb - sf) / st AS dr FROM (SELECT treatment, factor, {INC} FROM oos_v GROUP BY ALL)"
VIEWS["delta_v"] = f"SELECT treatment, factor, ts, (sb - sf) / st AS dr FROM (SELECT treatment, factor, ts, {INC} FROM oos_v GROUP BY ALL)"
VIEWS["delta_m"] = "SELECT treatment, factor, avg(dr) AS m FROM delta_v GROUP BY ALL"


@query("oos_prediction", f"SELECT {K}, asset, factor, R6(y) AS y, R5(yf) AS y_hat_full, R5(yb) AS y_hat_base, R6(yt) AS y_bar_train FROM oos_v")
def _(p):
    return rounded(_pred(p), 5, y=6, y_bar_train=6)


INCR = "treatment, factor, R5(rf) AS r2_oos_full, R5(rb) AS r2_oos_base, R6(dr) AS delta_r2, n AS n_test_obs"
SHOW = ["treatment", "factor", "r2_oos_full", "r2_oos_base", "delta_r2", "n_test_obs"]


@query("oos_incremental_r2", f"SELECT {INCR} FROM oos_inc WHERE factor = 'momentum'")
def _(p):
    return rounded(pv.oos_incremental(_pred(p).where("factor = 'momentum'")).select(*SHOW), 5, delta_r2=6)


@query("oos_incremental_all", f"SELECT {INCR} FROM oos_inc")
def _(p):
    return rounded(pv.oos_incremental(_pred(p)).select(*SHOW), 5, delta_r2=6)


@query("experiment_grid", f"SELECT {K}, factor, R5(dr) AS delta_r2 FROM delta_v")
def _(p):
    return rounded(_delta(p).select("treatment", "ts", "factor", "delta_r2"), 5)


_WEEKDAYS = "CAST(d AS DATE) AS as_of FROM (SELECT unnest(generate_series(lo, hi + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM {span}) WHERE dayofweek(d) {which}"
PACES = {"weekly": "= 1", "daily": "BETWEEN 1 AND 5"}


def _paced(root: str, pace: str) -> str:
    """The view ``root`` and all it rests on with the decision dates of another pace; returns the new name."""
    days = f"(SELECT {_WEEKDAYS.format(span=_SPAN, which=PACES[pace])})"
    done: dict[str, str] = {}

    def visit(name: str) -> str:
        if name not in done:
            body = VIEWS[name].replace(MONTHS_SQL, days)
            changed = body != VIEWS[name]
            for other in [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", body)]:
                new = visit(other)
                if new != other:
                    body, changed = re.sub(rf"\b{other}\b", new, body), True
            done[name] = f"{name}_{pace}" if changed else name
            if changed:
                VIEWS[done[name]] = body
        return done[name]

    return visit(root)


for _pace in PACES:
    @query(f"experiment_grid_{_pace}", f"SELECT {K}, factor, R4(dr) AS delta_r2 FROM {_paced('delta_v', _pace)}")
    def _(p, pace=_pace):
        return rounded(pv.experiment_grid(_rpanel(p, pace)), 4)


VIEWS["nw_v"] = """
WITH u AS (SELECT treatment, factor, ts, coef, coef - avg(coef) OVER (PARTITION BY treatment, factor) AS u FROM fm_v), l AS (SELECT *, """ + ", ".join(
    f"lag(u, {k}) OVER (PARTITION BY treatment, factor ORDER BY ts) AS l{k}" for k in range(1, 6)) + """ FROM u),
g AS (SELECT treatment, factor, count(*) AS n, avg(coef) AS m, floor(4 * pow(count(*) / 100.0, 2.0 / 9)) AS lags, sum(u * u) AS s0, """ + ", ".join(
    f"sum(u * l{k}) AS s{k}" for k in range(1, 6)) + """ FROM l GROUP BY ALL)
SELECT *, (s0 + """ + " + ".join(f"CASE WHEN lags >= {k} THEN 2 * (1 - {k} / (lags + 1)) * s{k} ELSE 0 END" for k in range(1, 6)) + ") / (n * n) AS v FROM g"


@query("newey_west_se", "SELECT treatment, factor, n, R6(m) AS mean_coeff, R6(sqrt(v)) AS nw_se FROM nw_v")
def _(p):
    return rounded(pv.newey_west_se(_fm(p)))


@query("coefficient_significance", """
SELECT treatment, factor, n, R6(m) AS mean_coeff, R6(se) AS nw_se, R5(m / se) AS nw_t_stat, R6(m - 1.96 * se) AS ci_lower, R6(m + 1.96 * se) AS ci_upper, m - 1.96 * se > 0 OR m + 1.96 * se < 0 AS significant
FROM (SELECT *, sqrt(v * n / (n - 1)) AS se FROM nw_v)""")
def _(p):
    return rounded(pv.coefficient_significance(_fm(p)), 6, nw_t_stat=5)


B = "'cross_sectional_zscore'"


@query("sign_stability", f"SELECT a.treatment, a.factor, R6(avg((sign(a.dr) = sign(b.dr))::INT)) AS same_sign FROM delta_v a JOIN delta_v b ON b.treatment = {B} AND a.factor = b.factor AND a.ts = b.ts GROUP BY 1, 2")
def _(p):
    return rounded(pv.sign_stability(_delta(p)))


@query("magnitude_change", f"SELECT a.treatment, a.factor, R5(abs(a.m - b.m)) AS abs_change, R4(abs(a.m - b.m) / abs(b.m)) AS rel_change FROM delta_m a JOIN delta_m b ON b.treatment = {B} AND a.factor = b.factor WHERE a.treatment <> {B}")
def _(p):
    return rounded(pv.magnitude_change(_delta(p)), 5, rel_change=4)


@query("robustness_summary", "SELECT factor, R5(min(m)) AS min, R5(max(m)) AS max, R5(max(m) - min(m)) AS range, R5(stddev_samp(m)) AS std FROM delta_m GROUP BY factor")
def _(p):
    return rounded(pv.robustness_summary(_delta(p)), 5)


VIEWS["rankrob"] = """
WITH l AS (SELECT treatment, factor, asset, avg(x) AS x FROM (""" + " UNION ALL ".join(f"SELECT treatment, asset, '{f}' AS factor, {f} AS x FROM composite_v" for f in pv.FACTORS) + """) GROUP BY ALL HAVING avg(x) IS NOT NULL),
r AS (SELECT treatment, factor, asset, rank() OVER (PARTITION BY treatment, factor ORDER BY x) + (count(*) OVER (PARTITION BY treatment, factor, x) - 1) / 2.0 AS rk FROM l),
c AS (SELECT a.factor, a.treatment AS ta, b.treatment AS tb, corr(a.rk, b.rk) AS c FROM r a JOIN r b ON a.factor = b.factor AND a.asset = b.asset GROUP BY ALL)
SELECT ta AS treatment_a, tb AS treatment_b, avg(c) AS c FROM c GROUP BY ALL"""


@query("rank_robustness", "SELECT treatment_a, treatment_b, R6(c) AS rank_correlation FROM rankrob")
def _(p):
    return rounded(pv.rank_robustness(_composite(p)))


def _r2(p):
    return pv.oos_incremental(_pred(p)).select("treatment", "factor", F.col("r2_oos_full").alias("r2"))


VIEWS["pred_rob"] = f"SELECT a.treatment, a.factor, a.rf AS r2, a.rf - b.rf AS delta_from_baseline FROM oos_inc a JOIN oos_inc b ON b.treatment = {B} AND b.factor = a.factor"


@query("predictive_robustness", "SELECT treatment, factor, R5(r2) AS r2, R5(delta_from_baseline) AS delta_from_baseline FROM pred_rob")
def _(p):
    return rounded(pv.predictive_robustness(_r2(p)), 5)


# section, key, metrics and the view they are in
SECTIONS = [
    ("Summary Statistics", "factor", {"min": "min", "max": "max", "range": "max - min", "std": "std"}, "(SELECT factor, min(m) AS min, max(m) AS max, stddev_samp(m) AS std FROM delta_m GROUP BY factor)"),
    ("Sign Stability", "treatment || '|' || factor", {"same_sign": "same_sign"},
     f"(SELECT a.treatment, a.factor, avg((sign(a.dr) = sign(b.dr))::INT) AS same_sign FROM delta_v a JOIN delta_v b ON b.treatment = {B} AND a.factor = b.factor AND a.ts = b.ts GROUP BY 1, 2)"),
    ("Magnitude Change", "treatment || '|' || factor", {"abs_change": "c", "rel_change": "c / m"},
     f"(SELECT a.treatment, a.factor, abs(a.m - b.m) AS c, abs(b.m) AS m FROM delta_m a JOIN delta_m b ON b.treatment = {B} AND a.factor = b.factor WHERE a.treatment <> {B})"),
    ("Statistical Robustness", "treatment || '|' || factor", {
        "n": "n", "mean_coeff": "m", "nw_se": "se", "nw_t_stat": "m / se", "ci_lower": "m - 1.96 * se", "ci_upper": "m + 1.96 * se",
        "significant": "(m - 1.96 * se > 0 OR m + 1.96 * se < 0)::INT"}, "(SELECT *, sqrt(v * n / (n - 1)) AS se FROM nw_v)"),
    ("Rank Robustness", "treatment_a || '|' || treatment_b", {"rank_correlation": "c"}, "rankrob"),
    ("Predictive Robustness", "treatment || '|' || factor", {"r2": "r2", "delta_from_baseline": "delta_from_baseline"}, "pred_rob"),
]


@query("robustness_report", " UNION ALL ".join(
    f"SELECT '{section}' AS section, {key} AS key, '{metric}' AS metric, R4({value}) AS value FROM {view}"
    for section, key, metrics, view in SECTIONS for metric, value in metrics.items()))
def _(p):
    d = _delta(p)
    return rounded(pv.robustness_report({
        "Summary Statistics": (pv.robustness_summary(d), ["factor"]), "Sign Stability": (pv.sign_stability(d), ["treatment", "factor"]),
        "Magnitude Change": (pv.magnitude_change(d), ["treatment", "factor"]),
        "Statistical Robustness": (pv.coefficient_significance(_fm(p)), ["treatment", "factor"]),
        "Rank Robustness": (pv.rank_robustness(_composite(p)), ["treatment_a", "treatment_b"]),
        "Predictive Robustness": (pv.predictive_robustness(_r2(p)), ["treatment", "factor"])}), 4)


VIEWS["month_w"] = """
SELECT ts, asset, v / sum(v) OVER (PARTITION BY ts) AS w FROM (SELECT date_trunc('month', ts)::DATE AS ts, asset, CAST(sum(volume) AS DOUBLE) AS v FROM bars_brand GROUP BY ALL)"""


def _month_w(p):
    v = p.closes().groupBy(F.trunc("ts", "month").alias("split"), "asset").agg(F.sum("volume").cast("double").alias("v"))
    return v.join(v.groupBy("split").agg(F.sum("v").alias("t")), "split").select("split", "asset", (F.col("v") / F.col("t")).alias("w"))


@query("turnover", """
WITH s AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev FROM (SELECT DISTINCT ts FROM month_w)), g AS (SELECT s.ts, a.asset FROM s, (SELECT DISTINCT asset FROM month_w) a)
SELECT D(g.ts) AS split, R6(CASE WHEN any_value(s.prev) IS NULL THEN 0 ELSE sum(abs(coalesce(x.w, 0) - coalesce(y.w, 0))) / 2 END) AS turnover
FROM g JOIN s USING (ts) LEFT JOIN month_w x ON x.ts = g.ts AND x.asset = g.asset LEFT JOIN month_w y ON y.ts = s.prev AND y.asset = g.asset GROUP BY g.ts""")
def _(p):
    return rounded(pv.turnover(_month_w(p), []))


# -- studies ------------------------------------------------------------------------------------------
def _study_inputs(p):
    r = stored(p.spark, (p.path, "complete_types"), lambda: rk.complete_dates(p.returns("p_type")).select("ts", "asset", "r"))
    return r, p.candidate_weights()


@query("estimator_stability_study")
def _(p):
    r, cand = _study_inputs(p)
    return rounded(st.estimator_stability_study(r, cv.purged_cv_splits(r, 10, embargo_days=5), cand, "year(ts)"))


def _bench_paths(p):
    r, cand = _study_inputs(p)
    return stored(p.spark, (p.path, "bench_paths"), lambda: st.benchmark_paths(r, cv.purged_cv_splits(r, 6, embargo_days=5, combinatorial=True), cand, "year(ts)"))


def _pair_tests(p):
    return stored(p.spark, (p.path, "pair_tests"), lambda: st.pair_tests(st.ensemble(_bench_paths(p)), "year(ts)", 500))


@query("method_benchmark_study")
def _(p):
    return rounded(_pair_tests(p))


@query("method_benchmark_dsr")
def _(p):
    return rounded(st.best_method_dsr(st.ensemble(_bench_paths(p))))


@query("findings_headline")
def _(p):
    return st.findings_headline(_pair_tests(p))


@query("findings_track1")
def _(p):
    r, cand = _study_inputs(p)
    return rounded(st.findings_track1(st.estimator_stability_study(r, cv.purged_cv_splits(r, 10, embargo_days=5), cand, "year(ts)")))


@query("findings_tables")
def _(p):
    return rounded(st.findings_tables(_bench_paths(p)))


# -- learned models -------------------------------------------------------------------------------------
FEATURES = ["M1", "M2", "M3", "M4", "M5", "M6"]


def _training(p):
    w = sc.wide_scores(p.module_scores())
    y = pit.forward_returns(p.closes(), months(p), 21).select(F.trunc("as_of", "month").alias("ts"), "asset", F.col("fwd").alias("y"))
    return w.join(y, ["asset", "ts"])


def _fit(p, splits=False):
    d = cut(_training(p))
    s = cv.purged_cv_splits(d.select("ts")) if splits else None
    return d, ml.meta_model_fit(d, FEATURES, splits=cut(s) if splits else None)


@query("meta_model_fit")
def _(p):
    return rounded(_fit(p, True)[1][1])


@query("meta_model_predict")
def _(p):
    d, (model, _) = _fit(p)
    return rounded(ml.meta_model_predict(model, d, FEATURES, ["asset", "ts"]))


@query("permutation_importance")
def _(p):
    d, (model, _) = _fit(p)
    return rounded(ml.permutation_importance(model, d, FEATURES, ["asset", "ts"]))


VIEWS["regf"] = """
WITH d AS (SELECT ts, bm, CASE WHEN count(*) OVER w = 21 THEN stddev_samp(bm) OVER w * sqrt(252) END AS rv, term_spread AS x FROM bm_type LEFT JOIN macro_w ON ts = month_end WINDOW w AS (ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))
SELECT * FROM (SELECT ts, bm, rv, coalesce(last_value(x IGNORE NULLS) OVER (ORDER BY ts), first_value(x IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM d) WHERE rv IS NOT NULL AND x IS NOT NULL"""
REG = ["mkt_return", "realized_vol", "term_spread"]


def _regime_features(p):
    m = _wide(p).select(F.col("month_end").alias("ts"), "term_spread")
    return ml.regime_features(p.benchmark("p_type"), m, ["term_spread"])


@query("regime_features", "SELECT D(ts) AS ts, R6(bm) AS mkt_return, R6(rv) AS realized_vol, R6(x) AS term_spread FROM regf")
def _(p):
    return rounded(_regime_features(p))


@query("regime_mixture_fit")
def _(p):
    f = cut(_regime_features(p))
    return rounded(ml.regime_transitions(ml.regime_posterior(*ml.regime_mixture_fit(f, REG), f)))


@query("regime_means")
def _(p):
    f = cut(_regime_features(p))
    return rounded(ml.regime_means(*ml.regime_mixture_fit(f, REG), f, REG))


@query("regime_posterior")
def _(p):
    f = cut(_regime_features(p))
    return rounded(ml.regime_posterior(*ml.regime_mixture_fit(f, REG), f))


# -- decisions --------------------------------------------------------------------------------------------
VIEWS["strats"] = "SELECT asset AS strategy, avg(r) * 252 / 100 AS cagr, stddev_samp(r) * sqrt(252) / 10 AS vol, 2.0 + count(*) / 1000.0 AS turn FROM ret_brand GROUP BY asset"


def _cap_sql() -> str:
    tiers = ", ".join(f"({t}::DOUBLE)" for t in dc.CAPITAL_TIERS)
    return f"""
SELECT strategy, aum, R6(cagr) AS gross_cagr, R8(turn * bps / 10000) AS annual_drag_pct, R6(cagr - turn * bps / 10000) AS net_cagr, R6((cagr - turn * bps / 10000) / vol) AS net_sharpe, R6(bps) AS market_impact_bps, aum * turn / 12 / 50e6 > 0.05 AS liquidity_breached
FROM (SELECT *, 5 + 0.3 * vol / sqrt(252) * sqrt(least(aum * turn / 12 / 50e6, 1)) * 10000 AS bps FROM strats, (VALUES {tiers}) t(aum))"""


@query("capacity_curve", _cap_sql())
def _(p):
    s = p.returns().groupBy(F.col("asset").alias("strategy")).agg((F.avg("r") * 252 / 100).alias("gross_cagr"), (F.stddev_samp("r") * 252.0 ** 0.5 / 10).alias("gross_vol"),
                                                                (2.0 + F.count(F.lit(1)) / 1000.0).alias("annual_turnover"))
    return rounded(dc.capacity_curve(s), 6, annual_drag_pct=8)


VIEWS["lastpx"] = "SELECT asset, arg_max(close, ts) AS price, sum(volume) / count(*) AS adv FROM bars_brand GROUP BY asset"


def _last(p):
    return p.closes().groupBy("asset").agg(F.max_by("close", "ts").alias("price"), (F.sum("volume") / F.count(F.lit(1))).alias("adv"))


@query("order_tickets", """
WITH d AS (SELECT coalesce(t.portfolio, h.portfolio) AS portfolio, coalesce(t.asset, h.asset) AS asset, w, shares FROM target_weights t FULL JOIN holdings h ON t.portfolio = h.portfolio AND t.asset = h.asset),
e AS (SELECT d.*, price, adv, CASE WHEN w IS NOT NULL THEN floor(200000 * w / price) ELSE 0 END AS ts FROM d JOIN lastpx USING (asset)),
f AS (SELECT *, ts - coalesce(shares, 0) AS delta, abs(ts - coalesce(shares, 0)) * price AS v, 200000 - sum(ts * price) OVER (PARTITION BY portfolio) AS cash FROM e)
SELECT portfolio, asset, CASE WHEN delta < 0 THEN 'SELL' ELSE 'BUY' END AS action, CAST(abs(delta) AS BIGINT) AS shares, CAST(ts AS BIGINT) AS target_shares, price AS est_price, R6(v) AS est_trade_value, R6(v / (adv * price) * 100) AS adv_participation_pct,
  v / (adv * price) > 0.05 AS warned, row_number() OVER (PARTITION BY portfolio ORDER BY CASE WHEN delta < 0 THEN 0 ELSE 1 END, v DESC, asset) AS seq, R6(cash) AS residual_cash
FROM f WHERE delta <> 0 AND v >= 2000""")
def _(p):
    last = _last(p)
    d = dc.order_tickets(p.target_weights(), p.holdings(), last, last, 200000.0)
    return rounded(d.withColumn("warned", F.col("warning").isNotNull()).drop("warning"), 6, est_price=16)


VIEWS["curw"] = "SELECT portfolio, asset, shares / sum(shares) OVER (PARTITION BY portfolio) AS w FROM holdings"


@query("pre_trade_checks", """
SELECT portfolio, R6(mw) AS max_weight, R6(ge) AS gross_exposure, R6(tt) AS turnover, (mw > 0.4001)::INT + (ge > 1.0001)::INT + (tt > 0.6)::INT AS n_violations, NOT (mw > 0.4001 OR ge > 1.0001 OR tt > 0.6) AS passed FROM (
  SELECT portfolio, max(t.w) AS mw, sum(abs(t.w)) AS ge, sum(abs(t.w - coalesce(c.w, 0))) / 2 AS tt FROM target_weights t LEFT JOIN curw c USING (portfolio, asset) GROUP BY portfolio)""")
def _(p):
    h = p.holdings()
    cur = h.join(h.groupBy("portfolio").agg(F.sum("shares").alias("t")), "portfolio").select("portfolio", "asset", (F.col("shares") / F.col("t")).alias("w"))
    d = dc.pre_trade_checks(p.target_weights(), cur)
    return rounded(d.withColumn("n_violations", F.size("violations")).drop("violations"))


@query("kill_switch", """
WITH v AS (SELECT portfolio, ts, pnl, exp(sum(ln(1 + pnl)) OVER (PARTITION BY portfolio ORDER BY ts)) AS v FROM daily_pnl),
d AS (SELECT *, v / max(v) OVER (PARTITION BY portfolio ORDER BY ts) - 1 AS dd FROM v),
r AS (SELECT *, CASE WHEN pnl < -0.05 THEN 'MAX_DAILY_LOSS' WHEN abs(dd) > 0.15 THEN 'MAX_PORTFOLIO_DRAWDOWN' END AS r FROM d),
f AS (SELECT *, first_value(r IGNORE NULLS) OVER w AS reason, first_value(CASE WHEN r IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS hit FROM r WINDOW w AS (PARTITION BY portfolio ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT portfolio, D(ts) AS ts, reason IS NOT NULL AS tripped, CASE WHEN reason IS NULL THEN 'PROCEED' WHEN hit = ts AND reason = 'MAX_DAILY_LOSS' THEN 'HALT_TRADING' ELSE 'HALT_TRADING_LIQUIDATE' END AS action, coalesce(reason, 'All risk limits normal') AS reason FROM f""")
def _(p):
    return dc.kill_switch(dc.running_drawdown(p.daily_pnl()), max_drawdown=0.15)


def _factor_sql() -> str:
    cols = {m: f"coalesce({m}, 50)" if m != "M9" else "50" for m in dc.FACTOR_NAMES}
    top = "greatest(" + ", ".join(cols.values()) + ")"
    return f"CASE WHEN {top} < 60 THEN '{dc.PASSIVE}' " + " ".join(f"WHEN {c} = {top} THEN '{dc.FACTOR_NAMES[m]}'" for m, c in cols.items()) + " END"


VIEWS["dom_v"] = f"SELECT asset, ts, {_factor_sql()} AS f FROM scores_wide"
_hor = "CASE f " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dc.HORIZONS.items()) + " ELSE '6 to 12 Months (General Beta)' END"
_rule = "'Hard Stop-Loss: Exit if position drops > ' || printf('%.1f', stop) || '% from entry.' || CASE f " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dc.RULES.items()) + " ELSE '' END"


def _dominant(p):
    return dc.dominant_factor(sc.wide_scores(p.module_scores()))


@query("dominant_factor", "SELECT asset, D(ts) AS ts, f AS dominant_factor FROM dom_v")
def _(p):
    return _dominant(p).select("asset", "ts", "dominant_factor")


@query("horizon_label", f"SELECT asset, D(ts) AS ts, f AS dominant_factor, {_hor} AS horizon FROM dom_v")
def _(p):
    return dc.horizon_label(_dominant(p)).select("asset", "ts", "dominant_factor", "horizon")


VIEWS["rule_v"] = "SELECT asset, ts, f, least(greatest(cvar * 2.5 / 10, 0.05), 0.25) * 100 AS stop FROM dom_v JOIN var95 USING (asset)"


def _cvar(p):
    return rk.value_at_risk(p.returns(), levels=(0.95,)).select("asset", (F.col("cvar") / 10).alias("cvar_95"))


@query("invalidation_rule", f"SELECT asset, D(ts) AS ts, R6(stop) AS stop_pct, {_rule} AS invalidation FROM rule_v")
def _(p):
    return rounded(dc.invalidation_rule(_dominant(p).join(_cvar(p), "asset")).select("asset", "ts", "stop_pct", "invalidation"))


@query("advisory_report", f"""
WITH l AS (SELECT * FROM rule_v WHERE ts = (SELECT max(ts) FROM scores_wide)),
j AS (SELECT portfolio, asset, w, price, coalesce(f, '{dc.PASSIVE}') AS f, coalesce(stop, 12.5) AS stop FROM target_weights JOIN lastpx USING (asset) LEFT JOIN l USING (asset) WHERE w > 0.001)
SELECT portfolio, asset, R6(w * 100) AS allocation_pct, R4(w * 1e6) AS allocation_usd, CAST(floor(w * 1e6 / price) AS BIGINT) AS target_shares, price AS current_price, f AS dominant_factor, {_hor} AS horizon FROM j""")
def _(p):
    w = sc.wide_scores(p.module_scores())
    last = w.agg(F.max("ts").alias("t"))
    scores = w.where(F.col("ts") == last.scalar()).drop("ts")
    d = dc.advisory_report(p.target_weights(), _last(p), scores, _cvar(p), 1e6)
    return rounded(d.drop("stop_pct", "invalidation"), 6, allocation_usd=4, current_price=16)
