"""Splits, paths, metrics, regimes and significance tests."""

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.mixing import MOD, sql_mix, sql_rounds
from ..operators import backtest as bt
from ..operators import crossval as cv
from ..operators import perftests as pt
from ..operators.risk import complete_dates
from ..sources.files import cut
from .registry import query
from .regressions import _wide
from .shared_sql import VIEWS, norm_cdf, norm_ppf

VIEWS["cal"] = "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM ret_type)"
VIEWS["emb"] = """
SELECT n, med AS median_gap, CASE WHEN n < 2 OR floor(n * 0.01) < 1 THEN 0 ELSE med * floor(n * 0.01) END AS e FROM (
  SELECT count(*) AS n, median(g) AS med FROM (SELECT date_diff('day', lag(ts) OVER (ORDER BY ts), ts) AS g FROM cal))"""


def _dates(p):
    return p.returns("p_type").select("ts").distinct()


@query("embargo_delta", "SELECT n, R6(median_gap) AS median_gap, R6(e) AS embargo_days FROM emb")
def _(p):
    return rounded(cv.embargo_delta(_dates(p)))


def splits_sql(k: int, m: int, horizon: int, embargo: str, source: str = "cal") -> str:
    combos = list(combinations(range(k), m))
    values = ", ".join(f"({i}, {g})" for i, t in enumerate(combos) for g in t)
    return f"""
SELECT p.path_id, c.ts, CASE WHEN bool_or(p.g = c.g) THEN 'test' WHEN bool_or(c.ts + {horizon} >= b.lo AND c.ts <= b.hi) THEN 'purged'
  WHEN bool_or(c.ts > b.hi AND date_diff('day', b.hi, c.ts) <= {embargo}) THEN 'embargo' ELSE 'train' END AS role
FROM (SELECT ts, least(pos // (n // {k}), {k - 1}) AS g FROM {source}) c, (VALUES {values}) p(path_id, g)
JOIN (SELECT g, min(ts) AS lo, max(ts) AS hi FROM (SELECT ts, least(pos // (n // {k}), {k - 1}) AS g FROM {source}) GROUP BY g) b ON b.g = p.g
GROUP BY p.path_id, c.ts"""


@query("purged_cv_splits", f"SELECT 'kfold' AS scheme, CAST(path_id AS BIGINT) AS path_id, D(ts) AS ts, role FROM ({splits_sql(5, 1, 20, '(SELECT e FROM emb)')}) "
       f"UNION ALL SELECT 'combinatorial', CAST(path_id AS BIGINT), D(ts), role FROM ({splits_sql(6, 2, 20, '5')})")
def _(p):
    d = _dates(p)
    a = cv.purged_cv_splits(d).withColumn("scheme", F.lit("kfold"))
    return a.unionByName(cv.purged_cv_splits(d, 6, embargo_days=5, combinatorial=True).withColumn("scheme", F.lit("combinatorial")))


VIEWS["wf"] = """
SELECT fold, ts, CASE WHEN ts <= te THEN 'train' ELSE 'test' END AS role FROM (
  SELECT i AS fold, c.ts, CAST(lo + to_months(CAST(36 + 12 * i AS INTEGER)) AS DATE) AS te, CAST(lo + to_months(CAST(48 + 12 * i AS INTEGER)) AS DATE) AS xe, hi FROM wf_cal c, (SELECT min(ts) AS lo, max(ts) AS hi FROM wf_cal), (SELECT unnest(generate_series(0, 20)) AS i))
WHERE xe <= hi AND ts <= xe"""
VIEWS["wf_cal"] = "SELECT DISTINCT ts FROM ret_ok"


@query("walk_forward_splits", "SELECT fold, D(ts) AS ts, role FROM wf")
def _(p):
    return cv.walk_forward_splits(complete_dates(p.returns("p_type")).select("ts"))


@query("rebalance_dates", "SELECT 'monthly' AS freq, D(max(ts)) AS ts FROM cal GROUP BY date_trunc('month', ts) UNION ALL SELECT 'quarterly', D(max(ts)) FROM cal GROUP BY date_trunc('quarter', ts)")
def _(p):
    d = _dates(p)
    out = [cv.rebalance_dates(d, f).withColumn("freq", F.lit(f)) for f in ("monthly", "quarterly")]
    return out[0].unionByName(out[1])


VIEWS["liq"] = """
SELECT asset, ts, close, volume, CASE WHEN n > 20 THEN avg(close * volume) OVER w ELSE 50e6 END AS adv, CASE WHEN n > 20 THEN stddev_samp(r) OVER w ELSE 0.015 END AS vol FROM (
  SELECT asset, ts, close, volume, row_number() OVER v AS n, close / lag(close) OVER v - 1 AS r FROM bars_brand WINDOW v AS (PARTITION BY asset ORDER BY ts))
WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


@query("adv_and_vol_asof", "SELECT asset, D(ts) AS ts, R4(adv) AS adv, R8(vol) AS vol FROM liq")
def _(p):
    return rounded(bt.adv_and_vol_asof(p.closes()), 8, adv=4)


@query("market_impact_cost", """
SELECT asset, D(ts) AS ts, R6(i) AS market_impact_bps, R6(5 + i) AS total_cost_bps, R6(q * (5 + i) / 10000) AS total_cost_dollar, R6(q / greatest(adv, 10000)) AS participation_pct, q / greatest(adv, 10000) > 0.05 AS liquidity_breached
FROM (SELECT *, close * volume * 0.03 AS q, 0.3 * vol * sqrt(least(close * volume * 0.03 / greatest(adv, 10000), 1)) * 10000 AS i FROM liq)""")
def _(p):
    c = p.closes()
    d = bt.adv_and_vol_asof(c).join(c, ["asset", "ts"]).withColumn("trade", F.col("close") * F.col("volume") * 0.03)
    return rounded(bt.market_impact_cost(d).select("asset", "ts", "market_impact_bps", "total_cost_bps", "total_cost_dollar", "participation_pct", "liquidity_breached"))


def gross_sql(targets: str, returns: str, keys: str) -> str:
    """Daily gross return with the weights of the last rebalance drifting until the next one."""
    on = " AND ".join(f"r.{k} = h.{k}" for k in keys.split(", ") if k == "fold") or "TRUE"
    return f"""
SELECT {keys}, ts, period, ratio, ratio / coalesce(lag(ratio) OVER (PARTITION BY {keys}, period ORDER BY ts), 1) - 1 AS r_gross FROM (
  SELECT {keys}, ts, period, sum(w * g) AS ratio FROM (
    SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY {keys}, asset, period ORDER BY ts)) AS g FROM (
      SELECT {', '.join('h.' + k for k in keys.split(', '))}, r.asset, r.ts, r.r, h.w, h.ts AS period
      FROM (SELECT *, lead(ts) OVER (PARTITION BY {keys}, asset ORDER BY ts) AS nxt FROM {targets}) h JOIN {returns} r ON h.asset = r.asset AND {on} AND r.ts >= h.ts AND (h.nxt IS NULL OR r.ts < h.nxt)))
  GROUP BY {keys}, ts, period)"""


VIEWS["reb_m"] = "SELECT max(ts) AS ts FROM ret_ok GROUP BY date_trunc('month', ts)"
VIEWS["cand_targets"] = "SELECT candidate, ts, asset, w FROM candidate_weights, reb_m"
VIEWS["cand_path"] = gross_sql("cand_targets", "ret_ok", "candidate")


def _targets(p):
    """Candidates rebalanced at month ends; the handful of dates is attached as one array."""
    r = complete_dates(p.returns("p_type"))
    days = cv.rebalance_dates(r).agg(F.array_sort(F.collect_list("ts")).alias("d"))
    return p.candidate_weights().withColumn("ts", F.explode(days.scalar())), r


@query("portfolio_path", "SELECT candidate, D(ts) AS ts, R8(ratio) AS ratio, R8(r_gross) AS r_gross FROM cand_path")
def _(p):
    t, r = _targets(p)
    plan, growth = bt.holding_growth(bt.normalise_targets(t, ["candidate"]), cut(r), ["candidate"])
    return rounded(bt.gross_path(plan, cut(growth), ["candidate"]).select(
        "candidate", "ts", "ratio", "r_gross"), 8)


def metrics_sql(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, n, tr AS total_return, ann AS annualised_return, vol AS volatility, sh AS sharpe_ratio, CASE WHEN down > 0 THEN (ann - 0.0252) / down ELSE sh END AS sortino_ratio, mdd AS max_drawdown,
  CASE WHEN abs(mdd) > 0.001 THEN ann / abs(mdd) ELSE 0 END AS calmar_ratio, coalesce(ma * 252 / nullif(te, 0), 0) AS information_ratio, beta,
  CASE WHEN n > 20 THEN ann - 0.0252 - beta * (bann - 0.0252) ELSE 0 END AS alpha, btr AS benchmark_total_return, bann AS benchmark_annualised_return, bvol AS benchmark_volatility,
  coalesce((mb - 0.0001) * 252 / nullif(bvol, 0), 0) AS benchmark_sharpe, hit AS hit_rate, pos / neg AS win_loss_ratio FROM (
  SELECT *, pow(1 + tr, 1 / greatest(n / 252.0, 0.1)) - 1 AS ann, pow(1 + btr, 1 / greatest(n / 252.0, 0.1)) - 1 AS bann, coalesce((m - 0.0001) * 252 / nullif(vol, 0), 0) AS sh,
    CASE WHEN n > 20 AND v > 0 THEN c / v ELSE 1 END AS beta FROM (
    SELECT {keys}, count(r) AS n, product(1 + r) - 1 AS tr, stddev_samp(r) * sqrt(252) AS vol, avg(r) AS m, stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252) AS down, min(dd) AS mdd,
      product(1 + bm) - 1 AS btr, stddev_samp(bm) * sqrt(252) AS bvol, avg(bm) AS mb, covar_samp(r, bm) AS c, var_samp(bm) AS v, stddev_samp(r - bm) * sqrt(252) AS te, avg(r - bm) AS ma,
      avg((r > 0)::INT) AS hit, avg(CASE WHEN r > 0 THEN r END) AS pos, coalesce(abs(avg(CASE WHEN r < 0 THEN r END)), 1) AS neg FROM (
      SELECT *, wealth / max(wealth) OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY {keys} ORDER BY ts)) AS wealth FROM ({source})))
    GROUP BY {keys} HAVING count(r) >= 20))"""


# Returns of the synthetic prices are noise of several hundred percent a day. CALM of them compounds to ordinary figures over
# years; the regimes take REGIME, so that their fixed limits of 20 % are crossed.
CALM, REGIME = 500, 50


def _metrics_out(sql: str, keys: str) -> str:
    return f"SELECT {keys}, n, " + ", ".join(f"R6({m}) AS {m}" for m in bt.METRICS) + f" FROM ({sql})"


@query("performance_metrics", _metrics_out(metrics_sql(f"SELECT asset, year(ts) AS fold, ts, r / {CALM} AS r, bm / {CALM} AS bm FROM ret_type JOIN bm_type USING (ts)", "asset, fold"), "asset, fold"))
def _(p):
    d = p.returns("p_type").join(p.benchmark("p_type"), "ts").select(
        "asset", F.year("ts").alias("fold"), "ts", (F.col("r") / CALM).alias("r"), (F.col("bm") / CALM).alias("bm"))
    return rounded(bt.performance_metrics(d, ["asset", "fold"]))


VIEWS["bt_train"] = "SELECT wf.fold, r.asset, avg(r) / stddev_samp(r) * 25 + 50 AS score FROM wf JOIN bt_ret r USING (ts) WHERE role = 'train' GROUP BY ALL"
VIEWS["bt_ret"] = f"SELECT ts, asset, r / {CALM} AS r FROM ret_ok"
VIEWS["bt_w"] = """
SELECT fold, asset, c / sum(c) OVER (PARTITION BY fold) AS w FROM (SELECT fold, asset, least(greatest(score, 0) / sum(greatest(score, 0)) OVER (PARTITION BY fold), 0.40) AS c FROM bt_train)"""
# Trades of a candidate in order of period and asset; the recursion carries its wealth from one to the next.
VIEWS["net_h"] = "SELECT h.candidate, h.ts AS period, n.nxt, h.asset, h.w FROM cand_targets h JOIN (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nxt FROM reb_m) n ON n.ts = h.ts"
VIEWS["net_g"] = """
SELECT asset, period, arg_max(g, ts) AS g FROM (
  SELECT r.asset, m.period, r.ts, exp(sum(ln(1 + r.r)) OVER (PARTITION BY r.asset, m.period ORDER BY r.ts)) AS g
  FROM bt_ret r JOIN (SELECT ts AS period, lead(ts) OVER (ORDER BY ts) AS nxt FROM reb_m) m ON r.ts >= m.period AND (m.nxt IS NULL OR r.ts < m.nxt)) GROUP BY ALL"""
VIEWS["net_d"] = """
SELECT candidate, nxt AS period, asset, w * g / sum(w * g) OVER (PARTITION BY candidate, period) AS drift, sum(w * g) OVER (PARTITION BY candidate, period) AS ratio, period AS before
FROM net_h JOIN net_g USING (asset, period)"""
VIEWS["net_path"] = gross_sql("cand_targets", "bt_ret", "candidate")
VIEWS["liq_type"] = VIEWS["liq"].replace("bars_brand", "bars_type")
VIEWS["net_t"] = f"""
SELECT candidate, period, asset, q, coalesce(adv, 50e6) AS adv, coalesce(vol, 0.015) AS vol, sum(q) OVER (PARTITION BY candidate, period) / 2 AS turnover,
  row_number() OVER (PARTITION BY candidate ORDER BY period, asset) AS k, coalesce(lag(period) OVER (PARTITION BY candidate ORDER BY period, asset) <> period, TRUE) AS opens FROM (
  SELECT t.*, l.adv, l.vol / {CALM} AS vol FROM (
    SELECT candidate, period, asset, abs(coalesce(w, 0) - coalesce(drift, 0)) AS q FROM net_h FULL JOIN (SELECT * FROM net_d WHERE period IS NOT NULL) USING (candidate, period, asset)) t
  ASOF LEFT JOIN liq_type l ON l.asset = t.asset AND l.ts <= t.period)"""


@query("portfolio_path_net", """
WITH RECURSIVE e AS (SELECT DISTINCT candidate, before AS period, ratio FROM net_d),
t AS (SELECT t.*, coalesce(e.ratio, 1) AS grown FROM net_t t LEFT JOIN (SELECT candidate, period, lead(period) OVER (PARTITION BY candidate ORDER BY period) AS nxt, ratio FROM e) e
  ON e.candidate = t.candidate AND e.nxt = t.period),
f AS (
  SELECT candidate, 0::BIGINT AS k, NULL::DATE AS period, 1e7::DOUBLE AS aum, 0::DOUBLE AS cost, 0::DOUBLE AS impact, 0::DOUBLE AS turnover FROM (SELECT DISTINCT candidate FROM t)
  UNION ALL
  SELECT candidate, k, period, a - paid, c + paid, i + hit, turnover FROM (
    SELECT *, size * 5 / 10000 + hit AS paid FROM (
      SELECT *, size * (0.3 * vol * sqrt(least(abs(size) / greatest(adv, 10000), 1)) * 10000) / 10000 AS hit FROM (
        SELECT t.candidate, t.k, t.period, t.q * (f.aum * CASE WHEN opens THEN grown ELSE 1 END) AS size, t.adv, t.vol, t.turnover, f.aum * CASE WHEN opens THEN grown ELSE 1 END AS a,
          CASE WHEN opens THEN 0 ELSE f.cost END AS c, CASE WHEN opens THEN 0 ELSE f.impact END AS i
        FROM f JOIN t ON t.candidate = f.candidate AND t.k = f.k + 1)))),
s AS (SELECT candidate, period, arg_max(aum, k) AS aum, arg_max(cost, k) AS cost, arg_max(impact, k) AS impact, max(turnover) AS turnover FROM f WHERE k > 0 GROUP BY 1, 2),
v AS (SELECT *, aum * ratio AS value FROM net_path JOIN s USING (candidate, period))
SELECT candidate, D(ts) AS ts, R2(value) AS value, R6(r_gross) AS r_gross, R6(value / coalesce(lag(value) OVER (PARTITION BY candidate ORDER BY ts), 1e7) - 1) AS r_net,
  R4(CASE WHEN ts = period THEN cost ELSE 0 END) AS cost, R4(CASE WHEN ts = period THEN impact ELSE 0 END) AS impact, R6(CASE WHEN ts = period THEN turnover ELSE 0 END) AS turnover FROM v""")
def _(p):
    t, r = _targets(p)
    r = r.withColumn("r", F.col("r") / CALM)
    liquidity = bt.adv_and_vol_asof(p.closes("p_type")).withColumn("vol", F.col("vol") / CALM)
    return rounded(bt.portfolio_path(t, r, liquidity, ["candidate"]), 6, value=2, cost=4, impact=4)


VIEWS["bt_test"] = "SELECT fold, ts, asset, r FROM wf JOIN bt_ret USING (ts) WHERE role = 'test'"
VIEWS["bt_targets"] = """
SELECT fold, ts, asset, w FROM (SELECT fold, max(ts) AS ts FROM bt_test GROUP BY fold, date_trunc('month', ts) UNION SELECT fold, min(ts) FROM bt_test GROUP BY fold) JOIN bt_w USING (fold)"""
VIEWS["bt_metrics"] = metrics_sql("SELECT fold, p.ts, r_gross AS r, coalesce(bm / " + str(CALM) + ", 0) AS bm FROM (" + gross_sql("bt_targets", "bt_test", "fold") + ") p LEFT JOIN bm_type USING (ts)", "fold")


def _backtest(p, liquidity=False):
    r = p.returns("p_type").withColumn("r", F.col("r") / CALM)
    folds = cv.walk_forward_splits(complete_dates(r).select("ts"))
    bm = p.benchmark("p_type").withColumn("bm", F.col("bm") / CALM)

    def score(train):
        return train.groupBy("fold", "asset").agg((F.avg("r") / F.stddev_samp("r") * 25 + 50).alias("score"))

    return bt.backtest(r, folds, score, bm, bt.adv_and_vol_asof(p.closes("p_type")) if liquidity else None)


@query("backtest", _metrics_out("SELECT * FROM bt_metrics", "fold"))
def _(p):
    return rounded(_backtest(p))


@query("backtest_with_costs")
def _(p):
    return rounded(_backtest(p, True).select("fold", "n", "sharpe_ratio", "total_transaction_costs", "total_market_impact_cost", "turnover", "n_rebalances"), 4)


@query("fold_summary", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, R4(avg({m})) AS mean, R4(stddev_pop({m})) AS std, R4(min({m})) AS min, R4(max({m})) AS max, count({m}) AS n_folds FROM bt_metrics" for m in bt.FOLD_METRICS))
def _(p):
    return rounded(bt.fold_summary(_backtest(p)), 4)


# -- regimes ------------------------------------------------------------------------------------------
VIEWS["reg_bb"] = f"""
SELECT ts, CASE WHEN c / lo - 1 > 0.20 THEN 'bull' WHEN c / hi - 1 < -0.20 THEN 'bear' ELSE 'neutral' END AS regime FROM (
  SELECT ts, c, max(c) OVER (ORDER BY ts) AS hi, min(c) OVER (ORDER BY ts) AS lo FROM (SELECT ts, exp(sum(ln(1 + bm / {REGIME})) OVER (ORDER BY ts)) AS c FROM bm_type))"""
VIEWS["reg_vol"] = """
SELECT ts, CASE WHEN v < lo THEN 'low_vol' WHEN v > hi THEN 'high_vol' ELSE 'normal_vol' END AS regime FROM reg_volv, (SELECT quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi FROM reg_volv)"""
VIEWS["reg_volv"] = f"SELECT ts, CASE WHEN count(*) OVER w = 63 THEN stddev_samp(bm / {REGIME}) OVER w * sqrt(252) END AS v FROM bm_type WINDOW w AS (ORDER BY ts ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
VIEWS["reg_mac"] = """
SELECT b.ts, CASE WHEN term_spread > 0 THEN 'expansion' WHEN term_spread < 0 THEN 'contraction' ELSE 'neutral' END AS regime FROM bm_type b JOIN macro_w ON last_day(b.ts) = month_end"""


def _bm(p):
    return p.benchmark("p_type").withColumn("bm", F.col("bm") / REGIME)


def _spread(p):
    w = _wide(p).select("month_end", "term_spread")
    return p.benchmark("p_type").withColumn("month_end", F.last_day("ts")).join(w, "month_end").select("ts", "term_spread")


@query("regime_bull_bear", "SELECT D(ts) AS ts, regime FROM reg_bb")
def _(p):
    return bt.regime_bull_bear(_bm(p))


@query("regime_volatility", "SELECT D(ts) AS ts, regime FROM reg_vol")
def _(p):
    return bt.regime_volatility(_bm(p))


@query("regime_macro", "SELECT D(ts) AS ts, regime FROM reg_mac")
def _(p):
    return bt.regime_macro(_spread(p))


def regime_sql(reg: str, scheme: str | None = None) -> str:
    return f"""
SELECT {f"'{scheme}' AS scheme, " if scheme else ''}asset, regime, R6(avg(r) * 252) AS port_return, R6(stddev_samp(r) * sqrt(252)) AS port_vol, R6(avg(r) * 252 / (stddev_samp(r) * sqrt(252))) AS port_sharpe, R6(min(dd)) AS port_max_dd,
  R6(avg(bm) * 252) AS bench_return, R6(avg(bm) * 252 / (stddev_samp(bm) * sqrt(252))) AS bench_sharpe FROM (
  SELECT *, w / max(w) OVER (PARTITION BY asset, regime ORDER BY ts) - 1 AS dd FROM (SELECT asset, regime, ts, r / {REGIME} AS r, bm / {REGIME} AS bm, exp(sum(ln(1 + r / {REGIME})) OVER (PARTITION BY asset, regime ORDER BY ts)) AS w
    FROM ret_type JOIN bm_type USING (ts) JOIN {reg} USING (ts))) GROUP BY asset, regime HAVING count(*) >= 2"""


def _asset_path(p):
    return p.returns("p_type").select("asset", "ts", (F.col("r") / REGIME).alias("r")).join(_bm(p), "ts")


@query("regime_performance", regime_sql("reg_vol"))
def _(p):
    return rounded(bt.regime_performance(_asset_path(p), bt.regime_volatility(_bm(p)), ["asset"]))


@query("regime_analysis", " UNION ALL ".join([regime_sql("reg_bb", "Bull_Bear"), regime_sql("reg_vol", "Volatility"), regime_sql("reg_mac", "Macro")]))
def _(p):
    return rounded(bt.regime_analysis(_asset_path(p), _bm(p), _spread(p), ["asset"]))


# -- significance -------------------------------------------------------------------------------------
def jkm_sql(source: str, strategy: str = "asset") -> str:
    return f"""
SELECT strategy_a, strategy_b, n, CASE WHEN theta > 0 THEN (sqrt(vb) * ma - sqrt(va) * mb) / sqrt(theta) ELSE 0 END AS z FROM (
  SELECT *, (2 * va * vb - 2 * sqrt(va) * sqrt(vb) * c + 0.5 * ma * ma * vb + 0.5 * mb * mb * va - ma * mb / (sqrt(va) * sqrt(vb)) * c * c) / n AS theta FROM (
    SELECT a.{strategy} AS strategy_a, b.{strategy} AS strategy_b, count(*) AS n, avg(a.r) AS ma, avg(b.r) AS mb, var_samp(a.r) AS va, var_samp(b.r) AS vb, covar_samp(a.r, b.r) AS c
    FROM {source} a JOIN {source} b ON a.ts = b.ts AND a.{strategy} < b.{strategy} GROUP BY 1, 2))"""


VIEWS["jkm_v"] = jkm_sql("ret_ok")


@query("jobson_korkie_memmel", f"SELECT strategy_a, strategy_b, n, R6(z) AS z_stat, R6(2 * (1 - {norm_cdf('abs(z)')})) AS p_value FROM jkm_v")
def _(p):
    return rounded(pt.jobson_korkie_memmel(complete_dates(p.returns("p_type")), "year(ts)"))


REPS = 1000


def boot_sql(source: str, strategy: str = "asset", reps: int = REPS) -> str:
    grid = f"SELECT rep, pos, n FROM (SELECT unnest(generate_series(0, {reps - 1})) AS rep), (SELECT unnest(generate_series(0, n - 1)) AS pos, n FROM (SELECT count(DISTINCT ts) AS n FROM {source}))"
    grid = sql_rounds(grid, sql_mix("rep", "pos", "1"), "x1")
    grid = sql_rounds(grid, sql_mix("rep", "pos", "2"), "x2")
    return f"""
SELECT rep, {strategy}, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std FROM (
  SELECT rep, pos, n, (o + pos - s) % n AS src FROM (SELECT rep, pos, n, last_value(s IGNORE NULLS) OVER w AS s, last_value(o IGNORE NULLS) OVER w AS o FROM (
    SELECT rep, pos, n, CASE WHEN st THEN pos END AS s, CASE WHEN st THEN x2 % n END AS o FROM (SELECT *, pos = 0 OR (x1 + 0.5::DOUBLE) / {MOD}.0::DOUBLE < 0.1::DOUBLE AS st FROM ({grid})))
    WINDOW w AS (PARTITION BY rep ORDER BY pos ROWS UNBOUNDED PRECEDING))) i
JOIN (SELECT {strategy}, r, row_number() OVER (PARTITION BY {strategy} ORDER BY ts) - 1 AS src FROM {source}) d USING (src) GROUP BY rep, {strategy}"""


VIEWS["boot_v"] = boot_sql("ret_ok")


@query("stationary_bootstrap", "SELECT rep, asset, n, R8(mean) AS mean, R8(std) AS std FROM boot_v")
def _(p):
    return rounded(pt.stationary_bootstrap(complete_dates(p.returns("p_type")), REPS), 8)


VIEWS["bootd_v"] = """
SELECT e.strategy_a, e.strategy_b, avg((abs(a.mean / a.std - b.mean / b.std - e.emp) >= abs(e.emp))::INT) AS p_value, any_value(e.emp) AS emp FROM boot_v a JOIN boot_v b ON a.rep = b.rep AND a.asset < b.asset
JOIN (SELECT x.asset AS strategy_a, y.asset AS strategy_b, x.sr - y.sr AS emp FROM (SELECT asset, avg(r) / stddev_samp(r) AS sr FROM ret_ok GROUP BY 1) x JOIN (SELECT asset, avg(r) / stddev_samp(r) AS sr FROM ret_ok GROUP BY 1) y ON x.asset < y.asset) e
  ON e.strategy_a = a.asset AND e.strategy_b = b.asset GROUP BY 1, 2"""


@query("bootstrap_sharpe_diff", "SELECT strategy_a, strategy_b, R6(p_value) AS p_value, R8(emp) AS sharpe_diff FROM bootd_v")
def _(p):
    return rounded(pt.bootstrap_sharpe_diff(complete_dates(p.returns("p_type")), REPS), 6, sharpe_diff=8)


VIEWS["ptests"] = f"""
SELECT asset, month, {norm_cdf('-abs(t)')} * 2 AS p FROM (SELECT asset, date_trunc('month', ts)::DATE AS month, avg(r) / (stddev_samp(r) / sqrt(count(*))) AS t FROM ret_brand GROUP BY ALL HAVING count(*) >= 3)"""


def _ptests(p):
    t = F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count("r")))
    g = p.returns().groupBy("asset", F.trunc("ts", "month").alias("month")).agg(F.count("r").alias("n"), F.count("r").alias("k"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    g = g.where("n >= 3").withColumn("t", F.col("m") / (F.col("s") / F.sqrt("n")))
    return g.select("asset", "month", (pt.norm_cdf(-F.abs("t")) * 2).alias("p"))


ADJ = {
    "bonferroni": "least(1, p * count(*) OVER (PARTITION BY month))",
    "benjamini_hochberg": "min(least(1, p * n / rk)) OVER (PARTITION BY month ORDER BY p DESC, asset ROWS UNBOUNDED PRECEDING)",
    "holm": "max(least(1, p * (n - rk + 1))) OVER (PARTITION BY month ORDER BY p, asset ROWS UNBOUNDED PRECEDING)",
}


def _adj_sql(name: str) -> str:
    return f"""SELECT asset, D(month) AS month, '{name}' AS method, R6(q) AS p_adjusted, q < 0.05 AS significant FROM (SELECT *, {ADJ[name]} AS q FROM (
SELECT *, count(*) OVER (PARTITION BY month) AS n, row_number() OVER (PARTITION BY month ORDER BY p, asset) AS rk FROM ptests))"""


@query("multiple_comparison", _adj_sql("bonferroni") + " UNION ALL " + _adj_sql("benjamini_hochberg"))
def _(p):
    t = _ptests(p)
    out = [pt.multiple_comparison(t, ["month"], method=m).withColumn("method", F.lit(m)) for m in ("bonferroni", "benjamini_hochberg")]
    return rounded(out[0].unionByName(out[1]).drop("p"))


@query("multiple_testing_holm", _adj_sql("holm"))
def _(p):
    return rounded(pt.multiple_comparison(_ptests(p), ["month"], method="holm").withColumn("method", F.lit("holm")).drop("p"))


VIEWS["strat"] = """
SELECT *, count(*) OVER () AS n_trials, var_samp(sharpe) OVER () AS variance FROM (SELECT asset AS strategy, count(r) AS n_obs, (avg(r) - 0.0001) / stddev_samp(r) AS sharpe,
  sqrt(count(r)) * sum(pow(r - m, 3)) / pow(sum(pow(r - m, 2)), 1.5) AS skew, kurtosis_pop(r) + 3 AS kurtosis FROM ret_brand JOIN (SELECT asset, avg(r) AS m FROM ret_brand GROUP BY asset) USING (asset) GROUP BY asset)"""
VIEWS["ems"] = f"SELECT *, CASE WHEN n_trials > 1 AND variance > 0 THEN sqrt(variance) * ((1 - {pt.GAMMA!r}) * {norm_ppf('1 - 1.0::DOUBLE / n_trials')} + {pt.GAMMA!r} * {norm_ppf('1 - 1.0::DOUBLE / (n_trials * 2.718281828459045::DOUBLE)')}) ELSE 0 END AS e FROM strat"


def _strategies(p):
    return pt.strategy_moments(p.returns().withColumnRenamed("asset", "strategy"), excess=0.0001)


@query("expected_max_sharpe", "SELECT strategy, n_trials, R8(variance) AS variance, R8(e) AS expected_max_sharpe FROM ems")
def _(p):
    return rounded(_strategies(p).withColumn("expected_max_sharpe", pt.expected_max_sharpe("n_trials", "variance")).select(
        "strategy", "n_trials", "variance", "expected_max_sharpe"), 8)


@query("deflated_sharpe", f"""
SELECT strategy, n_obs, R6(sharpe) AS sharpe, R6(skew) AS skew, R6(kurtosis) AS kurtosis, R6(e) AS expected_max_sharpe, R6({norm_cdf('z')}) AS dsr_probability
FROM (SELECT *, (sharpe - e) * sqrt(n_obs - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) AS z FROM ems)""")
def _(p):
    return rounded(pt.deflated_sharpe(_strategies(p)).select("strategy", "n_obs", "sharpe", "skew", "kurtosis", "expected_max_sharpe", "dsr_probability"))


def _qual_sql() -> str:
    import math
    z = math.sqrt(2 * math.log(10))
    null = (z + (1 - 0.5772156649) / z) / 252.0 ** 0.5
    return f"""SELECT *, s * sqrt(252) AS sr, greatest(s * sqrt(252) - {min(0.3 * math.log(10), 1.5)!r}, -2) AS haircut, (s - {null!r}::DOUBLE) * sqrt(n_obs - 1) / sqrt(greatest(1 - skew * s + (kurtosis - 1) / 4 * s * s, 0.001)) AS z
FROM (SELECT strategy, n_obs, skew, kurtosis, s FROM strat JOIN (SELECT asset AS strategy, avg(r) / stddev_samp(r) AS s FROM ret_brand GROUP BY asset) USING (strategy))"""


VIEWS["qual"] = _qual_sql()


@query("qualification_dsr", f"SELECT strategy, R6(sr) AS observed_sharpe, R6({norm_cdf('z')}) AS deflated_sharpe_ratio, R6(haircut) AS haircut_sharpe, R6(skew) AS skewness, R6(kurtosis) AS kurtosis, R6(0.3 * ln(10)) AS trials_penalty FROM qual")
def _(p):
    return rounded(pt.qualification_dsr(p.returns().withColumnRenamed("asset", "strategy")))


@query("qualification_verdict", f"""
WITH ir AS (SELECT asset AS strategy, avg(r - coalesce(bm, 0)) * 252 / (stddev_samp(r - coalesce(bm, 0)) * sqrt(252)) AS ir FROM ret_brand LEFT JOIN bm_brand USING (ts) GROUP BY asset),
dd AS (SELECT strategy, min(wealth / top - 1) AS mdd FROM (SELECT strategy, wealth, max(wealth) OVER (PARTITION BY strategy ORDER BY ts) AS top FROM (
  SELECT asset AS strategy, ts, exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY ts)) AS wealth FROM ret_brand)) GROUP BY strategy),
v AS (SELECT strategy, sr, {norm_cdf('z')} AS dsr, ir, mdd FROM qual JOIN ir USING (strategy) JOIN dd USING (strategy)),
s AS (SELECT *, CASE WHEN dsr < 0.50 THEN 'OVERFIT' WHEN sr < 0.40 OR ir < 0 THEN 'FAILED' WHEN abs(mdd) > 0.35 THEN 'FAILED' WHEN dsr < 0.85 THEN 'CONDITIONAL PASS' ELSE 'PASS' END AS st FROM v)
SELECT strategy, st AS qualification_status, CASE st WHEN 'PASS' THEN 'Scale / Multi-Asset Deployment' WHEN 'CONDITIONAL PASS' THEN 'Paper Trading / Small Capital Testing' WHEN 'OVERFIT' THEN 'Reject & Redesign Alpha' ELSE 'Reject' END AS deployment_stage,
  R6(sr) AS observed_sharpe, R6(dsr) AS deflated_sharpe_ratio, R6(ir) AS information_ratio,
  CASE WHEN st = 'OVERFIT' THEN printf('Deflated Sharpe ratio of %.1f%% is below 50%%: likely an effect of the trials', dsr * 100)
    WHEN st = 'FAILED' AND (sr < 0.40 OR ir < 0) THEN printf('Too little return for its risk: Sharpe %.2f, information ratio %.2f', sr, ir)
    WHEN st = 'FAILED' THEN printf('Largest drawdown of %.1f%% is beyond 35%%', abs(mdd) * 100)
    WHEN st = 'CONDITIONAL PASS' THEN printf('Deflated Sharpe ratio of %.1f%% asks for more dates out of sample', dsr * 100)
    ELSE printf('Deflated Sharpe ratio of %.1f%% holds after costs and trials', dsr * 100) END AS reasons FROM s""")
def _(p):
    d = p.returns().join(p.benchmark(), "ts", "left").select(F.col("asset").alias("strategy"), "ts", "r", "bm")
    return rounded(pt.qualification_verdict(d).select("strategy", "qualification_status", "deployment_stage", "observed_sharpe", "deflated_sharpe_ratio", "information_ratio", F.array_join("reasons", "; ").alias("reasons")))
