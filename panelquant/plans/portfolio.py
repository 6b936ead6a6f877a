"""Risk, tail risk, matrix diagnostics, covariance and allocation."""

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import allocation as al
from ..operators import risk as rk
from .registry import query
from .shared_sql import VIEWS

S = "sqrt(252)"
RF = "(0.04::DOUBLE / 252)"


@query("volatility", """
WITH v AS (SELECT asset, ts, r, CASE WHEN count(r) OVER w = 63 THEN stddev_samp(r) OVER w * sqrt(252) END AS v FROM ret_brand WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, last(v) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM v)
SELECT asset, R6(stddev_samp(r) * sqrt(252)) AS volatility, R6(max(c)) AS current_rolling_vol,
  R6((count(*) FILTER (v < c) + count(*) FILTER (v <= c) + 1) / 2.0 / count(v)) AS percentile_of_current_vol FROM c GROUP BY asset""")
def _(p):
    return rounded(rk.volatility(p.returns(), window=63))


VIEWS["dd_v"] = "SELECT asset, CASE WHEN count(*) FILTER (r < 0) > 1 THEN sqrt(sum(pow(least(r, 0), 2)) / (count(r) - 1)) ELSE 0 END * sqrt(252) AS downside_dev, avg(r) AS m, stddev_samp(r) AS s FROM ret_brand GROUP BY asset"


@query("downside_deviation", "SELECT asset, R6(downside_dev) AS downside_dev FROM dd_v")
def _(p):
    return rounded(rk.downside_deviation(p.returns()))


@query("sharpe_ratio", f"SELECT asset, R6((m - {RF}) * 252) AS annualised_return, R6(s * {S}) AS annualised_vol, R6((m - {RF}) * 252 / (s * {S})) AS sharpe_ratio FROM dd_v")
def _(p):
    return rounded(rk.sharpe_ratio(p.returns()))


@query("sortino_ratio", f"SELECT asset, R6((m - {RF}) * 252 / downside_dev) AS sortino_ratio, R6(downside_dev) AS downside_dev FROM dd_v")
def _(p):
    return rounded(rk.sortino_ratio(p.returns()))


VIEWS["mdd_v"] = """
SELECT asset, any_value(dd) AS max_drawdown, any_value(peak_ts) AS start_date, any_value(trough) AS trough_date, min(ts) FILTER (ts >= trough AND close >= peak) AS recovery_date, max(ts) AS last
FROM bars_brand JOIN (
  SELECT asset, d.dd, d.ts AS trough, d.peak, (SELECT min(b.ts) FROM bars_brand b WHERE b.asset = x.asset AND b.close = d.peak) AS peak_ts FROM (
    SELECT asset, min({'dd': (close - peak) / peak, 'ts': ts, 'peak': peak}) AS d FROM (
      SELECT asset, ts, close, max(close) OVER (PARTITION BY asset ORDER BY ts) AS peak FROM bars_brand) GROUP BY asset) x) USING (asset) GROUP BY asset"""


@query("max_drawdown", """
SELECT asset, R8(max_drawdown) AS max_drawdown, D(start_date) AS start_date, D(trough_date) AS trough_date, D(recovery_date) AS recovery_date,
  D(coalesce(recovery_date, last)) AS end_date, date_diff('day', start_date, coalesce(recovery_date, last)) AS duration_days FROM mdd_v""")
def _(p):
    return rounded(rk.max_drawdown(p.closes()), 8)


def _var_sql(a: float) -> str:
    return f"""SELECT asset, {a}::DOUBLE AS level, -q AS var, greatest(-q, -avg(r) FILTER (r <= q)) AS cvar, 'historical' AS method
FROM ret_brand JOIN (SELECT asset, quantile_cont(r, {1 - a!r}) AS q FROM ret_brand GROUP BY asset) USING (asset) GROUP BY asset, q"""


def _par_sql(a: float) -> str:
    z = NormalDist().inv_cdf(1 - a)
    return f"""SELECT asset, {a}::DOUBLE, -(m + ({z!r}) * s), greatest(-(m + ({z!r}) * s), -(m - s * {NormalDist().pdf(z) / (1 - a)!r}::DOUBLE)), 'parametric' FROM dd_v"""


VIEWS["var95"] = _var_sql(0.95)


@query("value_at_risk", "SELECT asset, level, R6(var) AS var, R6(cvar) AS cvar, method FROM (" + " UNION ALL ".join([_var_sql(0.95), _var_sql(0.99), _par_sql(0.95), _par_sql(0.99)]) + ")")
def _(p):
    r = p.returns()
    return rounded(rk.value_at_risk(r).unionByName(rk.value_at_risk(r, method="parametric")))


VIEWS["beta_v"] = """
SELECT asset, covar_samp(r, bm) / var_samp(bm) AS beta, pow(corr(r, bm), 2) AS r2, covar_samp(r, bm) AS c, var_samp(bm) AS v, var_samp(r) AS vx FROM ret_brand JOIN bm_brand USING (ts) GROUP BY asset"""


@query("beta", """
WITH w AS (SELECT asset, ts, CASE WHEN count(*) OVER w = 252 THEN covar_samp(r, bm) OVER w / var_samp(bm) OVER w END AS rb FROM ret_brand JOIN bm_brand USING (ts)
  WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
SELECT b.asset, R6(beta) AS beta, R6(r2) AS r_squared, R6(sqrt(vx - 2 * beta * c + beta * beta * v) * sqrt(252)) AS residual_vol, R6(l.rb) AS rolling_beta
FROM beta_v b JOIN (SELECT asset, last(rb ORDER BY ts) AS rb FROM w GROUP BY asset) l USING (asset)""")
def _(p):
    return rounded(rk.beta(p.returns(), p.benchmark()).drop("n"))


VIEWS["risk_v"] = f"""
SELECT asset, s * {S} AS volatility, max_drawdown, beta, downside_dev, (m - {RF}) * 252 / (s * {S}) AS sharpe_ratio, (m - {RF}) * 252 / downside_dev AS sortino_ratio,
  least(greatest(s * {S} / 0.4 * 100, 0), 100) AS vs, least(greatest(-max_drawdown / 0.5 * 100, 0), 100) AS ds, least(greatest((beta - 0.5) / 1.5 * 100, 0), 100) AS bs
FROM dd_v JOIN mdd_v USING (asset) JOIN beta_v USING (asset)"""


@query("risk_summary", "SELECT asset, R6(vs) AS volatility_score, R6(ds) AS drawdown_score, R6(bs) AS beta_score, R6(0.4 * vs + 0.4 * ds + 0.2 * bs) AS risk_score FROM risk_v")
def _(p):
    v = rk.volatility(p.returns()).join(rk.max_drawdown(p.closes()).select("asset", "max_drawdown"), "asset").join(
        rk.beta(p.returns(), p.benchmark()).select("asset", "beta"), "asset")
    return rounded(rk.risk_summary(v).select("asset", "volatility_score", "drawdown_score", "beta_score", "risk_score"))


VIEWS["m5"] = "SELECT asset, 100 - (0.4 * vs + 0.4 * ds + 0.2 * bs) AS score FROM risk_v"


@query("score_risk", """
SELECT asset, R6(score) AS score, R6(volatility) AS volatility, R6(max_drawdown) AS max_drawdown, R6(beta) AS beta, R6(downside_dev) AS downside_dev,
  R6(sharpe_ratio) AS sharpe_ratio, R6(sortino_ratio) AS sortino_ratio, R6(var) AS var_95, R6(cvar) AS cvar_95 FROM m5 JOIN risk_v USING (asset) JOIN var95 USING (asset)""")
def _(p):
    d = rk.score_risk(p.closes(), p.returns(), p.benchmark())
    return rounded(d.select("asset", "score", "volatility", "max_drawdown", "beta", "downside_dev", "sharpe_ratio", "sortino_ratio", "var_95", "cvar_95"))


# -- tails --------------------------------------------------------------------------------------------
VIEWS["ret_ok"] = "SELECT * FROM ret_type WHERE ts IN (SELECT ts FROM ret_type GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT asset) FROM ret_type))"
BLOCK = "floor(ts / 4096)"  # bounds the dates of one task of the vector panel


@query("copula_rank_correlation", """
WITH u AS (SELECT ts, asset, (rank() OVER (PARTITION BY asset ORDER BY r) + (count(*) OVER (PARTITION BY asset, r) - 1) / 2.0 - 0.5)::DOUBLE / count(*) OVER (PARTITION BY asset) AS u FROM vec_ret),
q AS (SELECT ts, asset, sign(u - 0.5) * 2 * sqrt(greatest(cos(acos(sqrt(4 * u * (1 - u))) / 3) / sqrt(4 * u * (1 - u)) - 1, 0)) AS q FROM u)
SELECT a.asset AS a, b.asset AS b, R6(CASE WHEN a.asset = b.asset THEN 1 ELSE corr(a.q, b.q) END) AS corr FROM q a JOIN q b ON a.ts = b.ts AND a.asset <= b.asset GROUP BY 1, 2""")
def _(p):
    return rounded(rk.copula_rank_correlation(p.vector_returns(), BLOCK))


@query("joint_tail_risk", """
WITH path AS (SELECT candidate, ts, sum(w * r) AS r FROM ret_ok JOIN candidate_weights USING (asset) GROUP BY 1, 2),
q AS (SELECT candidate, quantile_cont(r, 0.01) AS q FROM path GROUP BY 1),
crash AS (SELECT avg(c) AS p FROM (SELECT ts, (count(*) FILTER (r < -0.05) >= count(*) / 2)::INT AS c FROM ret_ok GROUP BY ts))
SELECT candidate, R6(-q) AS var_99, R6(greatest(-q, -avg(r) FILTER (r <= q + 1e-12))) AS cvar_99, R6(any_value(p)) AS joint_crash_probability
FROM path JOIN q USING (candidate), crash GROUP BY candidate, q""")
def _(p):
    return rounded(rk.joint_tail_risk(p.returns("p_type"), p.candidate_weights()))


@query("lower_tail_dependence", """
WITH t AS (SELECT asset, ts, r <= quantile_cont(r, 0.05) OVER (PARTITION BY asset) AS low FROM ret_brand)
SELECT a.asset AS a, b.asset AS b, count(*) AS n, count(*) FILTER (a.low AND b.low) AS "both", R6(count(*) FILTER (a.low AND b.low) / (count(*) * 0.05)) AS dependence
FROM t a JOIN t b ON a.ts = b.ts AND a.asset < b.asset GROUP BY 1, 2""")
def _(p):
    return rounded(rk.lower_tail_dependence(p.returns()))


@query("evt_peaks_over_threshold", """
WITH l AS (SELECT asset, -r AS x FROM ret_brand), c AS (SELECT asset, quantile_cont(x, 0.95) AS u, quantile_cont(x, 0.99) AS q, count(*) AS n FROM l GROUP BY asset),
g AS (SELECT asset, any_value(u) AS u, any_value(q) AS q, any_value(n) AS n, count(*) FILTER (x > u) AS k, avg(x - u) FILTER (x > u) AS m, var_samp(x - u) FILTER (x > u) AS s2 FROM l JOIN c USING (asset) GROUP BY asset),
f AS (SELECT *, 0.5 * (1 - m * m / s2) AS xi, 0.5 * m * (m * m / s2 + 1) AS b FROM g), v AS (SELECT *, u + b / xi * (pow((n / k) * (1 - 0.99::DOUBLE), -xi) - 1) AS v FROM f)
SELECT asset, 'success' AS status, R6(u) AS threshold_u, R6(xi) AS shape_xi, R6(b) AS scale_beta, R6(v) AS evt_var, R6((v + b - xi * u) / (1 - xi)) AS evt_cvar, k AS n_exceedances FROM v""")
def _(p):
    return rounded(rk.evt_peaks_over_threshold(p.returns()))


VIEWS["pbeta"] = "SELECT portfolio, sum(w * coalesce(beta, 1)) AS pb FROM target_weights LEFT JOIN (SELECT asset, beta FROM info WHERE quote_type <> 'ETF') USING (asset) GROUP BY portfolio"


def _betas(p):
    return p.info().where("quote_type <> 'ETF'")


@query("scenario_stress", " UNION ALL ".join(
    f"SELECT portfolio, '{n}' AS scenario, '{d}' AS scenario_name, R6(pb * ({s})) AS projected_portfolio_loss, pb * ({s}) > -0.35 AS portfolio_survival FROM pbeta"
    for n, d, s in rk.STRESS_SCENARIOS))
def _(p):
    return rounded(rk.scenario_stress(p.target_weights(), _betas(p)))


@query("reverse_stress", """
SELECT portfolio, -0.2::DOUBLE AS target_portfolio_loss, R6(pb) AS portfolio_weighted_beta, R6(t) AS market_drawdown_trigger,
  CASE WHEN abs(t) < 0.15 THEN 'HIGH' WHEN abs(t) < 0.25 THEN 'MODERATE' ELSE 'LOW' END AS vulnerability_rating FROM (SELECT *, CASE WHEN pb = 0 THEN -0.2 ELSE -0.2 / pb END AS t FROM pbeta)""")
def _(p):
    return rounded(rk.reverse_stress(p.target_weights(), _betas(p)))


# -- matrices -----------------------------------------------------------------------------------------
YEARLY = "month(ts)"


def _yearly(p):
    return p.returns("p_type").withColumn("year", F.year("ts"))


def _yearly_cov(p, method="sample"):
    return al.covariance(_yearly(p), YEARLY, method, ["year"])


VIEWS["year_ok"] = "SELECT y.* FROM (SELECT *, year(ts) AS year FROM ret_type) y JOIN (SELECT year, ts FROM (SELECT year(ts) AS year, ts, count(*) AS k FROM ret_type GROUP BY ALL) JOIN (SELECT year(ts) AS year, count(DISTINCT asset) AS n FROM ret_type GROUP BY 1) USING (year) WHERE k = n) USING (year, ts)"
VIEWS["year_cov"] = "SELECT a.year, a.asset AS a, b.asset AS b, covar_samp(a.r, b.r) * 252 AS value FROM year_ok a JOIN year_ok b ON a.year = b.year AND a.ts = b.ts AND a.asset <= b.asset GROUP BY ALL"


@query("eigenvalue_spectrum")
def _(p):
    return rounded(rk.eigenvalue_spectrum(_yearly_cov(p), "year"))


@query("condition_number")
def _(p):
    return rounded(rk.condition_number(_yearly_cov(p), "year"))


@query("effective_rank")
def _(p):
    return rounded(rk.effective_rank(_yearly_cov(p), "year"))


@query("participation_ratio", """
SELECT year, R6(pow(sum(CASE WHEN a = b THEN value ELSE 0 END), 2) / sum(CASE WHEN a = b THEN 1 ELSE 2 END * value * value)) AS participation_ratio FROM year_cov GROUP BY year""")
def _(p):
    return rounded(rk.participation_ratio(_yearly_cov(p), "year"))


VIEWS["vec_pairs"] = """
SELECT a.asset AS a, b.asset AS b, count(*) AS n, covar_samp(a.x, b.x) AS cs, covar_pop(a.x, b.x) AS c, sum(a.x * a.x * b.x * b.x) AS q FROM
(SELECT ts, asset, r - avg(r) OVER (PARTITION BY asset) AS x FROM vec_ret) a JOIN (SELECT ts, asset, r - avg(r) OVER (PARTITION BY asset) AS x FROM vec_ret) b ON a.ts = b.ts AND a.asset <= b.asset GROUP BY 1, 2"""
VIEWS["vec_lw"] = """
SELECT mu, CASE WHEN beta = 0 THEN 0 ELSE least(beta, delta) / delta END AS shrink FROM (SELECT mu, (d - 2 * mu * tr + p * mu * mu) / p AS delta, (b / n - d) / (p * n) AS beta FROM (
  SELECT *, tr / p AS mu FROM (SELECT max(n) AS n, sum((a = b)::INT) AS p, sum(CASE WHEN a = b THEN c END) AS tr, sum(CASE WHEN a = b THEN 1 ELSE 2 END * c * c) AS d,
    sum(CASE WHEN a = b THEN 1 ELSE 2 END * q) AS b FROM vec_pairs)))"""


@query("covariance", """
SELECT 'sample' AS method, a, b, R6(cs * 252) AS value FROM vec_pairs
UNION ALL SELECT 'ledoit_wolf', a, b, R6(((1 - shrink) * c + CASE WHEN a = b THEN shrink * mu ELSE 0 END) * 252) FROM vec_pairs, vec_lw""")
def _(p):
    m = al.centred_moments(p.vector_returns(), [], BLOCK)
    both = al.sample_covariance(m, []).withColumn("method", F.lit("sample")).unionByName(
        al.ledoit_wolf(m, []).drop("shrinkage").withColumn("method", F.lit("ledoit_wolf")))
    return rounded(both)


def _views(p, group="year"):
    s = p.returns("p_type").groupBy("asset", F.year("ts").alias("year")).agg(F.avg("r").alias("q"))
    return s.withColumn("w_mkt", F.lit(None).cast("double"))


@query("black_litterman")
def _(p):
    cov = al.psd_floor(_yearly_cov(p, "ledoit_wolf"), "year")
    return rounded(al.black_litterman(cov, _views(p), "year"))


@query("hrp_weights")
def _(p):
    m = al.centred_moments(_yearly(p), ["year"], YEARLY)
    return rounded(al.hrp_weights(al.sample_covariance(m, ["year"]), rk.correlation(m, ["year"]), "year"))


@query("candidate_portfolio_scoring", """
WITH ok AS (SELECT candidate FROM candidate_weights GROUP BY 1 HAVING min(w) >= 0 AND max(w) <= 0.40 AND abs(sum(w) - 1) < 1e-9), w AS (SELECT * FROM candidate_weights WHERE candidate IN (SELECT candidate FROM ok)),
cov AS (SELECT a.asset AS a, b.asset AS b, covar_samp(a.r, b.r) * 252 AS v FROM ret_ok a JOIN ret_ok b USING (ts) GROUP BY 1, 2), mu AS (SELECT asset, avg(r) * 252 AS mu FROM ret_ok GROUP BY 1),
s AS (SELECT candidate, er, ev, (er - 0.04) / ev AS sr FROM (SELECT candidate, sum(w * mu) AS er FROM w JOIN mu USING (asset) GROUP BY 1)
  JOIN (SELECT x.candidate, sqrt(sum(x.w * y.w * v)) AS ev FROM w x JOIN cov ON x.asset = cov.a JOIN w y ON y.candidate = x.candidate AND y.asset = cov.b GROUP BY 1) USING (candidate))
SELECT candidate, R6(er) AS expected_return, R6(ev) AS expected_volatility, R6(sr) AS sharpe_ratio, sr = (SELECT max(sr) FROM s) AS best FROM s""")
def _(p):
    r = rk.complete_dates(p.returns("p_type"))
    mu = r.groupBy("asset").agg((F.avg("r") * 252).alias("mu"))
    cov = al.covariance(p.returns("p_type"), "year(ts)", "sample")
    return rounded(al.candidate_portfolio_scoring(p.candidate_weights(), mu, cov))


@query("allocate")
def _(p):
    scores = p.returns("p_type").groupBy("asset").agg((50 + F.avg("r") * 100).alias("score"))
    return rounded(al.allocate(_yearly(p), scores, YEARLY, "year"))
