"""Factor and macro regressions."""

from ..functions.columns import rounded
from ..operators import regress as rg
from ..sources.files import month_end_series
from .assets import clip_sql
from .registry import query
from .shared_sql import VIEWS


def moments_sql(y: str, xs: list[str], over: str = "") -> str:
    """Sums of products, named as the Cholesky text below expects them."""
    v = ["1.0::DOUBLE", *xs]
    cols = [f"sum({v[i]} * {v[j]}) {over} AS a{j}_{i}" for i in range(len(v)) for j in range(i, len(v))]
    cols += [f"sum({v[i]} * {y}) {over} AS g{i}" for i in range(len(v))]
    return ", ".join([*cols, f"sum({y} * {y}) {over} AS yy"])


def ols_sql(source: str, k: int) -> str:
    """Solve the normal equations of each row by Cholesky: coefficients c0..ck, errors se0.., r2."""
    m = k + 1
    stages: list[list[str]] = []
    for j in range(m):
        col = {i: " - ".join([f"a{i}_{j}", *[f"l{i}_{q} * l{j}_{q}" for q in range(j)]]) for i in range(j, m)}
        stages.append([f"sqrt({col[j]}) AS l{j}_{j}"])
        stages.append([f"({col[i]}) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, m)])
    for i in range(m):
        # z solves L z = g; column t of the inverse factor gives the diagonal of the inverse.
        step = ["(" + " - ".join([f"g{i}", *[f"l{i}_{q} * z{q}" for q in range(i)]]) + f") / l{i}_{i} AS z{i}"]
        for t in range(i + 1):
            rhs = "1.0::DOUBLE" if i == t else "0.0::DOUBLE"
            step.append("(" + " - ".join([rhs, *[f"l{i}_{q} * u{q}_{t}" for q in range(t, i)]]) + f") / l{i}_{i} AS u{i}_{t}")
        stages.append(step)
    for i in reversed(range(m)):
        stages.append(["(" + " - ".join([f"z{i}", *[f"l{q}_{i} * c{q}" for q in range(i + 1, m)]]) + f") / l{i}_{i} AS c{i}"])
    stages.append(["yy - " + " - ".join(f"c{i} * g{i}" for i in range(m)) + " AS sse"]
                  + [" + ".join(f"u{i}_{t} * u{i}_{t}" for i in range(t, m)) + f" AS v{t}" for t in range(m)])
    stages.append(["1 - sse / (yy - g0 * g0 / a0_0) AS r2"] + [f"sqrt(v{i} * sse / (a0_0 - {m})) AS se{i}" for i in range(m)])
    out = source
    for st in stages:
        if st:
            out = f"SELECT *, {', '.join(st)} FROM ({out})"
    return out


VIEWS["monthly_p"] = "SELECT asset, CAST(date_trunc('month', ts) AS DATE) AS month, arg_max(close, ts) AS p FROM bars_brand GROUP BY 1, 2"
VIEWS["monthly_r"] = """
SELECT * FROM (SELECT asset, month, q / lag(q) OVER (PARTITION BY asset ORDER BY month) - 1 AS r FROM (
  SELECT asset, month, last_value(p IGNORE NULLS) OVER (PARTITION BY asset ORDER BY month) AS q FROM (
    SELECT asset, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM monthly_p GROUP BY asset) LEFT JOIN monthly_p USING (asset, month)))
WHERE r IS NOT NULL"""
VIEWS["fpanel"] = "SELECT asset, month, r, r - rf AS y, mkt_rf, smb, hml, wml FROM monthly_r JOIN factors USING (month)"
VIEWS["floads"] = ols_sql(f"SELECT asset, {moments_sql('y', rg.FACTORS)} FROM fpanel GROUP BY asset HAVING count(*) >= 12", 4)
NAMES = ["alpha", *[f"b_{x}" for x in rg.FACTORS]]
M_NAMES = ["alpha", *[f"b_{x}" for x in rg.MACRO_FEATURES]]


def _panel(p):
    return rg.factor_panel(p.closes(), p.factors())


@query("factor_columns", "SELECT D(month) AS month, R8(mkt_rf) AS mkt_rf, R8(smb) AS smb, R8(hml) AS hml, R8(rf) AS rf, R8(wml) AS wml FROM factors")
def _(p):
    f = p.factors().withColumnsRenamed({"mkt_rf": "Mkt-RF", "smb": "SMB", "hml": "HML", "rf": "RF", "wml": "Mom"})
    return rounded(rg.factor_columns(f), 8)


@query("factor_loadings", "SELECT asset, CAST(a0_0 AS BIGINT) AS n, R6(r2) AS r2, " + ", ".join(
    f"R6(c{i}) AS {n}, R5(c{i} / se{i}) AS t_{n}" for i, n in enumerate(NAMES)) + " FROM floads")
def _(p):
    d = rg.factor_loadings(_panel(p))
    return rounded(d.select("asset", "n", "r2", *NAMES, *[f"t_{n}" for n in NAMES]), 6, **{f"t_{n}": 5 for n in NAMES})


@query("factor_loadings_robust")
def _(p):
    return rounded(rg.factor_loadings_robust(_panel(p)), 5)


@query("rolling_factor_loadings", "SELECT asset, D(month) AS month, R6(r2) AS r2, " + ", ".join(f"R6(c{i}) AS {n}" for i, n in enumerate(NAMES)) + " FROM ("
       + ols_sql(f"SELECT * FROM (SELECT asset, month, {moments_sql('y', rg.FACTORS, 'OVER w')} FROM fpanel WINDOW w AS (PARTITION BY asset ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)) WHERE a0_0 = 36", 4) + ")")
def _(p):
    return rounded(rg.rolling_factor_loadings(_panel(p)).select("asset", "month", "r2", *NAMES))


@query("residual_information_ratio", """
WITH e AS (SELECT asset, y - (""" + " + ".join(f"c{i + 1} * {x}" for i, x in enumerate(rg.FACTORS)) + """) AS e FROM fpanel JOIN floads USING (asset)),
g AS (SELECT asset, avg(e) * 12 AS a, stddev_samp(e) * sqrt(12) AS v FROM e GROUP BY asset HAVING count(*) >= 12)
SELECT asset, R6(a / v) AS ir, R6(a) AS annualised_alpha, R6(v) AS idiosyncratic_vol,
  CASE WHEN a / v > 1 THEN 'Excellent' WHEN a / v > 0.5 THEN 'Good' WHEN a / v > 0 THEN 'Average' ELSE 'Negative' END AS interpretation FROM g""")
def _(p):
    d = _panel(p)
    return rounded(rg.residual_information_ratio(rg.residuals(d, rg.factor_loadings(d), with_alpha=False)))


_SYS = " + ".join(f"covar_samp({a}, {b}) * any_value(c{i + 1}) * any_value(c{j + 1})" for i, a in enumerate(rg.FACTORS) for j, b in enumerate(rg.FACTORS))


@query("variance_decomposition", f"""
SELECT asset, R8(tv) AS total_var, R8(sv) AS systematic_var, R8(tv - sv) AS idiosyncratic_var, R6(sv / tv) AS r_squared
FROM (SELECT asset, var_samp(r) AS tv, {_SYS} AS sv FROM fpanel JOIN floads USING (asset) GROUP BY asset)""")
def _(p):
    d = _panel(p)
    return rounded(rg.variance_decomposition(d, rg.factor_loadings(d)), 8, r_squared=6)


VIEWS["m4"] = f"""
SELECT asset, greatest(0, least(100, 50 + {clip_sql('c0 / se0', -3, 3)} / 3.0 * 25 + {clip_sql('(r2 - 0.40) / 0.30 * 10', -10, 10)})) AS score, c0 / se0 AS t_alpha, r2, a0_0 AS n FROM floads"""


@query("score_factors", "SELECT asset, R6(score) AS score, R5(t_alpha) AS t_alpha, R6(r2) AS r2, CAST(n AS BIGINT) AS n FROM m4")
def _(p):
    return rounded(rg.score_factors(_panel(p)), 6, t_alpha=5)


# -- macro ------------------------------------------------------------------------------------------
VIEWS["macro_m"] = """
SELECT series, month_end, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY month_end) AS value FROM (
  SELECT series, last_day(CAST(unnest(generate_series(date_trunc('month', min(ts)), (SELECT date_trunc('month', max(ts)) FROM macro_daily), INTERVAL 1 MONTH)) AS DATE)) AS month_end
  FROM macro_daily GROUP BY series)
LEFT JOIN (SELECT series, last_day(ts) AS month_end, arg_max(value, ts) AS value FROM macro_daily GROUP BY 1, 2) USING (series, month_end)"""
VIEWS["macro_w"] = "SELECT month_end, t10 - t2 AS term_spread, credit_spread, cpi, unemployment, fed_funds FROM (SELECT month_end, " + ", ".join(
    f"max(CASE WHEN series = '{s}' THEN value END) AS {n}" for s, n in (
        ("GS10", "t10"), ("GS2", "t2"), ("BAMLH0A0HYM2", "credit_spread"), ("CPIAUCSL", "cpi"), ("UNRATE", "unemployment"), ("FEDFUNDS", "fed_funds"))) + " FROM macro_m GROUP BY month_end)"
VIEWS["macro_f"] = "SELECT * FROM (SELECT month_end, " + ", ".join(f"lag({c}) OVER (ORDER BY month_end) AS {c}" for c in rg.MACRO_FEATURES) + " FROM (SELECT month_end, " + ", ".join(
    [f"{c} - lag({c}) OVER (ORDER BY month_end) AS delta_{c}" for c in ("term_spread", "credit_spread", "fed_funds")]
    + [f"{c} / lag({c}, 12) OVER (ORDER BY month_end) - 1 AS yoy_{c}" for c in ("cpi", "unemployment")]) + " FROM macro_w)) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in rg.MACRO_FEATURES)
VIEWS["mpanel"] = "SELECT asset, last_day(month) AS month_end, r AS y, " + ", ".join(rg.MACRO_FEATURES) + " FROM monthly_r JOIN macro_f ON last_day(month) = month_end"
VIEWS["mloads"] = ols_sql(f"SELECT asset, {moments_sql('y', rg.MACRO_FEATURES)} FROM mpanel GROUP BY asset HAVING count(*) >= 10", 5)
VIEWS["mpred"] = "SELECT asset, c0 + " + " + ".join(f"c{i + 1} * {c}" for i, c in enumerate(rg.MACRO_FEATURES)) + \
    " AS pred FROM mloads, (SELECT * FROM macro_f ORDER BY month_end DESC LIMIT 1)"


def _wide(p):
    return rg.macro_wide(month_end_series(p.macro_daily()))


@query("macro_features", "SELECT D(month_end) AS month_end, " + ", ".join(f"R8({c}) AS {c}" for c in rg.MACRO_FEATURES) + " FROM macro_f")
def _(p):
    return rounded(rg.macro_features(_wide(p)), 8)


@query("macro_regime", "SELECT D(month_end) AS month_end, R6(term_spread) AS term_spread, CASE WHEN term_spread < 0 THEN 'contraction' ELSE 'expansion' END AS regime FROM macro_w")
def _(p):
    return rounded(rg.macro_regime(_wide(p)), 6)


@query("macro_betas", "SELECT asset, CAST(a0_0 AS BIGINT) AS n, R6(r2) AS r2, " + ", ".join(
    f"R6(c{i}) AS {n}, R5(c{i} / se{i}) AS t_{n}" for i, n in enumerate(M_NAMES)) + " FROM mloads")
def _(p):
    d = rg.macro_betas(rg.macro_panel(p.closes(), rg.macro_features(_wide(p))))
    return rounded(d.select("asset", "n", "r2", *M_NAMES, *[f"t_{n}" for n in M_NAMES]), 6, **{f"t_{n}": 5 for n in M_NAMES})


@query("macro_betas_rolling", "SELECT asset, D(month_end) AS month_end, R5(r2) AS r2, " + ", ".join(f"R5(c{i}) AS {n}" for i, n in enumerate(M_NAMES)) + " FROM ("
       + ols_sql(f"SELECT * FROM (SELECT asset, month_end, {moments_sql('y', rg.MACRO_FEATURES, 'OVER w')} FROM mpanel WINDOW w AS (PARTITION BY asset ORDER BY month_end ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)) WHERE a0_0 = 36", 5) + ")")
def _(p):
    d = rg.macro_betas_rolling(rg.macro_panel(p.closes(), rg.macro_features(_wide(p))))
    return rounded(d.select("asset", "month_end", "r2", *M_NAMES), 5)


@query("macro_score", "SELECT asset, R6(pred) AS predicted_macro_return, CASE WHEN pred > 0 THEN 1 ELSE -1 END AS macro_tailwind FROM mpred")
def _(p):
    f = rg.macro_features(_wide(p))
    return rounded(rg.macro_score(f, rg.macro_betas(rg.macro_panel(p.closes(), f))))


@query("macro_stress", " UNION ALL ".join(
    f"SELECT asset, '{n}' AS scenario, R6(c0 + " + " + ".join(f"c{i + 1} * {s.get(c, 0.0)}" for i, c in enumerate(rg.MACRO_FEATURES)) + ") AS impact FROM mloads"
    for n, s in rg.MACRO_SHOCKS.items()))
def _(p):
    f = rg.macro_features(_wide(p))
    return rounded(rg.macro_stress(rg.macro_betas(rg.macro_panel(p.closes(), f))))


@query("score_macro", """
SELECT asset, CASE WHEN pred > 0.02 THEN 80.0 WHEN pred < -0.02 THEN 20.0 ELSE 50.0 END::DOUBLE AS score,
  (SELECT CASE WHEN term_spread < 0 THEN 'contraction' ELSE 'expansion' END FROM macro_w ORDER BY month_end DESC LIMIT 1) AS regime, R6(pred) AS predicted_macro_return FROM mpred""")
def _(p):
    return rounded(rg.score_macro(p.closes(), _wide(p)))
