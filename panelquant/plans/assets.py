"""Fundamentals, valuation, time-series analytics and price factors."""

import datetime as dt

from ..functions.columns import rounded
from ..operators import fundamentals as fd
from ..operators import timeseries as tsr
from .panel import MONTHS_SQL, months, sql_dates
from .registry import query
from .shared_sql import VIEWS

LAST = [dt.date(2001, 6, 29)]


def _fin_sql() -> str:
    wants = ", ".join(f"('{k}', '{s}', '{i}')" for k, (s, i) in fd.ITEM_NAMES.items())
    cols = ", ".join(f"max(CASE WHEN name = '{n}' AND pos = {k} THEN value END) AS {n}_{k}" for n in fd.ITEM_NAMES for k in range(3))
    return f"""
SELECT asset, {cols} FROM (
  SELECT asset, name, pos, value, item, inexact, min(inexact || item) OVER (PARTITION BY asset, name) AS best, inexact || item AS mine FROM (
    SELECT s.asset, w.name, s.pos, s.value, s.item, CASE WHEN s.item = w.want THEN '0' ELSE '1' END AS inexact
    FROM (SELECT *, dense_rank() OVER (PARTITION BY asset, stmt ORDER BY period_end DESC) - 1 AS pos FROM stmts WHERE period_end + 45 <= (SELECT max(ts) FROM bars_brand)) s
    JOIN (VALUES {wants}) w(name, stmt, want) ON s.stmt = w.stmt AND contains(lower(s.item), lower(w.want))))
WHERE mine = best GROUP BY asset"""


VIEWS["fin"] = _fin_sql()


def _fin(p):
    return fd.statement_item(fd.published(p.statements(), p.closes()))


SHOW = ["ni_0", "ni_1", "ca_0", "cl_0", "ebit_0", "ebitda_0", "cdebt_0", "cfo_0", "fcf_1"]


@query("statement_item", "SELECT asset, " + ", ".join(f"R2({c}) AS {c}" for c in SHOW) + " FROM fin")
def _(p):
    return rounded(_fin(p).select("asset", *SHOW), 2)


VIEWS["fscore_v"] = """
SELECT *, (f1 IS NOT NULL)::BIGINT + (f2 IS NOT NULL)::BIGINT + (f3 IS NOT NULL)::BIGINT + (f4 IS NOT NULL)::BIGINT + (f5 IS NOT NULL)::BIGINT
  + (f6 IS NOT NULL)::BIGINT + (f7 IS NOT NULL)::BIGINT + (f8 IS NOT NULL)::BIGINT + (f9 IS NOT NULL)::BIGINT AS valid_signals,
  coalesce(f1, 0) + coalesce(f2, 0) + coalesce(f3, 0) + coalesce(f4, 0) + coalesce(f5, 0) + coalesce(f6, 0) + coalesce(f7, 0) + coalesce(f8, 0) + coalesce(f9, 0) AS total
FROM (SELECT *, (ni_0 / nullif(assets_1, 0) > 0)::INT AS f1, (cfo_0 > 0)::INT AS f2, (ni_0 / nullif(assets_1, 0) > ni_1 / nullif(assets_2, 0))::INT AS f3,
 (cfo_0 > ni_0)::INT AS f4, (ltd_0 < ltd_1)::INT AS f5, (ca_0 / nullif(cl_0, 0) > ca_1 / nullif(cl_1, 0))::INT AS f6, (shares_0 <= shares_1)::INT AS f7,
 (gross_0 / nullif(rev_0, 0) > gross_1 / nullif(rev_1, 0))::INT AS f8, (rev_0 / nullif(assets_1, 0) > rev_1 / nullif(assets_2, 0))::INT AS f9 FROM fin)"""


@query("piotroski_fscore", "SELECT asset, CASE WHEN valid_signals > 0 THEN CAST(total AS DOUBLE) END AS fscore, valid_signals FROM fscore_v")
def _(p):
    return fd.piotroski_fscore(_fin(p)).select("asset", "fscore", "valid_signals")


VIEWS["roic_v"] = """
SELECT *, ebit_0 * (1.0 - 0.21) AS nopat, coalesce(debt_0, coalesce(ltd_0, 0) + coalesce(cdebt_0, 0)) + equity_0 - coalesce(cash_0, 0) AS cap FROM fscore_v"""


@query("roic", "SELECT asset, R2(nopat) AS nopat, R2(cap) AS invested_capital, R6(CASE WHEN cap > 0 THEN nopat / cap END) AS roic FROM roic_v")
def _(p):
    return rounded(fd.roic(_fin(p)).select("asset", "nopat", "invested_capital", "roic"), 2, roic=6)


ACCR = "(ni_0 - cfo_0) / nullif(coalesce((assets_0 + assets_1) / 2.0, assets_0), 0)"


@query("accruals_ratio", f"SELECT asset, R6({ACCR}) AS accruals FROM fin")
def _(p):
    return rounded(fd.accruals_ratio(_fin(p)).select("asset", "accruals"))


VIEWS["altman_v"] = f"""
SELECT r.*, i.market_cap, i.quote_type, {ACCR} AS accruals, CASE WHEN assets_0 <> 0 THEN
  1.2 * coalesce((ca_0 - cl_0) / assets_0, 0) + 1.4 * coalesce(re_0 / assets_0, 0) + 3.3 * coalesce(ebit_0 / assets_0, 0)
  + 0.6 * coalesce(coalesce(nullif(i.market_cap, 0), assets_0) / nullif(tl_0, 0), 1) + 1.0 * coalesce(rev_0 / assets_0, 0) END AS z
FROM roic_v r LEFT JOIN info i USING (asset)"""


@query("altman_z", "SELECT asset, R6(z) AS z_score, CASE WHEN z IS NULL THEN 'unknown' WHEN z > 2.99 THEN 'safe' WHEN z < 1.81 THEN 'distress' ELSE 'grey' END AS zone FROM altman_v")
def _(p):
    d = _fin(p).join(p.info().select("asset", "market_cap"), "asset", "left")
    return rounded(fd.altman_z(d).select("asset", "z_score", "zone"))


def clip_sql(x: str, lo, hi) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {float(lo)}::DOUBLE), {float(hi)}::DOUBLE) END"


def mean_sql(parts: list[str]) -> tuple[str, str]:
    n = " + ".join(f"(({x}) IS NOT NULL)::INT" for x in parts)
    s = " + ".join(f"coalesce({x}, 0)" for x in parts)
    return f"(({s}) / nullif({n}, 0))", f"({n})"


_m1, _n1 = mean_sql(["CASE WHEN valid_signals > 0 THEN total / 9.0::DOUBLE * 100 END", clip_sql("CASE WHEN cap > 0 THEN nopat / cap END / 0.25 * 100", 0, 100),
                     clip_sql("(z - 1.0) / 4.0 * 100", 0, 100), clip_sql("(0.10 - accruals) / 0.20 * 100", 0, 100)])
VIEWS["m1"] = f"""
SELECT asset, CASE WHEN quote_type = 'ETF' THEN 50.0::DOUBLE ELSE coalesce({_m1}, 50) END AS score,
  CASE WHEN quote_type = 'ETF' THEN 1.0::DOUBLE WHEN {_n1} > 0 THEN {_n1} / 4.0::DOUBLE ELSE 0.2::DOUBLE END AS confidence FROM altman_v"""


@query("score_fundamentals", "SELECT asset, R6(score) AS score, R6(confidence) AS confidence FROM m1")
def _(p):
    return rounded(fd.score_fundamentals(_fin(p), p.info()).select("asset", "score", "confidence"))


VIEWS["wacc_v"] = """
SELECT *, greatest(CASE WHEN weight_debt = 0 THEN ke ELSE weight_equity * ke + weight_debt * kd * (1 - tax_rate) END, 0.05) AS wacc FROM (
 SELECT *, CASE WHEN levered THEN equity_0 / (equity_0 + dt) ELSE 1 END AS weight_equity, CASE WHEN levered THEN dt / (equity_0 + dt) ELSE 0 END AS weight_debt,
  CASE WHEN dt > 0 THEN coalesce(CASE WHEN interest_0 IS NOT NULL THEN greatest(0.02, least(abs(interest_0) / dt, 0.15)) END, 0.02) ELSE 0.05 END AS kd FROM (
  SELECT *, 0.04 + greatest(1.0, 0.2) * 0.055 AS ke, coalesce(dt > 0 AND equity_0 > 0, FALSE) AS levered,
   CASE WHEN ebt_0 > 0 AND tax_0 IS NOT NULL THEN greatest(0.0::DOUBLE, least(tax_0 / ebt_0, 0.40::DOUBLE)) ELSE 0.21 END AS tax_rate FROM (
   SELECT f.*, CASE WHEN coalesce(ltd_0, 0) + coalesce(cdebt_0, sdebt_0, 0) = 0 THEN debt_0 ELSE coalesce(ltd_0, 0) + coalesce(cdebt_0, sdebt_0, 0) END AS dt,
     i.quote_type, coalesce(i.shares_outstanding, f.shares_0, 1e9) AS so, x.price
   FROM fin f LEFT JOIN info i USING (asset) LEFT JOIN (SELECT asset, arg_max(close, ts) AS price FROM bars_brand GROUP BY asset) x USING (asset))))"""


@query("wacc", "SELECT asset, R6(wacc) AS wacc, R6(ke) AS ke, R6(kd) AS kd, R6(weight_equity) AS weight_equity, R6(weight_debt) AS weight_debt, R6(tax_rate) AS tax_rate FROM wacc_v")
def _(p):
    return rounded(fd.wacc(_fin(p)).select("asset", "wacc", "ke", "kd", "weight_equity", "weight_debt", "tax_rate"))


def _dcf_sql() -> str:
    specs = {"bear": ("greatest(g - 0.05, -0.05)", "wacc + 0.01"), "base": ("g", "wacc"), "bull": ("least(g + 0.05, 0.25)", "greatest(wacc - 0.01, 0.05)")}
    inner = ", ".join(f"CAST({g} AS DOUBLE) AS g_{n}, CAST(greatest({w}, {fd.SCENARIOS[n][1] + 0.015}) AS DOUBLE) AS w_{n}" for n, (g, w) in specs.items())
    vals = ", ".join(
        f"CASE WHEN fcf_0 > 0 AND so > 0 THEN greatest((" + " + ".join(f"fcf_0 * pow((1 + g_{n}) / (1 + w_{n}), {t})" for t in range(1, 6))
        + f" + fcf_0 * pow((1 + g_{n}) / (1 + w_{n}), 5) * {1 + fd.SCENARIOS[n][1]} / (w_{n} - {fd.SCENARIOS[n][1]}) + coalesce(cash_0, 0) - coalesce(debt_0, 0)) / so, 0) END AS value_{n}"
        for n in specs)
    return f"""
SELECT *, CASE WHEN iv > 0 THEN (iv - price) / iv END AS mos FROM (SELECT *, value_bear * 0.25 + value_base * 0.5 + value_bull * 0.25 AS iv FROM (
SELECT *, {vals} FROM (SELECT *, {inner} FROM (
SELECT *, greatest(-0.05, least(0.20, coalesce((fcf_0 - fcf_1) / nullif(abs(fcf_1), 0), 0.05))) AS g FROM wacc_v))))"""


VIEWS["dcf_v"] = _dcf_sql()


def _val(p):
    return fd.wacc(fd.valuation_inputs(_fin(p), p.info(), p.closes()))


@query("scenario_dcf", """
SELECT asset, R2(value_bear) AS value_bear, R2(value_base) AS value_base, R2(value_bull) AS value_bull, R2(iv) AS intrinsic_value, R6(mos) AS margin_of_safety,
  CASE WHEN fcf_0 > 0 AND so > 0 THEN 'success' ELSE 'negative_or_missing_fcf' END AS status FROM dcf_v""")
def _(p):
    d = fd.scenario_dcf(_val(p))
    return rounded(d.select("asset", "value_bear", "value_base", "value_bull", "intrinsic_value", "margin_of_safety", "status"), 2, margin_of_safety=6)


REL = """CASE WHEN ni_0 > 0 THEN price * so / ni_0 END AS pe, CASE WHEN equity_0 > 0 THEN price * so / equity_0 END AS pb,
CASE WHEN rev_0 > 0 THEN price * so / rev_0 END AS ps, CASE WHEN ebitda_0 > 0 THEN (price * so + coalesce(debt_0, 0) - coalesce(cash_0, 0)) / ebitda_0 END AS ev"""


@query("relative_valuation", f"SELECT asset, R6(pe) AS pe_ratio, R6(pb) AS pb_ratio, R6(ps) AS ps_ratio, R6(ev) AS ev_ebitda FROM (SELECT *, {REL} FROM dcf_v)")
def _(p):
    return rounded(fd.relative_valuation(_val(p)).select("asset", "pe_ratio", "pb_ratio", "ps_ratio", "ev_ebitda"))


_m2, _n2 = mean_sql([clip_sql("100.0 / (1.0 + exp(-3.0 * mos))", 5, 95), clip_sql("100.0 / (1.0 + exp(0.08::DOUBLE * (pe - 22.0)))", 5, 95),
                     clip_sql("CASE WHEN ev > 0 THEN 100.0 / (1.0 + exp(0.12::DOUBLE * (ev - 14.0))) END", 5, 95)])
VIEWS["m2"] = f"""
SELECT asset, CASE WHEN quote_type = 'ETF' THEN 50.0::DOUBLE ELSE least(greatest(coalesce({_m2}, 50), 10), 90) END AS score,
  CASE WHEN quote_type = 'ETF' THEN 1.0::DOUBLE WHEN {_n2} > 0 THEN {_n2} / 3.0::DOUBLE ELSE 0.2::DOUBLE END AS confidence
FROM (SELECT *, {REL} FROM dcf_v)"""


@query("score_valuation", "SELECT asset, R6(score) AS score, R6(confidence) AS confidence FROM m2")
def _(p):
    return rounded(fd.score_valuation(_fin(p), p.info(), p.closes()).select("asset", "score", "confidence"))


# -- alias items ----------------------------------------------------------------------------------
ALIAS_ROWS = ", ".join("('{}', '{}', {})".format(c, a.replace("'", "''"), i) for c, names in fd.ALIASES.items() for i, a in enumerate(names))


def alias_sql(source: str, keys: str) -> str:
    return f"""
SELECT * EXCLUDE (pri, first) FROM (SELECT *, min(pri) OVER (PARTITION BY {keys}, canonical) AS first FROM (
  SELECT {keys}, canonical, item, period_end, value, pri FROM {source} JOIN (VALUES {ALIAS_ROWS}) a(canonical, alias, pri) ON item = alias)) WHERE pri = first"""


VIEWS["alias_items"] = alias_sql("stmts_q", "asset")
VIEWS["recent"] = "SELECT *, row_number() OVER (PARTITION BY asset, canonical ORDER BY period_end DESC) - 1 AS k FROM alias_items WHERE value IS NOT NULL"
VIEWS["pit_q"] = f"SELECT as_of, asset, item, period_end, value FROM stmts_q JOIN {MONTHS_SQL} ON period_end + 45 <= as_of"
VIEWS["pit_alias"] = alias_sql("pit_q", "as_of, asset")
VIEWS["pit_recent"] = "SELECT *, row_number() OVER (PARTITION BY as_of, asset, canonical ORDER BY period_end DESC) - 1 AS k FROM pit_alias WHERE value IS NOT NULL"
VIEWS["pit_close"] = f"""
SELECT c.as_of, c.asset, f.close FROM (SELECT as_of, a.asset FROM {MONTHS_SQL}, (SELECT DISTINCT asset FROM bars_brand) a) c
ASOF JOIN bars_brand f ON c.asset = f.asset AND c.as_of >= f.ts"""


def _alias(p):
    return fd.statement_alias_item(p.statements("quarter"))


@query("statement_alias_item", "SELECT asset, canonical, item, D(period_end) AS period_end, value FROM alias_items")
def _(p):
    return _alias(p)


@query("ttm_sum", "SELECT asset, canonical, R2(CASE WHEN count(*) FILTER (k < 4) = 4 THEN sum(value) FILTER (k < 4) END) AS ttm FROM recent GROUP BY ALL")
def _(p):
    return rounded(fd.ttm_sum(fd.recent_values(_alias(p))), 2)


@query("latest_item", "SELECT asset, canonical, arg_max(value, period_end) AS latest FROM recent GROUP BY ALL")
def _(p):
    return fd.latest_item(fd.recent_values(_alias(p)))


@query("avg_item", "SELECT asset, canonical, R4(CASE WHEN count(*) FILTER (k < 2) = 2 THEN avg(value) FILTER (k < 2) END) AS average FROM recent GROUP BY ALL")
def _(p):
    return rounded(fd.avg_item(fd.recent_values(_alias(p))), 4)


def _ttm(c, n=4):
    return f"CASE WHEN count(*) FILTER (canonical = '{c}' AND k < {n}) = {n} THEN sum(value) FILTER (canonical = '{c}' AND k < {n}) END"


def _lat(c):
    return f"max(value) FILTER (canonical = '{c}' AND k = 0)"


VIEWS["value_v"] = f"""
SELECT c.as_of, c.asset, ni / nullif(close * coalesce(sh, 1), 0) AS earnings_yield, bv / nullif(close * coalesce(sh, 1), 0) AS book_to_market,
  ocf / nullif(close * coalesce(sh, 1), 0) AS cash_flow_yield
FROM pit_close c LEFT JOIN (SELECT as_of, asset, {_lat('shares')} AS sh, {_ttm('net_income')} AS ni, {_lat('book_value')} AS bv, {_ttm('ocf')} AS ocf
  FROM pit_recent GROUP BY 1, 2) f USING (as_of, asset)"""
VIEWS["quality_v"] = f"""
SELECT as_of, asset, ni / nullif(eq2, 0) AS roe, ebit / nullif(ta - cl, 0) AS roce,
  CASE WHEN nn = 8 THEN 1 - sn / nullif(abs(mn), 0) END AS earnings_stability, -(debt / nullif(eq, 0)) AS leverage FROM (
  SELECT as_of, asset, {_ttm('net_income')} AS ni, CASE WHEN count(*) FILTER (canonical = 'book_value' AND k < 2) = 2 THEN avg(value) FILTER (canonical = 'book_value' AND k < 2) END AS eq2,
    {_ttm('ebit')} AS ebit, {_lat('total_assets')} AS ta, {_lat('current_liab')} AS cl, {_lat('book_value')} AS eq, {_lat('total_debt')} AS debt,
    count(*) FILTER (canonical = 'net_income' AND k < 8) AS nn, avg(value) FILTER (canonical = 'net_income' AND k < 8) AS mn,
    stddev_samp(value) FILTER (canonical = 'net_income' AND k < 8) AS sn FROM pit_recent GROUP BY 1, 2)"""


def _as_text(view: str, cols: list[str], digits: int = 6, last: bool = False) -> str:
    if last:
        for v in ("value_v", "quality_v", "momentum_v", "low_risk_v"):
            view = view.replace(v, v + "_last")
    return "SELECT D(as_of) AS as_of, asset, " + ", ".join(f"R{digits}({c}) AS {c}" for c in cols) + f" FROM {view}"


# One decision date: the same text with another date list.
def _swap(text: str, names: dict[str, str]) -> str:
    import re
    text = text.replace(MONTHS_SQL, sql_dates(LAST))
    for a, b in names.items():
        text = re.sub(rf"\b{a}\b", b, text)
    return text


_ONE = {n: n + "_last" for n in ("pit_q", "pit_alias", "pit_recent", "pit_close", "value_v", "quality_v")}
for _n in list(_ONE):
    VIEWS[_ONE[_n]] = _swap(VIEWS[_n], _ONE)

VALUE = ["earnings_yield", "book_to_market", "cash_flow_yield"]
QUALITY = ["roe", "roce", "earnings_stability", "leverage"]


@query("factor_value", _as_text("value_v", VALUE, 6, last=True))
def _(p):
    return rounded(fd.factor_value(p.statements("quarter"), p.closes(), LAST))


@query("factor_value_xs", _as_text("value_v", VALUE))
def _(p):
    return rounded(fd.factor_value(p.statements("quarter"), p.closes(), months(p)))


@query("factor_quality", _as_text("quality_v", QUALITY, 6, last=True))
def _(p):
    return rounded(fd.factor_quality(p.statements("quarter"), LAST))


@query("factor_quality_xs", _as_text("quality_v", QUALITY))
def _(p):
    return rounded(fd.factor_quality(p.statements("quarter"), months(p)))


# -- time series ----------------------------------------------------------------------------------
def _mom_sql(p: int) -> str:
    if p <= 21:
        return f"SELECT asset, CAST({p} AS BIGINT) AS period, CAST(NULL AS DOUBLE) AS momentum, CAST(NULL AS DOUBLE) AS annualised, CAST(NULL AS DOUBLE) AS percentile FROM ret_brand GROUP BY asset HAVING count(*) >= {p}"
    return f"""
SELECT asset, CAST({p} AS BIGINT) AS period, max(c) AS momentum, max(c) / {(p - 21) / 252.0} AS annualised,
  CASE WHEN max(c) IS NOT NULL THEN avg(CASE WHEN m IS NOT NULL THEN (m < c)::INT END) * 100 END AS percentile
FROM (SELECT *, last(m) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM (
  SELECT asset, ts, CASE WHEN count(lr) OVER w = {p - 21} THEN sum(lr) OVER w END AS m FROM ret_brand
  WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN {p - 1} PRECEDING AND 21 PRECEDING)))
GROUP BY asset HAVING count(*) >= {p}"""


VIEWS["mom252"] = _mom_sql(252)


@query("momentum_skip", "SELECT asset, period, R6(momentum) AS momentum, R6(annualised) AS annualised, R6(percentile) AS percentile FROM ("
       + " UNION ALL ".join(f"SELECT * FROM ({_mom_sql(p)})" for p in (21, 63, 126, 252)) + ")")
def _(p):
    return rounded(tsr.momentum_skip(p.returns()))


@query("hurst_rs", """
WITH x AS (SELECT asset, lr, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM ret_brand),
e AS (SELECT asset, lag, i, lr, n // lag AS k, n // (n // lag) AS size, n % (n // lag) AS extra FROM x, (SELECT unnest(generate_series(2, 99)) AS lag) WHERE n >= lag AND n + 1 >= 100),
c AS (SELECT asset, lag, i, lr, CASE WHEN i < extra * (size + 1) THEN i // (size + 1) ELSE extra + (i - extra * (size + 1)) // size END AS chunk FROM e),
d AS (SELECT asset, lag, chunk, i, lr, lr - avg(lr) OVER (PARTITION BY asset, lag, chunk) AS dev FROM c),
s AS (SELECT asset, lag, chunk, lr, sum(dev) OVER (PARTITION BY asset, lag, chunk ORDER BY i ROWS UNBOUNDED PRECEDING) AS cs FROM d),
r AS (SELECT asset, lag, (max(cs) - min(cs)) / stddev_pop(lr) AS rs FROM s GROUP BY asset, lag, chunk HAVING stddev_pop(lr) > 0),
t AS (SELECT asset, lag, avg(rs) AS tau FROM r GROUP BY asset, lag),
f AS (SELECT asset, regr_slope(ln(tau), ln(lag)) AS h, regr_r2(ln(tau), ln(lag)) AS r2, count(*) AS n FROM t GROUP BY asset)
SELECT asset, R6(h) AS h_exponent, R6(r2) AS r_squared,
  CASE WHEN h < 0.45 THEN 'Mean-reverting' WHEN h > 0.55 THEN 'Trending' ELSE 'Random walk' END AS interpretation,
  CASE WHEN r2 < 0.9 THEN 'Poor fit (R² < 0.9)' ELSE '' END AS warning FROM f""")
def _(p):
    return rounded(tsr.hurst_rs(p.closes()))


def _chi2_sql(x: str, dof: int) -> str:
    import math
    from .shared_sql import norm_cdf
    total, denom = [], 1.0
    for r in range(1, (dof - 1) // 2 + 1):
        denom *= 2 * r - 1
        total.append(f"pow(sqrt({x}), {2 * r - 1}) / {denom!r}::DOUBLE")
    return f"(2 * (1 - {norm_cdf(f'sqrt({x})')}) + 2 * exp(-{x} / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE * ({' + '.join(total)}))"


@query("autocorrelation", "WITH d AS (SELECT asset, ts, lr - avg(lr) OVER (PARTITION BY asset) AS x FROM ret_brand), l AS (SELECT asset, x, "
       + ", ".join(f"lag(x, {k}) OVER w AS l{k}" for k in range(1, 22)) + " FROM d WINDOW w AS (PARTITION BY asset ORDER BY ts)), g AS (SELECT asset, count(x) AS n, sum(x * x) AS c0, "
       + ", ".join(f"sum(x * l{k}) AS c{k}" for k in range(1, 22)) + " FROM l GROUP BY asset HAVING count(x) >= 42), q AS (SELECT *, n * (n + 2) * ("
       + " + ".join(f"pow(c{k} / c0, 2) / (n - {k})" for k in range(1, 22)) + ") AS lb FROM g) SELECT asset, "
       + ", ".join(f"R6(c{k} / c0) AS acf_{k}" for k in (1, 5, 10, 21)) + f", R6(lb) AS lb_statistic, R6({_chi2_sql('lb', 21)}) AS lb_pvalue, {_chi2_sql('lb', 21)} < 0.05 AS significant FROM q")
def _(p):
    return rounded(tsr.autocorrelation(p.returns()))


VIEWS["ma_v"] = """
SELECT asset, max(n) AS rows, max(flip) AS flip, arg_max(p, ts) AS p, last(s ORDER BY ts) AS s, last(l ORDER BY ts) AS l FROM (
  SELECT *, CASE WHEN up <> lag(up) OVER (PARTITION BY asset ORDER BY ts) THEN n END AS flip FROM (
    SELECT *, coalesce((p > l)::INT, 0) AS up FROM (
      SELECT asset, ts, close AS p, row_number() OVER w AS n, CASE WHEN row_number() OVER w >= 50 THEN avg(close) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS s,
        CASE WHEN row_number() OVER w >= 200 THEN avg(close) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS l
      FROM bars_brand WINDOW w AS (PARTITION BY asset ORDER BY ts)))) GROUP BY asset"""


@query("ma_regime", """
SELECT asset, CASE WHEN rows < 200 THEN 'Unknown' WHEN p > l THEN 'uptrend' ELSE 'downtrend' END AS current_regime, R6(CASE WHEN rows >= 200 THEN s END) AS ma_short,
  R6(CASE WHEN rows >= 200 THEN l END) AS ma_long, CASE WHEN rows < 200 THEN 0 ELSE coalesce(rows - flip + 1, rows) END AS days_in_current_regime,
  R6(CASE WHEN rows >= 200 THEN p / l END) AS price_to_ma200_ratio FROM ma_v""")
def _(p):
    return rounded(tsr.ma_regime(p.closes()))


@query("vol_regime", """
WITH v AS (SELECT asset, ts, CASE WHEN count(lr) OVER w = 21 THEN stddev_samp(lr) OVER w END AS v FROM ret_brand WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, last(v) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM v),
g AS (SELECT asset, count(*) AS n, max(c) AS c, avg(CASE WHEN v IS NOT NULL THEN (v < c)::INT END) * 100 AS pct FROM c GROUP BY asset)
SELECT asset, R6(c) AS current_vol, R6(c * sqrt(252)) AS current_vol_annualised, CASE WHEN n < 21 THEN 'Unknown' WHEN pct < 25 THEN 'low' WHEN pct > 75 THEN 'high' ELSE 'normal' END AS vol_regime, R6(pct) AS vol_percentile FROM g""")
def _(p):
    return rounded(tsr.vol_regime(p.returns()))


VIEWS["m3"] = """
SELECT asset, greatest(0, least(100, 50 + coalesce((percentile - 50) / 2, 0) + CASE WHEN rows < 200 THEN 0 WHEN p > l THEN 10 ELSE -10 END)) AS score
FROM ma_v LEFT JOIN mom252 USING (asset)"""


@query("score_timeseries", "SELECT asset, R6(score) AS score FROM m3")
def _(p):
    return rounded(tsr.score_timeseries(p.closes(), p.returns()).select("asset", "score"))


def _asof_feat(dates, feat: str, cols: str) -> str:
    return f"""
SELECT c.as_of, c.asset, {cols} FROM (SELECT as_of, a.asset FROM {dates}, (SELECT DISTINCT asset FROM ret_brand) a) c
ASOF JOIN ({feat}) f ON c.asset = f.asset AND c.as_of >= f.ts"""


_MOM = """SELECT asset, ts, row_number() OVER w AS n, lag(close, 20) OVER w / lag(close, 251) OVER w - 1 AS m12, close / lag(close, 125) OVER w - 1 AS m6
FROM bars_brand WINDOW w AS (PARTITION BY asset ORDER BY ts)"""
_LOW = """SELECT asset, ts, row_number() OVER w AS n, CASE WHEN count(lr) OVER w30 > 5 THEN -stddev_samp(lr) OVER w30 * sqrt(252) END AS volatility_30d,
 CASE WHEN count(CASE WHEN lr < 0 THEN lr END) OVER w30 > 3 THEN -stddev_samp(CASE WHEN lr < 0 THEN lr END) OVER w30 * sqrt(252) END AS downside_volatility,
 -covar_samp(lr, mkt) OVER w252 / nullif(var_samp(mkt) OVER w252, 0) AS b
FROM ret_brand JOIN (SELECT ts, avg(lr) AS mkt FROM ret_brand GROUP BY ts) USING (ts)
WINDOW w AS (PARTITION BY asset ORDER BY ts), w30 AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), w252 AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"""
for _sfx, _d in (("", MONTHS_SQL), ("_last", sql_dates(LAST))):
    VIEWS["momentum_v" + _sfx] = _asof_feat(_d, _MOM, "CASE WHEN n >= 252 THEN m12 END AS momentum_12m_skip1, CASE WHEN n >= 252 THEN m6 END AS momentum_6m")
    VIEWS["low_risk_v" + _sfx] = _asof_feat(_d, _LOW, "volatility_30d, downside_volatility, CASE WHEN n >= 252 THEN b END AS beta")

MOM = ["momentum_12m_skip1", "momentum_6m"]
LOW = ["volatility_30d", "beta", "downside_volatility"]


@query("factor_momentum", _as_text("momentum_v", MOM, last=True))
def _(p):
    return rounded(tsr.factor_momentum(p.closes(), LAST))


@query("factor_momentum_xs", _as_text("momentum_v", MOM))
def _(p):
    return rounded(tsr.factor_momentum(p.closes(), months(p)))


@query("factor_low_risk", _as_text("low_risk_v", LOW, last=True))
def _(p):
    return rounded(tsr.factor_low_risk(p.returns(), LAST))


@query("factor_low_risk_xs", _as_text("low_risk_v", LOW))
def _(p):
    return rounded(tsr.factor_low_risk(p.returns(), months(p)))
