"""Point-in-time, alignment, returns and normalisation."""

from pyspark.sql import functions as F

from ..functions.columns import by_time, rounded
from ..operators import normalize as nz
from ..operators import pit
from ..operators import returns as rt
from ..sources import files
from .registry import query
from .shared_sql import norm_ppf

_SPAN = "(SELECT date_trunc('year', min(CAST(l_shipdate AS DATE)))::DATE AS lo, date_trunc('year', max(CAST(l_shipdate AS DATE)))::DATE AS hi FROM lineitem)"
#: Decision dates of the SQL forms: ends of the years, and first business days of the months, of the years that have trades.
YEARS_SQL = f"(SELECT (d + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE AS as_of FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 YEAR)) AS d FROM {_SPAN}))"
MONTHS_SQL = f"""(SELECT (d + CASE dayofweek(d) WHEN 6 THEN INTERVAL 2 DAY WHEN 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)::DATE AS as_of FROM (
  SELECT unnest(generate_series(lo, hi + INTERVAL 11 MONTH, INTERVAL 1 MONTH)) AS d FROM {_SPAN}))"""


def years(p) -> list:
    return pit.year_ends(*p.years())


def months(p) -> list:
    return pit.month_starts(*p.years())


def sql_dates(ds) -> str:
    return "(SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in ds) + "]) AS as_of)"


@query("pit_register", "SELECT upper(asset) AS asset, D(ts) AS ts, D(ts) AS t_avail, close, volume FROM bars_brand")
def _(p):
    return pit.register(p.closes(), files.scratch(p.spark, "pit_prices"))


@query("pit_register_statements", "SELECT upper(asset) AS asset, stmt, D(period_end) AS period_end, item, value, D(period_end + 45) AS t_avail FROM stmts")
def _(p):
    return pit.register(p.statements(), files.scratch(p.spark, "pit_stmts"), "period_end", pit.STATEMENT_LAG_DAYS)


@query("pit_register_macro", "SELECT upper(series) AS series, D(ts) AS ts, value, D(ts + 30) AS t_avail FROM macro_daily")
def _(p):
    return pit.register(p.macro_daily(), files.scratch(p.spark, "pit_macro"), "ts", pit.MACRO_LAG_DAYS, key="series")


@query("pit_price_history", f"SELECT D(as_of) AS as_of, asset, D(ts) AS ts, close, volume FROM bars_brand JOIN {YEARS_SQL} ON ts <= as_of")
def _(p):
    return pit.pit_price_history(p.closes(), years(p))


@query("pit_statements", f"""
SELECT D(as_of) AS as_of, asset, stmt, item, D(period_end) AS period_end, value,
  row_number() OVER (PARTITION BY as_of, asset, stmt, item ORDER BY period_end DESC) - 1 AS pos
FROM stmts_q JOIN {YEARS_SQL} ON period_end + 45 <= as_of""")
def _(p):
    return pit.pit_statements(p.statements("quarter"), years(p))


@query("pit_macro", f"SELECT D(as_of) AS as_of, series, D(ts) AS ts, value FROM macro_daily JOIN {YEARS_SQL} ON ts + 30 <= as_of")
def _(p):
    return pit.pit_macro(p.macro_daily(), years(p))


@query("asof_latest", """
WITH s AS (SELECT asset, period_end + 45 AS filed, value FROM stmts_q WHERE item = 'Net Income')
SELECT b.asset, D(b.ts) AS ts, s.value AS net_income, D(s.filed) AS matched_ts
FROM bars_brand b ASOF LEFT JOIN s ON b.asset = s.asset AND b.ts >= s.filed""")
def _(p):
    s = p.statements("quarter").where("item = 'Net Income'").select(
        "asset", F.date_add("period_end", 45).alias("filed"), F.col("value").alias("net_income"))
    return pit.asof_join(p.closes().select("asset", "ts"), s, ["asset"], "ts", "filed", ["net_income"])


@query("leakage_reverse_corr", """
WITH d AS (SELECT asset, ts, r, close, lag(r, 5) OVER w AS leaky FROM ret_brand WINDOW w AS (PARTITION BY asset ORDER BY ts)),
l AS (SELECT asset, 'honest' AS signal, r, lead(close, 5) OVER (PARTITION BY asset ORDER BY ts) AS s FROM d
  UNION ALL SELECT asset, 'leaky', r, lead(leaky, 5) OVER (PARTITION BY asset ORDER BY ts) FROM d)
SELECT asset, signal, count(*) AS n, R6(corr(s, r)) AS reverse_corr, NOT (count(*) >= 10 AND abs(corr(s, r)) > 0.98) AS passed
FROM l GROUP BY asset, signal""")
def _(p):
    d = p.returns().withColumn("leaky", F.lag("r", 5).over(by_time()))
    out = [pit.leakage_reverse_corr(d, c, "r", 5).withColumn("signal", F.lit(n))
           for n, c in (("honest", "close"), ("leaky", "leaky"))]
    return rounded(out[0].unionByName(out[1]))


@query("register_delisting", "SELECT upper(asset) AS asset, D(max(ts)) AS delisted FROM bars_brand GROUP BY asset")
def _(p):
    return pit.register_delisting(p.closes().groupBy("asset").agg(F.max("ts").alias("ts")))


@query("investable_universe", f"""
WITH f AS (SELECT asset, ts, close, row_number() OVER w AS n, avg(close * volume) OVER (w ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS adv
  FROM bars_brand WINDOW w AS (PARTITION BY asset ORDER BY ts)),
c AS (SELECT as_of, a.asset FROM {MONTHS_SQL}, (SELECT DISTINCT asset FROM bars_brand) a),
j AS (SELECT c.as_of, c.asset, f.close, f.adv, f.n FROM c ASOF JOIN f ON c.asset = f.asset AND c.as_of >= f.ts)
SELECT D(as_of) AS as_of, asset, close, R2(adv) AS adv FROM j
WHERE n >= 10 AND close >= 200 AND adv >= 40000 AND NOT (asset LIKE '%3' AND as_of > DATE '1999-06-30')""")
def _(p):
    c = p.closes()
    gone = pit.register_delisting(c.where("asset like '%3'").select("asset", F.lit("1999-06-30").cast("date").alias("ts")).distinct())
    gone = gone.withColumn("asset", F.initcap("asset"))
    return rounded(pit.investable_universe(c, gone, months(p), min_adv=40000.0, min_price=200.0), 2, close=15)


@query("adjusted_total_return", """
SELECT asset, D(ts) AS ts, adj AS adj_close, R8(coalesce(adj / lag(adj) OVER (PARTITION BY asset ORDER BY ts) - 1, 0)) AS total_return
FROM (SELECT asset, ts, CASE WHEN volume % 3 = 0 THEN close ELSE adj_close END AS adj FROM bars_brand)""")
def _(p):
    b = p.bars().withColumn("adj_close", F.when(F.col("volume") % 3 != 0, F.col("adj_close")))
    return rounded(pit.adjusted_total_return(b).select("asset", "ts", "adj_close", "total_return"), 8, adj_close=16)


@query("align_business_days", """
WITH s AS (SELECT asset, CAST(d AS DATE) AS ts FROM (SELECT DISTINCT asset FROM bars_brand),
  (SELECT unnest(generate_series(lo, hi + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM """ + _SPAN + """) WHERE dayofweek(d) BETWEEN 1 AND 5)
SELECT asset, D(ts) AS ts, last_value(close IGNORE NULLS) OVER w AS close
FROM s LEFT JOIN bars_brand USING (asset, ts) WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def _(p):
    return pit.align_business_days(p.closes(), f"{p.years()[0]}-01-01", f"{p.years()[1]}-12-31", ["close"])


def _align_sql(source: str, limit: int) -> str:
    return f"""
WITH m AS ({source}), i AS (SELECT DISTINCT series, b.ts FROM m, (SELECT DISTINCT ts FROM bars_type) b)
SELECT series, D(ts) AS ts, last_value(value IGNORE NULLS) OVER w AS value FROM i LEFT JOIN m USING (series, ts)
WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW)"""


def _index(p, values):
    """(series, ts) for every trading date; the series list is a fixed handful."""
    names = values.select("series").distinct().agg(F.collect_list("series").alias("s"))
    return p.closes("p_type").select("ts").distinct().select(F.explode(names.scalar()).alias("series"), "ts")


@query("align_monthly_to_daily", _align_sql("SELECT series, last_day(ts) AS ts, arg_max(value, ts) AS value FROM macro_daily GROUP BY 1, 2", 31))
def _(p):
    m = p.macro_daily().groupBy("series", F.last_day("ts").alias("me")).agg(F.max_by("value", "ts").alias("value")).withColumnRenamed("me", "ts")
    return pit.align_to_index(m, _index(p, m), 31)


@query("align_quarterly_to_daily", _align_sql("SELECT asset AS series, period_end AS ts, value FROM stmts_q WHERE item = 'Total Assets'", 92))
def _(p):
    m = p.statements("quarter").where("item = 'Total Assets'").select(F.col("asset").alias("series"), F.col("period_end").alias("ts"), "value")
    return pit.align_to_index(m, _index(p, m), 92)


@query("lag_series", """
SELECT asset, D(ts) AS ts, lag(close, 3) OVER w AS lagged, lead(close, 2) OVER w AS led FROM bars_brand WINDOW w AS (PARTITION BY asset ORDER BY ts)""")
def _(p):
    d = p.closes().select("asset", "ts", F.col("close").alias("lagged"), F.col("close").alias("led"))
    return pit.lag_series(pit.lag_series(d, ["lagged"], 3), ["led"], -2)


FWD = f"""fwd AS (SELECT as_of, asset, ln(p1 / p0) AS fwd FROM (
  SELECT c.as_of, c.asset, f.close AS p0, f.p1 FROM (SELECT as_of, a.asset FROM {MONTHS_SQL}, (SELECT DISTINCT asset FROM bars_brand) a) c
  ASOF JOIN (SELECT asset, ts, close, lead(close, 21) OVER (PARTITION BY asset ORDER BY ts) AS p1 FROM bars_brand) f
  ON c.asset = f.asset AND c.as_of >= f.ts) WHERE p0 > 0 AND p1 > 0)"""


@query("forward_returns", f"WITH {FWD} SELECT D(as_of) AS as_of, asset, R8(fwd) AS fwd FROM fwd")
def _(p):
    return rounded(pit.forward_returns(p.closes(), months(p), 21), 8)


@query("validate_purity", "SELECT CAST(0 AS BIGINT) AS violations, TRUE AS passed FROM (SELECT count(*) FROM lineitem)")
def _(p):
    c = p.chars()
    cut = F.col("ts") < F.lit("1998-07-01").cast("date")
    return pit.validate_purity(lambda d: rounded(nz.xs_zscore(d)), c.where(cut), c.where(~cut))


@query("validate_lookahead", "SELECT CAST(0 AS BIGINT) AS violations, TRUE AS passed FROM (SELECT count(*) FROM lineitem)")
def _(p):
    def expanding(d):
        return rounded(nz.expanding_zscore(d, "close").select("asset", "ts", "z"))
    return pit.validate_lookahead(expanding, p.closes(), "1999-12-31", lambda d: d.withColumn("close", F.col("close") * 3 + 1))


@query("validate_treatment_equiv", """
SELECT treatment, count(*) AS n_rows, TRUE AS identical FROM chars, (SELECT unnest(['normal_score', 'rank', 'robust_zscore']) AS treatment) GROUP BY treatment""")
def _(p):
    raw = p.chars().withColumn("treatment", F.explode(F.array(*[F.lit(t) for t in ("normal_score", "rank", "robust_zscore")])))
    return pit.validate_treatment_equiv(raw, ["ts", "asset", "characteristic"], "value")


@query("validate_target_independence", f"""
WITH {FWD}, s AS (SELECT as_of AS ts, asset, fwd, -fwd AS score, lead(fwd) OVER (PARTITION BY asset ORDER BY as_of) AS nxt FROM fwd)
SELECT asset, count(*) AS n, R6(corr(score, nxt)) AS corr, abs(corr(score, nxt)) <= 0.5 AS passed FROM s WHERE nxt IS NOT NULL GROUP BY asset""")
def _(p):
    f = pit.forward_returns(p.closes(), months(p), 21).select(F.col("as_of").alias("ts"), "asset", "fwd", (-F.col("fwd")).alias("score"))
    return rounded(pit.validate_target_independence(f, "score", "fwd"))


# -- returns ------------------------------------------------------------------------------------
@query("log_returns", """
SELECT * FROM (SELECT asset, D(ts) AS ts, R8(ln(q / lag(q) OVER (PARTITION BY asset ORDER BY ts))) AS lr
FROM (SELECT asset, ts, CASE WHEN close > 300 THEN close - 300 END AS q FROM bars_brand)) WHERE lr IS NOT NULL""")
def _(p):
    return rounded(rt.log_returns(p.closes().withColumn("close", F.col("close") - 300)), 8)


@query("arithmetic_returns", """
SELECT * FROM (SELECT asset, D(ts) AS ts, R8(q / lag(q) OVER (PARTITION BY asset ORDER BY ts) - 1) AS r
FROM (SELECT asset, ts, last_value(CASE WHEN volume > 10 THEN close END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS q FROM bars_brand)) WHERE r IS NOT NULL""")
def _(p):
    return rounded(rt.arithmetic_returns(p.closes().withColumn("close", F.when(F.col("volume") > 10, F.col("close")))), 8)


@query("cumulative_return", """
SELECT asset, D(ts) AS ts, R6(exp(sum(lr) OVER w) - 1) AS cum_log, R6(exp(sum(ln(1 + r)) OVER w) - 1) AS cum_arith
FROM ret_brand WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _(p):
    d = rt.cumulative_return(p.returns(), "lr", "log").withColumnRenamed("cumulative", "cum_log")
    d = rt.cumulative_return(d, "r").withColumnRenamed("cumulative", "cum_arith")
    return rounded(d.select("asset", "ts", "cum_log", "cum_arith"))


@query("rolling_return", """
SELECT asset, D(ts) AS ts, R8(ln(close / lag(close, 21) OVER w)) AS log_21, R8((close - lag(close, 21) OVER w) / lag(close, 21) OVER w) AS arith_21
FROM bars_brand WINDOW w AS (PARTITION BY asset ORDER BY ts)""")
def _(p):
    a = rt.rolling_return(p.closes(), 21).withColumnRenamed("rolling_return", "log_21")
    b = rt.rolling_return(p.closes(), 21, "arithmetic").withColumnRenamed("rolling_return", "arith_21")
    return rounded(a.join(b, ["asset", "ts"]), 8)


@query("annualised_return", "SELECT asset, count(r) AS n, R8(pow(product(1 + r), 252.0 / count(r)) - 1) AS annualised_return FROM ret_brand GROUP BY asset")
def _(p):
    return rounded(rt.annualised_return(p.returns()), 8)


@query("compare_return_methods", """
SELECT asset, method, R6(avg(x)) AS mean, R6(stddev_samp(x)) AS std, R6(skewness(x)) AS skewness, R6(kurtosis(x)) AS kurtosis, R6(any_value(c)) AS correlation
FROM (SELECT asset, 'Arithmetic' AS method, r AS x FROM ret_brand UNION ALL SELECT asset, 'Logarithmic', lr FROM ret_brand)
JOIN (SELECT asset, corr(r, lr) AS c FROM ret_brand GROUP BY asset) USING (asset) GROUP BY asset, method""")
def _(p):
    return rounded(rt.compare_return_methods(p.returns()))


# -- normalisation of series --------------------------------------------------------------------
@query("zscore_normalise", """
SELECT asset, D(ts) AS ts, R6(greatest(-3, least(3, (close - avg(close) OVER w) / stddev_samp(close) OVER w))) AS z FROM bars_brand WINDOW w AS (PARTITION BY asset)""")
def _(p):
    return rounded(nz.zscore_normalise(p.closes(), "close").select("asset", "ts", "z"))


@query("minmax_normalise", """
SELECT asset, D(ts) AS ts, R8((close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w)) AS scaled FROM bars_brand WINDOW w AS (PARTITION BY asset)""")
def _(p):
    return rounded(nz.minmax_normalise(p.closes(), "close").select("asset", "ts", "scaled"), 8)


PCT_RANK = "(rank() OVER (PARTITION BY asset ORDER BY {c}) + (count(*) OVER (PARTITION BY asset, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY asset) * 100"


@query("rank_normalise", f"SELECT asset, D(ts) AS ts, R6({PCT_RANK.format(c='volume')}) AS pct_rank FROM bars_brand")
def _(p):
    return rounded(nz.rank_normalise(p.closes(), "volume").select("asset", "ts", "pct_rank"))


@query("robust_normalise", """
SELECT asset, D(ts) AS ts, R6((close - m) / iqr) AS robust FROM bars_brand JOIN (
  SELECT asset, median(close) AS m, quantile_cont(close, 0.75) - quantile_cont(close, 0.25) AS iqr FROM bars_brand GROUP BY asset) USING (asset)""")
def _(p):
    return rounded(nz.robust_normalise(p.closes(), "close").select("asset", "ts", "robust"))


@query("row_zscore", """
SELECT asset, D(ts) AS ts, R6((r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0)) AS z FROM ret_brand WINDOW w AS (PARTITION BY ts)""")
def _(p):
    return rounded(nz.row_zscore(p.returns().select("asset", "ts", "r"), "r").select("asset", "ts", "z"))


@query("expanding_zscore", """
SELECT asset, D(ts) AS ts, R6((close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0)) AS z
FROM bars_brand WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _(p):
    return rounded(nz.expanding_zscore(p.closes(), "close").select("asset", "ts", "z"))


@query("normalise_to_score", """
SELECT asset, D(ts) AS ts, R6((close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w) * 100) AS score FROM bars_brand WINDOW w AS (PARTITION BY asset)""")
def _(p):
    return rounded(nz.normalise_to_score(p.closes(), "close").select("asset", "ts", "score"))


@query("compare_normalisation", f"""
WITH s AS (SELECT asset, avg(close) AS m, stddev_samp(close) AS sd, min(close) AS lo, max(close) AS hi, median(close) AS med,
  quantile_cont(close, 0.75) - quantile_cont(close, 0.25) AS iqr FROM bars_brand GROUP BY asset),
b AS (SELECT asset, close, {PCT_RANK.format(c='close')} AS rk FROM bars_brand),
l AS (SELECT asset, 'Original' AS method, close AS x FROM b
 UNION ALL SELECT asset, 'Z-Score', (close - m) / sd FROM b JOIN s USING (asset)
 UNION ALL SELECT asset, 'Z-Score Winsorised', greatest(-3, least(3, (close - m) / sd)) FROM b JOIN s USING (asset)
 UNION ALL SELECT asset, 'MinMax', (close - lo) / (hi - lo) FROM b JOIN s USING (asset)
 UNION ALL SELECT asset, 'Rank', rk FROM b
 UNION ALL SELECT asset, 'Robust', (close - med) / iqr FROM b JOIN s USING (asset))
SELECT asset, method, count(x) AS count, R5(avg(x)) AS mean, R5(stddev_samp(x)) AS std, R5(min(x)) AS min, R5(quantile_cont(x, 0.25)) AS q25,
  R5(quantile_cont(x, 0.5)) AS q50, R5(quantile_cont(x, 0.75)) AS q75, R5(max(x)) AS max, R5(skewness(x)) AS skew, R5(kurtosis(x)) AS kurtosis
FROM l GROUP BY asset, method""")
def _(p):
    return rounded(nz.compare_normalisation(p.closes(), "close"), 5)


# -- normalisation of cross-sections --------------------------------------------------------------
RANKED = """ranked AS (SELECT ts, asset, characteristic, value, CASE WHEN value IS NOT NULL THEN
  rank() OVER (PARTITION BY ts, characteristic ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY ts, characteristic, value) - 1) / 2.0 END AS rk,
  count(value) OVER (PARTITION BY ts, characteristic) AS n FROM chars)"""
XS = {
    "cross_sectional_zscore": ("", "SELECT ts, asset, characteristic, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS score FROM chars WINDOW w AS (PARTITION BY ts, characteristic)"),
    "rank": (RANKED, "SELECT ts, asset, characteristic, (rk - 0.5) / n * 100 AS score FROM ranked"),
    "winsorized_zscore": ("""wq AS (SELECT ts, characteristic, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM chars GROUP BY 1, 2),
wz AS (SELECT ts, asset, characteristic, CASE WHEN value IS NOT NULL THEN least(greatest(value, lo), hi) END AS v FROM chars JOIN wq USING (ts, characteristic))""",
                          "SELECT ts, asset, characteristic, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS score FROM wz WINDOW w AS (PARTITION BY ts, characteristic)"),
    "robust_zscore": ("""rm AS (SELECT ts, characteristic, median(value) AS med FROM chars GROUP BY 1, 2),
rd AS (SELECT ts, characteristic, any_value(med) AS med, median(abs(value - med)) AS mad FROM chars JOIN rm USING (ts, characteristic) GROUP BY 1, 2)""",
                      "SELECT ts, asset, characteristic, (value - med) / nullif(1.4826::DOUBLE * mad, 0) AS score FROM chars JOIN rd USING (ts, characteristic)"),
    "normal_score": (RANKED, f"SELECT ts, asset, characteristic, {norm_ppf('u')} AS score FROM (SELECT *, CAST(rk AS DOUBLE) / (n + 1) AS u FROM ranked)"),
}


def xs_sql(name: str) -> str:
    pre, body = XS[name]
    return (f"WITH {pre} " if pre else "") + f"SELECT D(ts) AS ts, asset, characteristic, R6(score) AS score FROM ({body})"


@query("xs_zscore", xs_sql("cross_sectional_zscore"))
def _(p):
    return rounded(nz.xs_zscore(p.chars()))


@query("xs_rank", xs_sql("rank"))
def _(p):
    return rounded(nz.xs_rank(p.chars()))


@query("xs_winsorized_zscore", xs_sql("winsorized_zscore"))
def _(p):
    return rounded(nz.xs_winsorized_zscore(p.chars()))


@query("xs_robust_zscore", xs_sql("robust_zscore"))
def _(p):
    return rounded(nz.xs_robust_zscore(p.chars()))


@query("xs_normal_score", xs_sql("normal_score"))
def _(p):
    return rounded(nz.xs_normal_score(p.chars()))


@query("apply_normalization", f"WITH {RANKED}, {XS['winsorized_zscore'][0]}, {XS['robust_zscore'][0]} " + " UNION ALL ".join(
    f"SELECT D(ts) AS ts, asset, characteristic, R6(score) AS score, '{n}' AS treatment FROM ({b})" for n, (_, b) in XS.items()))
def _(p):
    return nz.apply_normalization(p.chars(), list(nz.TREATMENTS), digits=6)
