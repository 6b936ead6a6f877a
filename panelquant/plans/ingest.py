"""Scans, sinks and data quality."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import quality as q
from ..sources import catalog, files
from .registry import query

BARS = ["open", "high", "low", "close", "adj_close", "volume"]
BAR_SQL = ", ".join(BARS)  # built from whole cents, so equal to the last bit


def _price_files(p):
    path = files.scratch(p.spark, "prices")
    p.bars().select("ts", *BARS, "asset").write.partitionBy("asset").option("header", True).csv(path)
    return path


@query("scan_prices", f"SELECT upper(asset) AS asset, D(ts) AS ts, {BAR_SQL} FROM bars_brand WHERE ts BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' "
       "AND asset IN (SELECT asset FROM bars_brand GROUP BY asset HAVING count(*) > 20)")
def _(p):
    return files.scan_prices(p.spark, _price_files(p), "1996-01-01", "2000-12-31", per_file=False)


@query("scan_benchmark", """
SELECT 'GSPC' AS asset, D(ts) AS ts, R6(avg(close)) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM bars_brand GROUP BY ts""")
def _(p):
    path = files.scratch(p.spark, "benchmark")
    idx = p.bars().groupBy("ts").agg(*[F.avg(c).alias(c) for c in BARS[:-1]], F.sum("volume").alias("volume"))
    idx.withColumn("asset", F.lit("^GSPC")).write.partitionBy("asset").option("header", True).csv(path)
    return rounded(files.scan_benchmark(p.spark, path, per_file=False).select("asset", "ts", "close", "volume"))


@query("extend_merge_bars", """
SELECT asset, D(ts) AS ts, CASE WHEN ts >= DATE '1999-01-01' THEN close + 1 ELSE close END AS close, volume
FROM bars_brand""")
def _(p):
    b = p.closes()
    old = b.where("ts < date'1999-01-01'")
    new = b.where("ts >= date'1998-06-01'").withColumn("close", F.col("close") + 1)
    return files.extend_merge_bars(old, new)


def _statement_files(p):
    s = p.statements().withColumn("period", F.date_format("period_end", "yyyy-MM-dd"))
    items = s.groupBy("asset", "stmt", "period").agg(
        F.map_from_entries(F.collect_list(F.struct("item", "value"))).alias("items"))
    per = items.groupBy("asset", "stmt").agg(
        F.map_from_entries(F.collect_list(F.struct("period", "items"))).alias("periods"))
    wide = per.groupBy("asset").agg(*[
        F.first(F.when(F.col("stmt") == n, F.col("periods")), ignorenulls=True).alias(n) for n in files.STATEMENTS])
    path = files.scratch(p.spark, "statements")
    out = wide.select(*files.STATEMENTS, F.struct(F.col("asset").alias("symbol")).alias("info"))
    out.write.option("multiLine", False).json(path)
    return path


@query("scan_statements", "SELECT asset, stmt, D(period_end) AS period, item, R2(value) AS value FROM stmts")
def _(p):
    return rounded(files.scan_statements(p.spark, _statement_files(p), per_file=False), 2)


@query("statements_to_wide", """
SELECT asset, stmt, item, row_number() OVER (PARTITION BY asset, stmt, item ORDER BY period_end DESC) - 1 AS pos,
  D(period_end) AS period_end, R2(value) AS value FROM stmts""")
def _(p):
    s = p.statements().withColumn("period", F.date_format("period_end", "yyyy-MM-dd"))
    return rounded(files.statements_to_wide(s), 2)


@query("scan_factor_returns", """
SELECT D(month) AS month, R8(mkt_rf) AS mkt_rf, R8(smb) AS smb, R8(hml) AS hml, R8(rf) AS rf, R8(wml) AS wml FROM factors""")
def _(p):
    f = p.factors().withColumn("ym", F.date_format("month", "yyyyMM"))
    pct = [(F.col(c) * 100).cast("string").alias(c) for c in ("mkt_rf", "smb", "hml", "rf")]
    a, b = files.scratch(p.spark, "factors"), files.scratch(p.spark, "momentum")
    notes = f.select(F.lit("Copyright").alias("ym"), *[F.lit("").alias(c) for c in ("mkt_rf", "smb", "hml", "rf")]).distinct()
    f.select("ym", *pct).unionByName(notes).write.csv(a)
    f.select("ym", (F.col("wml") * 100).cast("string").alias("wml")).write.csv(b)
    return rounded(files.scan_factor_returns(p.spark, a, b), 8)


@query("scan_macro_series", """
WITH m AS (SELECT series, last_day(ts) AS month_end, arg_max(value, ts) AS value FROM macro_daily GROUP BY 1, 2),
spine AS (SELECT series, last_day(CAST(unnest(generate_series(date_trunc('month', min(month_end)),
  (SELECT date_trunc('month', max(month_end)) FROM m), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM m GROUP BY series)
SELECT series, D(month_end) AS month_end,
  R6(last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY month_end)) AS value
FROM spine LEFT JOIN m USING (series, month_end)""")
def _(p):
    path = files.scratch(p.spark, "macro")
    p.macro_daily().select("ts", "value", "series").write.partitionBy("series").option("header", True).csv(path)
    return rounded(files.scan_macro_series(p.spark, path))


def _quality_sql(source: str, keys: list[str], ts: str, missing: str, gap: int | None) -> str:
    return f"""(SELECT sum(k) AS n, sum(m) AS missing, sum(k - 1) AS repeated, count(*) FILTER (gap > {gap if gap else 'NULL'}) AS gaps FROM (
  SELECT *, date_diff('day', lag(day) OVER (PARTITION BY {", ".join(keys)} ORDER BY day), day) AS gap FROM (
    SELECT {", ".join(keys)}, {ts} AS day, count(*) AS k, sum({missing}) AS m FROM {source} GROUP BY ALL)))"""


# source, view, entity, date, availability lag in days, keys, values, widest gap in days
LOADED = [("prices", "bars_brand", "asset", "ts", 0, ["asset"], ["close", "volume"], 5),
          ("statements", "stmts", "asset", "period_end", 45, ["asset", "stmt", "item"], ["value"], None),
          ("macro", "macro_daily", "series", "ts", 30, ["series"], ["value"], None), ("news", "news", "asset", "published_at", 0, ["doc_id"], ["text"], None)]


def _check(keys, ts, values, gap=None):
    return lambda d: q.source_quality(d, keys, ts, values, gap)


@query("load_panel", " UNION ALL ".join(f"""
SELECT '{n}' AS source, 1 AS version, s.n_rows, s.n_entities, s.first_date, s.last_date, {lag} AS lag_days, CAST(missing AS DOUBLE) AS missing, CAST(repeated AS DOUBLE) AS repeated,
  CAST(gaps AS DOUBLE) AS gaps, repeated = 0 AS passed FROM (SELECT count(*) AS n_rows, count(DISTINCT {e}) AS n_entities, D(min({t})) AS first_date, D(max({t})) AS last_date FROM {v}) s,
  {_quality_sql(v, keys, t, " + ".join(f"({x} IS NULL)::INT" for x in values), gap)}""" for n, v, e, t, lag, keys, values, gap in LOADED))
def _(p):
    rows = {"prices": p.closes(), "statements": p.statements(), "macro": p.macro_daily(), "news": p.news()}
    store = catalog.Catalog(p.spark, files.scratch(p.spark, "catalog"))
    done = catalog.load_panel(store, {n: (rows[n], e, t, lag, _check(keys, t, values, gap)) for n, _, e, t, lag, keys, values, gap in LOADED})
    checks = store.quality().groupBy("source", "version").agg(*[
        F.max(F.when(F.col("check") == c, F.col("value"))).alias(c) for c in ("missing", "repeated", "gaps", "passed")])
    return done.join(checks, ["source", "version"]).select(
        "source", "version", "n_rows", "n_entities", "first_date", "last_date", "lag_days", "missing", "repeated", "gaps",
        (F.col("passed") == 1).alias("passed"))


# Prices until 1999, then a delivery that goes on from mid-1998 and restates what it repeats.
@query("panel_versions", """
WITH v AS (
  SELECT 1 AS version, asset, ts, close, volume FROM bars_brand WHERE ts < DATE '1999-01-01'
  UNION ALL SELECT 2, asset, ts, CASE WHEN ts >= DATE '1998-06-01' THEN close + 1 ELSE close END, volume FROM bars_brand)
SELECT version, upper(asset) AS asset, count(*) AS n_rows, R6(avg(close)) AS close, CAST(sum(volume) AS BIGINT) AS volume, D(max(ts)) AS last_date,
  CAST(count(*) FILTER (ts <= DATE '1998-12-01') AS BIGINT) AS known_by_then FROM v GROUP BY 1, 2""")
def _(p):
    b = p.closes()
    store = catalog.Catalog(p.spark, files.scratch(p.spark, "catalog"))
    check = _check(["asset"], "ts", ["close", "volume"])
    first = store.load("prices", b.where("ts < date'1999-01-01'"), lag_days=1, check=check)
    second = store.append("prices", b.where("ts >= date'1998-06-01'").withColumn("close", F.col("close") + 1), check)
    out = None
    for version in (first, second):
        d = store.read("prices", version, ["asset", "ts"])
        one = d.groupBy("asset").agg(
            F.count(F.lit(1)).alias("n_rows"), F.avg("close").alias("close"), F.sum("volume").alias("volume"), F.max("ts").alias("last_date"),
            F.count_if(F.col("t_avail") <= F.lit("1998-12-02").cast("date")).alias("known_by_then")).withColumn("version", F.lit(version))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("sink_results_json", """
SELECT asset, D(ts) AS ts, module, R6(CASE WHEN module = 'M4' AND score > 60 THEN NULL ELSE score END) AS score FROM module_scores""")
def _(p):
    path = files.scratch(p.spark, "results")
    s = p.module_scores().withColumn("score", F.when(
        (F.col("module") == "M4") & (F.col("score") > 60), F.lit(float("nan"))).otherwise(F.col("score")))
    files.sink_results_json(s.withColumn("regime_probs", F.lit(1.0)), path)
    back = p.spark.read.schema("asset STRING, ts DATE, module STRING, score DOUBLE").json(path)
    return rounded(back)


@query("sink_audit_trail", """
SELECT portfolio, asset, R8(w) AS target_weight, R8(w / 2) AS previous_weight, R8(w - w / 2) AS weight_delta, 'v2.0' AS model_version, batch
FROM target_weights, (SELECT unnest([0, 1]) AS batch)""")
def _(p):
    path = files.scratch(p.spark, "audit")
    t = p.target_weights().select("portfolio", "asset", F.col("w").alias("target_weight"), (F.col("w") / 2).alias("previous_weight"))
    for batch in (0, 1):
        files.sink_audit_trail(t.withColumn("batch", F.lit(batch)), path)
    back = p.spark.read.schema("portfolio INT, asset STRING, target_weight DOUBLE, previous_weight DOUBLE, "
                               "weight_delta DOUBLE, model_version STRING, batch INT").json(path)
    return rounded(back, 8)


@query("sink_experiment", """
SELECT characteristic AS normalization, D(ts) AS ts, count(value) AS n, R6(avg(value)) AS mean FROM chars GROUP BY ALL""")
def _(p):
    path = files.scratch(p.spark, "experiment")
    s = p.chars().groupBy(F.col("characteristic").alias("normalization"), "ts").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"))
    files.sink_experiment(s, path)
    back = p.spark.read.option("header", True).schema("ts DATE, n BIGINT, mean DOUBLE, normalization STRING").csv(path)
    return rounded(back)


@query("bulk_ingest_clean", """
SELECT asset, D(ts) AS ts, close, CASE WHEN volume % 5 = 0 THEN close ELSE adj_close END AS adj_close, volume
FROM bars_brand WHERE volume % 7 <> 0""")
def _(p):
    raw = p.bars().withColumn("adj_close", F.when(F.col("volume") % 5 != 0, F.col("adj_close"))).withColumn(
        "open", F.when(F.col("volume") % 7 != 0, F.col("open")))
    path = files.scratch(p.spark, "clean")
    files.bulk_ingest_clean(raw).write.partitionBy("asset").parquet(path)
    return p.spark.read.parquet(path).select("asset", "ts", "close", "adj_close", "volume")


def _gappy(p):
    return p.bars().withColumn("open", F.when(F.col("volume") > 10, F.col("open"))).withColumn(
        "adj_close", F.when(F.col("volume") % 50 != 0, F.col("adj_close")))


@query("dq_missing", """
SELECT asset, "column", n AS missing_count, R8(n / total) AS missing_pct, n / total > 0.05 AS flag FROM (
  SELECT asset, 'open' AS "column", count(*) FILTER (volume <= 10) AS n, count(*) AS total FROM bars_brand GROUP BY asset
  UNION ALL SELECT asset, 'adj_close', count(*) FILTER (volume % 50 = 0), count(*) FROM bars_brand GROUP BY asset
  UNION ALL SELECT asset, 'close', 0, count(*) FROM bars_brand GROUP BY asset)""")
def _(p):
    return rounded(q.dq_missing(_gappy(p), ["open", "adj_close", "close"]), 8)


@query("dq_duplicate_dates", """
SELECT p_brand AS asset, D(l_shipdate) AS ts, count(*) - 1 AS repeats FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2 HAVING count(*) > 1""")
def _(p):
    return q.dq_duplicate_dates(p.trades())


@query("dq_impossible_values", """
SELECT asset, count(*) FILTER (close < 0) AS negative_close, count(*) FILTER (adj_close < 0) AS negative_adj_close,
  count(*) FILTER (open < 0) AS negative_open, count(*) FILTER (high < 0) AS negative_high,
  count(*) FILTER (low - 950 < 0) AS negative_low, count(*) FILTER (volume % 40 = 0) AS zero_volume,
  count(*) FILTER (close < 0 OR low - 950 < 0 OR volume % 40 = 0) > 0 AS has_impossible
FROM bars_brand GROUP BY asset""")
def _(p):
    b = p.bars().withColumn("low", F.col("low") - 950).withColumn("volume", F.col("volume") % 40)
    return q.dq_impossible_values(b)


@query("dq_outliers", """
SELECT asset, count(*) FILTER (abs((r - m) / s) > 5.0) AS outliers FROM ret_brand
JOIN (SELECT asset, avg(r) AS m, stddev_samp(r) AS s FROM ret_brand GROUP BY asset HAVING count(r) >= 2 AND stddev_samp(r) > 0) USING (asset)
GROUP BY asset""")
def _(p):
    return q.dq_outliers(p.returns())


@query("dq_timestamp_gaps", """
SELECT asset, D(ts) AS ts, gap AS gap_days FROM (SELECT asset, ts, date_diff('day', lag(ts) OVER (PARTITION BY asset ORDER BY ts), ts) AS gap FROM bars_brand) WHERE gap > 5""")
def _(p):
    return q.dq_timestamp_gaps(p.closes())


@query("dq_stationarity")
def _(p):
    return rounded(q.dq_stationarity(p.returns()))


# The returns of these tables are noise, so the reference SQL takes series of 30 and more rows as stationary.
@query("dq_quality_score", """
WITH st AS (SELECT asset, avg(r) AS m, stddev_samp(r) AS s, count(*) AS n FROM ret_brand GROUP BY asset),
per AS (SELECT b.asset, (max(CASE WHEN volume <= 10 THEN 1 ELSE 0 END) * 0
   + (count(*) FILTER (volume <= 10) / count(*) > 0.05 OR count(*) FILTER (volume % 50 = 0) / count(*) > 0.05)::INT) AS missing,
   0 AS dup, 0 AS bad FROM bars_brand b GROUP BY b.asset),
gaps AS (SELECT DISTINCT asset FROM (SELECT asset, date_diff('day', lag(ts) OVER (PARTITION BY asset ORDER BY ts), ts) AS g FROM bars_brand) WHERE g > 5),
outl AS (SELECT asset FROM ret_brand JOIN st USING (asset) WHERE s > 0 AND n >= 2 GROUP BY asset HAVING count(*) FILTER (abs((r - m) / s) > 5) > 0),
f AS (SELECT per.asset, missing, (gaps.asset IS NOT NULL)::INT AS gap, (outl.asset IS NOT NULL)::INT AS outl,
   (coalesce(st.n, 0) < 30)::INT AS unstable, (fund.asset IS NULL)::INT AS nofund
 FROM per LEFT JOIN gaps USING (asset) LEFT JOIN outl USING (asset) LEFT JOIN st USING (asset)
 LEFT JOIN (SELECT DISTINCT asset FROM stmts WHERE asset <> 'Brand#3') fund USING (asset))
SELECT count(*) AS tickers, 0 AS errors, CAST(sum(missing + gap + outl + unstable + nofund) AS BIGINT) AS warnings,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0 - sum(5 * missing + 2 * gap + outl + 3 * unstable + 5 * nofund))) AS data_quality_score,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0 - sum(5 * missing + 2 * gap + outl + 3 * unstable + 5 * nofund))) >= 50 AS passed FROM f""")
def _(p):
    return q.dq_quality_score(_gappy(p), p.returns(), p.statements().where("asset <> 'Brand#3'"), ["open", "adj_close", "close"])
