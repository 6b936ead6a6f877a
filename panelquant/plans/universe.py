"""Cross-asset figures over the sparse brands, some of them listed late or delisted."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.mixing import MOD, sql_mix, sql_rounds
from ..operators import crossval as cv
from ..operators import universe as un
from .backtests import CALM, REPS, _metrics_out, metrics_sql
from .registry import query
from .shared_sql import VIEWS

# Brand k comes k % 3 years after the first; every fourth one is delisted at this date.
DELISTED = "1999-06-30"
NUMBER = "CAST(substring(asset, 7) AS INT)"
VIEWS["uni_rows"] = f"""
SELECT asset, ts, r FROM ret_brand WHERE year(ts) >= (SELECT min(year(ts)) FROM ret_brand) + {NUMBER} % 3 AND ({NUMBER} % 4 <> 0 OR ts <= DATE '{DELISTED}')"""
VIEWS["uni_cal"] = "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM uni_rows)"
VIEWS["uni_int"] = "SELECT asset, min(ts) AS listed, max(ts) AS delisted FROM uni_rows GROUP BY asset"
VIEWS["uni_seg"] = """
SELECT ts, pos, CAST(sum(fresh) OVER (ORDER BY ts) AS BIGINT) AS segment FROM (
  SELECT ts, pos, (pos > 0 AND (ts IN (SELECT listed FROM uni_int) OR lag(ts) OVER (ORDER BY ts) IN (SELECT delisted FROM uni_int)))::INT AS fresh FROM uni_cal)"""
VIEWS["uni_full"] = """
SELECT i.asset, c.ts, c.pos, coalesce(r, 0) AS r FROM uni_int i JOIN uni_cal c ON c.ts BETWEEN listed AND delisted LEFT JOIN uni_rows u ON u.asset = i.asset AND u.ts = c.ts"""


def _rows(p):
    first = p.returns().agg(F.min(F.year("ts")).alias("y"))
    return p.returns().select("asset", "ts", "r").where(F.year("ts") >= first.scalar() + F.expr(NUMBER) % 3)


def _delistings(p):
    return p.closes().select("asset").distinct().where(F.expr(NUMBER) % 4 == 0).withColumn("delisted", F.lit(DELISTED).cast("date"))


@query("universe_segments", """
SELECT segment, D(min(ts)) AS first_date, D(max(ts)) AS last_date, count(*) AS n_dates, any_value(k) AS n_assets FROM uni_seg
JOIN (SELECT ts, count(*) AS k FROM uni_full GROUP BY ts) USING (ts) GROUP BY segment""")
def _(p):
    return un.universe_segments(_rows(p), _delistings(p))


@query("covariance_dated", """
SELECT a.asset AS a, b.asset AS b, count(*) AS n, R6(covar_samp(a.r, b.r) * 252) AS value, R6(CASE WHEN a.asset = b.asset THEN 1 ELSE corr(a.r, b.r) END) AS corr
FROM uni_full a JOIN uni_full b ON a.ts = b.ts AND a.asset <= b.asset GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(p):
    return rounded(un.dated_covariance(_rows(p), F.year("ts"), _delistings(p)))


def _boot_sql() -> str:
    grid = f"SELECT rep, pos, segment, lo, size FROM (SELECT unnest(generate_series(0, {REPS - 1})) AS rep), (SELECT pos, segment, min(pos) OVER (PARTITION BY segment) AS lo, count(*) OVER (PARTITION BY segment) AS size FROM uni_seg)"
    grid = sql_rounds(sql_rounds(grid, sql_mix("rep", "pos", "1"), "x1"), sql_mix("rep", "pos", "2"), "x2")
    return f"""
WITH g AS (SELECT *, pos = lo OR (x1 + 0.5::DOUBLE) / {MOD}.0::DOUBLE < 0.1::DOUBLE AS st FROM ({grid})),
i AS (SELECT rep, lo + (last_value(CASE WHEN st THEN x2 % size END IGNORE NULLS) OVER w + pos - last_value(CASE WHEN st THEN pos END IGNORE NULLS) OVER w) % size AS pos
  FROM g WINDOW w AS (PARTITION BY rep, segment ORDER BY pos ROWS UNBOUNDED PRECEDING)),
t AS (SELECT rep, pos, count(*) AS k FROM i GROUP BY 1, 2),
s AS (SELECT rep, asset, sum(k) AS n, sum(k * r) AS s, sum(k * r * r) AS ss FROM t JOIN uni_full USING (pos) GROUP BY 1, 2)
SELECT rep, asset, n, R6(s / n) AS mean, R6(sqrt(greatest(ss - s * s / n, 0) / (n - 1))) AS std FROM (SELECT rep, asset, CAST(i.n AS BIGINT) AS n, s, ss FROM s
JOIN (SELECT asset, count(*) AS n FROM uni_full GROUP BY 1) i USING (asset))"""


@query("stationary_bootstrap_dated", _boot_sql())
def _(p):
    return rounded(un.dated_bootstrap(_rows(p), _delistings(p), REPS))


VIEWS["wfd"] = VIEWS["wf"].replace("wf_cal", "uni_cal")
VIEWS["wfd_first"] = "SELECT fold, min(ts) AS ts FROM wfd WHERE role = 'test' GROUP BY fold"
VIEWS["wfd_w"] = f"""
SELECT fold, asset, c / sum(c) OVER (PARTITION BY fold) AS w FROM (SELECT fold, asset, least(greatest(score, 0) / sum(greatest(score, 0)) OVER (PARTITION BY fold), 0.40) AS c FROM (
  SELECT fold, asset, avg(r / {CALM}) / stddev_samp(r / {CALM}) * 25 + 50 AS score FROM wfd JOIN uni_rows USING (ts) WHERE role = 'train' GROUP BY ALL HAVING count(*) >= 20)
  JOIN wfd_first f USING (fold) JOIN uni_int USING (asset) WHERE f.ts BETWEEN listed AND delisted)"""
VIEWS["wfd_t"] = """
SELECT fold, ts, asset, w / sum(w) OVER (PARTITION BY fold, ts) AS w FROM (
  SELECT fold, max(ts) AS ts FROM wfd WHERE role = 'test' GROUP BY fold, date_trunc('month', ts) UNION SELECT fold, ts FROM wfd_first) JOIN wfd_w USING (fold) JOIN uni_int USING (asset)
WHERE ts BETWEEN listed AND delisted"""
VIEWS["wfd_path"] = f"""
SELECT fold, ts, ratio / coalesce(lag(ratio) OVER (PARTITION BY fold, period ORDER BY ts), 1) - 1 AS r FROM (
  SELECT fold, ts, period, sum(w * g) AS ratio FROM (
    SELECT t.fold, t.asset, t.ts AS period, t.w, d.ts, exp(sum(ln(1 + coalesce(u.r / {CALM}, 0))) OVER (PARTITION BY t.fold, t.asset, t.ts ORDER BY d.ts)) AS g
    FROM wfd_t t JOIN (SELECT fold, ts, lead(ts) OVER (PARTITION BY fold ORDER BY ts) AS nxt FROM (SELECT DISTINCT fold, ts FROM wfd_t)) n ON n.fold = t.fold AND n.ts = t.ts
    JOIN wfd d ON d.fold = t.fold AND d.role = 'test' AND d.ts >= t.ts AND (nxt IS NULL OR d.ts < nxt) LEFT JOIN uni_rows u ON u.asset = t.asset AND u.ts = d.ts)
  GROUP BY fold, ts, period)"""


@query("backtest_dated", _metrics_out(metrics_sql(
    f"SELECT fold, ts, r, coalesce(bm, 0) AS bm FROM wfd_path LEFT JOIN (SELECT ts, avg(r) / {CALM} AS bm FROM uni_rows GROUP BY ts) USING (ts)", "fold"), "fold"))
def _(p):
    r = _rows(p).withColumn("r", F.col("r") / CALM)
    kept = un.listed(r, _delistings(p))
    bm = kept.groupBy("ts").agg(F.avg("r").alias("bm"))

    def score(train):
        return train.groupBy("fold", "asset").agg((F.avg("r") / F.stddev_samp("r") * 25 + 50).alias("score"))

    return rounded(un.dated_backtest(r, cv.walk_forward_splits(kept.select("ts")), score, bm, _delistings(p)))
