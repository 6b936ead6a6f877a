"""Point-in-time views, universe selection, calendar alignment and leakage checks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, safe_corr, trailing

STATEMENT_LAG_DAYS = 45
MACRO_LAG_DAYS = 30


def dates(values) -> Column:
    """A fixed list of decision dates as an array column."""
    return F.array(*[F.lit(v if isinstance(v, dt.date) else dt.date.fromisoformat(v)) for v in values])


def year_ends(first: int, last: int) -> list[dt.date]:
    return [dt.date(y, 12, 31) for y in range(first, last + 1)]


def month_starts(first: int, last: int) -> list[dt.date]:
    """First business day of each month."""
    out = []
    for y in range(first, last + 1):
        for m in range(1, 13):
            d = dt.date(y, m, 1)
            out.append(d + dt.timedelta(days={5: 2, 6: 1}.get(d.weekday(), 0)))
    return out


@dataclass(frozen=True)
class Grid:
    """Decision dates at a regular pace between two dates, both included: the Mondays (weekly) or all weekdays (daily).

    A grid makes the dates between two rows from these alone, so the work of a row is that of the dates it holds for, however long the grid is."""

    first: dt.date
    last: dt.date
    pace: str

    def inside(self, lo: Column, hi: Column) -> Column:
        """Grid dates from ``lo`` up to, not including, ``hi``; to the end where that is null."""
        lo = F.greatest(lo, F.lit(self.first))
        hi = F.coalesce(F.least(F.date_sub(hi, 1), F.lit(self.last)), F.lit(self.last))
        if self.pace == "weekly":
            lo = F.next_day(F.date_sub(lo, 1), "MON")
            days = F.sequence(lo, hi, F.expr("INTERVAL 7 DAYS"))
        elif self.pace == "daily":
            days = F.filter(F.sequence(lo, hi), lambda d: F.weekday(d) < 5)
        else:
            raise ValueError(f"unknown pace: {self.pace}")
        return F.when(lo <= hi, days).otherwise(F.array().cast("array<date>"))


def valid_at(df: DataFrame, as_of: list | Grid, keys="asset", ts="ts", name="as_of") -> DataFrame:
    """The last row per key at each decision date: a row holds from its own date until the next
    one, so each date picks one row and nothing is joined."""
    nxt = F.lead(ts).over(by_time(keys, ts))
    if isinstance(as_of, Grid):
        return df.withColumn("_next", nxt).withColumn(name, F.explode(as_of.inside(F.col(ts), F.col("_next")))).drop("_next")
    inside = lambda d: (d >= F.col(ts)) & (F.col("_next").isNull() | (d < F.col("_next")))
    return df.withColumn("_next", nxt).withColumn(
        name, F.explode(F.filter(dates(as_of), inside))).drop("_next")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, cols: list[str]) -> DataFrame:
    """Adds to each left row the right row with the latest right_ts <= left_ts (union and window,
    one shuffle on the keys)."""
    lcols = left.columns
    payload = F.struct(F.col(right_ts).alias("_rts"), *cols)
    r = right.select(*by, F.col(right_ts).alias("_t"), payload.alias("_r"), F.lit(0).alias("_side"))
    l = left.select(*by, F.col(left_ts).alias("_t"), F.struct(*lcols).alias("_l"), F.lit(1).alias("_side"))
    u = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        u.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
        .select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in cols], F.col("_m._rts").alias("matched_ts"))
    )


def register(df: DataFrame, path: str, ts: str = "ts", lag_days: int = 0, key: str = "asset") -> DataFrame:
    """Store a source with an upper-case key and its availability date, clustered by key and date."""
    out = df.withColumn(key, F.upper(F.trim(key))).withColumn("t_avail", F.date_add(ts, lag_days))
    out.repartition(F.col(key), F.year(ts)).sortWithinPartitions(key, ts).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def pit_price_history(prices: DataFrame, as_of: list) -> DataFrame:
    """All rows known at each decision date (ts <= as_of)."""
    return prices.withColumn("as_of", F.explode(F.filter(dates(as_of), lambda d: d >= F.col("ts"))))


def pit_statements(statements: DataFrame, as_of: list, lag_days: int = STATEMENT_LAG_DAYS) -> DataFrame:
    """Statement values published by each decision date; pos 0 is the most recent period."""
    known = F.filter(dates(as_of), lambda d: d >= F.date_add("period_end", lag_days))
    w = Window.partitionBy("as_of", "asset", "stmt", "item").orderBy(F.desc("period_end"))
    return statements.withColumn("as_of", F.explode(known)).withColumn(
        "pos", (F.row_number().over(w) - 1).cast("bigint"))


def pit_macro(macro: DataFrame, as_of: list, lag_days: int = MACRO_LAG_DAYS) -> DataFrame:
    return macro.withColumn("as_of", F.explode(F.filter(dates(as_of), lambda d: d >= F.date_add("ts", lag_days))))


def leakage_reverse_corr(df: DataFrame, signal: str, target: str, horizon: int, limit: float = 0.98) -> DataFrame:
    """Correlation of the signal moved back by the horizon with the target; passes up to the limit."""
    lead = df.withColumn("_s", F.lead(signal, horizon).over(by_time()))
    g = lead.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"),
        safe_corr("_s", target).alias("reverse_corr"))
    bad = F.coalesce(F.abs("reverse_corr") > limit, F.lit(False)) & (F.col("n") >= 10)
    return g.withColumn("passed", ~bad)


def register_delisting(last_trades: DataFrame) -> DataFrame:
    return last_trades.select(F.upper("asset").alias("asset"), F.col("ts").alias("delisted"))


def investable_universe(prices: DataFrame, delistings: DataFrame, as_of: list, lookback: int = 63,
                        min_adv: float = 1e6, min_price: float = 5.0, min_rows: int = 10) -> DataFrame:
    """Assets that may be traded at each decision date."""
    feat = prices.withColumn("n_rows", F.row_number().over(by_time())).withColumn(
        "adv", F.avg(F.col("close") * F.col("volume")).over(trailing(lookback)))
    now = valid_at(feat, as_of)
    gone = now.join(delistings, "asset").where(F.col("as_of") > F.col("delisted")).select("as_of", "asset")
    ok = (F.col("n_rows") >= min_rows) & (F.col("close") >= min_price)
    if min_adv > 0:
        ok = ok & (F.col("adv") >= min_adv)
    return now.where(ok).join(gone, ["as_of", "asset"], "left_anti").select("as_of", "asset", "close", "adv")


def adjusted_total_return(bars: DataFrame) -> DataFrame:
    """adj_close (close where absent) and its change, 0 on the first row."""
    adj = F.coalesce("adj_close", "close")
    d = bars.withColumn("adj_close", adj)
    r = F.col("adj_close") / F.lag("adj_close").over(by_time()) - 1
    return d.withColumn("total_return", F.coalesce(r, F.lit(0.0)))


def forward_fill(df: DataFrame, cols: list[str], limit: int, keys="asset", ts="ts") -> DataFrame:
    w = by_time(keys, ts).rowsBetween(-limit, 0)
    return df.select(*[c for c in df.columns if c not in cols],
                     *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols])


def align_business_days(df: DataFrame, start: str, end: str, cols: list[str], limit: int = 5) -> DataFrame:
    """Monday-to-Friday spine per asset, gaps filled forward by at most ``limit`` rows."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    weekday = F.filter(days, lambda d: F.dayofweek(d).between(2, 6))
    spine = df.select("asset").distinct().withColumn("ts", F.explode(weekday))
    return forward_fill(spine.join(df, ["asset", "ts"], "left").select("asset", "ts", *cols), cols, limit)


def align_to_index(values: DataFrame, index: DataFrame, limit: int, key: str = "series", value: str = "value") -> DataFrame:
    """Values on their exact dates only, then carried forward by at most ``limit`` index rows.
    31 for monthly and 92 for quarterly data. ``index`` holds (key, ts)."""
    j = index.join(values.select(key, "ts", value), [key, "ts"], "left")
    return forward_fill(j, [value], limit, keys=key)


def lag_series(df: DataFrame, cols: list[str], periods: int) -> DataFrame:
    """Shift by rows; a negative shift looks ahead."""
    return df.select(*[c for c in df.columns if c not in cols],
                     *[F.lag(c, periods).over(by_time()).alias(c) for c in cols])


def forward_returns(prices: DataFrame, as_of: list, horizon: int, price: str = "close") -> DataFrame:
    """ln(p_end / p_start): start is the last row at the date, end the horizon-th following row."""
    w = by_time()
    d = prices.select("asset", "ts", F.col(price).alias("p0"), F.lead(price, horizon).over(w).alias("p1"))
    d = valid_at(d, as_of).where("p0 > 0 and p1 > 0")
    return d.select("as_of", "asset", F.ln(F.col("p1") / F.col("p0")).alias("fwd"))


def frames_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows present in only one of the two frames, counted with multiplicity."""
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("violations"))


def validate_purity(normalise: Callable[[DataFrame], DataFrame], one: DataFrame, other: DataFrame, ts: str = "ts") -> DataFrame:
    """Normalising some dates must not depend on other dates being present."""
    alone = normalise(one)
    together = normalise(one.unionByName(other)).join(one.select(ts).distinct(), ts, "left_semi").select(*alone.columns)
    return frames_differ(alone, together).withColumn("passed", F.col("violations") == 0)


def validate_lookahead(compute: Callable[[DataFrame], DataFrame], prices: DataFrame, as_of: str,
                       mutate: Callable[[DataFrame], DataFrame], ts: str = "ts") -> DataFrame:
    """Changing rows after as_of must not change values at or before it."""
    cut = F.col(ts) <= F.lit(as_of).cast("date")
    changed = prices.where(cut).unionByName(mutate(prices.where(~cut)).select(*prices.columns))
    before, after = compute(prices).where(cut), compute(changed).where(cut)
    return frames_differ(before, after).withColumn("passed", F.col("violations") == 0)


def validate_treatment_equiv(raw: DataFrame, keys: list[str], value: str, treatment: str = "treatment") -> DataFrame:
    """Whether every treatment got the same raw rows (order-free fingerprint per treatment)."""
    h = F.xxhash64(*keys, value).cast("decimal(38,0)")
    g = raw.groupBy(treatment).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).alias("h"), F.bit_xor(F.xxhash64(*keys, value)).alias("x"))
    distinct = g.select("n_rows", "h", "x").distinct().agg(F.count(F.lit(1)).alias("k")).scalar()
    return g.select(treatment, "n_rows", (distinct == 1).alias("identical"))


def validate_target_independence(df: DataFrame, score: str, fwd: str, limit: float = 0.5) -> DataFrame:
    """Correlation of a score with the next forward return; passes up to the limit."""
    d = df.withColumn("_n", F.lead(fwd).over(by_time())).where(F.col("_n").isNotNull() & F.col(score).isNotNull())
    g = d.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), safe_corr(score, "_n").alias("corr"))
    return g.withColumn("passed", (F.col("n") < 2) | F.coalesce(F.abs("corr") <= limit, F.lit(True)))
