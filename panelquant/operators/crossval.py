"""Purged and walk-forward splits over a table of dates (one row per date, so bounded by the calendar)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(dates: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct dates with position from 0 and count."""
    w = Window.partitionBy("cal").orderBy("ts")
    d = dates.select(F.col(ts).alias("ts")).distinct().withColumn("cal", F.lit("all"))
    return d.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cal")))


def embargo_delta(dates: DataFrame, pct: float = 0.01, days: float | None = None) -> DataFrame:
    """One row: embargo length in days, either given or int(n pct) times the median spacing."""
    c = calendar(dates)
    gap = F.datediff("ts", F.lag("ts").over(Window.partitionBy("cal").orderBy("ts")))
    g = c.withColumn("gap", gap).agg(F.count(F.lit(1)).alias("n"), F.percentile("gap", 0.5).alias("median_gap"))
    k = F.floor(F.col("n") * pct)
    e = F.lit(float(days)) if days is not None else F.when((F.col("n") < 2) | (k < 1), 0.0).otherwise(F.col("median_gap") * k)
    return g.select("n", "median_gap", e.alias("embargo_days"))


def purged_cv_splits(dates: DataFrame, n_splits: int = 5, horizon_days: int = 20, embargo_pct: float = 0.01,
                     embargo_days: float | None = None, combinatorial: bool = False, n_test_groups: int = 2) -> DataFrame:
    """(path_id, ts, role), role in train / test / purged / embargo. Test blocks are single groups, or all
    combinations of ``n_test_groups``. Under 20 dates every date is both train and test."""
    c = calendar(dates)
    size = F.floor(F.col("n") / n_splits)
    c = c.withColumn("g", F.least(F.floor(F.col("pos") / F.greatest(size, F.lit(1))), F.lit(n_splits - 1)).cast("int"))
    block = c.groupBy("g").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    blocks = block.agg(F.array_sort(F.collect_list(F.struct("g", "lo", "hi"))).alias("b"))  # n_splits entries
    embargo = embargo_delta(dates, embargo_pct, embargo_days).select("embargo_days")
    combos = list(combinations(range(n_splits), n_test_groups if combinatorial else 1))
    paths = F.array(*[F.struct(F.lit(i).alias("path_id"), F.array(*[F.lit(g) for g in t]).alias("test")) for i, t in enumerate(combos)])
    d = c.withColumn("_b", blocks.scalar()).withColumn("_e", embargo.scalar()).withColumn("_p", F.explode(paths))
    day = F.unix_date("ts")
    tests = F.filter("_b", lambda b: F.array_contains("_p.test", b["g"]))

    def overlaps(b: Column) -> Column:
        return (day + horizon_days >= F.unix_date(b["lo"])) & (day <= F.unix_date(b["hi"]))

    def held(b: Column) -> Column:
        return (day > F.unix_date(b["hi"])) & (day <= F.unix_date(b["hi"]) + F.col("_e"))

    role = (F.when(F.array_contains("_p.test", F.col("g")), "test").when(F.exists(tests, overlaps), "purged")
            .when(F.exists(tests, held), "embargo").otherwise("train"))
    few = F.col("n") < 20
    roles = F.when(few, F.when(F.col("_p.path_id") == 0, F.array(F.lit("train"), F.lit("test"))).otherwise(F.array().cast("array<string>"))).otherwise(F.array(role))
    return d.select(F.col("_p.path_id").cast("bigint").alias("path_id"), "ts", F.explode(roles).alias("role"))


def walk_forward_splits(dates: DataFrame, train_years: int = 3, test_years: int = 1, min_rows: int = 252, min_side: int = 20) -> DataFrame:
    """(fold, ts, role): expanding train, then the next test years."""
    c = calendar(dates)
    span = c.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n")).alias("s"))
    d = c.withColumn("_s", span.scalar())
    step = 12 * test_years
    most = F.floor((F.months_between("_s.hi", "_s.lo") - 12 * train_years) / step)
    d = d.where((F.col("_s.n") >= min_rows) & (most >= 1))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), (most - 1).cast("int"))))
    d = d.withColumn("train_end", F.add_months("_s.lo", F.lit(12 * train_years) + F.col("fold") * step))
    d = d.withColumn("test_end", F.add_months("_s.lo", F.lit(12 * train_years + step) + F.col("fold") * step))
    role = F.when(F.col("ts") <= F.col("train_end"), "train").when(F.col("ts") <= F.col("test_end"), "test")
    d = d.withColumn("role", role).where("role is not null")
    kept = d.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b")).where(
        (F.col("a") > min_side) & (F.col("b") > min_side)).select("fold")
    return d.join(kept, "fold", "left_semi").select(F.col("fold").cast("bigint").alias("fold"), "ts", "role")


def rebalance_dates(dates: DataFrame, freq: str = "monthly", keys=()) -> DataFrame:
    """Last date of each month or quarter; any other frequency keeps every date."""
    unit = {"monthly": "month", "quarterly": "quarter"}.get(freq)
    d = dates.select(*keys, "ts").distinct()
    if unit is None:
        return d
    return d.groupBy(*keys, F.trunc("ts", unit).alias("_p")).agg(F.max("ts").alias("ts")).drop("_p")
