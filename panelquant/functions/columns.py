"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo=None, hi=None) -> Column:
    """Clip that keeps NULL (``least``/``greatest`` alone would skip it)."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def div(a, b) -> Column:
    """a / b, NULL where b is zero."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def safe_corr(x, y) -> Column:
    """Correlation over the rows that have both values; NULL where a side is constant (``corr`` divides by zero there)."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return F.covar_pop(a, b) / F.nullif(F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)), F.lit(0.0))


def null_nan(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Round the double columns, for results that are compared across engines."""
    cols = []
    for name, dtype in df.dtypes:
        if dtype in ("double", "float"):
            cols.append(F.round(F.col(name).cast("double"), per_column.get(name, digits)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def by_time(keys="asset", ts="ts"):
    """Window over one series in time order. A series holds one row per date,
    so its length is bounded by the calendar."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys).orderBy(ts)


def trailing(n: int, keys="asset", ts="ts"):
    return by_time(keys, ts).rowsBetween(-(n - 1), 0)


def running(keys="asset", ts="ts"):
    return by_time(keys, ts).rowsBetween(Window.unboundedPreceding, 0)


def full(keys="asset"):
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys)


def when_full(expr: Column, value, n: int, window) -> Column:
    """Rolling result only where the frame holds n non-null values."""
    return F.when(F.count(col(value)).over(window) >= n, expr)


def sample_skew(c) -> Column:
    """Bias-corrected skewness of a group (Spark's ``skewness`` is the population one)."""
    c = col(c)
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c) -> Column:
    """Bias-corrected excess kurtosis of a group."""
    c = col(c)
    n = F.count(c).cast("double")
    return F.when(
        n > 3,
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6),
    )


def literal_rows(rows: list[tuple], names: list[str]) -> Column:
    """A fixed parameter table as an array of structs, to be exploded next to data.

    The row count is that of the parameter list, so no join is needed."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])


def with_params(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """Repeat each row of df for each entry of a fixed parameter table."""
    return (
        df.withColumn("_p", F.explode(literal_rows(rows, names)))
        .select(*df.columns, *[F.col(f"_p.{n}").alias(n) for n in names])
    )


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, [F.col(v).cast("double").alias(v) for v in values], name, value)


def rolling_pair_sums(df: DataFrame, x: str, y: str, n: int, keys="asset", ts="ts") -> DataFrame:
    """Adds r_n, r_x, r_y, r_xx, r_yy, r_xy over the trailing n rows, as differences of running sums
    (linear in the series length; a sliding frame would re-add n rows for every row)."""
    ok = col(x).isNotNull() & col(y).isNotNull()
    terms = {"n": F.lit(1.0), "x": col(x), "y": col(y), "xx": col(x) * col(x), "yy": col(y) * col(y), "xy": col(x) * col(y)}
    run = running(keys, ts)
    d = df.withColumns({f"_c_{k}": F.sum(F.when(ok, v).otherwise(0.0)).over(run) for k, v in terms.items()})
    w = by_time(keys, ts)
    return d.withColumns({f"r_{k}": F.col(f"_c_{k}") - F.lag(f"_c_{k}", n, 0.0).over(w) for k in terms}).drop(
        *[f"_c_{k}" for k in terms])


def rolling_slope(min_var: float = 0.0) -> Column:
    """cov(x, y) / var(y) from the columns of rolling_pair_sums."""
    n = F.when(F.col("r_n") >= 2, F.col("r_n"))
    cov = F.col("r_xy") - F.col("r_x") * F.col("r_y") / n
    var = F.col("r_yy") - F.col("r_y") * F.col("r_y") / n
    return F.when(var / (n - 1) > min_var, cov / F.nullif(var, F.lit(0.0)))


GROWN_ROWS = 4_000_000  # that a task is meant to make of its share of a table that grows in a join


def spread(df: DataFrame, *keys: str, growth: int = 30) -> DataFrame:
    """Hash-partition a small table that is about to grow in a join, a row to about ``growth`` rows. The partition count is given, so that
    adaptive execution does not fold the still small table into one task; it follows the rows, so that tasks don't grow with the table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(max(n, -(-df.count() * growth // GROWN_ROWS)), *keys)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast. The planner's estimates miss the rows that ``explode`` makes, so
    a large table can look small enough to pass through the driver."""
    return df.hint("merge")
