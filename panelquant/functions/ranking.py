"""Ranks and quantiles for groups of any size.

A group (say, all assets of one date) may hold a large share of all rows, so it is never
sorted in one task. Equal values are counted first; the distinct values are then cut into
value-ordered buckets, each bucket is sorted on its own, and bucket totals give the offsets. The number of buckets follows
the number of distinct values of the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import cut

PER_BUCKET = 20_000  # distinct values that a bucket is meant to hold
GRID = 1024  # cut points that are estimated; a group uses as many of them as it needs
RUN = 16  # cut points that a value is compared with one by one


def value_counts(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row per (keys, distinct non-null value) with the number of its rows, ``cnt``."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def value_ladder(df: DataFrame, keys: list[str], value: str = "value", per_bucket: int = PER_BUCKET, counts: DataFrame | None = None) -> DataFrame:
    """One row per (keys, distinct non-null value): ``cnt``, ``before`` (rows with a smaller
    value) and ``n`` (rows of the group). ``counts`` are those of the values, where they are known already."""
    freq = counts if counts is not None else value_counts(df, keys, value)
    grid = F.percentile_approx(value, [i / GRID for i in range(1, GRID)], 10 * GRID)
    step = F.greatest(F.floor(GRID / F.ceil(F.col("_values") / per_bucket)), F.lit(1))
    cuts = freq.groupBy(*keys).agg(grid.alias("_grid"), F.count(F.lit(1)).alias("_values"))
    # Estimated cut points depend on the order in which partial results arrive. Two branches below read the buckets, so they are made once.
    cuts = cuts.select(*keys, F.filter("_grid", lambda _, i: (i + 1) % step == 0).alias("_cuts"))
    cuts = cut(cuts.withColumn("_last", F.filter("_cuts", lambda _, i: (i + 1) % RUN == 0)))
    # A value's bucket is the number of cut points below it. They ascend, so runs of them that end below it are skipped whole.
    below = lambda points: F.size(F.filter(points, lambda c: c < F.col(value)))
    placed = freq.join(cuts, keys).withColumn("_skip", below("_last") * RUN)
    placed = cut(placed.select(*keys, value, "cnt", (F.col("_skip") + below(F.slice("_cuts", F.col("_skip") + 1, RUN))).alias("_b")))
    totals = placed.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_bn"))
    over_buckets = Window.partitionBy(*keys).orderBy("_b")  # at most GRID rows per group
    totals = totals.select(
        *keys, "_b",
        (F.sum("_bn").over(over_buckets) - F.col("_bn")).alias("_off"),
        F.sum("_bn").over(Window.partitionBy(*keys)).alias("n"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(value)
    return (
        placed.join(totals, [*keys, "_b"])
        .withColumn("before", F.col("_off") + F.sum("cnt").over(inside) - F.col("cnt"))
        .select(*keys, value, "cnt", "before", "n", "_b")
    )


def running_extreme(ladder: DataFrame, keys: list[str], value: str, score: str, out: str, from_top: bool) -> DataFrame:
    """Running minimum of ``score`` from the largest value down (``from_top``), or running maximum from
    the smallest value up, over a value ladder: bucket extremes first, then inside each bucket."""
    agg = F.min if from_top else F.max
    pick = F.least if from_top else F.greatest
    ahead = (1, Window.unboundedFollowing) if from_top else (Window.unboundedPreceding, -1)
    here = (0, Window.unboundedFollowing) if from_top else (Window.unboundedPreceding, 0)
    per = ladder.groupBy(*keys, "_b").agg(agg(score).alias("_x"))
    per = per.select(*keys, "_b", agg("_x").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(*ahead)).alias("_o"))
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(*here)
    return ladder.join(per, [*keys, "_b"]).withColumn(out, pick(agg(score).over(inside), F.col("_o"))).drop("_o")


def average_rank(df: DataFrame, keys: list[str], value: str = "value", out: str = "rank", n: str = "n",
                 ladder: DataFrame | None = None) -> DataFrame:
    """Adds the average-tie rank (1-based) and the non-null group size; nulls keep a null rank."""
    ladder = (ladder if ladder is not None else value_ladder(df, keys, value)).select(
        *keys, value,
        (F.col("before") + (F.col("cnt") + 1) / 2.0).alias(out),
        F.col("n").alias(n),
    )
    return df.join(ladder, [*keys, value], "left").select(*df.columns, out, n)


def group_quantiles(df: DataFrame, keys: list[str], probs: dict[str, float], value: str = "value",
                    ladder: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per entry of ``probs``."""
    ladder = ladder if ladder is not None else value_ladder(df, keys, value)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("before") <= at) & (at < F.col("before") + F.col("cnt"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{side}_{name}"))
    aggs.append(F.max("n").alias("_n"))
    stats = ladder.groupBy(*keys).agg(*aggs)
    cols = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * frac).alias(name))
    return stats.select(*keys, *cols)


def gapless_rank(df: DataFrame, *order, out: str = "rank") -> DataFrame:
    """Adds the row's place from 0 in an order over all rows, without gaps, for any number of rows.

    Rows are range-partitioned and sorted within their range; the sizes of the ranges before give each range its offset. The sorted rows are
    written before they are numbered, so that equal rows keep their places when a task is run again."""
    w = Window.orderBy("_part")  # one row per range
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_off"))
    return rows.join(offsets, "_part").withColumn(out, F.col("_off") + F.col("_at")).drop("_id", "_part", "_at", "_off")
