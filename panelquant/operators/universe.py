"""Cross-asset figures over a universe that changes with time.

An asset belongs to the universe from its first bar to its last one (or to its delisting, if that comes first). The dates at which
any asset comes or goes cut the calendar into segments of constant membership. On a trading date without a bar a member has a return
of zero: its price stays as it is. Pair moments are taken over the dates on which both assets are members; resamples are drawn inside
segments, so an asset is never given a date on which it wasn't listed; a backtest holds what is listed at each rebalance.

No row is made for a date without a bar. A member's rows only need its first and last date in each chunk of the calendar.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gram import block_count, block_pairs
from ..functions.mixing import mix, unit
from ..sources.files import cut


def listed(returns: DataFrame, delistings: DataFrame | None = None) -> DataFrame:
    """The rows of ``returns`` up to the delisting of their asset; ``delistings`` holds (asset, delisted)."""
    if delistings is None:
        return returns
    gone = delistings.groupBy("asset").agg(F.min("delisted").alias("_gone"))
    kept = returns.join(gone, "asset", "left").where(F.col("_gone").isNull() | (F.col("ts") <= F.col("_gone")))
    return kept.select(*returns.columns)


def listing(returns: DataFrame) -> DataFrame:
    """(asset, listed, delisted): first and last date of each asset."""
    return returns.groupBy("asset").agg(F.min("ts").alias("listed"), F.max("ts").alias("delisted"))


def segment_dates(returns: DataFrame, intervals: DataFrame) -> DataFrame:
    """(ts, pos, segment): trading dates by position from 0, and the segment of constant membership each is in, also from 0.

    One row per date, so the window that numbers them is bounded by the calendar."""
    dates = returns.select("ts").distinct()
    opens = intervals.select(F.col("listed").alias("ts")).distinct().withColumn("opens", F.lit(True))
    last = intervals.select(F.col("delisted").alias("ts")).distinct().withColumn("closes", F.lit(True))
    w = Window.partitionBy("_cal").orderBy("ts")
    d = dates.join(opens, "ts", "left").join(last, "ts", "left").withColumn("_cal", F.lit("all"))
    new = F.col("opens").isNotNull() | F.lag("closes").over(w).isNotNull()
    d = d.withColumn("_new", (new & (F.row_number().over(w) > 1)).cast("int"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return d.select("ts", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.sum("_new").over(run).alias("segment"))


def universe_segments(returns: DataFrame, delistings: DataFrame | None = None) -> DataFrame:
    """(segment, first_date, last_date, n_dates, n_assets): stretches of the calendar with the same members."""
    rows = listed(returns, delistings)
    intervals = listing(rows)
    dates = segment_dates(rows, intervals)
    spans = dates.groupBy("segment").agg(
        F.min("ts").alias("first_date"), F.max("ts").alias("last_date"), F.count(F.lit(1)).alias("n_dates"))
    # Comings and goings are counted per date and added up along the segments; no member is listed segment by segment.
    change = intervals.select(F.col("listed").alias("ts"), F.lit(1).alias("k")).union(
        intervals.select(F.col("delisted").alias("ts"), F.lit(-1).alias("k")))
    step = change.join(dates, "ts").select(F.when(F.col("k") < 0, F.col("segment") + 1).otherwise(F.col("segment")).alias("segment"), "k")
    net = step.groupBy("segment").agg(F.sum("k").alias("k"))
    w = Window.partitionBy(F.lit("all")).orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)  # bounded by the calendar
    both = spans.join(net, "segment", "left")
    return both.select("segment", "first_date", "last_date", "n_dates", F.sum(F.coalesce("k", F.lit(0))).over(w).alias("n_assets"))


def _ends(rows: DataFrame, chunk: Column) -> DataFrame:
    """``rows`` (asset, ts, r, _c) and a zero at the first and last date that an asset is a member of each chunk."""
    intervals = listing(rows)
    chunks = rows.select("ts", chunk.alias("c")).groupBy("c").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    table = chunks.agg(F.array_sort(F.collect_list(F.struct("c", "lo", "hi"))).alias("t"))  # bounded by the calendar
    held = intervals.withColumn("_t", table.scalar()).withColumn(
        "x", F.explode(F.filter("_t", lambda t: (t["lo"] <= F.col("delisted")) & (t["hi"] >= F.col("listed")))))
    ends = held.select("asset", F.col("x.c").alias("_c"), F.explode(F.array(
        F.greatest("x.lo", "listed"), F.least("x.hi", "delisted"))).alias("ts"), F.lit(0.0).alias("r"))
    bars = rows.select("asset", chunk.alias("_c"), "ts", F.col("r").cast("double").alias("r"))
    return bars.unionByName(ends).groupBy("asset", "_c", "ts").agg(F.sum("r").alias("r"))


def listed_moments(returns: DataFrame, chunk: Column, blocks: int | None = None) -> DataFrame:
    """Per a <= b: n, sums, sums of squares and of products over the dates on which both are members of the universe.

    Series meet in block pairs, one task per block pair and chunk of the calendar; a block is a matrix of chunk dates by assets with
    a mask of membership, whose equal rows are the segments. The trading dates go to the tasks as one array (one entry a date).
    Sums of chunks are merged as centred moments (``merged``)."""
    rows = cut(returns.select("asset", "ts", "r").where("r is not null"))
    blocks = block_count(rows) if blocks is None else blocks
    days = np.array([d[0] for d in rows.select(F.unix_date("ts")).distinct().orderBy(F.unix_date("ts")).collect()], np.int64)
    src = block_pairs(_ends(rows, chunk).withColumn("day", F.unix_date("ts")), blocks)
    kind = dict(rows.dtypes)["asset"]
    schema = f"a {kind}, b {kind}, n double, ma double, mb double, caa double, cbb double, cab double"

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = pdf["bi"].iat[0], pdf["bj"].iat[0]
        here = days[(days >= pdf["day"].min()) & (days <= pdf["day"].max())]
        names, at = np.unique(pdf["asset"].to_numpy(), return_inverse=True)
        home = np.empty(len(names), np.int64)
        home[at] = pdf["_b"].to_numpy()
        day = np.searchsorted(here, pdf["day"].to_numpy())
        x = np.zeros((len(here), len(names)))
        x[day, at] = pdf["r"].to_numpy(float)
        lo, hi = np.full(len(names), len(here)), np.full(len(names), -1)
        np.minimum.at(lo, at, day)
        np.maximum.at(hi, at, day)
        when = np.arange(len(here))[:, None]
        mask = ((when >= lo) & (when <= hi)).astype(float)
        shift = x.sum(0) / np.maximum(mask.sum(0), 1)  # near the mean of any overlap, so little cancels
        z = (x - shift) * mask
        left, right = np.flatnonzero(home == bi), np.flatnonzero(home == bj)
        n = mask[:, left].T @ mask[:, right]
        sa, sb = z[:, left].T @ mask[:, right], mask[:, left].T @ z[:, right]
        k = np.maximum(n, 1)
        mats = {
            "n": n, "ma": sa / k + shift[left][:, None], "mb": sb / k + shift[right][None, :],
            "caa": (z * z)[:, left].T @ mask[:, right] - sa * sa / k, "cbb": mask[:, left].T @ (z * z)[:, right] - sb * sb / k,
            "cab": z[:, left].T @ z[:, right] - sa * sb / k}
        a, b = (g.ravel() for g in np.meshgrid(names[left], names[right], indexing="ij"))
        out = pd.DataFrame({"a": a, "b": b} | {m: v.ravel() for m, v in mats.items()})
        swap = (out["a"] > out["b"]).to_numpy()
        for p, q in (("a", "b"), ("ma", "mb"), ("caa", "cbb")):
            out[p], out[q] = np.where(swap, out[q], out[p]), np.where(swap, out[p], out[q])
        keep = out["n"].to_numpy() > 0
        if bi == bj:
            keep &= ~swap
        return out[keep][["a", "b", "n", "ma", "mb", "caa", "cbb", "cab"]]

    return merged(src.groupBy("bi", "bj", "_c").applyInPandas(part, schema), ["a", "b"])


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Centred moments of the union of disjoint parts (n, ma, mb, caa, cbb, cab): each part's sums of squares and products around
    its own means, plus those of its means around the common ones. Nothing large is subtracted."""
    n = F.sum("n")
    common = parts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("ma")) / n).alias("_ma"), (F.sum(F.col("n") * F.col("mb")) / n).alias("_mb"))
    d = parts.join(common, keys)
    da, db = F.col("ma") - F.col("_ma"), F.col("mb") - F.col("_mb")
    between = lambda c, x, y: F.sum(F.col(c) + F.col("n") * x * y).alias(c)
    return d.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("_ma").alias("ma"), F.max("_mb").alias("mb"), between("caa", da, da), between("cbb", db, db), between("cab", da, db))


def dated_covariance(returns: DataFrame, chunk: Column, delistings: DataFrame | None = None, periods: float = 252.0, min_dates: int = 2,
                     blocks: int | None = None) -> DataFrame:
    """(a <= b, n, value, corr): annualised covariance and correlation over the dates on which both assets are listed.

    Pairs that were never listed together for ``min_dates`` dates have no row."""
    m = listed_moments(listed(returns, delistings), chunk, blocks).where(F.col("n") >= min_dates)
    scale = F.nullif(F.sqrt("caa") * F.sqrt("cbb"), F.lit(0.0))
    return m.select("a", "b", F.col("n").cast("bigint").alias("n"), (F.col("cab") / (F.col("n") - 1) * periods).alias("value"),
                    F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("cab") / scale).alias("corr"))


def dated_bootstrap(returns: DataFrame, delistings: DataFrame | None = None, replicates: int = 1000, block_length: float = 10.0,
                    seed: int = 42) -> DataFrame:
    """(rep, asset, n, mean, std) of stationary-bootstrap resamples that keep the universe of every date.

    Each segment is resampled from its own dates, so all assets share the drawn dates and none gets a date outside its listing. A date
    without a bar adds a zero. Sums of the segments of an asset are added up."""
    rows = cut(listed(returns, delistings).select("asset", "ts", F.col("r").cast("double").alias("r")).where("r is not null"))
    intervals = listing(rows)
    dates = cut(segment_dates(rows, intervals))
    of = dates.groupBy("segment").agg(F.min("pos").alias("lo"), F.count(F.lit(1)).alias("size"))
    d = dates.join(of, "segment").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    start = (F.col("pos") == F.col("lo")) | (unit("rep", "pos", F.lit(1), seed=seed) < 1.0 / block_length)
    origin = F.pmod(mix("rep", "pos", F.lit(2), seed=seed), F.col("size"))
    w = Window.partitionBy("rep", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_s", F.last(F.when(start, F.struct(F.col("pos").alias("p"), origin.alias("o"))), ignorenulls=True).over(w))
    index = d.select("rep", (F.col("lo") + F.pmod(F.col("_s.o") + F.col("pos") - F.col("_s.p"), F.col("size"))).alias("pos"))
    index = index.groupBy("rep", "pos").agg(F.count(F.lit(1)).alias("times"))
    bars = rows.join(dates, "ts").select("asset", "pos", "r")
    sums = index.join(bars, "pos").groupBy("rep", "asset").agg(
        F.sum(F.col("times") * F.col("r")).alias("s"), F.sum(F.col("times") * F.col("r") * F.col("r")).alias("ss"))
    at = dates.select("ts", "pos")
    size = intervals.join(at.withColumnsRenamed({"ts": "listed", "pos": "_lo"}), "listed").join(
        at.withColumnsRenamed({"ts": "delisted", "pos": "_hi"}), "delisted").select("asset", (F.col("_hi") - F.col("_lo") + 1).alias("n"))
    every = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))  # a resample may have drawn no bar of an asset
    d = every.join(sums, ["rep", "asset"], "left").withColumns({"s": F.coalesce("s", F.lit(0.0)), "ss": F.coalesce("ss", F.lit(0.0))})
    mean, n = F.col("s") / F.col("n"), F.col("n")
    var = F.greatest(F.col("ss") - F.col("s") * mean, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))
    return d.select("rep", "asset", "n", mean.alias("mean"), F.sqrt(var).alias("std"))


def dated_backtest(returns: DataFrame, folds: DataFrame, score: Callable[[DataFrame], DataFrame], benchmark: DataFrame,
                   delistings: DataFrame | None = None, freq: str = "monthly", min_train: int = 20) -> DataFrame:
    """Metrics per walk-forward fold over a universe that changes.

    A fold scores the assets that are listed on its first test date and have ``min_train`` training rows. Each rebalance holds those of
    them that are still listed, weights rescaled. A holding that is delisted between rebalances stays as cash until the next one."""
    from .backtest import gross_path, holding_growth, normalise_targets, performance_metrics, score_weights
    from .crossval import rebalance_dates

    rows = cut(listed(returns, delistings).select("asset", "ts", "r").where("r is not null"))
    intervals = cut(listing(rows))
    tagged = rows.join(folds, "ts")
    days = folds.where("role = 'test'").select("fold", "ts").distinct()
    first = days.groupBy("fold").agg(F.min("ts").alias("ts"))
    train = tagged.where("role = 'train'").drop("role")
    known = train.groupBy("fold", "asset").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_train)
    present = known.join(first, "fold").join(intervals, "asset").where("listed <= ts and ts <= delisted").select("fold", "asset")
    train = train.join(present, ["fold", "asset"], "left_semi")
    w = score_weights(score(train), ["fold"])
    reb = rebalance_dates(days, freq, ["fold"]).select("fold", "ts").union(first.select("fold", "ts")).distinct()
    targets = reb.join(w.select("fold", "asset", "w"), "fold").join(intervals, "asset").where("listed <= ts and ts <= delisted")
    targets = cut(normalise_targets(targets.select("fold", "ts", "asset", "w"), ["fold"]))
    test = cut(tagged.where("role = 'test'").drop("role"))
    path = gross_path(*holding_growth(targets, test, ["fold"]), ["fold"])
    d = path.select("fold", "ts", F.col("r_gross").alias("r")).join(benchmark.select("ts", "bm"), "ts", "left").withColumn("bm", F.coalesce("bm", F.lit(0.0)))
    return performance_metrics(d, ["fold"])
