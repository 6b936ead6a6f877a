"""Trading costs, portfolio paths, performance metrics, walk-forward backtests and regimes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import by_shuffle, by_time, div, running, spread, trailing, unpivot, when_full
from ..sources.files import cut
from .pit import asof_join
from .returns import running_product
from .risk import complete_dates

YEAR = 252.0 ** 0.5
Y_COEFF = 0.30  # of the square-root impact


def impact_bps(trade: Column, adv: Column, vol: Column, y_coeff: float = Y_COEFF) -> Column:
    """Square-root impact in basis points; ADV has a floor of 10,000."""
    part = F.abs(trade) / F.greatest(adv, F.lit(10000.0))
    return F.when(trade == 0, 0.0).otherwise(y_coeff * vol * F.sqrt(F.least(part, F.lit(1.0))) * 10000)


def market_impact_cost(trades: DataFrame, trade="trade", adv="adv", vol="vol", commission=2.0, half_spread=3.0, max_part=0.05) -> DataFrame:
    q = F.abs(F.col(trade))
    part = F.when(q > 0, q / F.greatest(F.col(adv), F.lit(10000.0))).otherwise(0.0)
    imp = impact_bps(q, F.col(adv), F.col(vol))
    bps = F.when(q > 0, commission + half_spread + imp).otherwise(0.0)
    return trades.withColumns({"market_impact_bps": imp, "total_cost_bps": bps, "total_cost_dollar": q * bps / 10000,
                               "participation_pct": part, "liquidity_breached": part > max_part})


def adv_and_vol_asof(prices: DataFrame, window: int = 20) -> DataFrame:
    """Dollar volume and return deviation of the trailing rows; 50e6 and 0.015 up to ``window`` rows."""
    d = prices.withColumn("_r", F.col("close") / F.lag("close").over(by_time()) - 1).withColumn("_n", F.row_number().over(by_time()))
    w, known = trailing(window), F.col("_n") > window
    return d.select("asset", "ts", F.when(known, F.avg(F.col("close") * F.col("volume")).over(w)).otherwise(50e6).alias("adv"),
                    F.when(known, F.stddev_samp("_r").over(w)).otherwise(0.015).alias("vol"))


def normalise_targets(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Negative weights to zero, rest to sum one, equal weights where nothing is left."""
    d = weights.withColumn("w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)))
    t = d.groupBy(*keys, "ts").agg(F.sum("w").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return d.join(by_shuffle(t), [*keys, "ts"]).select(*keys, "ts", "asset", F.when(F.col("_t") > 0, F.col("w") / F.col("_t")).otherwise(1.0 / F.col("_k")).alias("w"))


FAR = "9999-12-31"


def holding_growth(targets: DataFrame, returns: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(plan, growth): plan is (keys, asset, period, nxt, w); growth is ([keys of returns,] period, nxt,
    asset, ts, growth), the asset's growth since the rebalance on ``period``.

    ``targets`` holds (keys, ts, asset, w); an asset that a rebalance leaves out is sold there. A rebalance acts before the
    return of its own date. Growth is worked out once per distinct holding span, not per portfolio."""
    shared = [k for k in keys if k in returns.columns]
    nxt = F.coalesce(F.lead("ts").over(Window.partitionBy(*keys).orderBy("ts")), F.lit(FAR).cast("date"))
    calendar = targets.select(*keys, "ts").distinct().withColumn("nxt", nxt)  # one row per rebalance of a portfolio
    plan = cut(targets.join(by_shuffle(calendar), [*keys, "ts"]).select(*keys, "asset", F.col("ts").alias("period"), "nxt", "w"))
    spans = plan.select(*shared, "period", "nxt").distinct()
    cal = F.array_sort(F.collect_set("ts")).alias("_cal")  # trading dates, bounded by the calendar
    spans = spans.join(returns.groupBy(*shared).agg(cal), shared) if shared else spans.withColumn("_cal", returns.agg(cal).scalar())
    days = spans.withColumn("ts", F.explode(F.filter("_cal", lambda d: (d >= F.col("period")) & (d < F.col("nxt"))))).drop("_cal")
    w = Window.partitionBy(*shared, "period", "nxt", "asset").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    held = plan.select(*shared, "period", "nxt", "asset").distinct()
    days = days.join(held, [*shared, "period", "nxt"]).join(returns.select(*shared, "ts", "asset", "r"), [*shared, "ts", "asset"], "left")
    r = F.coalesce("r", F.lit(0.0))  # a day without a bar leaves the holding as it is
    growth = days.withColumn("growth", running_product(1 + r, w)).drop("r")
    return plan, growth


def gross_path(plan: DataFrame, growth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, period, ratio, r_gross): value relative to the period start, and the daily return."""
    shared = [k for k in keys if k in growth.columns]
    # The plan is small next to the daily rows it turns into, so it is spread by (keys, period) first: with a
    # growth table that the planner sees to be small, neither the sums nor the lag shuffle the daily rows.
    d = spread(plan, *keys, "period").join(growth, [*shared, "period", "nxt", "asset"])
    v = d.groupBy(*keys, "period", "ts").agg(F.sum(F.col("w") * F.col("growth")).alias("ratio"))
    prev = F.coalesce(F.lag("ratio").over(Window.partitionBy(*keys, "period").orderBy("ts")), F.lit(1.0))
    return v.withColumn("r_gross", F.col("ratio") / prev - 1)


def period_ends(plan: DataFrame, growth: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The plan with the growth ``g`` of each holding over its whole period, and (keys, period, growth) of the portfolios."""
    shared = [k for k in keys if k in growth.columns]
    last = growth.groupBy(*shared, "period", "nxt", "asset").agg(F.max_by("growth", "ts").alias("g"))
    end = plan.join(last, [*shared, "period", "nxt", "asset"])
    return end, end.groupBy(*keys, "period").agg(F.sum(F.col("w") * F.col("g")).alias("growth"))


def rebalance_trades(plan: DataFrame, growth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, period, asset, dw): change from the drifted weight of the period just before (zero if not held in it)."""
    end, total = period_ends(plan, growth, keys)
    d = end.join(by_shuffle(total), [*keys, "period"]).withColumn("drift", F.col("w") * F.col("g") / F.nullif("growth", F.lit(0.0)))
    held = d.where(F.col("nxt") < F.lit(FAR).cast("date")).select(*keys, "asset", F.col("nxt").alias("period"), "drift")
    both = plan.select(*keys, "asset", "period", "w").join(held, [*keys, "asset", "period"], "full")  # sold assets have no target
    return both.select(*keys, "period", "asset", (F.coalesce("w", F.lit(0.0)) - F.coalesce("drift", F.lit(0.0))).alias("dw"))


def portfolio_path(targets: DataFrame, returns: DataFrame, liquidity: DataFrame, keys: list[str], capital: float = 1e7,
                   linear_bps: float = 5.0) -> DataFrame:
    """Daily value after trading costs: (keys, ts, value, r_gross, r_net, cost, impact, turnover).

    Growth, turnover and liquidity are set-oriented. Only the wealth after costs is sequential (``cost_fold``): trades in order of
    period and asset name, one pass over a sorted partition."""
    t = normalise_targets(targets, keys)
    plan, growth = holding_growth(t, cut(returns), keys)
    growth = cut(growth)
    path = gross_path(plan, growth, keys)
    # The last row known then is looked up once per asset and date, not per portfolio. Trades are where a period begins or ends.
    pairs = plan.select("asset", "period").unionByName(plan.select("asset", F.col("nxt").alias("period"))).distinct()
    known = cut(asof_join(pairs, liquidity, ["asset"], "period", "ts", ["adv", "vol"]).drop("matched_ts"))
    trades = rebalance_trades(plan, growth, keys).join(known, ["asset", "period"])
    ends = path.groupBy(*keys, "period").agg(F.max_by("ratio", "ts").alias("growth"))
    chain = cost_fold(trades.join(by_shuffle(ends), [*keys, "period"]), keys, capital, linear_bps)
    d = path.join(by_shuffle(chain), [*keys, "period"])
    value = F.col("start") * F.col("ratio")
    w = Window.partitionBy(*keys).orderBy("ts")
    first = F.col("ts") == F.col("period")
    d = d.withColumn("value", value)
    return d.select(*keys, "ts", "value", "r_gross",
                    (F.col("value") / F.coalesce(F.lag("value").over(w), F.lit(float(capital))) - 1).alias("r_net"),
                    *[F.when(first, F.col(c)).otherwise(0.0).alias(c) for c in ("cost", "impact", "turnover")])


def cost_fold(trades: DataFrame, keys: list[str], capital: float = 1e7, linear_bps: float = 5.0) -> DataFrame:
    """(keys, period, start, cost, impact, turnover) of each rebalance: wealth after its trades, and what they cost.

    ``trades`` holds (keys, period, asset, dw, adv, vol, growth), ``growth`` being the portfolio's until the next rebalance. Portfolios are
    hash-partitioned and sorted by (period, asset); wealth is carried through the sorted stream, so a portfolio may have any number of
    trades. Nothing but the running sums of one rebalance is held. Unknown liquidity counts as 50e6 and 0.015."""
    kinds = [f for f in trades.select(*keys, "period").schema]
    out = T.StructType([*kinds, *(T.StructField(c, T.DoubleType()) for c in ("start", "cost", "impact", "turnover"))])
    rows = trades.select(*keys, "period", F.abs("dw").alias("q"), F.coalesce("adv", F.lit(50e6)).alias("adv"),
                         F.coalesce("vol", F.lit(0.015)).alias("vol"), "growth", "asset")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "period", "asset").drop("asset")
    k = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = period = None
        wealth = cost = impact = turnover = last = 0.0
        for batch in batches:
            columns, done = [c.to_pylist() for c in batch.columns], []
            for *name, q, adv, vol, growth in zip(*columns, strict=True):
                if name != period:
                    if period is not None:
                        done.append((*period, wealth, cost, impact, turnover / 2))
                    wealth = wealth * last if name[:k] == owner else float(capital)
                    owner, period, last = name[:k], name, growth
                    cost = impact = turnover = 0.0
                size = q * wealth
                part = math.sqrt(min(abs(size) / max(adv, 10000.0), 1.0)) if size else 0.0
                hit = size * (Y_COEFF * vol * part * 10000) / 10000
                paid = size * linear_bps / 10000 + hit
                wealth, cost, impact, turnover = wealth - paid, cost + paid, impact + hit, turnover + q
            yield _records(done, out)
        if period is not None:
            yield _records([(*period, wealth, cost, impact, turnover / 2)], out)

    return rows.mapInArrow(fold, out)


def _records(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)


METRICS = ["total_return", "annualised_return", "volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio",
           "information_ratio", "beta", "alpha", "benchmark_total_return", "benchmark_annualised_return",
           "benchmark_volatility", "benchmark_sharpe", "hit_rate", "win_loss_ratio"]


def performance_metrics(path: DataFrame, keys: list[str], value: str = "r", bm: str = "bm", risk_free: float = 0.0001, min_rows: int = 20) -> DataFrame:
    """Sixteen metrics per key group; groups under ``min_rows`` dates are left out."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    r, b = F.col(value), F.col(bm)
    d = path.withColumn("_w", running_product(1 + r, w)).withColumn("_dd", F.col("_w") / F.max("_w").over(w) - 1)
    g = d.groupBy(*keys).agg(
        F.count(r).alias("n"), (F.product(1 + r) - 1).alias("total_return"), (F.stddev_samp(r) * YEAR).alias("volatility"), F.avg(r).alias("_m"),
        (F.stddev_samp(F.when(r < 0, r)) * YEAR).alias("_down"), F.min("_dd").alias("max_drawdown"),
        (F.product(1 + b) - 1).alias("benchmark_total_return"), (F.stddev_samp(b) * YEAR).alias("benchmark_volatility"), F.avg(b).alias("_mb"),
        F.covar_samp(r, b).alias("_c"), F.var_samp(b).alias("_v"), F.count(F.when(r.isNotNull() & b.isNotNull(), 1)).alias("_nb"),
        (F.stddev_samp(r - b) * YEAR).alias("_te"), F.avg(r - b).alias("_ma"), F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.avg(F.when(r > 0, r)).alias("_pos"), F.coalesce(F.abs(F.avg(F.when(r < 0, r))), F.lit(1.0)).alias("_neg")).where(F.col("n") >= min_rows)
    years = F.greatest(F.col("n") / 252.0, F.lit(0.1))
    zero = F.lit(0.0)
    g = g.withColumns({"annualised_return": F.pow(1 + F.col("total_return"), 1 / years) - 1,
                       "benchmark_annualised_return": F.pow(1 + F.col("benchmark_total_return"), 1 / years) - 1})
    rf = risk_free * 252
    g = g.withColumns({
        "sharpe_ratio": F.coalesce(div((F.col("_m") - risk_free) * 252, "volatility"), zero),
        "benchmark_sharpe": F.coalesce(div((F.col("_mb") - risk_free) * 252, "benchmark_volatility"), zero)})
    many = F.col("_nb") > 20
    beta = F.when(many & (F.col("_v") > 0), div("_c", "_v")).otherwise(1.0)
    return g.withColumn("beta", beta).withColumns({
        "sortino_ratio": F.when(F.col("_down") > 0, div(F.col("annualised_return") - rf, "_down")).otherwise(F.col("sharpe_ratio")),
        "calmar_ratio": F.when(F.abs("max_drawdown") > 0.001, div("annualised_return", F.abs("max_drawdown"))).otherwise(0.0),
        "information_ratio": F.coalesce(div(F.col("_ma") * 252, "_te"), zero),
        "alpha": F.when(many, F.col("annualised_return") - rf - F.col("beta") * (F.col("benchmark_annualised_return") - rf)).otherwise(0.0),
        "win_loss_ratio": F.coalesce(div("_pos", "_neg"), F.lit(1.0)),
    }).select(*keys, "n", *METRICS)


def score_weights(scores: DataFrame, keys: list[str], cap: float = 0.40) -> DataFrame:
    """Weights in proportion to positive scores, capped and then rescaled (so the cap can be exceeded)."""
    d = scores.withColumn("s", F.greatest("score", F.lit(0.0)))
    t = d.groupBy(*keys).agg(F.sum("s").alias("_t"), F.count(F.lit(1)).alias("_k"))
    d = d.join(t, keys).withColumn("c", F.least(F.when(F.col("_t") > 0, F.col("s") / F.col("_t")).otherwise(1.0 / F.col("_k")), F.lit(cap)))
    t2 = d.groupBy(*keys).agg(F.sum("c").alias("_u"))
    return d.join(t2, keys).select(*keys, "asset", (F.col("c") / F.col("_u")).alias("w"), (F.col("c") >= cap).alias("capped"))


def backtest(returns: DataFrame, folds: DataFrame, score: Callable[[DataFrame], DataFrame], benchmark: DataFrame,
             liquidity: DataFrame | None = None, freq: str = "monthly") -> DataFrame:
    """Metrics per walk-forward fold, all folds in one plan. ``score`` maps the training returns
    (fold, asset, ts, r) to (fold, asset, score)."""
    from .crossval import rebalance_dates

    tagged = cut(complete_dates(returns.select("asset", "ts", "r")).join(folds, "ts"))
    train, test = tagged.where("role = 'train'").drop("role"), tagged.where("role = 'test'").drop("role")
    w = score_weights(score(train), ["fold"])
    days = test.select("fold", "ts").distinct()
    first = days.groupBy("fold").agg(F.min("ts").alias("ts"))
    reb = rebalance_dates(days, freq, ["fold"]).select("fold", "ts").union(first.select("fold", "ts")).distinct()
    targets = cut(reb.join(w.select("fold", "asset", "w"), "fold"))
    if liquidity is None:
        path = gross_path(*holding_growth(normalise_targets(targets, ["fold"]), test, ["fold"]), ["fold"])
        extra = None
    else:
        path = portfolio_path(targets, test, liquidity, ["fold"])
        extra = path.groupBy("fold").agg(F.sum("cost").alias("total_transaction_costs"), F.sum("impact").alias("total_market_impact_cost"),
                                         F.sum("turnover").alias("turnover"), F.count_if(F.col("turnover") > 0).alias("n_rebalances"))
    d = path.select("fold", "ts", F.col("r_gross").alias("r")).join(benchmark.select("ts", "bm"), "ts", "left").withColumn("bm", F.coalesce("bm", F.lit(0.0)))
    m = performance_metrics(d, ["fold"])
    return m if extra is None else m.join(extra, "fold")


FOLD_METRICS = ["total_return", "annualised_return", "volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown",
                "information_ratio", "beta", "alpha", "hit_rate"]


def fold_summary(folds: DataFrame, by=()) -> DataFrame:
    """Mean, population deviation, range and count of each metric over the folds."""
    long = unpivot(folds, list(by), FOLD_METRICS, "metric", "x").where("x is not null")
    return long.groupBy(*by, "metric").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"),
                                           F.max("x").alias("max"), F.count("x").alias("n_folds"))


# -- regimes ----------------------------------------------------------------------------------
def _series(df: DataFrame) -> DataFrame:
    return df.withColumn("_one", F.lit("series"))


def regime_bull_bear(bm: DataFrame, value: str = "bm", threshold: float = 0.20) -> DataFrame:
    """Bear below -threshold from the running peak; a rise above it from the running low overrides to bull."""
    w = running("_one")
    d = _series(bm).withColumn("_c", running_product(1 + F.col(value), w))
    dd, up = F.col("_c") / F.max("_c").over(w) - 1, F.col("_c") / F.min("_c").over(w) - 1
    return d.select("ts", F.when(up > threshold, "bull").when(dd < -threshold, "bear").otherwise("neutral").alias("regime"))


def regime_volatility(bm: DataFrame, value: str = "bm", window: int = 63, low: float = 25, high: float = 75) -> DataFrame:
    w = trailing(window, "_one")
    d = _series(bm).withColumn("v", when_full(F.stddev_samp(value).over(w) * YEAR, value, window, w)).select("ts", "v")
    cut = d.agg(F.percentile("v", [low / 100, high / 100]).alias("q"))
    d = d.withColumn("q", cut.scalar())
    return d.select("ts", F.when(F.col("v") < F.col("q")[0], "low_vol").when(F.col("v") > F.col("q")[1], "high_vol").otherwise("normal_vol").alias("regime"))


def regime_macro(spread: DataFrame, value: str = "term_spread") -> DataFrame:
    return spread.select("ts", F.when(F.col(value) > 0, "expansion").when(F.col(value) < 0, "contraction").otherwise("neutral").alias("regime"))


def regime_performance(path: DataFrame, regimes: DataFrame, keys=(), value: str = "r", bm: str = "bm") -> DataFrame:
    """Return, volatility, Sharpe and drawdown per regime (at least two dates) next to the benchmark."""
    keys = [*keys, "regime"]
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = path.join(regimes, "ts").withColumn("_w", running_product(1 + F.col(value), w)).withColumn("_dd", F.col("_w") / F.max("_w").over(w) - 1)
    g = d.groupBy(*keys).agg(F.count(value).alias("n"), (F.avg(value) * 252).alias("port_return"), (F.stddev_samp(value) * YEAR).alias("port_vol"),
                             F.min("_dd").alias("port_max_dd"), (F.avg(bm) * 252).alias("bench_return"), (F.stddev_samp(bm) * YEAR).alias("_bv")).where("n >= 2")
    return g.select(*keys, "port_return", "port_vol", F.coalesce(div("port_return", "port_vol"), F.lit(0.0)).alias("port_sharpe"), "port_max_dd",
                    "bench_return", F.coalesce(div("bench_return", "_bv"), F.lit(0.0)).alias("bench_sharpe"))


def regime_analysis(path: DataFrame, bm: DataFrame, spread: DataFrame, keys=()) -> DataFrame:
    parts = {"Bull_Bear": regime_bull_bear(bm), "Volatility": regime_volatility(bm), "Macro": regime_macro(spread)}
    out = None
    for name, reg in parts.items():
        one = regime_performance(path, reg, keys).withColumn("scheme", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
