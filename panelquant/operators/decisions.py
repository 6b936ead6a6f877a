"""Decision tables over many portfolios: capacity, orders, checks, kill switch, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, div, with_params
from .backtest import market_impact_cost

# Assets under management per tier of the capacity curve.
CAPITAL_TIERS = [100_000.0, 1_000_000.0, 10_000_000.0, 50_000_000.0, 100_000_000.0, 500_000_000.0, 1_000_000_000.0]


def capacity_curve(strategies: DataFrame, key: str = "strategy", median_adv: float = 50e6, tiers=None) -> DataFrame:
    """Net growth and Sharpe per tier; a year's turnover is traded in twelve chunks.
    ``strategies`` holds (key, gross_cagr, gross_vol, annual_turnover)."""
    d = with_params(strategies, [(t,) for t in tiers or CAPITAL_TIERS], ["aum"])
    d = d.withColumns({"trade": F.col("aum") * F.col("annual_turnover") / 12.0, "adv": F.lit(median_adv), "vol": F.col("gross_vol") / 252.0 ** 0.5})
    d = market_impact_cost(d).withColumn("annual_drag_pct", F.col("annual_turnover") * F.col("total_cost_bps") / 10000)
    d = d.withColumn("net_cagr", F.col("gross_cagr") - F.col("annual_drag_pct"))
    return d.select(key, "aum", "gross_cagr", "annual_drag_pct", "net_cagr",
                    F.when(F.col("gross_vol") > 0, div("net_cagr", "gross_vol")).otherwise(0.0).alias("net_sharpe"),
                    F.col("total_cost_bps").alias("market_impact_bps"), "liquidity_breached")


def order_tickets(weights: DataFrame, holdings: DataFrame, prices: DataFrame, adv: DataFrame, capital: float,
                  min_trade_pct: float = 0.01, max_adv_pct: float = 0.05) -> DataFrame:
    """Buy and sell tickets per portfolio over the union of targets and holdings. Trades under 1 % of
    capital are left out, trades over 5 % of daily volume carry a warning; ``seq`` lists sells first,
    then buys, by value."""
    k = ["portfolio", "asset"]
    d = weights.select(*k, "w").join(holdings.select(*k, "shares"), k, "full").join(prices.select("asset", "price"), "asset", "left").join(
        adv.select("asset", F.col("adv").alias("adv_shares")), "asset", "left")
    target = F.when(F.col("w").isNotNull(), F.floor(capital * F.col("w") / F.coalesce("price", F.lit(1e-6)))).otherwise(0)
    d = d.withColumn("target_shares", target.cast("bigint")).withColumn("delta", F.col("target_shares") - F.coalesce("shares", F.lit(0)))
    price = F.coalesce("price", F.lit(1.0))
    d = d.withColumn("est_price", price).withColumn("est_trade_value", F.abs("delta") * F.col("est_price"))
    value = F.coalesce("adv_shares", F.lit(1e6)) * F.col("est_price")
    part = F.when(value > 0, F.col("est_trade_value") / F.nullif(value, F.lit(0.0))).otherwise(1.0)
    residual = F.lit(capital) - F.sum(F.col("target_shares") * F.coalesce("price", F.lit(1e-6))).over(Window.partitionBy("portfolio"))
    d = d.withColumns({"adv_participation": part, "residual_cash": residual})
    d = d.where((F.col("delta") != 0) & (F.col("est_trade_value") >= min_trade_pct * capital))
    sell = F.col("delta") < 0
    order = Window.partitionBy("portfolio").orderBy(F.when(sell, 0).otherwise(1), F.desc("est_trade_value"), "asset")
    warn = F.when(F.col("adv_participation") > max_adv_pct, F.format_string(
        f"High Market Impact: Trade is %.1f%% of ADV (Limit {max_adv_pct * 100:.1f}%%)", F.col("adv_participation") * 100))
    return d.select(*k, F.when(sell, "SELL").otherwise("BUY").alias("action"), F.abs("delta").alias("shares"), "target_shares", "est_price",
                    "est_trade_value", (F.col("adv_participation") * 100).alias("adv_participation_pct"), warn.alias("warning"),
                    F.row_number().over(order).cast("bigint").alias("seq"), "residual_cash")


def _violation(cond: Column, text: str, *vals: Column) -> Column:
    return F.when(cond, F.format_string(text, *[v * 100 for v in vals]))


def pre_trade_checks(weights: DataFrame, current: DataFrame | None = None, max_weight: float = 0.40, max_leverage: float = 1.0,
                     max_turnover: float = 0.60, tol: float = 1e-4) -> DataFrame:
    """Largest weight, gross exposure and turnover per portfolio against the limits."""
    w = F.coalesce("w", F.lit(0.0))
    d = weights.withColumn("w", w)
    if current is not None:
        d = d.join(current.select("portfolio", "asset", F.col("w").alias("c")), ["portfolio", "asset"], "left")
    else:
        d = d.withColumn("c", F.col("w"))
    g = d.groupBy("portfolio").agg(F.max("w").alias("max_weight"), F.sum(F.abs("w")).alias("gross_exposure"),
                                   (F.sum(F.abs(F.col("w") - F.coalesce("c", F.lit(0.0)))) / 2).alias("turnover"))
    bad = F.array_compact(F.array(
        _violation(F.col("max_weight") > max_weight + tol, f"Position concentration breached: Max weight is %.1f%%, limit is {max_weight * 100:.1f}%%", F.col("max_weight")),
        _violation(F.col("gross_exposure") > max_leverage + tol, f"Leverage limit breached: Gross exposure is %.1f%%, limit is {max_leverage * 100:.1f}%%", F.col("gross_exposure")),
        _violation(F.col("turnover") > max_turnover, f"Turnover threshold breached: Rebalance turnover is %.1f%%, limit is {max_turnover * 100:.1f}%%", F.col("turnover"))))
    return g.withColumn("violations", bad).withColumn("passed", F.size("violations") == 0)


# Actions when running, on the day of a loss, once stopped, and the text when running.
OUTCOMES = ("PROCEED", "HALT_TRADING", "HALT_TRADING_LIQUIDATE", "All risk limits normal")


def kill_switch(status: DataFrame, max_daily_loss: float = 0.05, max_drawdown: float = 0.25) -> DataFrame:
    """Latched stop per portfolio: once a day loses too much or the drawdown is too deep it stays tripped.
    ``status`` holds (portfolio, ts, pnl, drawdown)."""
    loss, deep = F.col("pnl") < -max_daily_loss, F.abs("drawdown") > max_drawdown
    reason = F.when(loss, "MAX_DAILY_LOSS").when(deep, "MAX_PORTFOLIO_DRAWDOWN")
    w = Window.partitionBy("portfolio").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = status.withColumn("_r", reason).withColumn("reason", F.first("_r", ignorenulls=True).over(w))
    d = d.withColumn("_t", F.first(F.when(F.col("_r").isNotNull(), F.col("ts")), ignorenulls=True).over(w))
    tripped = F.col("reason").isNotNull()
    fresh = (F.col("_t") == F.col("ts")) & (F.col("reason") == "MAX_DAILY_LOSS")
    return d.select("portfolio", "ts", tripped.alias("tripped"),
                    F.when(~tripped, OUTCOMES[0]).when(fresh, OUTCOMES[1]).otherwise(OUTCOMES[2]).alias("action"),
                    F.coalesce("reason", F.lit(OUTCOMES[3])).alias("reason"))


def running_drawdown(pnl: DataFrame) -> DataFrame:
    """(portfolio, ts, pnl, drawdown) from daily profit shares."""
    from .returns import running_product

    w = Window.partitionBy("portfolio").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = pnl.withColumn("_v", running_product(1 + F.col("pnl"), w))
    return d.select("portfolio", "ts", "pnl", (F.col("_v") / F.max("_v").over(w) - 1).alias("drawdown"))


# Display name per module in order of precedence, and text per dominant factor.
FACTOR_NAMES = {"M1": "Quality (M1)", "M2": "Valuation (M2)", "M3": "Momentum (M3)", "M4": "Factor Beta (M4)", "M9": "Stat-Arb Reversion (M9)"}
PASSIVE = "Mixed / Passive Beta"
HORIZONS = {"Stat-Arb Reversion (M9)": "1 to 4 Weeks (Mean Reversion)", "Momentum (M3)": "3 to 6 Months (Regime & Trend)",
            "Factor Beta (M4)": "3 to 6 Months (Regime & Trend)", "Quality (M1)": "12 to 36 Months (Fundamental Value Convergence)",
            "Valuation (M2)": "12 to 36 Months (Fundamental Value Convergence)"}
RULES = {"Stat-Arb Reversion (M9)": " Thesis Invalidation: Z-score reverts to 0 or spread breaks structural cointegration.",
         "Momentum (M3)": " Thesis Invalidation: 50-day moving average crosses below 200-day moving average.",
         "Valuation (M2)": " Thesis Invalidation: Operating margins degrade structurally, breaking DCF assumptions."}


def dominant_factor(wide: DataFrame, floor: float = 60.0) -> DataFrame:
    """Name of the largest of the five scores (missing counts 50, first of equals), mixed under the floor."""
    cols = {m: F.coalesce(F.col(m) if m in wide.columns else F.lit(None).cast("double"), F.lit(50.0)) for m in FACTOR_NAMES}
    top = F.greatest(*cols.values())
    out = F.when(top < floor, PASSIVE)
    for m, c in cols.items():
        out = out.when(c == top, FACTOR_NAMES[m])
    return wide.withColumn("dominant_factor", out)


def horizon_label(df: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in HORIZONS.items() for x in kv])
    return df.withColumn("horizon", F.coalesce(F.try_element_at(table, "dominant_factor"), F.lit("6 to 12 Months (General Beta)")))


def invalidation_rule(df: DataFrame, cvar: str = "cvar_95") -> DataFrame:
    """Stop at 2.5 CVaR within 5-25 % plus the text of the factor."""
    stop = clip(F.coalesce(cvar, F.lit(0.05)) * 2.5, 0.05, 0.25) * 100
    table = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])
    text = F.concat(F.format_string("Hard Stop-Loss: Exit if position drops > %.1f%% from entry.", stop), F.coalesce(F.try_element_at(table, "dominant_factor"), F.lit("")))
    return df.withColumn("stop_pct", stop).withColumn("invalidation", text)


def advisory_report(weights: DataFrame, prices: DataFrame, scores: DataFrame, risk: DataFrame, capital: float) -> DataFrame:
    """Allocation, whole shares, factor, horizon and rule for every weight above 0.1 %."""
    d = weights.where("w > 0.001").join(prices.select("asset", "price"), "asset", "left").join(scores, "asset", "left").join(risk.select("asset", "cvar_95"), "asset", "left")
    d = invalidation_rule(horizon_label(dominant_factor(d.withColumn("price", F.coalesce("price", F.lit(1.0))))))
    usd = capital * F.col("w")
    return d.select("portfolio", "asset", (F.col("w") * 100).alias("allocation_pct"), usd.alias("allocation_usd"),
                    F.when(F.col("price") > 0, F.floor(usd / F.nullif("price", F.lit(0.0)))).otherwise(0).cast("bigint").alias("target_shares"),
                    F.col("price").alias("current_price"), "dominant_factor", "horizon", "stop_pct", "invalidation")
