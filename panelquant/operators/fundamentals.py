"""Statement items, quality (M1) and valuation (M2) scores, value and quality factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, col, div, running
from .pit import STATEMENT_LAG_DAYS, valid_at

# Short name -> (statement, item) as looked up by the quality and valuation scores.
ITEM_NAMES = {
    "ni": ("income_stmt", "Net Income"),
    "ebit": ("income_stmt", "EBIT"),
    "ebitda": ("income_stmt", "EBITDA"),
    "gross": ("income_stmt", "Gross Profit"),
    "rev": ("income_stmt", "Total Revenue"),
    "tax": ("income_stmt", "Tax Provision"),
    "ebt": ("income_stmt", "Pretax Income"),
    "interest": ("income_stmt", "Interest Expense"),
    "assets": ("balance_sheet", "Total Assets"),
    "ltd": ("balance_sheet", "Long Term Debt"),
    "cdebt": ("balance_sheet", "Current Debt"),
    "sdebt": ("balance_sheet", "Short Term Debt"),
    "debt": ("balance_sheet", "Total Debt"),
    "equity": ("balance_sheet", "Stockholders Equity"),
    "cash": ("balance_sheet", "Cash And Cash Equivalents"),
    "ca": ("balance_sheet", "Current Assets"),
    "cl": ("balance_sheet", "Current Liabilities"),
    "shares": ("balance_sheet", "Ordinary Shares Number"),
    "re": ("balance_sheet", "Retained Earnings"),
    "tl": ("balance_sheet", "Total Liabilities Net Minority Interest"),
    "cfo": ("cash_flow", "Operating Cash Flow"),
    "fcf": ("cash_flow", "Free Cash Flow"),
}
# Funds and indices that get a neutral score.
NEUTRAL_TYPES = ["ETF", "MUTUALFUND", "INDEX"]
NEUTRAL_TICKERS = ["SPY", "QQQ", "DIA", "IWM", "SMH", "XLK", "XLF", "XLE", "XLV", "GLD", "TLT", "IBIT",
                   "^GSPC", "^NDX", "^DJI", "^RUT"]
# Alternative line-item names in order of preference.
ALIASES = {
    "shares": ["Diluted Average Shares", "Shares Outstanding", "shares_outstanding", "Common Stock",
               "Basic Average Shares", "Ordinary Shares Number"],
    "net_income": ["Net Income", "NetIncome", "net_income"],
    "book_value": ["Total Shareholders' Equity", "Total Equity", "Book Value", "book_value",
                   "Total Stockholder Equity", "Stockholders Equity"],
    "ocf": ["Operating Cash Flow", "Cash Flow From Operations", "operating_cash_flow",
            "Net Cash Provided By Operating Activities"],
    "ebit": ["EBIT", "Operating Income", "ebit"],
    "total_assets": ["Total Assets", "total_assets"],
    "current_liab": ["Total Current Liabilities", "Current Liabilities", "current_liabilities"],
    "eps": ["Basic EPS", "EPS", "eps", "Diluted EPS"],
    "total_debt": ["Total Debt", "Long Term Debt", "total_debt"],
}


def published(statements: DataFrame, prices: DataFrame) -> DataFrame:
    """The statements that were public at the date of the last price, so that a score doesn't look ahead of its price."""
    return statements.where(F.date_add("period_end", STATEMENT_LAG_DAYS) <= prices.agg(F.max("ts")).scalar())


def statement_item(statements: DataFrame, wants: dict | None = None, periods: int = 3, keys=("asset",)) -> DataFrame:
    """One row per key with columns <name>_<period>: the exact item, else the (alphabetically) first
    whose name contains the wanted one; period 0 is the statement's most recent period."""
    wants, keys = wants or ITEM_NAMES, list(keys)
    table = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(s).alias("stmt"), F.lit(i).alias("want"))
                      for k, (s, i) in wants.items()])
    hit = F.filter(table, lambda w: (w["stmt"] == F.col("stmt")) & F.contains(F.lower("item"), F.lower(w["want"])))
    pos = F.dense_rank().over(Window.partitionBy(*keys, "stmt").orderBy(F.desc("period_end"))) - 1
    d = statements.withColumn("_pos", pos).withColumn("_w", F.explode(hit)).withColumn(
        "_pick", F.struct((F.col("item") != F.col("_w.want")).alias("inexact"), F.col("item").alias("i")))
    best = F.min("_pick").over(Window.partitionBy(*keys, "_w.name"))
    d = d.withColumn("_best", best).where((F.col("_pick") == F.col("_best")) & (F.col("_pos") < periods))
    cell = F.struct(F.concat_ws("_", F.col("_w.name"), F.col("_pos")).alias("k"), F.col("value").alias("v"))
    # At most one entry per wanted item and period, so the map is bounded by the item list.
    cells = d.groupBy(*keys).agg(F.map_from_entries(F.collect_list(cell)).alias("_m"))
    return cells.select(*keys, *[F.try_element_at("_m", F.lit(f"{n}_{k}")).alias(f"{n}_{k}")
                                 for n in wants for k in range(periods)])


def _signal(cond: Column) -> Column:
    return cond.cast("int")


def piotroski_fscore(fin: DataFrame) -> DataFrame:
    """Sum of the available ones of nine binary signals."""
    roa0, roa1 = div("ni_0", "assets_1"), div("ni_1", "assets_2")
    cr0, cr1 = div("ca_0", "cl_0"), div("ca_1", "cl_1")
    mg0, mg1 = div("gross_0", "rev_0"), div("gross_1", "rev_1")
    to0, to1 = div("rev_0", "assets_1"), div("rev_1", "assets_2")
    signals = {
        "f1_roa_positive": roa0 > 0, "f2_cfo_positive": F.col("cfo_0") > 0, "f3_roa_growth": roa0 > roa1,
        "f4_earnings_quality": F.col("cfo_0") > F.col("ni_0"), "f5_leverage_decrease": F.col("ltd_0") < F.col("ltd_1"),
        "f6_liquidity_increase": cr0 > cr1, "f7_no_dilution": F.col("shares_0") <= F.col("shares_1"),
        "f8_margin_increase": mg0 > mg1, "f9_turnover_increase": to0 > to1,
    }
    d = fin.withColumns({k: _signal(v).cast("double") for k, v in signals.items()})
    valid = F.array_compact(F.array(*signals))
    total = F.aggregate(valid, F.lit(0.0), lambda a, x: a + x)
    return d.withColumn("valid_signals", F.size(valid).cast("bigint")).withColumn(
        "fscore", F.when(F.size(valid) > 0, total))


def roic(fin: DataFrame, tax_rate: float = 0.21) -> DataFrame:
    zero = F.lit(0.0)
    debt = F.coalesce("debt_0", F.coalesce("ltd_0", zero) + F.coalesce("cdebt_0", zero))
    cap = debt + F.col("equity_0") - F.coalesce("cash_0", zero)
    return fin.withColumn("nopat", F.col("ebit_0") * (1.0 - tax_rate)).withColumn("invested_capital", cap).withColumn(
        "roic", F.when(F.col("invested_capital") > 0, F.col("nopat") / F.col("invested_capital")))


def accruals_ratio(fin: DataFrame) -> DataFrame:
    avg = F.coalesce((F.col("assets_0") + F.col("assets_1")) / 2.0, F.col("assets_0"))
    return fin.withColumn("accruals", div(F.col("ni_0") - F.col("cfo_0"), avg))


def altman_z(fin: DataFrame, market_cap: str = "market_cap") -> DataFrame:
    zero, ta = F.lit(0.0), F.nullif("assets_0", F.lit(0.0))
    x1 = F.coalesce((F.col("ca_0") - F.col("cl_0")) / ta, zero)
    x2 = F.coalesce(F.col("re_0") / ta, zero)
    x3 = F.coalesce(F.col("ebit_0") / ta, zero)
    x4 = F.coalesce(div(F.coalesce(F.nullif(market_cap, zero), ta), "tl_0"), F.lit(1.0))
    x5 = F.coalesce(F.col("rev_0") / ta, zero)
    z = F.when(ta.isNotNull(), 1.2 * x1 + 1.4 * x2 + 3.3 * x3 + 0.6 * x4 + 1.0 * x5)
    return fin.withColumn("z_score", z).withColumn("zone", F.when(F.col("z_score").isNull(), "unknown").when(
        F.col("z_score") > 2.99, "safe").when(F.col("z_score") < 1.81, "distress").otherwise("grey"))


def mean_of(parts: list[Column]) -> tuple[Column, Column]:
    """(mean, count) of the non-null entries."""
    a = F.array_compact(F.array(*parts))
    n = F.size(a)
    return F.when(n > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n), n


def is_neutral() -> Column:
    return F.upper("quote_type").isin(NEUTRAL_TYPES) | F.upper("asset").isin(NEUTRAL_TICKERS)


def score_fundamentals(fin: DataFrame, info: DataFrame) -> DataFrame:
    """M1: mean of the available parts, each on 0-100."""
    d = fin.join(info.select("asset", "market_cap", "quote_type"), "asset", "left")
    d = altman_z(accruals_ratio(roic(piotroski_fscore(d))))
    mean, n = mean_of([
        F.col("fscore") / 9.0 * 100.0, clip(F.col("roic") / 0.25 * 100.0, 0, 100),
        clip((F.col("z_score") - 1.0) / 4.0 * 100.0, 0, 100), clip((0.10 - F.col("accruals")) / 0.20 * 100.0, 0, 100)])
    neutral = F.coalesce(is_neutral(), F.lit(False))
    return d.select(
        "asset", F.when(neutral, 50.0).otherwise(F.coalesce(mean, F.lit(50.0))).alias("score"),
        F.when(neutral, 1.0).when(n > 0, n / 4.0).otherwise(0.2).alias("confidence"),
        "fscore", "roic", "z_score", "accruals")


def wacc(fin: DataFrame, beta=1.0, risk_free: float = 0.04, erp: float = 0.055) -> DataFrame:
    zero = F.lit(0.0)
    beta = F.lit(float(beta)) if isinstance(beta, (int, float)) else col(beta)
    ke = risk_free + F.greatest(beta, F.lit(0.2)) * erp
    own = F.coalesce("ltd_0", zero) + F.coalesce("cdebt_0", "sdebt_0", zero)
    debt = F.when(own == 0, F.col("debt_0")).otherwise(own)
    tax = F.when((F.col("ebt_0") > 0) & F.col("tax_0").isNotNull(), clip(F.col("tax_0") / F.col("ebt_0"), 0, 0.40)).otherwise(0.21)
    d = fin.withColumns({"ke": ke, "_debt": debt, "tax_rate": tax})
    # An unknown interest expense leaves the floor of 2 %.
    kd = F.when(F.col("_debt") > 0, F.coalesce(clip(F.abs("interest_0") / F.nullif("_debt", zero), 0.02, 0.15), F.lit(0.02))).otherwise(0.05)
    levered = F.coalesce((F.col("_debt") > 0) & (F.col("equity_0") > 0), F.lit(False))
    we = F.when(levered, F.col("equity_0") / (F.col("equity_0") + F.col("_debt"))).otherwise(1.0)
    wd = F.when(levered, F.col("_debt") / (F.col("equity_0") + F.col("_debt"))).otherwise(0.0)
    d = d.withColumns({"kd": kd, "weight_equity": we, "weight_debt": wd})
    raw = F.when(F.col("weight_debt") == 0, F.col("ke")).otherwise(
        F.col("weight_equity") * F.col("ke") + F.col("weight_debt") * F.col("kd") * (1 - F.col("tax_rate")))
    return d.withColumn("wacc", F.greatest(raw, F.lit(0.05))).drop("_debt")


# Scenario -> (probability, terminal growth).
SCENARIOS = {"bear": (0.25, 0.015), "base": (0.50, 0.025), "bull": (0.25, 0.035)}


def scenario_dcf(fin: DataFrame, price: str = "price", shares: str = "shares_out") -> DataFrame:
    """Three-scenario value per share: five projected years plus a terminal value."""
    zero, f0, f1 = F.lit(0.0), F.col("fcf_0"), F.col("fcf_1")
    growth = F.coalesce((f0 - f1) / F.nullif(F.abs(f1), zero), F.lit(0.05))
    d = fin.withColumn("_g", clip(growth, -0.05, 0.20))
    ok = (f0 > 0) & (F.col(shares) > 0)
    spec = {
        "bear": (F.greatest(F.col("_g") - 0.05, F.lit(-0.05)), F.col("wacc") + 0.01),
        "base": (F.col("_g"), F.col("wacc")),
        "bull": (F.least(F.col("_g") + 0.05, F.lit(0.25)), F.greatest(F.col("wacc") - 0.01, F.lit(0.05))),
    }
    net_cash = F.coalesce("cash_0", zero) - F.coalesce("debt_0", zero)
    for name, (g, w) in spec.items():
        gt = SCENARIOS[name][1]
        d = d.withColumn("_gp", g).withColumn("_w", F.greatest(w, F.lit(gt + 0.015)))
        ratio = (1 + F.col("_gp")) / (1 + F.col("_w"))
        pv = sum((f0 * F.pow(ratio, F.lit(float(t))) for t in range(1, 6)), zero)
        pv_tv = f0 * F.pow(ratio, F.lit(5.0)) * (1 + gt) / (F.col("_w") - gt)
        d = d.withColumn(f"value_{name}", F.when(ok, F.greatest((pv + pv_tv + net_cash) / F.nullif(shares, zero), zero)))
    value = sum((F.col(f"value_{n}") * p for n, (p, _) in SCENARIOS.items()), zero)
    d = d.withColumn("intrinsic_value", value)
    mos = F.when(F.col("intrinsic_value") > 0, (F.col("intrinsic_value") - F.col(price)) / F.nullif("intrinsic_value", zero))
    return d.withColumn("margin_of_safety", mos).withColumn(
        "status", F.when(ok, "success").otherwise("negative_or_missing_fcf")).drop("_g", "_gp", "_w")


def relative_valuation(fin: DataFrame, price: str = "price", shares: str = "shares_out") -> DataFrame:
    mcap = F.when(F.col(shares) > 0, F.col(price) * F.col(shares))
    ev = mcap + F.coalesce("debt_0", F.lit(0.0)) - F.coalesce("cash_0", F.lit(0.0))

    def over(num, den):
        return F.when(F.col(den) > 0, num / F.nullif(den, F.lit(0.0)))

    return fin.withColumns({"pe_ratio": over(mcap, "ni_0"), "pb_ratio": over(mcap, "equity_0"),
                            "ps_ratio": over(mcap, "rev_0"), "ev_ebitda": over(ev, "ebitda_0")})


def _logistic(x: Column, slope: float) -> Column:
    return clip(100.0 / (1.0 + F.exp(slope * x)), 5, 95)


def valuation_inputs(fin: DataFrame, info: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds the latest close and the share count (info, else statements, else one billion)."""
    last = prices.groupBy("asset").agg(F.max_by("close", "ts").alias("price"))
    d = fin.join(info.select("asset", "shares_outstanding", "quote_type"), "asset", "left").join(last, "asset", "left")
    return d.withColumn("shares_out", F.coalesce("shares_outstanding", "shares_0", F.lit(1e9)))


def score_valuation(fin: DataFrame, info: DataFrame, prices: DataFrame, beta=1.0, risk_free: float = 0.04) -> DataFrame:
    """M2: mean of logistic maps of margin of safety, P/E and EV/EBITDA."""
    d = relative_valuation(scenario_dcf(wacc(valuation_inputs(fin, info, prices), beta, risk_free)))
    mean, n = mean_of([
        _logistic(F.col("margin_of_safety"), -3.0), F.when(F.col("pe_ratio") > 0, _logistic(F.col("pe_ratio") - 22.0, 0.08)),
        F.when(F.col("ev_ebitda") > 0, _logistic(F.col("ev_ebitda") - 14.0, 0.12))])
    neutral = F.coalesce(is_neutral(), F.lit(False))
    return d.select(
        "asset", F.when(neutral, 50.0).otherwise(clip(F.coalesce(mean, F.lit(50.0)), 10, 90)).alias("score"),
        F.when(neutral, 1.0).when(n > 0, n / 3.0).otherwise(0.2).alias("confidence"),
        "wacc", "margin_of_safety", "pe_ratio", "ev_ebitda")


# -- alias-based items of the research factors ----------------------------------------------------
def statement_alias_item(statements: DataFrame, aliases: dict[str, list[str]] | None = None, keys=("asset",)) -> DataFrame:
    """(keys, canonical, item, period_end, value): the first alias present per key."""
    aliases, keys = aliases or ALIASES, list(keys)
    table = F.array(*[F.struct(F.lit(c).alias("canonical"), F.lit(a).alias("alias"), F.lit(i).alias("pri"))
                      for c, names in aliases.items() for i, a in enumerate(names)])
    d = statements.withColumn("_a", F.explode(F.filter(table, lambda a: a["alias"] == F.col("item"))))
    d = d.select(*keys, F.col("_a.canonical").alias("canonical"), "item", "period_end", "value", F.col("_a.pri").alias("_pri"))
    first = F.min("_pri").over(Window.partitionBy(*keys, "canonical"))
    return d.withColumn("_first", first).where("_pri = _first").drop("_pri", "_first")


def recent_values(items: DataFrame, keys=("asset",)) -> DataFrame:
    """Adds k = 0, 1, ... over the non-null values, most recent period first."""
    w = Window.partitionBy(*keys, "canonical").orderBy(F.desc("period_end"))
    return items.where("value is not null").withColumn("k", F.row_number().over(w) - 1)


def _per_canonical(recent: DataFrame, n: int, agg, out: str, keys=("asset",)) -> DataFrame:
    v = F.when(F.col("k") < n, F.col("value"))
    return recent.groupBy(*keys, "canonical").agg(F.when(F.count(v) == n, agg(v)).alias(out))


def ttm_sum(recent: DataFrame, n: int = 4, keys=("asset",)) -> DataFrame:
    return _per_canonical(recent, n, F.sum, "ttm", keys)


def latest_item(recent: DataFrame, keys=("asset",)) -> DataFrame:
    return recent.groupBy(*keys, "canonical").agg(F.max_by("value", "period_end").alias("latest"))


def avg_item(recent: DataFrame, n: int = 2, keys=("asset",)) -> DataFrame:
    return _per_canonical(recent, n, F.avg, "average", keys)


KEYS = ("as_of", "asset")


def statement_states(statements: DataFrame, aliases: dict[str, list[str]] | None = None, lag_days: int = STATEMENT_LAG_DAYS, keep: int = 8) -> DataFrame:
    """(asset, known_from, one array per canonical item): what was known after each publication of an asset.

    An array is the ring of the item's last ``keep`` non-null periods, oldest first. A row holds from its date until the asset's next
    one, so a decision date picks one row and no statement is repeated for later dates. Of several aliases of an item the first in order that
    has been published counts from then on."""
    aliases = aliases or ALIASES
    table = F.array(*[F.struct(F.lit(c).alias("canonical"), F.lit(a).alias("alias"), F.lit(i).alias("pri"))
                      for c, names in aliases.items() for i, a in enumerate(names)])
    d = statements.withColumn("_a", F.explode(F.filter(table, lambda a: a["alias"] == F.col("item"))))
    d = d.select("asset", F.col("_a.canonical").alias("canonical"), F.col("_a.pri").alias("pri"), "period_end", "value")
    item = ["asset", "canonical", "pri"]
    values = Window.partitionBy(*item, F.col("value").isNull()).orderBy("period_end").rowsBetween(1 - keep, 0)
    ring = F.when(F.col("value").isNotNull(), F.collect_list("value").over(values))
    d = d.withColumn("ring", ring)
    so_far = Window.partitionBy(*item).orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("ring", F.coalesce(F.last("ring", ignorenulls=True).over(so_far), F.array().cast("array<double>")))
    of_day = d.groupBy("asset", "canonical", F.date_add("period_end", lag_days).alias("known_from")).agg(F.min(F.struct("pri", "ring")).alias("s"))
    days = Window.partitionBy("asset", "canonical").orderBy("known_from").rowsBetween(Window.unboundedPreceding, 0)
    of_day = of_day.withColumn("_best", F.min("s.pri").over(days)).where("s.pri = _best")  # later news of a lesser alias changes nothing
    wide = of_day.groupBy("asset", "known_from").agg(*[F.max(F.when(F.col("canonical") == c, F.col("s.ring"))).alias(c) for c in aliases])
    run = running("asset", "known_from")
    return wide.select("asset", "known_from", *[F.coalesce(F.last(c, ignorenulls=True).over(run), F.array().cast("array<double>")).alias(c) for c in aliases])


def _states_at(statements: DataFrame, as_of: list) -> DataFrame:
    """The state of each asset with any known value at each date."""
    known = F.greatest(*[F.size(c) for c in ALIASES]) > 0
    return valid_at(statement_states(statements), as_of, "asset", "known_from").where(known)


def _last(ring: str, n: int) -> Column:
    """The latest n values, NULL if there are fewer."""
    return F.when(F.size(ring) >= n, F.slice(ring, -n, n))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _newest(ring: str) -> Column:
    return F.try_element_at(ring, F.lit(-1))


def factor_value(statements: DataFrame, prices: DataFrame, as_of: list) -> DataFrame:
    """Earnings yield, book to market and cash-flow yield from what was published at each date."""
    f = _states_at(statements, as_of).select(
        *KEYS, _newest("shares").alias("shares"), _total(_last("net_income", 4)).alias("ni"), _newest("book_value").alias("bv"),
        _total(_last("ocf", 4)).alias("ocf"))
    px = valid_at(prices.select("asset", "ts", "close"), as_of).select("as_of", "asset", "close")
    j = px.join(f, list(KEYS), "left")
    cap = F.nullif(F.col("close") * F.coalesce("shares", F.lit(1.0)), F.lit(0.0))
    return j.select(*KEYS, (F.col("ni") / cap).alias("earnings_yield"), (F.col("bv") / cap).alias("book_to_market"),
                    (F.col("ocf") / cap).alias("cash_flow_yield"))


def factor_quality(statements: DataFrame, as_of: list) -> DataFrame:
    """ROE, ROCE, earnings stability over eight periods, minus debt to equity."""
    f = _states_at(statements, as_of).select(
        *KEYS, _total(_last("net_income", 4)).alias("ni"), (_total(_last("book_value", 2)) / 2).alias("eq2"), _total(_last("ebit", 4)).alias("ebit"),
        _newest("total_assets").alias("ta"), _newest("current_liab").alias("cl"), _newest("book_value").alias("eq"),
        _newest("total_debt").alias("debt"), F.when(F.size("eps") > 0, _last("eps", 8)).otherwise(F.when(F.size("eps") == 0, _last("net_income", 8))).alias("e"))
    f = f.withColumn("m", _total(F.col("e")) / 8)
    spread2 = F.aggregate("e", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m")))
    return f.select(
        *KEYS, div("ni", "eq2").alias("roe"), div("ebit", F.col("ta") - F.col("cl")).alias("roce"),
        (1 - F.sqrt(spread2 / 7) / F.nullif(F.abs("m"), F.lit(0.0))).alias("earnings_stability"),
        (-div("debt", "eq")).alias("leverage"))
