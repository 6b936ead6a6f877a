"""Logical inputs of the operators, built from the tables at hand.

Trades are reduced to one row per (asset, date) before anything is ordered, so every later
per-asset window is bounded by the calendar however many trades one asset has. Money is summed
in whole cents, which makes the bars independent of the order of aggregation.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import by_shuffle, by_time, spread
from .files import stored

# The stand-in statement items: (statement, item, signed) by order priority and status.
ITEMS = {
    ("1", "F"): ("income_stmt", "Total Revenue", False),
    ("1", "O"): ("income_stmt", "Gross Profit", False),
    ("1", "P"): ("income_stmt", "EBIT", True),
    ("2", "F"): ("income_stmt", "Net Income", True),
    ("2", "O"): ("income_stmt", "Pretax Income", False),
    ("2", "P"): ("income_stmt", "Tax Provision", False),
    ("3", "F"): ("income_stmt", "Interest Expense", True),
    ("3", "O"): ("balance_sheet", "Total Assets", False),
    ("3", "P"): ("balance_sheet", "Stockholders Equity", False),
    ("4", "F"): ("balance_sheet", "Long Term Debt", False),
    ("4", "O"): ("balance_sheet", "Total Current Assets", False),
    ("4", "P"): ("balance_sheet", "Current Liabilities", False),
    ("5", "F"): ("balance_sheet", "Cash And Cash Equivalents", False),
    ("5", "O"): ("cash_flow", "Operating Cash Flow", True),
    ("5", "P"): ("cash_flow", "Free Cash Flow", True),
}
# Second reading of the same orders, by priority alone.
ITEMS_BY_PRIORITY = {
    "1": ("income_stmt", "EBITDA"),
    "2": ("balance_sheet", "Total Debt"),
    "3": ("balance_sheet", "Ordinary Shares Number"),
    "4": ("balance_sheet", "Total Liabilities Net Minority Interest"),
    "5": ("balance_sheet", "Retained Earnings"),
}

MACRO_SERIES = {
    "o_orderstatus": {"F": "GS10", "O": "GS2", "P": "BAMLH0A0HYM2"},
    "o_orderpriority": {"1-URGENT": "CPIAUCSL", "2-HIGH": "UNRATE", "3-MEDIUM": "FEDFUNDS"},
}


def whole(c, scale: int = 1) -> Column:
    """A decimal-like double as an exact integer number of 1/scale units."""
    return F.round(F.col(c) * scale).cast("bigint")


def pick(keys: list[Column], table: dict, field: int) -> Column:
    """CASE expression over a small fixed mapping."""
    out = None
    for k, v in table.items():
        k = k if isinstance(k, tuple) else (k,)
        cond = keys[0] == k[0]
        for c, x in zip(keys[1:], k[1:]):
            cond = cond & (c == x)
        v = v[field] if isinstance(v, tuple) else v
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out


def panel(fn):
    """A panel method whose result is stored once per application and directory."""
    @wraps(fn)
    def run(self, *args, **kw):
        return stored(self.spark, (self.path, fn.__name__, args, tuple(sorted(kw.items()))), lambda: fn(self, *args, **kw))
    return run


class Panels:
    """Lazily defined inputs over one directory of Parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def years(self) -> tuple[int, int]:
        """First and last year with trades."""
        if not hasattr(self, "_years"):
            ts = F.to_date("l_shipdate")
            self._years = tuple(self.table("lineitem").agg(F.min(F.year(ts)), F.max(F.year(ts))).first())
        return self._years

    # -- prices ---------------------------------------------------------------------------
    def trades(self, asset: str = "p_brand") -> DataFrame:
        li = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            F.to_date("l_shipdate").alias("ts"),
            whole("l_extendedprice", 100).alias("cents"),
            whole("l_quantity").alias("qty"),
            whole("l_discount", 100).alias("disc"),
        )
        if asset == "l_partkey":
            return li.withColumn("asset", F.col("l_partkey"))
        part = self.table("part").select("p_partkey", F.col(asset).alias("asset"))
        # Parts grow with the trades, so they are not broadcast; the tasks of the join follow the trades.
        return spread(li, "l_partkey", growth=1).join(by_shuffle(part), F.col("l_partkey") == part.p_partkey).drop("p_partkey")

    @panel
    def bars(self, asset: str = "p_brand") -> DataFrame:
        """Daily bars; brand for a sparse panel, type for a dense one, part for a wide one."""
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        order = F.struct("l_orderkey", "l_linenumber", unit.alias("u"))
        return (
            self.trades(asset).groupBy("asset", "ts").agg(
                F.min_by(unit, order).alias("open"),
                F.max(unit).alias("high"),
                F.min(unit).alias("low"),
                (F.sum("cents").cast("double") / (F.sum("qty") * 100.0)).alias("close"),
                (F.sum(F.col("cents") * (100 - F.col("disc"))).cast("double") / (F.sum("qty") * 10000.0))
                .alias("adj_close"),
                F.sum("qty").alias("volume"),
            )
        )

    @panel
    def closes(self, asset: str = "p_brand") -> DataFrame:
        return self.trades(asset).groupBy("asset", "ts").agg(
            (F.sum("cents").cast("double") / (F.sum("qty") * 100.0)).alias("close"),
            F.sum("qty").alias("volume"),
        )

    def returns(self, asset: str = "p_brand") -> DataFrame:
        """Simple and log returns, first date of each asset dropped."""
        w = by_time()
        prev = F.lag("close").over(w)
        return (
            self.closes(asset)
            .select("asset", "ts", "close", "volume",
                    (F.col("close") / prev - 1).alias("r"), F.ln(F.col("close") / prev).alias("lr"))
            .where(F.col("r").isNotNull())
        )

    def benchmark(self, asset: str = "p_brand") -> DataFrame:
        """Equal-weight mean return per date."""
        return self.returns(asset).groupBy("ts").agg(F.avg("r").alias("bm"))

    # -- statements -----------------------------------------------------------------------
    @panel
    def statements(self, freq: str = "year") -> DataFrame:
        """(asset, stmt, period_end, item, value), one company per nation."""
        o = self.table("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", whole("o_totalprice", 100).alias("cents"),
            F.substring("o_orderpriority", 1, 1).alias("pri"),
            F.last_day(F.add_months(F.trunc("o_orderdate", freq), 11 if freq == "year" else 2)).alias("period_end"),
        )
        c = self.table("customer").select("c_custkey", "c_nationkey")
        signed = F.when(F.col("o_orderkey") % 3 == 0, -F.col("cents")).otherwise(F.col("cents"))
        base = (
            spread(o, "o_custkey", growth=1).join(by_shuffle(c), F.col("o_custkey") == c.c_custkey)
            .groupBy("c_nationkey", "period_end", "pri", "o_orderstatus")
            .agg(F.sum("cents").alias("cents"), F.sum(signed).alias("signed"), F.count(F.lit(1)).alias("n"))
            .withColumn("asset", F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")))
        )
        k = [F.col("pri"), F.col("o_orderstatus")]
        first = base.select(
            "asset", "period_end",
            pick(k, ITEMS, 0).alias("stmt"), pick(k, ITEMS, 1).alias("item"),
            (F.when(pick(k, ITEMS, 2), F.col("signed")).otherwise(F.col("cents")) / F.lit(100.0)).alias("value"),
        )
        p = [F.col("pri")]
        second = base.groupBy("asset", "period_end", "pri").agg(F.sum("cents").alias("cents"), F.sum("n").alias("n")).select(
            "asset", "period_end",
            pick(p, ITEMS_BY_PRIORITY, 0).alias("stmt"), pick(p, ITEMS_BY_PRIORITY, 1).alias("item"),
            F.when(F.col("pri") == "3", F.col("n") * 1000.0).otherwise(F.col("cents") / F.lit(100.0)).alias("value"),
        )
        return first.unionByName(second).select("asset", "stmt", "period_end", "item", "value")

    @panel
    def info(self) -> DataFrame:
        """(asset, market_cap, shares_outstanding, trailing_pe, beta, quote_type)."""
        cents = whole("c_acctbal", 100)
        return (
            self.table("customer").groupBy("c_nationkey")
            .agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("n"))
            .select(
                F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("asset"),
                (F.col("cents") / F.lit(100.0)).alias("market_cap"),
                F.when(F.col("c_nationkey") % 5 != 0, F.col("n") * 100.0).alias("shares_outstanding"),
                F.when(F.col("c_nationkey") % 7 != 0, F.col("cents") / (F.col("n") * 20000.0)).alias("trailing_pe"),
                (F.lit(0.1) + F.col("c_nationkey") / F.lit(20.0)).alias("beta"),
                F.when(F.col("c_nationkey") % 12 == 0, "ETF").otherwise("EQUITY").alias("quote_type"),
            )
        )

    # -- macro and factor series ------------------------------------------------------------
    @panel
    def macro_daily(self) -> DataFrame:
        """(series, ts, value): irregular daily observations of six series."""
        o = self.table("orders").select(
            F.to_date("o_orderdate").alias("ts"), whole("o_totalprice", 100).alias("cents"),
            F.array(
                pick([F.col("o_orderstatus")], MACRO_SERIES["o_orderstatus"], 0),
                pick([F.col("o_orderpriority")], MACRO_SERIES["o_orderpriority"], 0),
            ).alias("names"),
        )
        return (
            o.select("ts", "cents", F.explode("names").alias("series")).where("series is not null")
            .groupBy("series", "ts")
            .agg((F.sum("cents").cast("double") / (F.count(F.lit(1)) * 1e7)).alias("value"))
        )

    @panel
    def factors(self) -> DataFrame:
        """(month, mkt_rf, smb, hml, rf, wml), one row per first of month with all values."""
        def mean(cond):
            return F.sum(F.when(cond, F.col("cents"))).cast("double") / F.count(F.when(cond, 1))

        st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
        g = (
            self.table("orders")
            .select(F.trunc("o_orderdate", "month").alias("month"), whole("o_totalprice", 100).alias("cents"),
                    "o_orderstatus", "o_orderpriority")
            .groupBy("month").agg(
                mean(F.lit(True)).alias("m"), mean(st == "F").alias("f"), mean(st == "O").alias("o"),
                mean(st == "P").alias("p"), mean(pr == "1-URGENT").alias("u"), mean(pr == "5-LOW").alias("l"),
                mean(pr == "2-HIGH").alias("h"), mean(pr == "4-NOT SPECIFIED").alias("x"),
            )
        )
        return g.select(
            "month", (F.col("f") / F.col("m") - 1).alias("mkt_rf"), (F.col("o") / F.col("p") - 1).alias("smb"),
            (F.col("u") / F.col("l") - 1).alias("hml"), F.lit(0.002).alias("rf"),
            (F.col("h") / F.col("x") - 1).alias("wml"),
        ).dropna()

    # -- cross-sections -------------------------------------------------------------------
    @panel
    def chars(self) -> DataFrame:
        """(ts, asset, characteristic, value): monthly characteristics of every part."""
        g = (
            self.table("lineitem").select(
                F.trunc("l_shipdate", "month").alias("ts"), F.col("l_partkey").alias("asset"),
                whole("l_extendedprice", 100).alias("cents"), whole("l_quantity").alias("qty"),
                whole("l_discount", 100).alias("disc"),
            ).groupBy("ts", "asset").agg(
                (F.sum("cents").cast("double") / (F.sum("qty") * 100.0)).alias("price"),
                F.sum("qty").cast("double").alias("volume"),
                F.when(F.max("disc") > 0, F.sum("disc").cast("double") / F.count(F.lit(1))).alias("discount"),
            )
        )
        return g.unpivot(["ts", "asset"], ["price", "volume", "discount"], "characteristic", "value")

    @panel
    def module_scores(self) -> DataFrame:
        """(asset, ts, module, score): monthly 0-100 scores of six modules per brand."""
        li = self.table("lineitem").select(
            "l_partkey", F.trunc("l_shipdate", "month").alias("ts"),
            whole("l_extendedprice", 100).alias("cents"), whole("l_quantity").alias("qty"),
            whole("l_discount", 100).alias("disc"), whole("l_tax", 100).alias("tax"),
            (F.col("l_returnflag") == "A").cast("bigint").alias("ra"),
            (F.col("l_linestatus") == "O").cast("bigint").alias("so"),
        )
        part = self.table("part").select("p_partkey", F.col("p_brand").alias("asset"))
        g = spread(li, "l_partkey", growth=1).join(by_shuffle(part), F.col("l_partkey") == part.p_partkey).groupBy("asset", "ts").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(c).alias(c) for c in ("cents", "qty", "disc", "tax", "ra", "so")],
        )
        n = F.col("n")
        g = g.select(
            "asset", "ts",
            (F.col("disc") * 10.0 / n).alias("M1"), (F.col("tax") * 12.5 / n).alias("M2"),
            (F.col("qty") * 2.0 / n).alias("M3"), F.when(F.col("ra") > 0, F.col("ra") * 100.0 / n).alias("M4"),
            (F.col("so") * 100.0 / n).alias("M5"), (F.col("cents") / (F.col("qty") * 1500.0)).alias("M6"),
        )
        return g.unpivot(["asset", "ts"], ["M1", "M2", "M3", "M4", "M5", "M6"], "module", "score")

    # -- text -----------------------------------------------------------------------------
    def news(self) -> DataFrame:
        """(asset, doc_id, published_at, text)."""
        return self.table("documents").select(
            F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("asset"),
            "doc_id",
            F.date_add(F.lit("1998-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).alias("published_at"),
            "text",
        )

    # -- returns matrix, portfolios ---------------------------------------------------------
    def vector_returns(self) -> DataFrame:
        """(ts BIGINT, asset INT, r): every component of the vectors as one series."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("ts"), F.posexplode("embedding").alias("asset", "r")
        ).withColumn("r", F.col("r").cast("double"))

    @panel
    def target_weights(self) -> DataFrame:
        """(portfolio, asset, w): suppliers of a nation as one portfolio, w by positive balance."""
        s = self.table("supplier").groupBy(
            F.col("s_nationkey").alias("portfolio"),
            F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("asset"),
        ).agg(F.sum(F.greatest(whole("s_acctbal", 100), F.lit(0))).alias("c"))
        total = s.groupBy("portfolio").agg(F.sum("c").alias("t"))
        return s.join(total, "portfolio").where("t > 0").select(
            "portfolio", "asset", (F.col("c").cast("double") / F.col("t")).alias("w"))

    @panel
    def holdings(self) -> DataFrame:
        """(portfolio, asset, shares): customers of a nation as the present book."""
        return self.table("customer").groupBy(
            F.col("c_nationkey").alias("portfolio"),
            F.concat(F.lit("Brand#"), (F.col("c_custkey") % 25 + 1).cast("string")).alias("asset"),
        ).agg(F.sum(F.floor(F.greatest(whole("c_acctbal", 100), F.lit(0)) / 100000)).alias("shares"))

    @panel
    def candidate_weights(self) -> DataFrame:
        """(candidate, asset, w): one candidate per supplier, weights by traded value per type."""
        g = self.trades("p_type").groupBy(F.col("l_suppkey").alias("candidate"), "asset").agg(F.sum("cents").alias("c"))
        total = g.groupBy("candidate").agg(F.sum("c").alias("t"))
        return g.join(total, "candidate").select(
            "candidate", "asset", (F.col("c").cast("double") / F.col("t")).alias("w"))

    # -- ticks ----------------------------------------------------------------------------
    @panel
    def daily_pnl(self) -> DataFrame:
        """(portfolio, ts, pnl): per event type and day, from exact cents."""
        g = self.table("events").groupBy(F.col("event_type").alias("portfolio"), F.to_date("ts").alias("ts")).agg(
            F.sum(whole("value", 100)).alias("c"), F.count(F.lit(1)).alias("n"))
        w = by_time("portfolio")
        level = F.col("c").cast("double") / F.col("n")
        return g.select("portfolio", "ts", level.alias("level")).select(
            "portfolio", "ts", ((F.col("level") / F.lag("level").over(w) - 1) / 10).alias("pnl")
        ).where("pnl is not null")
