"""Text signals (M8)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, clip
from .pit import asof_join

# Sentiment words and event patterns.
POSITIVE = ["record", "profit", "exceeded", "surpassed", "growth", "outperformed", "expansion", "strong", "increased",
            "dividend", "buyback", "raised", "upgrade", "favorable", "optimistic", "gain", "rebound", "resilient"]
NEGATIVE = ["loss", "dropped", "declined", "missed", "recession", "headwind", "downgrade", "lawsuit", "investigation",
            "resignation", "restructuring", "bankruptcy", "default", "impairment", "deficit", "slump", "weakness"]
EVENTS = {
    "earnings_beat": [r"beats? estimates?", r"revenue above expectations", r"record earnings"],
    "earnings_miss": [r"misses? estimates?", r"revenue below expectations", r"profit falls short"],
    "guidance_cut": [r"lowers? guidance", r"cuts? forecast", r"profit warning"],
    "management_change": [r"ceo resigns?", r"cfo steps down", r"executive departure"],
    "regulatory_probe": [r"sec investigation", r"regulatory inquiry", r"subpoena issued"],
    "capital_return": [r"share repurchase", r"stock buyback", r"dividend hike"],
}


def text_sentiment(docs: DataFrame, text: str = "text", positive=POSITIVE, negative=NEGATIVE) -> DataFrame:
    """Lexicon sentiment of each whole text; only words of plain letters count. Adds prob_pos,
    prob_neu, prob_neg and sentiment_score."""
    # One pass over the text: a word character run that is a plain-letter word.
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    d = docs.withColumn("_w", F.filter(runs, lambda w: w.rlike("^[a-z]+$")))
    d = d.withColumns({"_n": F.size("_w"), "_p": F.size(F.filter("_w", lambda w: w.isin(positive))).cast("double"),
                       "_q": F.size(F.filter("_w", lambda w: w.isin(negative))).cast("double")}).drop("_w")
    empty = F.col("_n").isNull() | (F.col("_n") <= 0)
    t = F.col("_p") + F.col("_q")
    pos = F.when(empty, 0.33).when(t == 0, 0.15).otherwise(F.col("_p") / (t + 2))
    neg = F.when(empty, 0.33).when(t == 0, 0.15).otherwise(F.col("_q") / (t + 2))
    neu = F.when(empty, 0.34).when(t == 0, 0.70).otherwise(F.greatest(F.lit(0.0), 1 - F.col("_p") / (t + 2) - F.col("_q") / (t + 2)))
    return d.withColumns({"prob_pos": pos, "prob_neu": neu, "prob_neg": neg}).withColumn(
        "sentiment_score", F.col("prob_pos") - F.col("prob_neg")).drop("_n", "_p", "_q")


def text_events(docs: DataFrame, text: str = "text", patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``events``, the event types of which any pattern occurs in the whole text."""
    hits = []
    for name, pats in (patterns or EVENTS).items():
        cond = F.lit(False)
        for pat in pats:
            cond = cond | F.col("_low").rlike(pat)
        hits.append(F.when(cond, F.lit(name)))
    return docs.withColumn("_low", F.lower(text)).withColumn("events", F.array_compact(F.array(*hits))).drop("_low")


def ewma(df: DataFrame, value: str, decay: float, out: str, keys="asset", ts="ts") -> DataFrame:
    """Exponentially weighted mean with adjusted weights. Each series is cut into blocks so long that
    a weight over one whole block is below double precision; a block needs only its own running sum
    and the total of the block before."""
    n_block = math.ceil(40 / -math.log(decay))
    keys = [keys] if isinstance(keys, str) else list(keys)
    lam = F.lit(decay)
    d = df.withColumn("_n", F.row_number().over(by_time(keys, ts)) - 1)
    d = d.withColumn("_b", F.floor(F.col("_n") / n_block)).withColumn("_p", F.col("_n") - F.col("_b") * n_block)
    inside = Window.partitionBy(*keys, "_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_s", F.sum(F.col(value) * F.pow(lam, -F.col("_p").cast("double"))).over(inside) * F.pow(lam, F.col("_p").cast("double")))
    before = by_time(keys, ts).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_c", F.last(F.when(F.col("_p") == n_block - 1, F.col("_s")), ignorenulls=True).over(before))
    total = F.col("_s") + F.coalesce("_c", F.lit(0.0)) * F.pow(lam, F.col("_p") + 1.0)
    norm = (1 - F.pow(lam, F.col("_n") + 1.0)) / (1 - decay)
    return d.withColumn(out, total / norm).drop("_n", "_b", "_p", "_s", "_c")


def daily_sentiment(scored: DataFrame, index: DataFrame, decay: float = 0.85, momentum: int = 20) -> DataFrame:
    """Document scores on the last trading date at or before publication, summed and clipped to +-1,
    with EWMA and momentum. ``scored`` holds (asset, published_at, sentiment_score), ``index`` (asset, ts)."""
    days = index.select("asset", "ts")
    # Added up per publication date first: an asset may hold most of the news, but only one row per date goes on.
    dated = scored.groupBy("asset", "published_at").agg(F.sum("sentiment_score").alias("s"), F.count(F.lit(1)).alias("k"))
    placed = asof_join(dated, days.withColumn("day", F.col("ts")), ["asset"], "published_at", "ts", ["day"]).where("day is not null")
    daily = placed.groupBy("asset", F.col("day").alias("ts")).agg(F.sum("s").alias("s"), F.sum("k").alias("news"))
    d = days.join(daily, ["asset", "ts"], "left").select(
        "asset", "ts", clip(F.coalesce("s", F.lit(0.0)), -1, 1).alias("daily_sentiment"), F.coalesce("news", F.lit(0)).alias("news"))
    d = ewma(d, "daily_sentiment", decay, "ewma_sentiment")
    prev = F.coalesce(F.lag("ewma_sentiment", momentum).over(by_time()), F.lit(0.0))
    return d.withColumn("sentiment_momentum", F.col("ewma_sentiment") - prev)


def score_sentiment(daily: DataFrame, news: DataFrame) -> DataFrame:
    """M8: 50 + 35 EWMA + 15 momentum on the last date; confidence 0.8 with news, 0.3 without."""
    g = daily.groupBy("asset").agg(F.max_by(F.struct("ewma_sentiment", "sentiment_momentum"), "ts").alias("l"))
    n = news.groupBy("asset").agg(F.count(F.lit(1)).alias("news_items"))
    d = g.join(n, "asset", "left").withColumn("news_items", F.coalesce("news_items", F.lit(0)))
    s = clip(50 + F.col("l.ewma_sentiment") * 35 + F.col("l.sentiment_momentum") * 15, 0, 100)
    return d.select("asset", s.alias("score"), F.when(F.col("news_items") > 0, 0.8).otherwise(0.3).alias("confidence"), "news_items")
