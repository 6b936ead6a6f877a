"""Streams whose rows come in any order: a latch that waits for its dates, and the join of bars with what was published by then.

Both are exact on whatever is no later than the watermark; each equals its batch operator on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.decisions import OUTCOMES
from ..operators.pit import STATEMENT_LAG_DAYS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class _Latch(StatefulProcessor):
    """State of a portfolio: rows whose date isn't closed yet, by date, and why it was stopped."""

    def __init__(self, max_daily_loss: float, max_drawdown: float):
        self.limits = max_daily_loss, max_drawdown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day bigint", "pnl double, drawdown double")
        self.reason = handle.getValueState("reason", "reason string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for day, pnl, drawdown in zip(frame["day"].tolist(), frame["pnl"].tolist(), frame["drawdown"].tolist(), strict=True):
                self.waiting.updateValue((day,), (pnl, drawdown))
                self.handle.registerTimer(day * DAY_MS)  # fires when no earlier row can come any more
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The dates up to the timer, in order; timers of one batch may fire in any order, so an early one takes all before it."""
        until = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS
        due = sorted((d[0], v) for d, v in self.waiting.iterator() if d[0] <= until)
        reason, out = (self.reason.get()[0] if self.reason.exists() else ""), []
        for day, (pnl, drawdown) in due:
            fresh = ""
            if not reason:
                reason = fresh = "MAX_DAILY_LOSS" if pnl < -self.limits[0] else "MAX_PORTFOLIO_DRAWDOWN" if abs(drawdown) > self.limits[1] else ""
            action = OUTCOMES[0] if not reason else OUTCOMES[1] if fresh == "MAX_DAILY_LOSS" else OUTCOMES[2]
            out.append((key[0], pd.Timestamp(day * DAY_MS, unit="ms").date(), bool(reason), action, reason or OUTCOMES[3]))
            self.waiting.removeKey((day,))
        if reason:
            self.reason.update((reason,))
        if out:
            yield pd.DataFrame(out, columns=["portfolio", "ts", "tripped", "action", "reason"])

    def close(self) -> None:
        pass


def kill_switch_unordered(status: DataFrame, delay: str = "7 days", max_daily_loss: float = 0.05, max_drawdown: float = 0.25) -> DataFrame:
    """The latch over a stream of (portfolio, ts, pnl, drawdown) whose rows come in any order, late by at most ``delay``.

    Rows wait in state until the watermark has passed their date and are then judged in order of date, so the result is that of the batch
    operator. Later rows are dropped by the watermark. A date that comes twice counts once, with its last values. The session needs the
    RocksDB state store (``ROCKS``)."""
    day = F.unix_date(F.to_date("ts")).cast("bigint")
    rows = status.select("portfolio", F.to_timestamp("ts").alias("at"), day.alias("day"), F.col("pnl").cast("double").alias("pnl"), F.col("drawdown").cast("double").alias("drawdown"))
    kind = dict(status.dtypes)["portfolio"]
    return rows.withWatermark("at", delay).groupBy("portfolio").transformWithStateInPandas(
        _Latch(max_daily_loss, max_drawdown), f"portfolio {kind}, ts date, tripped boolean, action string, reason string", "Append", "EventTime")


def available_statements(bars: DataFrame, statements: DataFrame, lag_days: int = STATEMENT_LAG_DAYS, keep_days: int = 120, delay: str = "7 days") -> DataFrame:
    """(asset, ts, close, item, period_end, value): every bar with the statement values published in the ``keep_days`` before it.

    Both sides may be streams: an interval join on the asset and the availability date, so that each side's state is dropped once the
    other's watermark has passed the interval. A quarter's value is available for longer than a quarter; the newest per item is
    chosen downstream, by ``newest_available``."""
    b = bars.select("asset", F.to_timestamp("ts").alias("at"), F.col("ts").alias("ts"), "close").withWatermark("at", delay)
    published = F.to_timestamp(F.date_add("period_end", lag_days))
    s = statements.select(F.col("asset").alias("_asset"), published.alias("published"), "item", "period_end", "value").withWatermark("published", delay)
    inside = F.expr(f"asset = _asset AND at >= published AND at < published + INTERVAL {keep_days} DAYS")
    return b.join(s, inside).select("asset", "ts", "close", "item", "period_end", "value")


def newest_available(joined: DataFrame) -> DataFrame:
    """(asset, ts, item, period_end, value): of the values known at a bar the one of the latest period."""
    return joined.groupBy("asset", "ts", "item").agg(F.max(F.struct("period_end", "value")).alias("m")).select("asset", "ts", "item", "m.*")

