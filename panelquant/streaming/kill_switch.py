"""Structured Streaming forms of the stateful pieces; each equals its batch operator on the same input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "portfolio string, ts date, tripped boolean, action string, reason string"


def kill_switch_stream(status: DataFrame, max_daily_loss: float = 0.05, max_drawdown: float = 0.25) -> DataFrame:
    """The latch over a stream of (portfolio, ts, pnl, drawdown). Rows of a portfolio must arrive in date
    order across batches; inside a batch they are put in order here."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reason = state.get[0] if state.exists else ""
        out = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            fresh = ""
            if not reason:
                if row.pnl < -max_daily_loss:
                    reason = fresh = "MAX_DAILY_LOSS"
                elif abs(row.drawdown) > max_drawdown:
                    reason = fresh = "MAX_PORTFOLIO_DRAWDOWN"
            action = "PROCEED" if not reason else "HALT_TRADING" if fresh == "MAX_DAILY_LOSS" else "HALT_TRADING_LIQUIDATE"
            out.append((key[0], row.ts, bool(reason), action, reason or "All risk limits normal"))
        state.update((reason,))
        yield pd.DataFrame(out, columns=["portfolio", "ts", "tripped", "action", "reason"])

    return status.groupBy("portfolio").applyInPandasWithState(step, OUT, "reason string", "append", GroupStateTimeout.NoTimeout)


def bars_stream(ticks: DataFrame, key: str, value: str, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """OHLC bars per key and window over a stream of ticks with late data up to ``delay``."""
    t = F.struct("ts", "event_id")
    return ticks.withWatermark("ts", delay).groupBy(key, F.window("ts", width).alias("w")).agg(
        F.min_by(value, t).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, t).alias("close"),
        F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def audit_stream(decisions: DataFrame, path: str, checkpoint: str):
    """Write decision records of a stream to the audit trail, one folder per batch: a batch that is replayed replaces its own."""
    return decisions.writeStream.foreachBatch(lambda df, batch: write_audit_batch(df, batch, path)).option("checkpointLocation", checkpoint)


def write_audit_batch(decisions: DataFrame, batch: int, path: str) -> None:
    from ..sources.files import audit_records

    audit_records(decisions).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/batch={batch}")
