"""Registered queries: the driver contract, agreement with the reference SQL, file scans and streaming."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelquant.operators import decisions as dc
from panelquant.plans import backtests
from panelquant.sources import files
from panelquant.sources.panels import Panels
from panelquant.streaming.kill_switch import bars_stream, kill_switch_stream
from tools.check import compare, connect

from .helpers import pdf

SF = "/root/testdata/sf0.001"
SAMPLE = ["score_risk", "scan_prices", "pit_statements", "asof_latest", "xs_winsorized_zscore", "score_valuation", "momentum_skip",
          "factor_loadings", "covariance", "daily_sentiment", "composite_ci", "purged_cv_splits", "portfolio_path", "multiple_comparison",
          "oos_incremental_all", "order_tickets", "kill_switch"]


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 205
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", SAMPLE)
def test_agrees_with_sql(spark, key):
    got = entry.queries()[key](spark, SF).toPandas()
    want = connect(SF).execute(entry.oracle_sql()[key]).fetchdf()
    assert compare(got, want).startswith("ok")


def test_price_files(spark, tmp_path):
    head = "ts,open,high,low,close,adj_close,volume\n"
    body = "".join(f"2020-01-{d:02d},1,2,0.5,{d},{d},10\n" for d in range(1, 31))
    (tmp_path / "abc_price.csv").write_text(head + body)
    (tmp_path / "short_price.csv").write_text(head + "2020-01-01,1,1,1,1,1,1\n")
    (tmp_path / "^GSPC_price.csv").write_text(head + body)
    out = pdf(files.scan_prices(spark, str(tmp_path), "2020-01-05", "2020-01-10"), "asset", "ts")
    assert sorted(set(out.asset)) == ["ABC", "^GSPC"] and len(out) == 12
    assert set(pdf(files.scan_benchmark(spark, str(tmp_path)))["asset"]) == {"ABC", "GSPC"}


def test_statement_files(spark, tmp_path):
    doc = {"income_stmt": {"2024-12-31": {"Net Income": 5.0}}, "balance_sheet": {}, "cash_flow": {"bad": {"FCF": 1.0}}, "info": {"symbol": "AXP"}}
    (tmp_path / "AXP_fundamentals.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "EMPTY_fundamentals.json").write_text(json.dumps({"income_stmt": {}, "balance_sheet": {}, "cash_flow": {}, "info": {}}))
    raw = files.scan_statements(spark, str(tmp_path))
    assert {(r.asset, r.stmt, r.item) for r in raw.collect()} == {("AXP", "income_stmt", "Net Income"), ("AXP", "cash_flow", "FCF")}
    wide = {r.item: r.period_end for r in files.statements_to_wide(raw).collect()}
    assert wide["FCF"] is None and str(wide["Net Income"]) == "2024-12-31"


def _run(stream, name, tmp_path):
    out = str(tmp_path / name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_c").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    return stream.sparkSession.read.parquet(out)


def test_streaming_latch_equals_batch(spark, tmp_path):
    status = dc.running_drawdown(Panels(spark, "/root/testdata/sf0.01").daily_pnl())
    src = str(tmp_path / "status")
    status.coalesce(1).write.parquet(src)
    live = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    got = _run(kill_switch_stream(live, max_drawdown=0.15), "latch", tmp_path)
    assert got.exceptAll(dc.kill_switch(status, max_drawdown=0.15)).count() == 0
    assert got.count() == status.count()


def test_streaming_bars_equal_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    ev = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "ticks")
    ev.coalesce(1).write.parquet(src)
    live = spark.readStream.schema(ev.schema).parquet(src)
    got = _run(bars_stream(live, "event_type", "value", delay="0 seconds"), "bars", tmp_path)
    batch = bars_stream(ev, "event_type", "value")
    assert got.exceptAll(batch).count() == 0 and got.count() > 0


def test_regimes_scale_asset_and_benchmark_returns_alike(spark):
    p = Panels(spark, SF)
    ratio = lambda d, a, b: d.where(f"abs({b}) > 1e-6").select(F.round(F.max(F.col(b) / F.col(a)), 6)).first()[0]
    bm = p.benchmark("p_type").select("ts", F.col("bm").alias("whole_bm"))
    r = p.returns("p_type").select("asset", "ts", F.col("r").alias("whole_r"))
    path = backtests._asset_path(p)
    assert ratio(path.join(bm, "ts"), "bm", "whole_bm") == ratio(path.join(r, ["asset", "ts"]), "r", "whole_r") == 50
