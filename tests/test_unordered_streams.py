"""Streams in any order against the batch operators on the same rows."""

import datetime as dt

import pytest
from panelquant.operators import decisions as dc
from panelquant.operators import pit
from panelquant.streaming import unordered as un
from pyspark.sql import functions as F

from .helpers import day, rng


def run(stream, name, tmp_path, **options):
    out = str(tmp_path / name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_c").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(300)
    return stream.sparkSession.read.parquet(out)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, un.ROCKS)
    yield
    spark.conf.set(key, before)


def batches(spark, folder, frames):
    """A stream that reads one file a batch, in the order given."""
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_latch_over_shuffled_and_late_rows(spark, tmp_path, rocks):
    g = rng(1)
    rows = [(f"p{k}", day(i), float(g.normal(0, 0.022)), -abs(float(g.normal(0, 0.09)))) for k in range(6) for i in range(40)]
    schema = "portfolio string, ts date, pnl double, drawdown double"
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1].toordinal() + g.integers(0, 5)))  # up to five days late
    parts = [[rows[i] for i in order[k::1]][:60] for k in range(0, len(order), 60)]
    end = [("end", day(400), 0.0, 0.0)]  # moves the watermark past all dates
    live = batches(spark, str(tmp_path / "status"), [spark.createDataFrame(p, schema) for p in [*parts, end, [("end", day(401), 0.0, 0.0)]]])
    got = run(un.kill_switch_unordered(live, "7 days", max_drawdown=0.2), "latch", tmp_path).where("portfolio <> 'end'")
    want = dc.kill_switch(spark.createDataFrame(rows, schema), max_drawdown=0.2)
    assert got.count() == len(rows) == want.count()
    assert got.select(*want.columns).exceptAll(want).count() == 0
    assert 0 < want.where("tripped").count() < len(rows)


def test_bars_with_published_statements(spark, tmp_path):
    g = rng(2)
    bars = [(a, day(i), float(i)) for a in ("A", "B") for i in range(0, 300, 3)]
    quarters = [dt.date(2019, 9, 30), dt.date(2019, 12, 31), dt.date(2020, 3, 31), dt.date(2020, 6, 30)]
    facts = [(a, item, q, float(g.normal())) for a in ("A", "B") for item in ("EBIT", "Debt") for q in quarters]
    b = spark.createDataFrame(bars, "asset string, ts date, close double")
    s = spark.createDataFrame(facts, "asset string, item string, period_end date, value double")
    far = [b, spark.createDataFrame([("end", day(900), 0.0)], b.schema)], [s, spark.createDataFrame([("end", "EBIT", day(900), 0.0)], s.schema)]
    live = [batches(spark, str(tmp_path / n), frames) for n, frames in zip(("bars", "facts"), far, strict=True)]
    got = un.newest_available(run(un.available_statements(*live, keep_days=120), "joined", tmp_path))
    known = s.withColumn("known", F.date_add("period_end", pit.STATEMENT_LAG_DAYS))
    want = None
    for item in ("EBIT", "Debt"):
        one = pit.asof_join(b, known.where(F.col("item") == item), ["asset"], "ts", "known", ["item", "period_end", "value"]).where("item is not null")
        one = one.where(F.datediff("ts", "matched_ts") < 120).select("asset", "ts", "item", "period_end", "value")
        want = one if want is None else want.unionByName(one)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.count() > 300
