"""File scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import null_nan

PRICE_SCHEMA = "ts DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, adj_close DOUBLE, volume BIGINT"
STATEMENT_SCHEMA = (
    "income_stmt MAP<STRING, MAP<STRING, DOUBLE>>, balance_sheet MAP<STRING, MAP<STRING, DOUBLE>>, "
    "cash_flow MAP<STRING, MAP<STRING, DOUBLE>>, info STRUCT<symbol: STRING, marketCap: DOUBLE, "
    "sharesOutstanding: DOUBLE, trailingPE: DOUBLE, beta: DOUBLE, sector: STRING, quoteType: STRING>"
)
STATEMENTS = ("income_stmt", "balance_sheet", "cash_flow")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``. Where that is unset a local session takes its warehouse;
    on a cluster that may be a machine's own disk, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/panelquant-{uuid.uuid4().hex}/{name}"


_STORED: dict[tuple, tuple] = {}


def stored(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Write a reduced panel once per application to the shared folder and read it from there on.

    The large tables are scanned once per panel, lineage is cut in a place that survives lost executors,
    and the planner sees the true size of the panel when it picks join strategies."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _STORED:
        path, df = scratch(spark, "panel"), build()
        df.write.parquet(path)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read to the shared folder and go on from there."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ticker_from_file() :
    # File names come percent-encoded (the ^ of an index, say).
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    return F.upper(F.trim(F.regexp_extract(name, r"^(.*?)_(price|fundamentals)", 1)))


def scan_prices(spark, path, start=None, end=None, min_rows: int = 20, per_file: bool = True) -> DataFrame:
    """Price CSVs, one file per ticker (``<TICKER>_price.csv``) or directories ``asset=<TICKER>``.

    A ticker counts only with more than ``min_rows`` rows; the date range is inclusive."""
    reader = spark.read.option("header", True)
    if per_file:
        df = reader.schema(PRICE_SCHEMA).csv(path).select(_ticker_from_file().alias("asset"), "*")
    else:
        df = reader.schema(PRICE_SCHEMA + ", asset STRING").csv(path).withColumn("asset", F.upper(F.trim("asset")))
    df = df.where("ts is not null")
    enough = df.groupBy("asset").count().where(F.col("count") > min_rows).select("asset")
    df = df.join(enough, "asset", "left_semi")
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("ts") <= F.lit(end).cast("date"))
    return df.select("asset", "ts", "open", "high", "low", "close", "adj_close", "volume")


def scan_benchmark(spark, path, start=None, end=None, per_file: bool = True) -> DataFrame:
    """An index series; the leading ^ of its name is dropped."""
    return scan_prices(spark, path, start, end, per_file=per_file).withColumn(
        "asset", F.regexp_replace("asset", r"\^", ""))


def extend_merge_bars(*pieces: DataFrame) -> DataFrame:
    """Union of pieces; a date present in several is taken from the first one."""
    tagged = [p.withColumn("_src", F.lit(i)) for i, p in enumerate(pieces)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    w = Window.partitionBy("asset", "ts").orderBy("_src")
    return out.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_src")


def scan_statements(spark, path, per_file: bool = True) -> DataFrame:
    """Nested statement JSON, one document a file or (``per_file`` off) one a line, to (asset, stmt, period, item, value); documents
    whose three statements are all empty are skipped, NaN becomes NULL."""
    raw = spark.read.schema(STATEMENT_SCHEMA).option("multiLine", per_file).json(path)
    return normalise_statements(raw.select("*", _ticker_from_file().alias("file_ticker")))


def normalise_statements(raw: DataFrame) -> DataFrame:
    name = F.col("info.symbol")
    if "file_ticker" in raw.columns:
        name = F.coalesce(name, F.col("file_ticker"))
    raw = raw.select(name.alias("asset"), *STATEMENTS)
    size = sum((F.coalesce(F.size(s), F.lit(0)) for s in STATEMENTS), F.lit(0))
    raw = raw.where(size > 0)
    parts = [
        raw.select("asset", F.lit(s).alias("stmt"), F.explode(s).alias("period", "items"))
        .select("asset", "stmt", "period", F.explode("items").alias("item", "value"))
        for s in STATEMENTS
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("value", null_nan("value"))


def statements_to_wide(raw: DataFrame) -> DataFrame:
    """(asset, stmt, item, period index 0 = most recent, period_end, value); an unreadable period
    label becomes NULL and sorts last."""
    dated = raw.withColumn("period_end", F.try_to_timestamp("period", F.lit("yyyy-MM-dd")).cast("date"))
    w = Window.partitionBy("asset", "stmt", "item").orderBy(F.desc_nulls_last("period_end"))
    return dated.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).select(
        "asset", "stmt", "item", "pos", "period_end", "value")


def scan_factor_returns(spark, path, momentum_path=None, columns=("mkt_rf", "smb", "hml", "rf")) -> DataFrame:
    """Fixed-format factor files: rows that start with a six-digit month, percent to decimals."""
    def read(p, names):
        schema = ", ".join(["yyyymm STRING"] + [f"{n} STRING" for n in names])
        df = spark.read.schema(schema).option("ignoreLeadingWhiteSpace", True).option(
            "ignoreTrailingWhiteSpace", True).csv(p)
        df = df.where(F.col("yyyymm").rlike(r"^\d{6}$"))
        return df.select(
            F.to_date("yyyymm", "yyyyMM").alias("month"),
            *[(F.expr(f"try_cast({n} AS DOUBLE)") / 100.0).alias(n) for n in names],
        ).dropna()

    out = read(path, list(columns))
    if momentum_path:
        out = out.join(read(momentum_path, ["wml"]), "month")
    return out


def month_end_series(df: DataFrame) -> DataFrame:
    """(series, ts, value) to (series, month_end, value): last value of the month, gaps carried
    forward from the series' first month to the last month of all series."""
    monthly = df.where("value is not null").groupBy("series", F.last_day("ts").alias("month_end")).agg(
        F.max_by("value", "ts").alias("value"))
    span = monthly.agg(F.max("month_end").alias("hi"))
    spine = monthly.groupBy("series").agg(F.min("month_end").alias("lo")).select(
        "series",
        F.explode(F.sequence(F.trunc("lo", "month"), F.trunc(span.scalar(), "month"),
                                           F.expr("interval 1 month"))).alias("m"),
    ).select("series", F.last_day("m").alias("month_end"))
    w = Window.partitionBy("series").orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(monthly, ["series", "month_end"], "left").select(
        "series", "month_end", F.last("value", ignorenulls=True).over(w).alias("value"))


def scan_macro_series(spark, path) -> DataFrame:
    """Series CSVs under ``series=<ID>`` directories ('.' is NULL) to month ends, gaps filled."""
    df = spark.read.option("header", True).option("nullValue", ".").schema(
        "ts DATE, value DOUBLE, series STRING").csv(path)
    return month_end_series(df)


def sink_results_json(df: DataFrame, path: str, exclude: tuple[str, ...] = ("regime_probs",)) -> None:
    """Results as JSON lines, NaN as null, nulls written out, excluded sections dropped."""
    cols = [null_nan(n).alias(n) if t in ("double", "float") else F.col(n)
            for n, t in df.dtypes if n not in exclude]
    df.select(*cols).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def audit_records(decisions: DataFrame, model_version: str = "v2.0", rationale: str = "") -> DataFrame:
    return decisions.withColumn("weight_delta", F.col("target_weight") - F.col("previous_weight")).withColumn(
        "model_version", F.lit(model_version)).withColumn("rationale", F.lit(rationale))


def sink_audit_trail(decisions: DataFrame, path: str, **kw) -> None:
    """Append-only decision records."""
    audit_records(decisions, **kw).write.mode("append").option("ignoreNullFields", False).json(path)


def sink_experiment(df: DataFrame, path: str) -> None:
    """One CSV directory per normalisation."""
    df.write.mode("overwrite").partitionBy("normalization").option("header", True).csv(path)


def bulk_ingest_clean(raw: DataFrame) -> DataFrame:
    """Keep the six price columns, fill close and adj_close from each other, drop incomplete rows."""
    return raw.select(
        "asset", "ts", "open", "high", "low",
        F.coalesce("close", "adj_close").alias("close"), F.coalesce("adj_close", "close").alias("adj_close"),
        "volume",
    ).dropna()
