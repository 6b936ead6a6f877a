"""Registered sources: an append-only manifest of file sets, read by version.

Each load or append of a source writes new files and then one manifest entry, which is what makes them visible. Files and entries are
never changed, so every version can be read again as it was. An entry also keeps the availability lag, the extent of its rows and the
result of the quality checks made on the files as written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = ("kind STRING, folder STRING, ddl STRING, entity STRING, ts STRING, lag_days INT, n_rows BIGINT, n_entities BIGINT, "
         "first_date DATE, last_date DATE, quality STRING")


class Catalog:
    """The sources registered under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> DataFrame:
        """(source, version, ...) of every load and append, one row each."""
        schema = T.StructType.fromDDL(f"{ENTRY}, source STRING, version INT")
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/manifest").select("source", "version", *schema.names[:-2])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema).select("source", "version", *schema.names[:-2])

    def _entries(self, source: str, version: int | None = None) -> list:
        """Entries that make up a version: back to the last load. One entry for each append, so a list on the driver is short."""
        rows = self.manifest().where(F.col("source") == source).orderBy("version").collect()
        if version is not None:
            if version not in {r.version for r in rows}:
                raise ValueError(f"{source} has no version {version}")
            rows = [r for r in rows if r.version <= version]
        loads = [i for i, r in enumerate(rows) if r.kind == "load"]
        return rows[loads[-1]:] if loads else []

    def load(self, source: str, rows: DataFrame, entity: str = "asset", ts: str = "ts", lag_days: int = 0,
             check: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Register ``rows`` as all of a source and return the new version."""
        return self._register("load", source, rows, entity, ts, lag_days, check)

    def append(self, source: str, rows: DataFrame, check: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Add ``rows`` to a source; the columns, their types and the lag are those of its load."""
        entries = self._entries(source)
        if not entries:
            raise ValueError(f"{source} was never loaded")
        first = entries[0]
        columns = [f for f in T.StructType.fromDDL(first.ddl) if f.name != "t_avail"]
        if {(f.name, f.dataType) for f in columns} != {(f.name, f.dataType) for f in T.StructType.fromDDL(rows.schema.toDDL())}:
            raise ValueError(f"columns of {source} differ from those of its load")
        return self._register("append", source, rows.select(*[f.name for f in columns]), first.entity, first.ts, first.lag_days, check)

    def _register(self, kind, source, rows, entity, ts, lag_days, check) -> int:
        version = (self.manifest().where(F.col("source") == source).agg(F.max("version")).first()[0] or 0) + 1
        folder = f"{self.path}/data/{source}/{version}-{uuid.uuid4().hex}"
        if dict(rows.dtypes)[entity] == "string":
            rows = rows.withColumn(entity, F.upper(F.trim(entity)))
        rows = rows.withColumn("t_avail", F.date_add(ts, lag_days))
        # By entity and year: a busy entity is several files, a file has a narrow range of dates for the reader to skip.
        rows.repartition(F.col(entity), F.year(ts)).sortWithinPartitions(entity, ts).write.parquet(folder)
        written = self.spark.read.schema(rows.schema).parquet(folder)
        extent = written.agg(F.count(F.lit(1)), F.count_distinct(entity), F.min(F.col(ts).cast("date")), F.max(F.col(ts).cast("date"))).first()
        quality = None if check is None else json.dumps(check(written).first().asDict())
        entry = (kind, folder, rows.schema.toDDL(), entity, ts, lag_days, *extent, quality)
        # A second writer of the same version fails here and leaves only files that no entry names.
        self.spark.createDataFrame([entry], ENTRY).coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/source={source}/version={version}")
        return version

    def read(self, source: str, version: int | None = None, keys: list[str] | None = None) -> DataFrame:
        """A source as it was at a version (the latest by default), with ``t_avail``.

        With ``keys`` a row restated by an append stands in place of the earlier one; without, all rows are there."""
        entries = self._entries(source, version)
        if not entries:
            raise ValueError(f"{source} was never loaded")
        schema = T.StructType.fromDDL(entries[0].ddl)
        if keys is None:
            return self.spark.read.schema(schema).parquet(*[e.folder for e in entries])
        parts = [self.spark.read.schema(schema).parquet(e.folder).withColumn("_version", F.lit(e.version)) for e in entries]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        if len(parts) == 1:
            return out.drop("_version")
        w = Window.partitionBy(*keys).orderBy(F.desc("_version"))
        return out.withColumn("_k", F.rank().over(w)).where("_k = 1").drop("_k", "_version")

    def known(self, source: str, as_of, version: int | None = None, keys: list[str] | None = None) -> DataFrame:
        """The rows of a version that were available at a date."""
        return self.read(source, version, keys).where(F.col("t_avail") <= F.lit(as_of).cast("date"))

    def quality(self, source: str | None = None) -> DataFrame:
        """(source, version, check, value) of the checks attached to each version."""
        d = self.manifest().where("quality is not null")
        if source is not None:
            d = d.where(F.col("source") == source)
        return d.select("source", "version", F.explode(F.from_json("quality", "map<string,double>")).alias("check", "value"))


def load_panel(catalog: Catalog, sources: dict[str, tuple[DataFrame, str, str, int, Callable | None]]) -> DataFrame:
    """Register all sources (name -> rows, entity column, date column, lag in days, check) and return their manifest rows."""
    versions = {name: catalog.load(name, *rest) for name, rest in sources.items()}
    wanted = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(v).alias("version")) for n, v in versions.items()])
    return catalog.manifest().where(F.array_contains(wanted, F.struct("source", "version")))
