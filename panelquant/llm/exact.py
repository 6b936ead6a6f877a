"""Exact dedup by content sort, with DataFrame functions only.

Rows are range-partitioned on sampled splitters over the leading characters of the text (then its hash, so that texts with a
common beginning can be cut apart), every partition is sorted externally by the whole text, and neighbours are compared in
full: a window over the sorted rows starts a new group where the text changes. Splitters are short, so the sample that
reaches the driver does not grow with the texts.

A group of copies that holds very many rows would be one range. Such groups are found beforehand from the counts of text
hashes (at most ``cells`` of them by construction) and dealt into numbered cells; each cell is reduced by the sort, and the
cells of a group are then joined by its SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, sha256_hex

PREFIX = 24  # characters of the text in a splitter


def hot_hashes(hashes: DataFrame, min_rows: int, cells: int) -> list[tuple[int, int]]:
    """(text hash, number of cells) of groups with over max(min_rows, rows / cells) rows: fewer than ``cells`` of them."""
    total = hashes.count()
    limit = max(min_rows, total // cells)
    many = hashes.groupBy("h").count().where(F.col("count") > limit)
    return [(r["h"], -(-r["count"] // limit)) for r in many.collect()]


def _sorted(docs: DataFrame, id_col: str, text_col: str, keep: str, min_rows: int, cells: int, columns: list[Column]) -> DataFrame:
    """One column per row of ``docs``: row (struct of ``columns``), then cell, cells, sha, and from the sort: place in the run of
    equal texts, the run's best id and its length n."""
    spark = docs.sparkSession
    packed = docs.select(F.struct(*columns).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    packed = packed.withColumn("h", F.xxhash64("body"))
    hot = hot_hashes(packed.select("h"), min_rows, cells)
    table = F.broadcast(spark.createDataFrame(hot, "h long, cells long"))  # below `cells` rows
    salted = packed.join(table, "h", "left").withColumn("cells", F.coalesce("cells", F.lit(1).cast("long")))
    salted = salted.withColumn("cell", F.pmod(F.monotonically_increasing_id(), F.col("cells")))
    salted = salted.withColumn("lead", F.substring("body", 1, PREFIX))

    ranged = salted.repartitionByRange("lead", "h", "cell")
    first = F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last()
    run = Window.partitionBy("lead", "h", "cell", "body").orderBy(first)  # the ranges hold these rows together: a local sort
    return ranged.select(
        "row", "cell", "cells", sha256_hex(F.col("body")).alias("sha"), F.row_number().over(run).alias("place"),
        F.first("id").over(run).alias("best"),
        F.count(F.lit(1)).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
    )


def _choice(keep: str):
    """Order of the heads of a group's cells; the first one stays."""
    best = F.col("best")
    return [best.asc_nulls_last() if keep == "min" else best.desc_nulls_last(), F.col("cell")]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", min_rows: int = 1000,
                 cells: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; nothing else is normalised. ``keep`` is 'min' or 'max': which id of a group stays. A null id
    stays only where the whole group has no other. Of several rows with the id that stays, exactly one is ``kept``. An empty
    table gives no rows. Other columns are not read.
    """
    rows = settle(_sorted(docs, id_col, text_col, keep, min_rows, cells, [F.col(id_col).alias("doc_id")]))  # narrow; read twice
    of_group = Window.partitionBy("sha")
    heads = rows.where("cells > 1 and place = 1").select(
        "sha", F.row_number().over(of_group.orderBy(*_choice(keep))).alias("rank"),
        F.col("best").alias("g_best"), F.col("cell").alias("g_cell"), F.sum("n").over(of_group).alias("g_n"),
    ).where("rank = 1").drop("rank")
    whole = rows.join(F.broadcast(heads), "sha", "left")  # below `cells` rows
    split = F.col("g_n").isNotNull()
    return whole.select(
        F.col("row.doc_id").alias("doc_id"), F.when(split, F.col("g_best")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("g_n", "n").alias("group_size"),
        ((F.col("place") == 1) & (~split | (F.col("cell") == F.col("g_cell")))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", min_rows: int = 1000,
                cells: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rules as in ``exact_groups``."""
    heads = settle(_sorted(docs, id_col, text_col, keep, min_rows, cells, [F.col(c) for c in docs.columns]).where("place = 1"))
    of_group = Window.partitionBy("sha").orderBy(*_choice(keep))
    split = heads.where("cells > 1").withColumn("rank", F.row_number().over(of_group)).where("rank = 1")  # few rows
    return heads.where("cells = 1").select("row.*").union(split.select("row.*"))
