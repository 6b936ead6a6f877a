"""Corpus pipeline over ``documents``: every stage is written as Parquet and read again by the next one.

Each stage works on all rows that its predecessor kept and returns the columns of ``documents``; the last one returns the piece
ids. Learned and iterative stages have no SQL form, so the whole is tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelquant.llm import decontaminate, exact, jaccard, langid, pieces
from panelquant.llm.common import bound_batches, drop_settled, settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language: drops null texts, texts without a letter and those whose language isn't told from chance."""
    bound_batches(spark)
    model = langid.train(docs)
    known = langid.certain(model, F.col("_language"))
    return langid.identify(docs, model, out="_language").where(known).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of equal texts."""
    return exact.drop_copies(docs, keep="min")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of texts that share 0.8 of their five-word shingles."""
    bound_batches(spark)
    return jaccard.drop_near_copies(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    bound_batches(spark)
    marked = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="_hits")
    return marked.where(F.size("_hits.hits") == 0).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text with merge-dropout, and whether they decode to the text."""
    bound_batches(spark)
    coded = pieces.round_trip(docs.select("doc_id", "text"), pieces.installed_model())
    return coded.select(
        "doc_id", F.col("coded.ids").alias("ids"), F.size("coded.ids").cast("long").alias("n_pieces"),
        F.coalesce("coded.text", F.lit("")).eqNullSafe(F.coalesce("text", F.lit(""))).alias("lossless"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = settled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, settled = settled, settle(stage(spark, settled, sf_dir))
        if before is not docs:
            drop_settled(before)  # all that its successor needs is written
    return settled
