"""Small tables with the cases that every operator must stand."""

from pyspark.sql import DataFrame

LONG = "long words of a very long text and on it goes " * 30_000


def documents(spark, texts, extra: str = "") -> DataFrame:
    """(doc_id, text, lang, source, n_chars) of texts, or of (id, text) pairs; ``extra`` names a text column that may clash."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (f", {extra} string" if extra else "")
    return spark.createDataFrame([(i, t, "en", None, None) + (("kept as it is",) if extra else ()) for i, t in rows], schema)


def collected(df: DataFrame, *by: str) -> list[dict]:
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: tuple((r[k] is not None, r[k]) for k in by))
