"""Line dedup over documents, with DataFrame functions only.

Each line's key is hashed; rows (hash, document, place) are range-partitioned by hash and sorted by document and place, so the
first row of a hash is its first occurrence, and a streaming window marks every row of a later document. What comes back is not
text but a bitmap for each document that loses lines: words of 64 lines, equal neighbouring words as one run, words that keep
all of their lines left out. Texts meet the bitmaps in one join, by document.

A key that very many documents share would be one range. Such keys are dealt into cells by document; each cell is sorted and
streamed alone, then the first documents of a key's cells, which are few, are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

BLANK = " \t\n\x0b\x0c\r"
WORD = 64  # lines in a word of a bitmap


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lower_ascii(text: Column) -> Column:
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _name(id_col: str, text_col: str) -> list[Column]:
    """What tells rows of one id and different texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("doc"), F.xxhash64(text).alias("body")]


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, body, place, h1, h2) of every line whose key has at least ``min_chars`` code points; 128 bits name a key."""
    lines = docs.where(F.length(text_col) >= min_chars).select(*_name(id_col, text_col), F.posexplode(lines_of(F.col(text_col))).alias("place", "line"))
    key = F.btrim("line", F.lit(BLANK))
    keyed = lines.where(F.char_length(key) >= min_chars).select("doc", "body", "place", _lower_ascii(key).alias("key"))
    return keyed.select("doc", "body", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def _cells(rows: DataFrame, min_rows: int, cells: int, sample: int) -> DataFrame:
    """(h1, h2, cells) of keys that hold over 1 / cells of a sample of rows: fewer than ``cells`` keys. Results don't depend on the
    sample, which only says what is dealt into cells."""
    total = rows.count()
    share = min(1.0, sample / max(total, 1))
    limit = max(min_rows * share, total * share / cells)
    seen = rows.sample(share, 7) if share < 1 else rows
    many = seen.groupBy("h1", "h2").count().where(F.col("count") > limit)
    return many.select("h1", "h2", F.ceil(F.col("count") / limit).alias("cells"))


def later_lines(rows: DataFrame, min_rows: int = 10_000, cells: int = 4096, sample: int = 1_000_000) -> DataFrame:
    """(doc, body, place) of the lines of ``rows`` (as of ``line_keys``) whose key an earlier document holds; null ids are last."""
    hot = settle(_cells(rows, min_rows, cells, sample))
    dealt = rows.join(F.broadcast(hot), ["h1", "h2"], "left")  # below `cells` rows
    cell = F.when(F.col("cells").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc", F.lit(1)), F.col("cells")))
    ranged = dealt.withColumn("cell", cell.cast("long")).repartitionByRange("h1", "h2", "cell")
    run = Window.partitionBy("h1", "h2", "cell").orderBy(F.col("doc").asc_nulls_last(), "place").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.struct("doc")).over(run)["doc"]
    streamed = ranged.select("doc", "body", "place", "h1", "h2", F.col("cells").isNotNull().alias("dealt"), first.alias("first"))
    streamed = settle(streamed.withColumn("later", ~F.col("doc").eqNullSafe(F.col("first"))).where("later or dealt"))
    heads = streamed.where("not later")  # of dealt keys: the lines of the first document of each cell
    earliest = heads.groupBy("h1", "h2").agg(F.min("doc").alias("earliest"))  # below `cells` keys
    late_heads = heads.join(F.broadcast(earliest), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("earliest")))
    return streamed.where("later").select("doc", "body", "place").union(late_heads.select("doc", "body", "place"))


def bitmaps(later: DataFrame) -> DataFrame:
    """(doc, body, n_dropped, keep) from (doc, body, place); ``keep`` has runs (word, words, bits) of equal words.

    Bit k of word w is line 64 w + k, set if it stays; lines in words that no run covers stay."""
    word, bit = F.floor(F.col("place") / WORD).cast("int"), F.expr(f"shiftleft(1L, place % {WORD})")
    words = later.groupBy("doc", "body", word.alias("word")).agg(F.bit_or(bit).alias("gone"))
    packed = words.groupBy("doc", "body").agg(
        F.sum(F.bit_count("gone").cast("long")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("w"))
    w = F.col("w")
    begins = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.when(i == 0, True).otherwise(
        (w[i]["word"] != w[i - 1]["word"] + 1) | (w[i]["bits"] != w[i - 1]["bits"])))
    packed = packed.withColumn("begins", begins)
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size(w)))
    runs = F.zip_with("begins", ends, lambda i, j: F.struct(w[i]["word"].alias("word"), (j - i).alias("words"), w[i]["bits"].alias("bits")))
    return packed.select("doc", "body", "n_dropped", runs.alias("keep"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_rows: int = 10_000,
                 cells: int = 4096) -> DataFrame:
    """(doc, body, n_dropped, keep) of each document that loses lines; ``doc`` is its id, ``body`` a hash of its text.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code points that several
    documents hold stay only in the one with the smallest id, there with all their repeats. Rows with one id are one document: none
    loses a line to another. A null id comes after all others; rows with null ids are one document. A null text is one
    empty line. An empty table gives no rows. Other columns are not read."""
    rows = settle(line_keys(docs, id_col, text_col, min_chars))  # narrow; read for counts, range bounds and sort
    return bitmaps(later_lines(rows, min_rows, cells))


def apply_bitmaps(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "kept") -> DataFrame:
    """``docs`` with a column ``out``: struct (n_lines, n_dropped, text), the text without the lines that ``maps`` takes away.

    All rows and columns of ``docs`` stay; one called ``out`` is replaced."""
    own = [c for c in docs.columns if c != out]
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), *_name(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = left.alias("l").join(maps.alias("m"), F.col("l.doc").eqNullSafe(F.col("m.doc")) & (F.col("l.body") == F.col("m.body")), "left")
    runs = F.col("m.keep")
    gap = lambda r, k: r["word"] - F.when(k == 0, 0).otherwise(runs[k - 1]["word"] + runs[k - 1]["words"])
    words = F.flatten(F.transform(runs, lambda r, k: F.concat(
        F.array_repeat(F.lit(-1).cast("long"), gap(r, k)), F.array_repeat(r["bits"], r["words"]))))
    stays = F.flatten(F.transform(words, lambda bits: F.transform(
        F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit(bits, k) == 1)))
    staying = F.zip_with(F.split("l.text", "\n", -1), stays, lambda line, stay: F.when(F.coalesce(stay, F.lit(True)), line))
    kept = F.when(runs.isNull(), F.col("l.text")).otherwise(F.array_join(staying, "\n"))
    lines = F.octet_length("l.text") - F.octet_length(F.replace(F.col("l.text"), F.lit("\n"), F.lit(""))) + 1
    return both.select("row.*", F.struct(
        lines.cast("long").alias("n_lines"), F.coalesce("m.n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("text")).alias(out))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, out: str = "kept") -> DataFrame:
    """``docs`` with the lines that stay; rules as in ``keep_bitmaps``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col, out)
