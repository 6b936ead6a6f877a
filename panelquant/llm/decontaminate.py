"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items. A block is a pair of words. Over all patterns of one length m the
shift table gives, for a block, how far the window can move before any pattern could end there; blocks that no pattern
holds move it by m - 1. Where the shift is zero, the bucket of that block (the pattern's suffix) names the candidates, and
the words are compared one by one.

Documents are never shuffled: one pass per pattern set. Items are cut into sets by a hash of their text so that every set
that is sent to the executors stays below ``block_bytes`` of benchmark text; with more than one set the marks of a document
travel with it from pass to pass.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, settle

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
PIECE = 1 << 22  # bytes of a document that are split into words at a time
MARKS = "struct<n_words: bigint, hits: array<struct<start: bigint, end: bigint>>, items: array<string>>"
_MARKS = pa.struct([
    ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())),
])


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


def pattern_tables(items: list[tuple[str, bytes]], size: int) -> list[tuple]:
    """(m, shift, far, buckets) for every pattern length m; a bucket maps a suffix block to [(pattern, item ids)]."""
    owners: dict[tuple, set[str]] = defaultdict(set)
    for item, text in items:
        for w in windows(words_of(text), size):
            owners[w].add(item)
    tables = []
    for m in sorted({len(w) for w in owners}):
        width = min(2, m)
        shift: dict[tuple, int] = {}
        buckets: dict[tuple, list] = defaultdict(list)
        for w, ids in owners.items():
            if len(w) == m:
                for end in range(width, m + 1):
                    block = w[end - width:end]
                    shift[block] = min(shift.get(block, m), m - end)
                buckets[w[m - width:]].append((w, sorted(ids)))
        tables.append((m, width, shift, m - width + 1, dict(buckets)))
    return tables


def search(words: list[bytes], tables: list[tuple]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words that lie in an occurrence (merged, by start), and the items that occur."""
    found, items, n = [], set(), len(words)
    for m, width, shift, far, buckets in tables:
        i, get = m - 1, shift.get
        while i < n:
            block = (words[i - 1], words[i]) if width == 2 else (words[i],)
            step = get(block, far)
            if step:
                i += step
                continue
            start = i - m + 1
            here = tuple(words[start:i + 1])
            for pattern, ids in buckets[block]:
                if pattern == here:
                    found.append((start, i + 1))
                    items.update(ids)
            i += 1
    return merge(found), items


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_text(text: bytes, tables: list[tuple], size: int) -> tuple[int, list[tuple[int, int]], set[str]]:
    """As ``search``, on a text of any length: long texts go piece by piece, each with the last words of the one before."""
    if len(text) <= PIECE:
        words = words_of(text)
        return (len(words), *search(words, tables))
    tail, done, at, spans, items = [], 0, 0, [], set()
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and WORD.match(text[end:end + 1].lower()):
            end += 1
        words = tail + words_of(text[at:end])
        base = done - len(tail)
        got, ids = search(words, tables)
        spans += [(a + base, b + base) for a, b in got]
        items |= ids
        done, at = base + len(words), end
        tail = words[-(size - 1):] if size > 1 else []
    return done, merge(spans), items


def _marker(broadcast, size: int):
    """Text and earlier marks -> marks."""
    key = uuid.uuid4().hex  # a worker's address of the broadcast can be that of an earlier one

    def mark(text: pa.Array, before: pa.Array) -> pa.Array:
        tables, out = held("decontaminate", key, lambda: pattern_tables(broadcast.value, size)), []
        for value, old in zip(text, before, strict=True):
            value, old = value.as_buffer(), old.as_py() or {"hits": [], "items": []}
            n, spans, items = search_text(value.to_pybytes() if value else b"", tables, size)
            spans = merge([*spans, *((x["start"], x["end"]) for x in old["hits"])])
            out.append({"n_words": n, "hits": [{"start": a, "end": b} for a, b in spans], "items": sorted(items | set(old["items"]))})
        return pa.array(out, _MARKS)

    return F.arrow_udf(mark, MARKS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = 10, out: str = "contamination", block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with a column ``out``: n_words, hits (merged word spans inside an occurring window), items (their ids, sorted).

    Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z in lower case. A window is ``window``
    consecutive words of an item; a shorter item is one window, one without words (or null) none. A null text has no words.
    A null item id is called 'null'; items that repeat an id count once. An empty benchmark marks nothing. A column of
    ``docs`` that is called ``out`` is replaced; all others pass through. Repeated rows are marked each on their own.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("item_text"),
    ).where("item_text is not null")
    total = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    sets = 1 + total // block_bytes
    marked = docs.withColumn(out, F.lit(None).cast(MARKS))
    for k in range(sets):
        part = items.where(F.pmod(F.xxhash64("item_text"), F.lit(sets)) == k).collect()  # below block_bytes on average
        known = spark.sparkContext.broadcast([(r["item"], r["item_text"].encode()) for r in part])
        marked = marked.withColumn(out, _marker(known, window)(F.col(text_col), F.col(out)))
        if k + 1 < sets:
            marked = settle(marked)
    return marked
