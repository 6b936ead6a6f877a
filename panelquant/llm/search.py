"""Ranked lexical search with pipelined term partitions.

The terms of all items are dealt to a few owner stages, rare terms first. Items travel in bundles; a bundle carries, for one block of
documents, the sparse accumulators (item, document, score) it has so far. At each stage a cogroup brings a bundle together with the
postings of the stage's terms in that block; their integer contributions are added, and the bundle goes on to the next stage.

Blocks are sized by the contributions they bring, so no group grows with the corpus. An accumulator is let go only when even the
highest contributions of all later stages can't lift it to the score that ``k`` documents of its item already have; so the final
selection is exact. That score is first the block's own, then, between stages, the highest of all blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_settled, settle

PART = 1 << 20  # bytes of a text that are counted at once
#: letters and digits of ASCII and all bytes of longer characters; A-Z lower-cased, all else a space
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def count_terms(text: str) -> tuple[int, Counter]:
    """(number of terms with repeats, occurrences of each) of a whole text, part by part."""
    raw, counts, begin, n = text.encode().translate(_TERM), Counter(), 0, 0
    while begin < len(raw):
        end = raw.find(b" ", begin + PART) if begin + PART < len(raw) else -1
        end = len(raw) if end < 0 else end
        terms = raw[begin:end].split()
        counts.update(terms)
        n, begin = n + len(terms), end
    return n, counts


def term_counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, term, tf) for each distinct term of each row; ``row`` numbers the rows. Each batch adds a row without ``row`` that
    holds the texts with a term (tf) and their terms (n)."""
    own = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", rows.schema[id_col].dataType)])
    schema = schema.add("n", T.LongType()).add("term", T.StringType()).add("tf", T.LongType())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n_of, terms, tf, some, every = [], [], [], [], 0, 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                n, counts = count_terms(text or "")
                some, every = some + (n > 0), every + n
                at += [i] * len(counts)
                n_of += [n] * len(counts)
                terms += counts.keys()
                tf += counts.values()
                if len(at) > 500_000:
                    yield _rows(batch, at, n_of, terms, tf)
                    at, n_of, terms, tf = [], [], [], []
            yield _rows(batch, [*at, None], [*n_of, every], [*terms, None], [*tf, some])

    def _rows(batch, at, n_of, terms, tf):
        at = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(n_of, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())],
            schema.names)

    return own.mapInArrow(counted, schema)


def gain(n: Column, tf: Column, n_docs: int, n_terms: int) -> Column:
    """What an occurrence count adds to a score, before the term's weight, in whole numbers; decimals only where 64 bits may overflow."""
    m = F.expr(f"CAST((CAST(50 * n AS DECIMAL(19, 0)) * CAST({n_docs} AS DECIMAL(19, 0))) div CAST({n_terms} AS DECIMAL(19, 0)) AS BIGINT)") + 50
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, 1000 * tf + 20 * m)


def owners(frequencies: DataFrame, stages: int) -> list[int]:
    """Stage of a term by the bits of its document frequency: rare terms first, near equal postings in each stage."""
    bits = F.length(F.bin(F.col("df")))
    volume = dict(frequencies.groupBy(bits.alias("bits")).agg(F.sum("df")).collect())  # at most 64 rows
    total, before, out = max(sum(volume.values()), 1), 0, []
    for b in range(65):
        out.append(min(stages - 1, before * stages // total))
        before += volume.get(b, 0)
    return out


def _add(left: pa.Table, right: pa.Table, stage: int, k: int, schema: pa.Schema) -> pa.Table:
    """One stage of one bundle in one block: adds the stage's contributions and lets hopeless accumulators go."""
    state = {name: left.column(name).combine_chunks() for name in left.column_names}
    query = state["query"].flatten()
    number = lambda a: np.asarray(a.to_numpy(zero_copy_only=False)).astype(np.int64)
    q_item, q_term, q_weight, q_top, q_stage = (number(query.field(f)) for f in ("item", "tid", "w", "top", "stage"))
    items, q_at = np.unique(q_item, return_inverse=True)
    still = np.bincount(q_at[q_stage > stage], q_top[q_stage > stage].astype(float), len(items))  # the later stages' highest sum
    floor = number(state["floor"].flatten()) if len(state["floor"].flatten()) else np.zeros(len(items), np.int64)

    old_rows, new_rows = number(state["rows"].flatten()), number(right.column("row"))
    rows, first, place = np.unique(np.concatenate([old_rows, new_rows]), return_index=True, return_inverse=True)
    ids = pa.concat_arrays([state["ids"].flatten(), right.column("id").combine_chunks()]).take(pa.array(first))

    mine = np.flatnonzero(q_stage == stage)
    mine = mine[np.argsort(q_term[mine], kind="stable")]
    term = number(right.column("tid"))
    low, high = np.searchsorted(q_term[mine], term), np.searchsorted(q_term[mine], term, "right")
    times = high - low
    asks = mine[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
    added = q_weight[asks] * np.repeat(number(right.column("gain")), times)
    key = np.concatenate([
        number(state["item"].flatten()) * len(rows) + place[:len(old_rows)][number(state["doc"].flatten())],
        q_at[asks] * len(rows) + np.repeat(place[len(old_rows):], times)])
    score = np.concatenate([number(state["score"].flatten()), added])
    order = np.argsort(key, kind="stable")
    key, score = key[order], score[order]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    key, score = key[begin], np.add.reduceat(score, begin) if len(begin) else score
    item = key // max(len(rows), 1)

    to = np.searchsorted(item, np.arange(len(items) + 1))
    for i in range(len(items)):
        mine_of = score[to[i]:to[i + 1]]
        if len(mine_of) >= k:
            floor[i] = max(floor[i], np.partition(mine_of, len(mine_of) - k)[len(mine_of) - k])
    stays = (score + still[item] >= floor[item]) & (score > 0)  # sums stay below 2^53, where floats are exact
    key, score, item = key[stays], score[stays], item[stays]
    used, doc = np.unique(key - item * len(rows), return_inverse=True)
    lists = {"query": query, "rows": pa.array(rows[used]), "ids": ids.take(pa.array(used)), "item": pa.array(item, pa.int32()),
             "doc": pa.array(doc, pa.int32()), "score": pa.array(score), "floor": pa.array(floor)}
    return pa.Table.from_arrays([
        pa.ListArray.from_arrays(pa.array([0, len(lists[f.name])], pa.int32()), lists[f.name]).cast(f.type) if f.name in lists else state[f.name]
        for f in schema], schema=schema)


def search(docs: DataFrame, items: DataFrame, k: int = 50, stages: int = 4, block: int = 2_000_000, bundle: int = 256, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item with a score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))); all else is whole numbers. Equal scores are in order of doc_id, null ids last. Every row of ``docs`` is
    a document and every row of ``items`` an item of its own, repeated ids too. Null and empty texts have no terms. Empty tables
    give no rows. Other columns are not read. ``block`` is the number of contributions that one task adds at a time,
    ``bundle`` the items that travel together; neither changes the result."""
    spark = docs.sparkSession
    wanted = settle(term_counts(items, item_col, item_text).where("row IS NOT NULL").select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term"))
    vocabulary = settle(wanted.groupBy("term").agg(F.count(F.lit(1)).alias("asked")).withColumn("tid", F.monotonically_increasing_id()))
    posted = settle(term_counts(docs, id_col, text_col).join(vocabulary.select("term", "tid"), "term", "left")
                    .where("tid IS NOT NULL OR row IS NULL").select("row", "id", "n", "tid", "tf"))  # a side is broadcast by its measured size
    n_docs, n_terms = posted.where("row IS NULL").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    postings = posted.where("row IS NOT NULL").select("row", "id", "tid", gain(F.col("n"), F.col("tf"), n_docs, max(n_terms, 1)).alias("gain"))

    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    terms = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("df"), F.max("gain").alias("most")).withColumn("w", weight)
    terms = settle(terms.join(vocabulary, "tid"))
    stage_of = F.array(*[F.lit(s) for s in owners(terms, stages)])
    terms = terms.select("term", "tid", "df", "asked", "w", (F.col("w") * F.col("most")).alias("top"), F.get(stage_of, F.length(F.bin("df"))).alias("stage"))

    n_items, work = wanted.agg(F.count_distinct("item")).first()[0], terms.agg(F.coalesce(F.sum(F.col("df") * F.col("asked")), F.lit(0))).first()[0]
    n_bundles = max(1, -(-n_items // bundle))
    n_blocks = max(1, -(-work // (n_bundles * block)))
    bundle_of = F.pmod(F.xxhash64("item"), F.lit(n_bundles)).alias("bundle")
    asks = settle(wanted.join(terms.drop("df", "asked"), "term").select(bundle_of, "item", "tid", "w", "top", "stage"))
    queries = asks.groupBy("bundle").agg(F.collect_list(F.struct("item", "tid", "w", "top", "stage")).alias("query"))
    id_type = docs.schema[id_col].dataType
    nothing = lambda kind: F.array().cast(T.ArrayType(kind))
    state = queries.select(
        "bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "query", nothing(T.LongType()).alias("rows"),
        nothing(id_type).alias("ids"), nothing(T.IntegerType()).alias("item"), nothing(T.IntegerType()).alias("doc"),
        nothing(T.LongType()).alias("score"), nothing(T.LongType()).alias("floor"))
    owned = asks.select("bundle", "tid", "stage").distinct()
    block_of = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("to_block")
    for stage in range(stages):
        here = postings.join(owned.where(F.col("stage") == stage), "tid").select(F.col("bundle").alias("to_bundle"), block_of, "row", "id", "tid", "gain")
        done = settle(_stage(state, here, stage, k))
        if stage:
            drop_settled(before)
        before, state = done, _with_floors(done)
    ranked = _flat(state, id_type)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    top = ranked.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(wanted.select("item", "item_id").distinct(), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _stage(state: DataFrame, postings: DataFrame, stage: int, k: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType.elementType) if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in state.schema])
    kinds = to_arrow_schema(out)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        return _add(left, right, stage, k, kinds)

    return state.groupBy("bundle", "block").cogroup(postings.groupBy("to_bundle", "to_block")).applyInArrow(add, out)


def _flat(state: DataFrame, id_type: T.DataType) -> DataFrame:
    """(item, doc_id, score) of the accumulators that reach their item's floor."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, ids, item, doc, score, floor = (batch.column(c)[i].values for c in range(6))
                item, score = item.to_numpy(), score.to_numpy()
                keep = np.flatnonzero(score >= floor.to_numpy()[item])
                items = np.unique(asked.to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items[item[keep]]), ids.take(doc.take(pa.array(keep))), pa.array(score[keep])], ["item", "doc_id", "score"])

    return state.select("query.item", "ids", F.col("item").alias("at"), "doc", "score", "floor").mapInArrow(rows, schema)


def _with_floors(state: DataFrame) -> DataFrame:
    """Every block gets the highest floors of all blocks of its bundle."""
    best = state.select("bundle", F.posexplode("floor").alias("at", "floor")).groupBy("bundle", "at").agg(F.max("floor").alias("floor"))
    floors = best.groupBy("bundle").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "floor"))), lambda x: x["floor"]).alias("floor"))
    return state.drop("floor").join(floors, "bundle").select(*state.columns)
