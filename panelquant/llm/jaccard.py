"""Near-duplicate classes by an exact Jaccard join on word n-grams with adaptive multi-match prefixes.

A document with n n-grams can only be similar to one with which it shares at least o = ceil(t n) of them. In any common order of
the n-grams, both documents then have the l smallest shared ones among their first n - o + l: the l-prefix. So a pair is a
candidate only if its prefixes share min(l, l') n-grams, and each document may choose its own l.

1. Documents with equal n-gram sets are one node.
2. Screening: prefixes in hash order, l by length; a node whose prefix doesn't share l n-grams with other nodes is alone.
3. For the nodes that are left, exact document frequencies. N-grams that no other node has can't be shared, so a node with
   fewer than o shared ones is alone. The rest are ordered by rising frequency; each node picks the l for which the estimated
   cost, postings read plus candidates to verify (at most postings / l), is least.
4. A posting list isn't expanded into all its pairs. First every node is verified against the best one of its lists' pivots, and
   the links found are merged into components. Then only pairs from different components are formed, where sizes, numbers
   of shared n-grams and places in the prefixes still allow a link with min(l, l') matches or more, and are verified in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, free_shuffles, let_go, number_lists, settle
from .components import components

PIECE = 1 << 22  # bytes that are hashed at a time
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text of any length; A-Z count as a-z."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        raw = _LOWER[np.frombuffer(text, np.uint8, end - at, at)]
        word = np.zeros(len(raw) + 2, np.int8)
        word[1:-1] = ~_SPACE[raw]
        edge = np.diff(word)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power_tables(len(raw))
        sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(_VALUE[raw] * up, out=sums[1:])
        out.append(_mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, _U)


def ngrams(text: bytes, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; fewer words are one n-gram, no word is none."""
    words = word_hashes(text)
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        width = min(size, len(words))
        total = np.full(len(words) - width + 1, width, _U)
        for k in range(width):
            total = _mix(total * _U(0x100000001B3) + words[k:len(words) - width + 1 + k])
    return np.unique(total)


def least_overlap(n: int, percent: int) -> int:
    """The smallest number of shared n-grams with which a set of n can be similar to any other."""
    return -(-n * percent // 100)


GRAMS_A_TASK = 1 << 19  # n-grams of prefixes that a task counts, about 120 bytes each
_SIGNATURE = "struct<n: bigint, node: bigint, l: int, prefix: array<int>>"


def _signature(percent: int, size: int):
    def sign(values: pa.Array) -> pa.Array:
        let_go("jaccard")
        sizes, nodes, needs, prefixes = [], [], [], []
        for v in values:
            grams = ngrams(v.as_buffer().to_pybytes(), size) if v.is_valid else ()
            n = len(grams)
            sizes.append(n)
            if not n:
                nodes.append(None)
                needs.append(0)
                prefixes.append(np.zeros(0, np.int32))
                continue
            node = int(_mix(np.array([int(np.bitwise_xor.reduce(_mix(grams + _U(1)))) ^ (int(grams.sum()) * 31 + n) & (1 << 64) - 1], _U))[0].astype(np.int64))
            o = least_overlap(n, percent)
            matches = min(o, 1 + (n - o) * 5 // 8)
            low = np.partition(_mix(grams), min(n - 1, n - o + matches - 1))[:n - o + matches]
            nodes.append(node)
            needs.append(matches)
            prefixes.append((low & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
        columns = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(needs, pa.int32()), number_lists(prefixes, np.int32)]
        return pa.StructArray.from_arrays(columns, ["n", "node", "l", "prefix"])

    return F.arrow_udf(sign, _SIGNATURE)


def _ngram_lists(size: int):
    def lists(values: pa.Array) -> pa.Array:
        let_go("jaccard")
        return number_lists([ngrams(v.as_buffer().to_pybytes(), size).view(np.int64) for v in values], np.int64)

    return F.arrow_udf(lists, "array<bigint>")


VERIFY_COST = 16  # cost of verifying a candidate, in postings read
MOST_MATCHES = 8  # the largest l that is tried


def _chooser(percent: int):
    """Frequencies (rising) and n-grams of a node that others share -> l and the shared part of its l-prefix."""
    def choose(n: pa.Array, shared: pa.Array) -> pa.Array:
        out = []
        for total, row in zip(n.to_pylist(), shared, strict=True):
            df = row.values.field("df").to_numpy(zero_copy_only=False)
            gram = row.values.field("gram").to_numpy(zero_copy_only=False)
            o, s = least_overlap(total, percent), len(df)
            reads = np.cumsum(df - 1)
            best, chosen, width = None, 1, 0
            for matches in range(1, min(o, MOST_MATCHES) + 1):
                length = s - o + matches  # the prefix without the n-grams that nobody shares
                cost = length + reads[length - 1] * (1 + VERIFY_COST / matches)
                if best is None or cost < best:
                    best, chosen, width = cost, matches, length
            out.append({"l": chosen, "prefix": gram[:width].tolist()})
        return pa.array(out, pa.struct([("l", pa.int32()), ("prefix", pa.list_(pa.int64()))]))

    return F.arrow_udf(choose, "struct<l: int, prefix: array<bigint>>")


def _similar(inter: str, n: str, m: str, percent: int):
    return F.expr(f"100 * {inter} >= {percent} * ({n} + {m} - {inter})")


def _verified(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: those with min(l, l') matches in the prefixes, then in full."""
    side = lambda x: candidates.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in ("node", "n", "l", "prefix", "grams")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.least("l_a", "l_b"))
    inter = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("inter"))
    return inter.where(_similar("inter", "n_a", "n_b", percent)).select("a", "b")


FILTER_BITS = 24  # a filter of 2^24 bits, two megabytes whatever the input


def _bit_places(row_id):
    return [F.pmod(F.xxhash64(row_id, F.lit(k)), F.lit(1 << FILTER_BITS)) for k in range(2)]


def _may_hold(kept: DataFrame):
    """A Bloom filter on the row ids of ``kept``: what fails it is not among them. It spares the shuffle of texts that the join
    after it would drop; with very many ids it lets more pass, never less."""
    places = kept.select(F.explode(F.array(*_bit_places(F.col("row_id")))).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found = words.toPandas()
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    shared = kept.sparkSession.sparkContext.broadcast(table)

    def hold(one: pa.Array, two: pa.Array) -> pa.Array:
        ok = np.ones(len(one), bool)
        for places in (one, two):
            at = places.to_numpy()
            ok &= (shared.value[at >> 6] >> (at & 63)) & 1 == 1
        return pa.array(ok)

    test = F.arrow_udf(hold, "boolean")
    return lambda row_id: test(*_bit_places(row_id))


def _repeated(nodes: DataFrame) -> DataFrame:
    """(gram) that several prefixes hold, written.

    Nearly all n-grams are in one prefix only, so counting before the shuffle takes a table entry for each n-gram that a task
    sees: tasks are dealt out by the n-grams, not by the size of the files. Counts and n-grams aren't on disk at the same time."""
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    dealt = nodes.select("node", "prefix").repartition(1 + total // GRAMS_A_TASK, "node").select(F.explode("prefix").alias("gram"))
    return settle(dealt.groupBy("gram").count().where("count > 1").select("gram"))


def _candidate_nodes(docs: DataFrame, nodes: DataFrame, percent: int, size: int) -> DataFrame:
    """(node, n, grams, s, l, prefix) of nodes that may have a similar one.

    ``nodes`` has (node, n, l, prefix, low_id, row_id); the last two name the row of ``docs`` (doc_id, row_id, text) that stands
    for the node, so the text of a hot group of copies is read once."""
    index = nodes.select("node", F.explode("prefix").alias("gram"))
    often = _repeated(nodes)
    free_shuffles(docs.sparkSession)
    hits = index.join(often, "gram").groupBy("node").count()
    named = nodes.select("node", "n", "l", "row_id", F.coalesce("low_id", F.lit(0)).alias("low_id"), F.col("low_id").isNull().alias("no_id"))
    kept = settle(named.join(hits, "node").where("count >= l").drop("count", "l"))
    free_shuffles(docs.sparkSession)  # all prefixes, which would lie beside the n-grams of the next step
    rows = docs.where(_may_hold(kept)(F.col("row_id")))
    rows = rows.select("row_id", F.coalesce("doc_id", F.lit(0)).alias("low_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    texts = rows.join(kept, ["row_id", "low_id", "no_id"]).dropDuplicates(["row_id", "low_id", "no_id"])
    grams = texts.select("node", "n", F.explode(_ngram_lists(size)(F.col("text"))).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = grams.join(shared, "gram").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("held"))
    held = held.where(F.expr(f"100 * size(held) >= {percent} * n"))  # a node's own n-grams, never a group of nodes
    chosen = held.withColumn("p", _chooser(percent)(F.col("n"), F.col("held")))
    out = settle(chosen.select("node", "n", F.col("held.gram").alias("grams"), F.size("held").cast("long").alias("s"), F.col("p.l").alias("l"), F.col("p.prefix").alias("prefix")))
    drop_settled(kept)
    drop_settled(often)
    return out


_NODE = ("node", "n", "s", "l", "width", "at")


def similar_links(candidates: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that connect exactly the nodes that similar pairs connect, and the written frames that they are read from."""
    spark = candidates.sparkSession
    index = candidates.select("node", "n", "s", "l", F.size("prefix").alias("width"), F.posexplode("prefix").alias("at", "gram"))

    # the pivot of a list is the node with the smallest share of n-grams of its own
    own = (F.lit(1) - F.col("s") / F.col("n")).alias("own")
    pivots = index.groupBy("gram").agg(F.min(F.struct(own, *_NODE)).alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pivots = pivots.select("gram", *[F.col(f"p.{c}").alias(f"{c}_b") for c in _NODE])
    at_pivot = index.select("gram", *[F.col(c).alias(f"{c}_a") for c in _NODE]).join(pivots, "gram").where((F.col("node_a") != F.col("node_b")) & _may_reach(percent))
    best = at_pivot.groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("hits"))
    best = best.groupBy("node_a").agg(F.max(F.struct("hits", "node_b")).alias("best")).select(F.col("node_a").alias("a"), F.col("best.node_b").alias("b"))
    stars = settle(_verified(best, candidates, percent))
    del pivots, at_pivot, best
    free_shuffles(spark)

    labels = components(stars)
    labelled = settle(index.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    parts = labelled.groupBy("gram", "label").count().groupBy("gram")
    mixed = parts.agg(F.max(F.struct("count", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("gram", F.col("top.label").alias("main"))
    rows = labelled.join(mixed, "gram")
    left = rows.where("label <> main").select("gram", *[F.col(c).alias(f"{c}_a") for c in (*_NODE, "label")])
    right = rows.select("gram", "main", *[F.col(c).alias(f"{c}_b") for c in (*_NODE, "label")])
    met = (left["gram"] == right["gram"]) & (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("main")) | (F.col("node_a") < F.col("node_b")))
    crossing = left.join(right, met & _may_reach(percent) & _first_shared(percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    return stars.union(_verified(crossing, candidates, percent)), [stars, labelled]


def _reaches(in_prefixes: str, percent: int):
    """Whether two nodes a and b that share so many n-grams inside their prefixes can be similar.

    Beyond the prefix that ends first in the common order, no more can be shared than that node has left there; n-grams that
    no other node has are never shared."""
    most = f"least(s_a, s_b, {in_prefixes} + greatest(s_a - width_a, s_b - width_b))"
    return F.expr(f"100 * {most} >= {percent} * (n_a + n_b - {most})")


def _may_reach(percent: int):
    """The same for one shared n-gram at places ``at`` of the prefixes: at most the smaller number before it and after it is shared."""
    return _reaches("(least(at_a, at_b) + 1 + least(width_a - at_a, width_b - at_b) - 1)", percent)


def _first_shared(percent: int):
    """Whether the n-gram can be the first one that a and b share: as many as a link needs in the prefixes must still follow.

    A similar pair is met at its first shared n-gram, so the others, which only repeat it, aren't formed."""
    shared = f"((n_a + n_b) * {percent} + {99 + percent}) div {100 + percent}"
    need = f"greatest({shared} - greatest(s_a - width_a, s_b - width_b), least(l_a, l_b))"
    return F.expr(f"at_a <= width_a - {need} and at_b <= width_b - {need}")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept (one text of each class is), row_id (hash of the text).

    Two documents link when 100 * shared >= ``percent`` * union of their sets of ``size``-word n-grams (words are runs of
    non-blanks, A-Z in lower case; fewer words are one n-gram). component_id is the smallest id reachable by links. A null text
    or one without words has no n-grams and is linked with nothing: its component_id is its own id. Null ids are never the
    smallest; a class with null ids only has a null component_id. Repeated rows and ids that repeat with other texts are fine:
    classes are formed on sets, not ids. An empty table gives no rows. Other columns of ``docs`` are not read."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row_id", F.xxhash64("text"))
    signed = settle(base.select("doc_id", "row_id", _signature(percent, size)(F.col("text")).alias("g")).select("doc_id", "row_id", "g.*"))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("low")
    nodes = signed.where("n > 0").groupBy("node", "n").agg(low, F.first(F.struct("l", "prefix")).alias("f"))  # f is equal in all rows of a set
    nodes = settle(nodes.select("node", "n", "f.l", "f.prefix", F.col("low.doc_id").alias("low_id"), "low.row_id"))
    free_shuffles(docs.sparkSession)
    candidates = _candidate_nodes(base, nodes, percent, size)
    free_shuffles(docs.sparkSession)
    links, read = similar_links(candidates, percent)
    labels = components(links)
    del links
    for used in (candidates, *read):
        drop_settled(used)
    row = F.struct(F.col("low_id").isNull().alias("no_id"), F.col("low_id").alias("component_id"), F.col("row_id").alias("kept_row"))
    labelled = settle(nodes.select("node", row.alias("row")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    drop_settled(nodes)
    free_shuffles(docs.sparkSession)
    lowest = labelled.groupBy("label").agg(F.min("row").alias("row"))
    of_node = labelled.drop("row").join(lowest, "label").select("node", "row.component_id", "row.kept_row")
    some = F.col("n") > 0
    kept = ~some | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_id") == F.col("kept_row")))
    return signed.join(of_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), kept.alias("kept"), "row_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of every class the text of its smallest id.

    Rows that repeat both the id and the text stay or go together. The rest is as in ``near_classes``."""
    gone = near_classes(docs, id_col, text_col, size, percent).where("not kept").select(F.col("doc_id").alias("_id"), F.col("row_id").alias("_row"))
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row"))
    return packed.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left_anti").select("doc.*")
