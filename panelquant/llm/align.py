"""Alignment of two tokenizers by galloping intersection of their token ends.

Both token lists of a text end at byte offsets of the same string, so the ends are two increasing lists with the same last entry.
The shorter list drives: each of its ends gallops through the longer one, in doubling steps from where an end before it was found
and then by halving the last step. Ends found in both lists cut the tokens into groups; the ranks of neighbouring ends give, by
their difference, the range of tokens that a token overlaps. No list is walked token by token in Python: all ends of a batch gallop
side by side in numpy.

Corpus counts of linked id pairs are added up per batch, then by Spark. Only pairs that are frequent enough to be few by
construction are broadcast; the rest is joined.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle

META = "▁"
TOGETHER = 1_000_000  # characters that are aligned in one go
SEGMENT = 1_000_000  # longer texts are cut where both tokenizers must cut
STRIDE = 32  # ends between two that gallop from further back
CACHED = 400_000  # words whose ids a Python worker remembers, some 200 bytes each
BLOCK = 50_000  # characters of new words that are encoded as one text
LONGEST = 64  # characters of a word that is remembered
_CUT = re.compile(r" (?=\S)(?<=\S )")  # a single space between other signs: both tokenizers cut before it


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each entry of ``short`` the number of entries of ``long`` below it. Both increase; the last entry is the same.

    Every STRIDE-th entry gallops first, from the place of a STRIDE times coarser one; those between start where it was found."""
    found = np.zeros(len(short), np.int64)
    stride = 1
    while stride * STRIDE < len(short):
        stride *= STRIDE
    known = np.zeros(1, np.int64)  # places of the coarser entries 0, stride * STRIDE, ...: a place before entry 0 is 0
    while stride >= 1:
        at = np.arange(0, len(short), stride)
        found[at] = known = _search(short[at], long, np.repeat(known, STRIDE)[:len(at)] if stride * STRIDE < len(short) else np.zeros(len(at), np.int64))
        stride //= STRIDE
    return found


def _search(values: np.ndarray, long: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of ``values`` in ``long``; entries before ``low`` are known to be smaller."""
    low, last = low.copy(), len(long) - 1
    step = np.ones(len(low), np.int64)
    live = np.flatnonzero(long[low] < values)
    while len(live):  # doubling: long[low] < value stays true
        probe = low[live] + step[live]
        passed = long[np.minimum(probe, last)] < values[live]
        live, probe = live[passed], probe[passed]
        low[live] = probe
        step[live] *= 2
    live = np.flatnonzero(long[low] < values)
    high = np.minimum(low[live] + step[live], last)  # long[high] >= value
    low_of, wanted = low[live], values[live]
    while len(high) and (high - low_of > 1).any():  # halving
        middle = (low_of + high) >> 1
        below = long[middle] < wanted
        low_of, high = np.where(below, middle, low_of), np.where(below, high, middle)
    low[live] = high
    return low


def _ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    return np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def overlaps(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (short token, long token) of tokens whose byte ranges overlap, and the last short and long token of each group."""
    rank = gallop(short, long)
    common = long[rank] == short
    first = np.zeros_like(rank)
    first[1:] = rank[:-1] + common[:-1]
    counts = rank - first + 1
    return np.repeat(np.arange(len(short)), counts), _ranges(first, counts), np.flatnonzero(common), rank[common]


def _byte_of_sign() -> dict[str, int]:
    """The byte-level alphabet: a printable Latin-1 byte stands for itself, the others are numbered from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Aligner:
    """Byte-level BPE (A) and SentencePiece (B), with the bytes of every token."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        self.a = Tokenizer.from_buffer(a_json)
        self.a.encode_special_tokens = True  # their strings inside a text are plain text
        self.b = sp = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        signs = _byte_of_sign()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [b"".join(bytes([signs[c]]) if c in signs else c.encode() for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        self.b_bytes = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.b_bytes.append(b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace(META, " ").encode())
        self.a_size = np.array([len(b) for b in self.a_bytes], np.int64)
        self.b_size = np.array([len(b) for b in self.b_bytes], np.int64)
        #: texts may be cut before a word if no piece goes over the space before it
        self.cuts = all(META not in sp.id_to_piece(i).lstrip(META) for i in range(sp.vocab_size()))
        self._forget()
        na, self.n_b = len(self.a_bytes), len(self.b_bytes)
        #: decimal ids with what follows them: inside a group, at the end of its A side, at the end of its B side
        self.shown = [f"{i}{end}" for end in ",|" for i in range(na)] + [f"{i}{end}" for end in ",;" for i in range(self.n_b)]

    def segments(self, text: str, limit: int) -> list[str]:
        """A space and the text, cut into parts that start with a space and on which both tokenizers work alone."""
        text, out, begin = " " + text, [], 0
        while self.cuts and len(text) - begin > limit and (cut := _CUT.search(text, begin + limit)):  # a space that is part of what follows
            out.append(text[begin:cut.start()])
            begin = cut.start()
        return [*out, text[begin:]]

    def encode(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of each part, which starts with a space; None where joined bytes differ from the part.

        A word's ids don't depend on its neighbours, so each new word is encoded once and its ids are remembered."""
        words = [_CUT.split(p[1:]) if self.cuts else [p[1:]] for p in parts]
        flat = [w for of in words for w in of]
        place = self.words
        new = [w for w in dict.fromkeys(flat) if w not in place]
        if len(place) + len(new) > CACHED:
            self._forget()
            place, new = self.words, [*dict.fromkeys(flat)]
        self._remember(new)
        at = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        first = np.cumsum([0, *map(len, words)])
        good = np.minimum.reduceat(at, first[:-1]) >= 0 if parts else []
        sides = []
        for ids, begin in ((self.a_ids, self.a_at), (self.b_ids, self.b_at)):
            n = np.where(at >= 0, begin[at + 1] - begin[at], 0)
            sides.append(np.split(ids[_ranges(begin[at], n)], np.cumsum(np.add.reduceat(n, first[:-1]))[:-1]) if parts else [])
        for w in new:
            if len(w) > LONGEST:
                del place[w]
        return [(a, b) if ok else None for a, b, ok in zip(*sides, good, strict=True)]

    def _forget(self) -> None:
        self.words: dict[str, int] = {}  # place of a word, -1 if its bytes differ
        self.a_ids, self.b_ids = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.a_at, self.b_at = np.zeros(1, np.int64), np.zeros(1, np.int64)  # where the ids of a place begin; one more than places

    def _remember(self, words: list[str]) -> None:
        """Encode new words, many as one text with single spaces between them: their ends are ends of both tokenizers."""
        group, size, found = [], 0, []
        for w in words:
            if not self.cuts or not w or w[0].isspace() or w[-1].isspace():
                found += self._encode([w])
                continue
            group.append(w)
            size += len(w)
            if size > BLOCK:
                found += self._encode(group)
                group, size = [], 0
        found += self._encode(group) if group else []
        n = len(self.a_at) - 1
        for of, a, a_n, b, b_n in found:
            self.words.update(zip(of, range(n, n + len(of)), strict=True) if a is not None else dict.fromkeys(of, -1))
            n += len(of) if a is not None else 0
        good = [f for f in found if f[1] is not None]
        self.a_ids, self.b_ids = (np.concatenate([ids, *(f[k] for f in good)]) for ids, k in ((self.a_ids, 1), (self.b_ids, 3)))
        self.a_at, self.b_at = (
            np.concatenate([at, at[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in good)]))]) for at, k in ((self.a_at, 2), (self.b_at, 4)))

    def _encode(self, words: list[str]) -> list[tuple]:
        """(words, ids of A, their number in each word, ids of B, their number); no ids for a word whose bytes differ."""
        text = " ".join(words)
        raw = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw:
            ends = np.cumsum([len(w.encode()) + 1 for w in words])
            sides = []
            for ids, size in ((a, self.a_size), (b, self.b_size)):
                ids = np.array(ids, np.int32)
                upto = np.searchsorted(np.cumsum(size[ids]), ends) + 1
                sides += [ids, np.diff(upto, prepend=0)]
            return [(words, *sides)]
        if len(words) == 1:
            return [(words, None, None, None, None)]
        half = len(words) // 2  # some word is to blame
        return self._encode(words[:half]) + self._encode(words[half:])

    def align(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
        """(number of groups, groups as text, distinct linked pairs a * n_b + b, how often each) of each part, ids of A and B given."""
        out: list = [None] * len(parts)
        for a_drives in (True, False):  # the shorter list of a part drives
            names = [i for i, (x, y) in enumerate(parts) if (len(x) <= len(y)) is a_drives]
            if not names:
                continue
            a = np.concatenate([parts[i][0] for i in names]).astype(np.int64)
            b = np.concatenate([parts[i][1] for i in names]).astype(np.int64)
            a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])  # ends of parts are common ends
            if a_drives:
                link_a, link_b, last_a, last_b = overlaps(a_end, b_end)
            else:
                link_b, link_a, last_b, last_a = overlaps(b_end, a_end)
            a_to = np.cumsum([len(parts[i][0]) for i in names])
            groups_to = np.searchsorted(last_a, a_to - 1) + 1  # the last token of a part ends a group
            part_of = np.repeat(np.arange(len(names)), np.diff(a_to, prepend=0))
            width = len(self.a_bytes) * self.n_b
            keys, times = np.unique(part_of[link_a] * width + a[link_a] * self.n_b + b[link_b], return_counts=True)
            to = np.searchsorted(keys, np.arange(1, len(names) + 1) * width)
            text = self._text(a, b, last_a, last_b)
            text_to = a_to + np.cumsum([len(parts[i][1]) for i in names])
            begin = (0, 0, 0)
            for name, *end in zip(names, groups_to.tolist(), to.tolist(), text_to.tolist(), strict=True):
                part = slice(begin[1], end[1])
                out[name] = (end[0] - begin[0], "".join(text[begin[2]:end[2]])[:-1], keys[part] % width, times[part])
                begin = end
        return out

    def _text(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """The ids in order of groups, A before B, each with the sign that follows it."""
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        code = np.empty(len(a) + len(b), np.int64)
        shown_a, shown_b = a.copy(), b + 2 * len(self.a_bytes)
        shown_a[last_a] += len(self.a_bytes)
        shown_b[last_b] += self.n_b
        code[np.arange(len(a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = shown_a
        code[np.arange(len(b)) + np.repeat(np.cumsum(size_a), size_b)] = shown_b
        return [*map(self.shown.__getitem__, code.tolist())]


_LOADED: dict[bytes, Aligner] = {}


def _load(a_json: bytes, b_model: bytes) -> Aligner:
    key = hashlib.sha256(a_json).digest() + hashlib.sha256(b_model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(a_json, b_model)
    return _LOADED[key]


def installed(name: str, folder: str | None = None) -> bytes:
    """A tokenizer file of the driver's machine; executors get its bytes by broadcast (a few megabytes)."""
    if folder is None:
        import public_tokenizers

        return Path(public_tokenizers.path(name)).read_bytes()
    return (Path(folder) / name).read_bytes()


def _together(sizes: list[int], limit: int) -> Iterator[slice]:
    """Neighbouring rows of about ``limit`` characters; a longer text is alone."""
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield slice(begin, i)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def align(docs: DataFrame, a_json: bytes, b_model: bytes, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per row of ``docs``: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    A reads a space and the text, B the text, to which it adds that space. ``groups`` holds the decimal ids of A and B between common
    ends, as ``a1,a2|b1;a3|b2,b3``. ``pairs`` are the distinct linked id pairs, a * (size of B) + b, ``times`` their occurrences in
    the text. A null or empty text, or one whose tokens don't join to its bytes, has no tokens: zeros, an empty string, empty arrays.
    Texts of over ``segment`` characters are cut where both tokenizers cut anyway, at a single space between other signs, so memory doesn't grow with them if they have such places. Repeated rows and ids, null ids too, are rows of their own; the
    other columns are not read. An empty table gives no rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((a_json, b_model))
    pair_type = T.IntegerType() if _pair_limit(a_json, b_model) < 1 << 31 else T.LongType()
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType)])
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("groups", T.StringType()).add("pairs", T.ArrayType(pair_type)).add("times", T.ArrayType(T.IntegerType()))
    kind = pa.int32() if pair_type == T.IntegerType() else pa.int64()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = _load(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for rows in _together([len(t) for t in texts], TOGETHER):
                yield _aligned_rows(it, batch.slice(rows.start, rows.stop - rows.start), texts[rows], segment, kind)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(aligned, schema)


def _pair_limit(a_json: bytes, b_model: bytes) -> int:
    it = _load(a_json, b_model)
    return len(it.a_bytes) * it.n_b


def _aligned_rows(it: Aligner, batch: pa.RecordBatch, texts: list[str], segment: int, kind: pa.DataType) -> pa.RecordBatch:
    found = [None] * len(texts)
    plain = [i for i, t in enumerate(texts) if 0 < len(t) <= segment]
    coded = it.encode([" " + texts[i] for i in plain])
    good = [(i, c) for i, c in zip(plain, coded, strict=True) if c is not None]
    for (i, c), got in zip(good, it.align([c for _, c in good]), strict=True):
        found[i] = (len(c[0]), len(c[1]), *got)
    for i, text in enumerate(texts):
        if len(text) > segment:
            found[i] = _long(it, text, segment)
    none = np.zeros(0, np.int64)
    found = [f or (0, 0, 0, "", none, none) for f in found]
    ends = np.cumsum([0, *(len(f[4]) for f in found)])
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([none, *(f[k] for f in found)]), type_))
             for k, type_ in ((4, kind), (5, pa.int32()))]
    numbers = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
    links = pa.array([int(f[5].sum()) for f in found], pa.int64())
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, links, pa.array([f[3] for f in found], pa.string()), *lists], names)


def _long(it: Aligner, text: str, segment: int):
    """A long text part by part; cuts are common ends, so what the parts give is added up."""
    n = [0, 0, 0]
    shown, pairs, times = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in it.segments(text, segment):
        coded = it.encode([part])[0]
        if coded is None:
            return None
        groups, text_of, new, new_times = it.align([coded])[0]
        n = [n[0] + len(coded[0]), n[1] + len(coded[1]), n[2] + groups]
        shown.append(text_of)
        pairs, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
        times = np.bincount(place, np.concatenate([times, new_times])).astype(np.int64)
    return (*n, ";".join(shown), pairs, times)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): links of each id pair in the whole corpus, and whether no other pair of its B id has more.

    Batches are added up before the shuffle, so a pair found in every text sends one row a batch."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, place = np.unique(batch.column(0).flatten().to_numpy(), return_inverse=True)
            n = np.bincount(place, batch.column(1).flatten().to_numpy(), len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    sums = settle(aligned.select("pairs", "times").mapInArrow(added, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    b = (F.col("pair") % n_b).alias("b")
    highest = sums.groupBy(b).agg(F.max("n").alias("top"))
    return sums.select("pair", "n", b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def count_links(aligned: DataFrame, n_b: int, shared_pairs: int = 1 << 19) -> DataFrame:
    """``aligned`` without pairs and times, but with n_best (links whose pair no other pair of its B id outnumbers, ties included)
    and count_sum (corpus counts summed over the links).

    ``aligned`` is read twice, so it should be a written table. Pairs with more than a share of 1 / shared_pairs of all links, fewer
    than ``shared_pairs`` by construction, are broadcast as arrays (17 bytes each); all of them if there are no more than that. The
    others are joined by shuffle; none of those is frequent."""
    spark = aligned.sparkSession
    counts = settle(pair_counts(aligned, n_b))
    n_pairs, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    floor = 0 if n_pairs <= shared_pairs else total // shared_pairs
    table = counts.where(F.col("n") > floor).toArrow()
    pairs, n, best = (np.asarray(table.column(k)) for k in ("pair", "n", "best"))
    order = np.argsort(pairs)
    known = spark.sparkContext.broadcast((pairs[order], n[order], best[order].astype(bool)))
    kept = [f for f in aligned.schema.fields if f.name not in ("pairs", "times")]
    rest = T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())])
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rest", T.ArrayType(rest))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            owner = np.repeat(np.arange(len(lists)), np.diff(ends))
            wanted = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pairs, wanted), max(len(pairs) - 1, 0))
            hit = pairs[at] == wanted if len(pairs) else np.zeros(len(wanted), bool)
            sums, bests = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
            np.add.at(sums, owner[hit], times[hit] * n[at[hit]])
            np.add.at(bests, owner[hit], times[hit] * best[at[hit]])
            rest_ends = np.cumsum([0, *np.bincount(owner[~hit], minlength=len(lists))])
            rest = pa.StructArray.from_arrays([pa.array(wanted[~hit], pa.int64()), pa.array(times[~hit], pa.int64())], ["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(bests), pa.array(sums), pa.ListArray.from_arrays(pa.array(rest_ends, pa.int32()), rest)],
                schema.names)

    first = aligned.mapInArrow(counted, schema)
    if floor == 0:
        return first.drop("rest")
    first = settle(first)
    tail = first.select("row", F.inline("rest")).join(counts.where(F.col("n") <= floor), "pair")
    added = tail.groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    return first.join(added, "row", "left").select(
        *[f.name for f in kept], (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"))


def b_size(a_json: bytes, b_model: bytes) -> int:
    return _load(a_json, b_model).n_b
