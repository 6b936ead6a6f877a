"""SentencePiece encoding and decoding with seeded merge-dropout.

A text is cut into chunks that no piece of the vocabulary can span. A chunk starts as characters; an agenda holds the merges of
neighbours that form a piece, best score first, leftmost first among equals. When a merge comes up, a keyed hash of (seed,
document, place of the chunk, position, piece) decides whether it is skipped; a skipped merge can only come back with another
neighbour. So every occurrence of a chunk is segmented on its own, yet every rerun gives the same ids. With dropout 0 the ids are
the model's own. What is remembered of a chunk is what follows from the skips, never which of them happen.

Characters that the vocabulary lacks become byte pieces, also the meta symbol U+2581 itself, so decoding gives back every text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, held

META = "▁"
_LETTER = re.compile(r"[^\W\d_]")
_BY_SPACE = re.compile(r" *[^ ]+| +")
CACHED = 200_000  # segmentations that a Python worker remembers, about 230 bytes each
UNSEEN, ONCE = -1, -2  # in place of a node
SKIPS = 2  # segmentations with more skipped merges are not remembered
LONGEST = 48  # characters of a chunk that is merged on a list and remembered
NEVER = 1 << 62
SYMBOL = 22  # bits of a piece id or a character
PLACE = 6  # bits of a place in a chunk of at most LONGEST characters
TOGETHER = 1_000_000  # bytes of text whose chunks are merged together


def _hash(key: int, at: int, rank: int) -> int:
    """30 bits from a key of 30 bits, a position and a rank; small factors keep Python's integers short."""
    x = key ^ at * 40503 ^ rank * 30011
    return (x ^ x >> 13) * 668265261 >> 7 & 0x3FFFFFFF


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def occurrence_keys(seed: int, doc_keys, counts: np.ndarray) -> np.ndarray:
    """A key of 30 bits for each chunk of each text, from (seed, the text's key of 64 bits, the chunk's place)."""
    docs = np.array([(k + seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for k in doc_keys], np.uint64)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return (_mixed(np.repeat(_mixed(docs), counts) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(34)).astype(np.int64)


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype, *first: int):
        self.data, self.n = np.array([*first, *[0] * 1024], dtype), len(first)

    def add(self, values) -> None:
        n = self.n + len(values)
        if n > len(self.data):
            self.data = np.concatenate([self.data[:self.n], np.empty(n // 2 + n - self.n, self.data.dtype)])
        self.data[self.n:n], self.n = values, n


class _Paths:
    """Segmentations of chunks by the merges that were skipped.

    A node is a chunk with a set of skipped merges. It has the ids if no other merge is skipped, and the merges that come up after
    the last of its skips, in their order; the first of them that an occurrence skips leads to another node."""

    def __init__(self):
        self.roots: dict[str, int] = {}
        self.begin, self.ids_begin = _Grown(np.int32, 0), _Grown(np.int32, 0)  # where a node's merges and ids begin; one more than nodes
        self.code, self.mix, self.child = _Grown(np.int64), _Grown(np.int64), _Grown(np.int32)  # of a merge: rank and place, hash part, node
        self.ids = _Grown(np.int32)
        self.came, self.depth = _Grown(np.int32), _Grown(np.int8)  # the merge whose skip led to a node, the number of skips

    def add(self, codes: np.ndarray, counts: np.ndarray, ids: list[bytes], came, depth: int) -> None:
        self.code.add(codes)
        self.mix.add((codes & ((1 << PLACE) - 1)) * 40503 ^ (codes >> PLACE) * 30011)
        self.child.add(np.full(len(codes), UNSEEN))
        self.begin.add(self.begin.data[self.begin.n - 1] + np.cumsum(counts))
        self.ids_begin.add(self.ids_begin.data[self.ids_begin.n - 1] + np.cumsum([len(x) // 4 for x in ids]))
        self.ids.add(np.frombuffer(b"".join(ids), np.int32))
        self.came.add(came)
        self.depth.add(np.full(len(ids), depth))


def _slices(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of slices one after the other."""
    return np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Pieces:
    """The vocabulary of a SentencePiece BPE model; spaces stand for the meta symbol."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, int] = {}  # place in the order of merging
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                text = piece.replace(META, " ")
                self.ids[text] = i
                self.bytes.append(text.encode())
                self.rank[text] = -int(sp.get_score(i))
        self.chunks = self._splitter().findall
        self.paths = _Paths()
        self._pairs()

    def _splitter(self) -> re.Pattern:
        """Chunks of one kind of character with the spaces before, where no piece mixes kinds; else what stands between spaces."""
        odd = re.escape("".join(sorted({c for piece in self.ids for c in piece if _LETTER.match(c) and not c.isalpha()})))
        kinds = (rf"[^\W\d_{odd}]+", r"\d+", rf"(?:[^\w ]|[_{odd}])+")
        whole = [re.compile(" *" + k) for k in (*kinds, "")]
        if all(any(k.fullmatch(piece) for k in whole) for piece in self.ids):
            return re.compile(f" *(?:{'|'.join(kinds)})| +")
        return _BY_SPACE

    def merge(self, chunk: str, key: int, limit: int) -> list[int]:
        """Piece ids of a chunk; ``limit`` is the dropout as a share of 2^30."""
        parts = self._merge_long(chunk, key, limit) if len(chunk) > LONGEST else self._merge_short(chunk, key, limit)
        ids, out = self.ids, []
        for part in parts:
            piece = ids.get(part)
            if piece is None:
                out += [self.byte_ids[b] for b in part.encode()]
            else:
                out.append(piece)
        return out

    def _merge_short(self, chunk: str, key: int, limit: int) -> list[str]:
        """The agenda as a list beside the symbols: for few symbols its smallest entry is found faster than in a heap."""
        get, never = self.rank.get, NEVER
        parts, at = list(chunk), list(range(len(chunk)))
        agenda = [get(a + b, never) for a, b in zip(chunk, chunk[1:])]  # noqa: B905
        while agenda and (first := min(agenda)) != never:
            k = agenda.index(first)
            if limit and _hash(key, at[k], first) < limit:
                agenda[k] = never
                continue
            del agenda[k], at[k + 1]
            both = parts.pop(k + 1)
            parts[k] = both = parts[k] + both
            if k < len(agenda):
                agenda[k] = get(both + parts[k + 1], never)
            if k:
                agenda[k - 1] = get(parts[k - 1] + both, never)
        return parts

    def _merge_long(self, chunk: str, key: int, limit: int) -> list[str]:
        """As ``_merge_short``, with a heap: n log n steps for a chunk of any length."""
        get, n = self.rank.get, len(chunk)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # end 0: merged into the symbol before
        agenda = [(get(chunk[i:i + 2]), i, i + 1, i + 2) for i in range(n - 1) if chunk[i:i + 2] in self.rank]
        heapq.heapify(agenda)
        while agenda:
            first, i, middle, stop = heapq.heappop(agenda)
            if end[i] != middle or end[middle] != stop or limit and _hash(key, i, first) < limit:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                right = get(chunk[i:end[stop]])
                if right is not None:
                    heapq.heappush(agenda, (right, i, stop, end[stop]))
            left = before[i]
            if left >= 0:
                joined = get(chunk[left:stop])
                if joined is not None:
                    heapq.heappush(agenda, (joined, left, i, stop))
        parts, i = [], 0
        while i < n:
            parts.append(chunk[i:end[i]])
            i = end[i]
        return parts

    def _pairs(self) -> None:
        """Keys of the pairs of pieces that merge, with the rank and the id of what they form."""
        self.size = len(self.bytes)
        found = {}
        for piece, whole in self.ids.items():
            for i in range(1, len(piece)):
                left, right = self.ids.get(piece[:i]), self.ids.get(piece[i:])
                if left is not None and right is not None:
                    found[left << SYMBOL | right] = (self.rank[piece], whole)
        self.pair_keys = np.full(1 << max(10, 3 + len(found).bit_length()), -2, np.int64)  # a hash table, the next slot where one is taken
        self.pair_rank, self.pair_into = np.full_like(self.pair_keys, NEVER), np.full_like(self.pair_keys, -1)
        keys = np.array(list(found), np.int64)
        slots = self._slot(keys)
        for key, slot, value in zip(keys.tolist(), slots.tolist(), found.values(), strict=True):
            while self.pair_keys[slot] != -2:
                slot = (slot + 1) % len(self.pair_keys)
            self.pair_keys[slot], self.pair_rank[slot], self.pair_into[slot] = key, *value
        self.char_id = np.arange(0x110000, dtype=np.int64) + self.size  # characters without a piece stand for themselves
        for piece, whole in self.ids.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = whole
        #: every piece is made of characters that are pieces, so symbols can be ids
        self.closed = all(c in self.ids for piece in self.ids for c in piece)

    def _formed(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what pairs of symbols form; rank NEVER where they form nothing. Padding is -1."""
        key = left << SYMBOL | right
        at = self._slot(key)
        there = self.pair_keys[at]
        more = np.nonzero((there != key) & (there != -2))
        while len(more[0]):
            at[more] = (at[more] + 1) % len(self.pair_keys)
            there[more] = found = self.pair_keys[at[more]]
            further = (found != key[more]) & (found != -2)
            more = tuple(x[further] for x in more)
        hit = there == key
        return np.where(hit, self.pair_rank[at], NEVER), np.where(hit, self.pair_into[at], -1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * -7046029254386353131 >> 24) & (len(self.pair_keys) - 1)

    def merge_many(self, chunks: list[str], keys: list[int], limit: int) -> list[bytes]:
        """``merge`` of many chunks, those of equal length together; ids as bytes of int32, which join faster than lists."""
        out: list = [b""] * len(chunks)
        all_keys = np.array(keys, np.int64)
        for width, part, grid in self._grids(chunks):
            if width > LONGEST or not self.closed:
                for r in part.tolist():
                    out[r] = np.array(self.merge(chunks[r], keys[r], limit), np.int32).tobytes()
                continue
            self._merge_grid(grid, all_keys[part], limit)
            self._emit(grid.T, part, out)
        return out

    def _grids(self, chunks: list[str]):
        """(length, places in the list, symbols) of chunks of equal length; a column is a chunk. No symbols of what no grid takes."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = self.char_id[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        for width in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == width)
            if width > LONGEST or not self.closed:
                yield width, rows, None
                continue
            for part in np.array_split(rows, 1 + len(rows) * width // 200_000):
                grid = np.full((width + 1, len(part)), -1, np.int64)
                grid[:width] = symbols[starts[part] + np.arange(width)[:, None]]
                yield width, part, grid

    def _remember(self, chunks: list[str], came: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """New nodes of chunks of at most LONGEST characters; ``skips`` has their skipped merges, a column for each chunk."""
        nodes = np.empty(len(chunks), np.int64)
        for _, part, grid in self._grids(chunks):
            trace: list = []
            self._merge_grid(grid, None, 0, skips[:, part], trace)
            out: list = [b""] * len(part)
            self._emit(grid.T, np.arange(len(part)), out)
            column = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in trace)])
            codes = np.concatenate([np.zeros(0, np.int64), *(x for _, x in trace)])
            nodes[part] = self.paths.depth.n + np.arange(len(part))
            self.paths.add(codes[np.argsort(column, kind="stable")], np.bincount(column, minlength=len(part)), out, came[part], len(skips))
        return nodes

    def _merge_grid(self, sym: np.ndarray, key: np.ndarray | None, limit: int, skips: np.ndarray | None = None, trace: list | None = None) -> None:
        """Merges chunks in place: a column is a chunk, a symbol stands where it starts, -1 where one was merged away.

        The agenda holds rank and place of each pair in one number, so a minimum down the column is its first entry; a round
        takes the first entry of every chunk. The last row is a sentinel. With ``skips`` just these entries are skipped; ``trace``
        gets (columns, entries) of each round, of columns with no skips to come."""
        height, count = sym.shape
        rank, into = self._formed(sym[:-1], sym[1:])
        place = np.arange(height - 1)[:, None]
        agenda = np.where(rank < NEVER, rank << PLACE | place, NEVER)
        after = np.repeat(np.arange(1, height + 1), count).reshape(height, count)
        before = after - 2
        live = np.arange(count)
        to_come = None if skips is None else np.full(count, len(skips))
        while True:
            first = agenda[:, live].min(0) if len(live) < count else agenda.min(0)
            open_ = first < NEVER
            live, first = live[open_], first[open_]
            if not len(live):
                return
            k, rows = first & ((1 << PLACE) - 1), live
            if limit:
                x = key[live] ^ k * 40503 ^ (first >> PLACE) * 30011
                merges = ((x ^ x >> 13) * 668265261 >> 7 & 0x3FFFFFFF) >= limit
                agenda[k[~merges], live[~merges]] = NEVER
                k, rows = k[merges], live[merges]
            elif skips is not None:
                done = to_come[live] == 0
                trace.append((live[done], first[done]))
                if len(skips):
                    hit = (skips[:, live] == first).any(0)
                    to_come[live[hit]] -= 1
                    agenda[k[hit], live[hit]] = NEVER
                    k, rows = k[~hit], live[~hit]
            gone = after[k, rows]
            new = into[k, rows]
            stop = after[gone, rows]
            sym[k, rows], sym[gone, rows] = new, -1
            after[k, rows], before[np.minimum(stop, height - 1), rows] = stop, k
            inner = gone < height - 1
            agenda[gone[inner], rows[inner]] = NEVER
            rank, made = self._formed(new, sym[np.minimum(stop, height - 1), rows])
            agenda[k, rows], into[k, rows] = np.where(rank < NEVER, rank << PLACE | k, NEVER), made
            left = before[k, rows]
            has = left >= 0
            left, new, rows = left[has], new[has], rows[has]
            rank, made = self._formed(sym[left, rows], new)
            agenda[left, rows], into[left, rows] = np.where(rank < NEVER, rank << PLACE | left, NEVER), made

    def _emit(self, sym: np.ndarray, names: np.ndarray, out: list) -> None:
        data, ends = sym[sym >= 0].astype(np.int32).tobytes(), (4 * np.cumsum((sym >= 0).sum(1))).tolist()
        begin = 0
        for name, end in zip(names.tolist(), ends, strict=True):
            out[name], begin = data[begin:end], end
        for i in np.flatnonzero((sym >= self.size).any(1)).tolist():  # characters without a piece become bytes
            ids = [b for x in sym[i].tolist() if x >= 0 for b in ([x] if x < self.size else [self.byte_ids[c] for c in chr(x - self.size).encode()])]
            out[names[i]] = np.array(ids, np.int32).tobytes()

    def encode_many(self, texts: list[str], doc_keys: list[int], dropout: float = 0.0, seed: int = 0) -> list[np.ndarray]:
        """Piece ids of texts: ``merge`` of each chunk with the key of its occurrence. Occurrences that skip the same merges share
        what was found for one of them; what isn't remembered is merged for all texts at once."""
        limit = int(dropout * (1 << 30))
        if self.paths.depth.n > CACHED or len(self.paths.roots) > CACHED:
            self.paths = _Paths()
        paths = self.paths
        cut = [self.chunks(" " + t) if t else [] for t in texts]
        counts = np.array([len(c) for c in cut], np.int64)
        flat = [c for chunks in cut for c in chunks]
        keys = occurrence_keys(seed, doc_keys, counts) if limit else np.zeros(len(flat), np.int64)
        node = np.fromiter(map(paths.roots.get, flat, repeat(UNSEEN)), np.int64, len(flat))
        if self.closed:
            self._root(node, flat)
        active = np.flatnonzero(node >= 0) if limit else np.zeros(0, np.int64)
        while len(active):
            active, skipped = self._first_skip(node[active], keys[active], limit, active)
            node[active] = self._follow(node[active], skipped, active, flat)
            active = active[node[active] >= 0]
        alone = np.flatnonzero(node < 0)
        own = self.merge_many([flat[i] for i in alone.tolist()], keys[alone].tolist(), limit)
        pool = np.concatenate([paths.ids.data[:paths.ids.n], np.frombuffer(b"".join(own), np.int32)])
        begin = paths.ids_begin.data[node].astype(np.int64)
        sizes = paths.ids_begin.data[node + 1] - begin
        sizes[alone] = [len(x) // 4 for x in own]
        begin[alone] = paths.ids.n + np.cumsum(sizes[alone]) - sizes[alone]
        ids = pool[_slices(begin, sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)] if len(counts) else counts
        return np.split(ids, ends[:-1]) if len(counts) else []

    def _first_skip(self, node: np.ndarray, keys: np.ndarray, limit: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the occurrences that skip one of their node's merges, and the first merge that each skips."""
        paths, who, what = self.paths, [names[:0]], [names[:0]]
        for at in range(0, len(node), 50_000):  # arrays that stay in the processor's cache
            part = slice(at, at + 50_000)
            begin = paths.begin.data[node[part]].astype(np.int64)
            counts = paths.begin.data[node[part] + 1] - begin
            merge = _slices(begin, counts)
            x = np.repeat(keys[part], counts) ^ paths.mix.data[merge]
            hit = np.flatnonzero(((x ^ x >> 13) * 668265261 >> 7 & 0x3FFFFFFF) < limit)
            owner = np.searchsorted(np.cumsum(counts), hit, "right")
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            who.append(names[part][owner[first]])
            what.append(merge[hit[first]])
        return np.concatenate(who), np.concatenate(what)

    def _root(self, node: np.ndarray, flat: list[str]) -> None:
        """Nodes of chunks that have none; a chunk gets one when it comes for the second time."""
        roots = self.paths.roots
        at = np.flatnonzero(node < 0)
        chunks = [flat[i] for i in at.tolist()]
        times = {c: n for c, n in Counter(chunks).items() if len(c) <= LONGEST}
        several = [c for c, n in times.items() if n > 1 or c in roots]
        roots.update(dict.fromkeys(times, ONCE))
        if several:
            roots.update(zip(several, self._remember(several, np.full(len(several), UNSEEN), np.zeros((0, len(several)), np.int64)).tolist(), strict=True))
            node[at] = np.fromiter(map(roots.get, chunks, repeat(UNSEEN)), np.int64, len(chunks))

    def _follow(self, node: np.ndarray, skipped: np.ndarray, names: np.ndarray, flat: list[str]) -> np.ndarray:
        """The nodes that skipped merges lead to, made when they are come to for the second time; negative where there is none."""
        paths = self.paths
        out = paths.child.data[skipped].astype(np.int64)
        for depth in range(SKIPS):
            rows = np.flatnonzero((out < 0) & (paths.depth.data[node] == depth))
            new, one, times = np.unique(skipped[rows], return_index=True, return_counts=True)
            again = (times > 1) | (paths.child.data[new] == ONCE)
            paths.child.data[new] = ONCE
            new, one = new[again], rows[one[again]]
            if len(new):
                skips = [paths.code.data[new]]
                if depth:
                    skips.append(paths.code.data[paths.came.data[node[one]]])
                paths.child.data[new] = self._remember([flat[i] for i in names[one].tolist()], new, np.array(skips, np.int64))
        return np.where(out < 0, paths.child.data[skipped], out)

    def encode(self, text: str, doc_key: int = 0, dropout: float = 0.0, seed: int = 0) -> list[int]:
        return self.encode_many([text], [doc_key], dropout, seed)[0].tolist()

    def decode(self, ids) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids])[1:].decode()


def _load(model: bytes) -> Pieces:
    return held("pieces", model[:64] + zlib.crc32(model).to_bytes(4, "big"), lambda: Pieces(model))


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model's bytes through Spark's readers: any path that the cluster can read."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def installed_model(name: str = "piece_bpe_32k.model", folder: str | None = None) -> bytes:
    """A model file of the machine that runs the driver; executors get its bytes by broadcast (half a megabyte)."""
    if folder is None:
        import public_tokenizers

        return Path(public_tokenizers.path(name)).read_bytes()
    return (Path(folder) / name).read_bytes()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 0, out: str = "ids") -> DataFrame:
    """``docs`` with a column ``out``: array of piece ids.

    A null or empty text has no ids. The id only keys the skips; a null id counts as 0, rows that repeat an id have the same keys. The whole text is encoded, however long. An empty table gives no rows. A column called ``out`` is replaced,
    all others pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run = F.arrow_udf(lambda values, keys: _ids(_load(shared.value), values, keys, dropout, seed), "array<int>")
    return docs.withColumn(out, run(F.col(text_col), _key(id_col)))


def round_trip(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 0, out: str = "coded") -> DataFrame:
    """``docs`` with a column ``out``: struct of the ids that ``encode`` gives and the text that ``decode`` makes of them.

    In one pass: a column that one function makes and another takes would be made twice."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def both(values: pa.Array, keys: pa.Array) -> pa.Array:
        p = _load(shared.value)
        ids = _ids(p, values, keys, dropout, seed)
        out = pa.StructArray.from_arrays([ids, _texts(p, ids)], ["ids", "text"])
        give_back()
        return out

    return docs.withColumn(out, F.arrow_udf(both, "struct<ids:array<int>,text:string>")(F.col(text_col), _key(id_col)))


def _key(id_col: str):
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("0")))


def _ids(p: Pieces, values: pa.Array, keys: pa.Array, dropout: float, seed: int) -> pa.Array:
    keys, flat, ends = keys.to_pylist(), [], [0]
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy()
    group = np.cumsum(sizes) // TOGETHER
    for rows in np.split(np.arange(len(values)), np.flatnonzero(np.diff(group)) + 1):
        texts = [t or "" for t in values.slice(int(rows[0]), len(rows)).to_pylist()] if len(rows) else []
        for got in p.encode_many(texts, keys[rows[0]:rows[-1] + 1] if len(rows) else [], dropout, seed):
            flat.append(got)
            ends.append(ends[-1] + len(got))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()))


def _texts(p: Pieces, ids: pa.Array) -> pa.Array:
    return pa.array([p.decode(v.values.to_numpy().tolist()) if v.is_valid else None for v in ids], pa.string())


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with a column ``out``: the text of the ids. Null ids give a null text, no ids an empty one."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.withColumn(out, F.arrow_udf(lambda values: _texts(_load(shared.value), values), "string")(F.col(ids_col)))
