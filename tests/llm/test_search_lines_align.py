"""Ranked search, line dedup and tokenizer alignment against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from panelquant.llm import align, lines, search

from .tables import LONG, collected, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_search(docs, items, k):
    counts = [(i, Counter(TERM.findall(low(t or "")))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for name, text in items:
        scores = []
        for i, c in counts:
            n = sum(c.values())
            s = 0
            for t in set(TERM.findall(low(text or ""))) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                s += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * (50 + (50 * n * n_docs) // total)))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(name, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("stages", "block", "bundle"), [(4, 2_000_000, 256), (3, 150, 2), (1, 40, 1)])
def test_search(spark, stages, block, bundle):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "ñu", "A1"]
    text = lambda n: " ".join(rng.choice(words) if rng.random() < 0.7 else "the" for _ in range(n))
    rows = [(i, text(rng.randint(1, 40))) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(9, "w1 W2"), (9, "w1 W2"), (None, "w3 w3"), (301, None), (302, ""), (303, "...")]
    asked = [(1, rows[0][1]), (2, "the THE w5"), (2, "w5, w6"), (3, None), (4, "nowhere"), (5, "É-ñu w7 w8 w9"), (None, "w3")]
    items = documents(spark, asked).withColumnRenamed("doc_id", "item_id")
    docs = documents(spark, rows, "row")
    got = search.search(docs, items, 7, stages, block, bundle).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_search(rows, asked, 7)


def test_search_long_texts_and_empty_tables(spark):
    rows = [(1, LONG + " needle"), (2, "needle needle"), (3, LONG)]
    docs, items = documents(spark, rows), documents(spark, [(1, "needle long")]).withColumnRenamed("doc_id", "item_id")
    assert sorted(map(tuple, search.search(docs, items).collect()), key=str) == brute_search(rows, [(1, "needle long")], 50)
    assert search.search(docs.limit(0), items).count() == search.search(docs, items.limit(0)).count() == 0
    assert search.count_terms("é x" * search.PART)[0] == search.PART + 1  # more bytes than one part


def brute_lines(rows, min_chars=10):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add((i is None, i or 0))
    out = []
    for i, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if len(key(x)) < min_chars or min(holders[key(x)]) == (i is None, i or 0)]
        out.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_rows", [10_000, 3])  # 3: frequent keys are dealt into cells
def test_lines(spark, min_rows):
    rng = random.Random(8)
    pool = ["a line that repeats", "  A LINE that repeats\t", "éa line that repeats", "short", "", " \t ", "x" * 10, "X" * 9, "nul\x0bl inside\x0c"]
    text = lambda n: "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"line number {rng.randint(0, 60)}" for _ in range(n))
    rows = [(i, text(rng.randint(1, 12))) for i in range(80)]
    rows += [(100, text(9000)), (101, text(9000)), (7, "a line that repeats\nown line of seven"), (7, "own line of seven"), (7, "own line of seven")]
    rows += [(None, "line number 1\nonly without an id"), (None, "only without an id"), (103, None), (104, ""), (105, "\n\n"), (106, LONG), (107, LONG)]
    docs = documents(spark, rows, "line")
    maps = lines.keep_bitmaps(docs, min_rows=min_rows, cells=16)
    got = lines.apply_bitmaps(docs, maps)
    assert got.columns == [*docs.columns, "kept"]
    assert sorted([(r.doc_id, r.kept.n_lines, r.kept.n_dropped, r.kept.text) for r in got.collect()], key=str) == brute_lines(rows)
    assert sum(len(r.keep) for r in maps.collect() if r.doc == 101) <= 9000 // 64 + 1


def test_bitmaps_join_equal_words(spark):
    later = spark.range(6400).selectExpr("1L AS doc", "2L AS body", "cast(id AS int) AS place").where("place <> 700")
    (row,) = lines.bitmaps(later).collect()
    assert [(r.word, r.words) for r in row.keep] == [(0, 10), (10, 1), (11, 89)] and row.n_dropped == 6399


def test_lines_empty(spark):
    assert lines.drop_repeated_lines(documents(spark, ["x"]).limit(0)).count() == 0


def brute_align(it, texts, n_b):
    found, counts = [], Counter()
    for text in texts:
        raw = (" " + text).encode() if text else b""
        a, b = (it.a.encode(" " + text, add_special_tokens=False).ids, it.b.encode(text)) if text else ([], [])
        if b"".join(it.a_bytes[i] for i in a) != raw or b"".join(it.b_bytes[i] for i in b) != raw:
            a, b = [], []
        spans = []
        for ids, table in ((a, it.a_bytes), (b, it.b_bytes)):
            ends = np.cumsum([len(table[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends], ends, ids)))  # noqa: B905
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[",".join(str(i) for s, e, i in side if begin <= s and e <= end) for side in spans] for begin, end in zip([0, *common], common)]  # noqa: B905
        links = Counter((x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e)
        counts.update(links)
        found.append((len(a), len(b), len(groups), ";".join("|".join(g) for g in groups), links))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(*f[:3], sum(f[4].values()), sum(t for p, t in f[4].items() if counts[p] == top[p[1]]), sum(t * counts[p] for p, t in f[4].items()), f[3])
            for f in found]


@pytest.fixture(scope="module")
def tokenizers():
    return align.installed("byte_bpe_50k.json"), align.installed("piece_bpe_32k.model")


@pytest.mark.parametrize("shared_pairs", [1 << 19, 20])
@pytest.mark.parametrize("segment", [align.SEGMENT, 60])
def test_alignment(spark, tokenizers, shared_pairs, segment):
    rng = random.Random(2)
    words = ["the", "Straße", "naïve", "日本語", "x=1;", "\n", "  ", "<|endoftext|>", "<s>", "<0x0A>", "12345", "🙂", "don't", "Übergrößenträger"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += ["a ▁ b", "a", " ", "", None, texts[0], texts[0], "plain words without any odd sign " * 30, "é", "\x00\x01"]
    docs = documents(spark, [*enumerate(texts), (3, "again"), (None, "no id")], "row")
    rows = align.settle(align.align(docs, *tokenizers, segment=segment))
    n_b = align.b_size(*tokenizers)
    got = align.count_links(rows, n_b, shared_pairs).collect()
    want = brute_align(align._load(*tokenizers), [*texts, "again", "no id"], n_b)
    names = [*range(len(texts)), 3, None]
    assert sorted([tuple(r)[1:] for r in got], key=str) == sorted(
        [(i, *w[:4], w[6], *w[4:6]) for i, w in zip(names, want, strict=True)], key=str)
    assert sum(w[0] > 0 for w in want) > 40


def test_gallop():
    rng = np.random.default_rng(1)
    for n in (1, 2, 31, 32, 33, 1024, 1025, 5000):
        long = np.unique(rng.integers(0, 20 * n, 3 * n))
        short = np.unique(np.append(rng.choice(20 * n, n), long[-1]))
        short = short[short <= long[-1]]
        assert (align.gallop(short, long) == np.searchsorted(long, short)).all()


def test_alignment_cuts_long_texts(spark, tokenizers):
    docs = documents(spark, [(1, LONG), (2, "x" * 3000), (3, "word " * 1000)])
    whole = collected(align.align(docs, *tokenizers, segment=10_000_000), "doc_id")
    assert collected(align.align(docs, *tokenizers, segment=1000), "doc_id") == whole
    assert len(align._load(*tokenizers).segments(LONG, 1000)) > 1000
    assert align.align(docs.limit(0), *tokenizers).count() == 0


def test_query_columns_are_digests(spark, tokenizers):
    (row,) = align.align(documents(spark, ["a word"]), *tokenizers).collect()
    groups = [g.split("|") for g in row.groups.split(";")]
    assert len(groups) == row.n_groups and sum(len(a.split(",")) for a, _ in groups) == row.n_a
    assert len(hashlib.sha256(row.groups.encode()).hexdigest()) == 64
