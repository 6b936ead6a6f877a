"""Exact dedup and sharding against plain Python."""

import hashlib
import random
import zlib

import pytest
from panelquant.llm import exact, shard
from panelquant.llm.common import new_path

from .tables import LONG, collected, documents


def brute_groups(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max(known) if keep == "max" else min(known)) if known else None
        out += [(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("min_rows", [1000, 3])  # 3: the large groups are dealt into cells
def test_groups(spark, keep, min_rows):
    rng = random.Random(4)
    rows = [(i, rng.choice(["same start, a", "same start, b", "ä", "", None, "copy"])) for i in range(60)]
    rows += [(100 + i, "hot") for i in range(40)] + [(7, "twice"), (7, "twice"), (None, "no id"), (None, "copy"), (500, LONG), (501, LONG)]
    got = exact.exact_groups(documents(spark, rows, "cell"), keep=keep, min_rows=min_rows, cells=16).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute_groups(rows, keep)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len(kept) == len({t or "" for _, t in rows}) == len({r.text_sha256 for r in kept})


@pytest.mark.parametrize("min_rows", [1000, 3])
def test_drop_copies_keeps_columns(spark, min_rows):
    docs = documents(spark, [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), *[(10 + i, "hot") for i in range(20)]], "place")
    out = exact.drop_copies(docs, keep="min", min_rows=min_rows, cells=16)
    assert out.columns == docs.columns
    assert [(r["doc_id"], r["text"], r["place"]) for r in collected(out, "doc_id")] == [
        (None, "c", "kept as it is"), (1, "a", "kept as it is"), (3, None, "kept as it is"), (5, "b", "kept as it is"), (10, "hot", "kept as it is")]


def test_exact_empty(spark):
    empty = documents(spark, [("x",)][:0])
    assert exact.exact_groups(empty).count() == 0 and exact.drop_copies(empty).count() == 0


def test_shards(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 400) + "é") for i in range(3000)] + [(5000, None), (None, "no id"), (7, "again"), (7, "again"), (5001, LONG[:3000])]
    docs = documents(spark, rows, "slot")
    got = shard.shard_documents(docs, n_slots=512).collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted(
        (i or -1 if i != 0 else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    assert sorted(by_shard) == list(range(16))
    for part in by_shard.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sizes = [sum(r["size"] for r in part) for part in by_shard.values()]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 16
    assert len({(r.virtual_slot, r.shard) for r in got}) == len({r.virtual_slot for r in got})
    assert shard.shard_documents(docs.limit(0)).count() == 0


def test_rebalance_moves_slots_only_as_needed(spark):
    sizes = [(s, 100 + s % 7, 3) for s in range(256)]
    old = shard.first_map(sizes, 8)
    new = shard.rebalanced(old, 9)
    was, now = {r[0]: r[1] for r in old}, {r[0]: r[1] for r in new}
    assert all(was[s] == now[s] or now[s] == 8 for s in was)  # rows only go into the new shard
    load = [sum(r[2] for r in new if r[1] == k) for k in range(9)]
    assert max(load) - min(load) <= 2 * 107
    assert {r[5] for r in new} == {2}
    fewer = shard.rebalanced(new, 5)
    assert {r[1] for r in fewer} == set(range(5)) and all(now[r[0]] == r[1] for r in fewer if now[r[0]] < 5)
    path = new_path(spark, "map")
    shard.write_map(spark, old, path)
    assert shard.write_map(spark, new, path).select("shard").distinct().count() == 9
    assert shard.read_map(spark, path, 1).select("shard").distinct().count() == 8


@pytest.mark.parametrize("seed", range(40))
def test_rebalance_over_random_sizes(seed):
    rng = random.Random(seed)
    k = rng.randint(1, 12)
    sizes = [(slot, rng.randint(1, 1000), 1) for slot in range(rng.randint(k, 400))]
    old = shard.first_map(sizes, k)
    was = {r[0]: r[1] for r in old}
    more = shard.rebalanced(old, k + rng.randint(1, 4))
    assert all(r[1] in (was[r[0]], *range(k, k + 5)) for r in more)  # only new shards receive
    load = lambda rows, shards: [sum(r[2] for r in rows if r[1] == n) for n in shards]
    assert max(load(more, range(k))) <= max(load(old, range(k)))
    less = rng.randint(1, k)
    fewer = {r[0]: r[1] for r in shard.rebalanced(old, less)}
    assert all(fewer[s] == was[s] if was[s] < less else fewer[s] < less for s in was)  # only homeless slots move
