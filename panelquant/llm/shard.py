"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots. Bytes are added up per slot, and a versioned table maps
slots to shards. Rebalancing edits that table: a new version moves slots, never single records, so a slot's records stay
together for ever and only the moved slots are copied.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, settle

MAP = "virtual_slot int, shard int, n_bytes bigint, n_rows bigint, first_slot bigint, version int"


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def hashed(docs: DataFrame, id_col: str, text_col: str, n_slots: int) -> DataFrame:
    """(id, size, crc, virtual slot); the text goes no further than this pass."""
    crc = text_crc(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"), byte_size(F.col(text_col)).alias("size"), crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))


def _placed(slots: list[tuple[int, int, int, int]], version: int) -> list[tuple]:
    """Rows of the map from (slot, shard, bytes, rows); first_slot numbers a shard's records from 0 in slot order."""
    at: dict[int, int] = {}
    out = []
    for slot, shard, size, n in sorted(slots):
        out.append((slot, shard, size, n, at.get(shard, 0), version))
        at[shard] = at.get(shard, 0) + n
    return out


def first_map(sizes: list[tuple[int, int, int]], n_shards: int) -> list[tuple]:
    """Version 1: the largest slot goes to the lightest shard; ties by number."""
    load = [(0, shard) for shard in range(n_shards)]
    slots = []
    for slot, size, n in sorted(sizes, key=lambda s: (-s[1], s[0])):
        held, shard = heapq.heappop(load)
        slots.append((slot, shard, size, n))
        heapq.heappush(load, (held + size, shard))
    return _placed(slots, 1)


def rebalanced(old: list[tuple], n_shards: int) -> list[tuple]:
    """The next version for ``n_shards``.

    More shards: slots move from the heaviest shards into the new ones only, while that brings the two closer. Fewer: the slots of
    the shards that are given up go to the lightest ones, largest first, and no other moves. As many: slots move from the heaviest to
    the lightest shard."""
    load = dict.fromkeys(range(n_shards), 0)
    held: dict[int, list[tuple]] = {shard: [] for shard in load}
    homeless = []
    for slot, shard, size, n, _, _ in old:
        if shard in load:
            load[shard] += size
            bisect.insort(held[shard], (size, slot, n))
        else:
            homeless.append((size, slot, n))

    def put(shard: int, one: tuple) -> None:
        load[shard] += one[0]
        bisect.insort(held[shard], one)

    new = [shard for shard, slots in held.items() if not slots]
    takers = [] if homeless else new or list(load)
    for one in sorted(homeless, reverse=True):
        put(min(load, key=lambda k: (load[k], k)), one)
    while takers:
        heavy, light = max(load, key=lambda k: (load[k], -k)), min(takers, key=lambda k: (load[k], k))
        gap = load[heavy] - load[light]
        k = max(0, bisect.bisect_right(held[heavy], (gap / 2, 1 << 62, 0)) - 1)
        if not held[heavy] or held[heavy][k][0] >= gap:
            break
        one = held[heavy].pop(k)
        load[heavy] -= one[0]
        put(light, one)
    slots = [(slot, shard, size, n) for shard, all_of in held.items() for size, slot, n in all_of]
    return _placed(slots, max((r[5] for r in old), default=0) + 1)


def write_map(spark, rows: list[tuple], path: str) -> DataFrame:
    """Append one version of the map to the table at ``path``; it has at most one row per virtual slot."""
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return read_map(spark, path)


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    table = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == F.lit(version))


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Hashed rows with their shard and a position in it, gapless from 0: the slot's first position plus the rank inside the slot.

    The map is bounded by the number of virtual slots, so it is broadcast."""
    rank = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return rows.join(F.broadcast(slot_map), "virtual_slot").withColumn("slot", F.col("first_slot") + F.row_number().over(rank) - 1)


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", n_slots: int = 4096,
                    map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot (position in the shard), version.

    Shards get near equal bytes: sizes per slot are added up, then slots are placed largest first. A null text has size 1, a
    null id hashes like a value of its own. Repeated rows share a virtual slot and get positions of their own. An empty table
    gives no rows. Other columns of ``docs`` are not read. The map of version 1 is written to ``map_path``.
    """
    spark = docs.sparkSession
    rows = settle(hashed(docs, id_col, text_col, n_slots))
    sizes = [(r[0], r[1], r[2]) for r in slot_sizes(rows).collect()]  # at most n_slots rows
    return assign(rows, write_map(spark, first_map(sizes, n_shards), map_path or new_path(spark, "slot_map")))
