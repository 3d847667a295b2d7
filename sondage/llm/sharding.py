"""Operator 2, sharding through fixed virtual slots.

A record's id and text hash it into one of `n_slots` virtual slots, whatever the number of
shards. Bytes and rows are summed for each slot, and a versioned map (slot to shard) of at most
`n_slots` rows gives each slot its shard. Rebalancing edits the map: it moves as few slots as
the new number of shards needs and leaves all others where they are.

Defined results: a null text has size 1; records with null ids spread by their text; repeated
rows share their slot; an empty table gives an empty result and a map without rows; extra
columns are left alone. Size is the text's UTF-8 bytes plus 1.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import shared_path, written

N_SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, n_rows long"


def keyed_records(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Slim rows: doc_id, size, text_crc32, virtual_slot. Texts go no further than this."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int")
    return slim.withColumn("virtual_slot", slot)


def slot_stats(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot: at most n_slots rows, combined on the map side."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def first_map(stats: list[tuple[int, int, int]], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """Version 1 of the map: largest slot first, each to the shard with the fewest bytes so far.

    `stats` has (slot, bytes, rows) and no more rows than there are virtual slots.
    """
    heap = [(0, shard) for shard in range(n_shards)]
    out = []
    for slot, size, rows in sorted(stats, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out.append((1, slot, shard, size, rows))
        heapq.heappush(heap, (load + size, shard))
    return out


def edited_map(current: list[tuple[int, int, int, int, int]], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """The next version for `n_shards` shards.

    Slots of shards that no longer exist move first; then slots move from the fullest to the
    emptiest shard while that narrows the gap between the two. All others stay.
    """
    version = max((x[0] for x in current), default=0) + 1
    held: dict[int, list[tuple[int, int, int]]] = {shard: [] for shard in range(n_shards)}
    homeless = []
    for _, slot, shard, size, rows in current:
        (held[shard] if shard < n_shards else homeless).append((size, slot, rows))
    load = {shard: sum(x[0] for x in slots) for shard, slots in held.items()}
    for item in sorted(homeless, key=lambda x: (-x[0], x[1])):
        shard = min(load, key=lambda s: (load[s], s))
        held[shard].append(item)
        load[shard] += item[0]
    while True:
        full, thin = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[full] - load[thin]
        item = max((x for x in held[full] if 2 * x[0] <= gap and x[0]), default=None)
        if item is None:
            break
        held[full].remove(item)
        held[thin].append(item)
        load[full] -= item[0]
        load[thin] += item[0]
    return sorted((version, slot, shard, size, rows) for shard, slots in held.items() for size, slot, rows in slots)


def write_map(spark: SparkSession, path: str, rows: list[tuple[int, int, int, int, int]]) -> None:
    """Store one version; earlier versions stay readable."""
    version = rows[0][0] if rows else 1
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version:06d}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version:06d}")


def shard_records(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record with its shard and a gapless position in that shard.

    Positions are numbered inside each virtual slot and shifted by the rows of the shard's
    earlier slots, so no task holds a whole shard. The map is broadcast: it has n_slots rows at most.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = records.withColumn("place", F.row_number().over(inside)).join(F.broadcast(starts), "virtual_slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), "virtual_slot")


def shard_documents(docs: DataFrame, n_shards: int = 8, *, map_path: str | None = None, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write version 1 of the map for `docs` and return every record with its shard."""
    spark = docs.sparkSession
    map_path = map_path or shared_path(spark, "slot-map")
    records = written(keyed_records(docs, id_col=id_col, text_col=text_col, n_slots=n_slots), "sharding-records")
    stats = [tuple(x) for x in slot_stats(records).collect()]  # n_slots rows at most
    write_map(spark, map_path, first_map(stats, n_shards))
    return shard_records(records, read_map(spark, map_path, 1))
