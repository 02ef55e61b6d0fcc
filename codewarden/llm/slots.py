"""Sharding by fixed virtual slots.

Records are hashed into ``SLOTS`` slots, for good: a record's slot follows from its id and text alone.
Bytes are summed for each slot, and a map says which shard each slot is in. The map is a table of ``SLOTS``
rows with a version; rebalancing edits the map and moves whole slots, never single records by
themselves. Versions are written side by side, so a reader can pin one and a shard can say what moved.

Only the map and the sums per slot (``SLOTS`` rows, whatever the input) are seen by the driver. A record's
place in its shard is the records of the slots before its own plus its place in its slot, so nothing is sorted
by shard; slots are the unit of work, a few thousand tasks' worth.

Defined results: size is the text's UTF-8 bytes plus ``OVERHEAD``; a null text has none. A missing id is
hashed as none, and its records are told apart by text. Records equal in id and text share a slot.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.llm.common import all_columns, unused

SLOTS = 4096
OVERHEAD = 8
#: A shard may hold this much more or less than its equal share before slots move.
TOLERANCE = 0.002


def size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long"), text.cast("string")), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size(text).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        slot_of(F.col("doc_id"), text, slots).alias("virtual_slot"),
    )


def slot_totals(found: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each slot."""
    sums = found.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    weight, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in sums.collect():  # at most ``slots`` rows
        weight[r["virtual_slot"]], rows[r["virtual_slot"]] = r["bytes"], r["rows"]
    return weight, rows


def first_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """The map before anything is known of the data: equal runs of slots."""
    return np.arange(slots) * shards // slots


def rebalance(shard_of: np.ndarray, weight: np.ndarray, shards: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """An edited map: slots move from the fullest shard to the emptiest, as large as fits and no
    more than needed, until all shards are within ``tolerance`` of an equal share or no move helps.
    ``shards`` may be more than the map has so far, or fewer."""
    out = shard_of.copy()
    total = np.bincount(out, weight, max(shards, int(out.max(initial=0)) + 1)).astype(np.int64)
    goal = weight.sum() / shards
    held: list[list[int]] = [[] for _ in total]
    for slot in np.argsort(weight, kind="stable"):
        held[out[slot]].append(int(slot))

    def move(slot: int, source: int, target: int) -> None:
        held[source].remove(slot)
        # Kept in order of size.
        at = int(np.searchsorted(weight[held[target]], weight[slot])) if held[target] else 0
        held[target].insert(at, slot)
        out[slot] = target
        total[source] -= weight[slot]
        total[target] += weight[slot]

    # Shards that are no more give all they have, largest slots first, to the emptiest.
    heap = [(int(total[s]), s) for s in range(shards)]
    heapq.heapify(heap)
    for source in range(shards, len(total)):
        for slot in reversed(held[source].copy()):
            _, target = heapq.heappop(heap)
            move(slot, source, target)
            heapq.heappush(heap, (int(total[target]), target))
    for _ in range(4 * len(out)):
        full, empty = int(total[:shards].argmax()), int(total[:shards].argmin())
        if max(total[full] - goal, goal - total[empty]) <= tolerance * goal:
            break
        gap = total[full] - total[empty]
        # The best move leaves both near their middle; failing a move, a swap of two slots may.
        sizes = weight[held[full]]
        fits = np.flatnonzero((sizes > 0) & (sizes < gap))
        if len(fits):
            best = fits[np.abs(sizes[fits] - gap / 2).argmin()]
            if sizes[best] <= gap * 0.75 or not held[empty]:
                move(held[full][int(best)], full, empty)
                continue
        if not held[empty]:
            break
        other = weight[held[empty]]
        give = np.arange(len(sizes))
        take = np.clip(np.searchsorted(other, sizes - gap / 2), 0, len(other) - 1)
        change = sizes - other[take]
        good = np.flatnonzero((change > 0) & (change < gap))
        if not len(good):
            break
        pick = good[np.abs(change[good] - gap / 2).argmin()]
        a, b = held[full][int(give[pick])], held[empty][int(take[pick])]
        move(a, full, empty)
        move(b, empty, full)
    return out


def map_frame(spark: SparkSession, shard_of: np.ndarray, rows: np.ndarray, version: int) -> DataFrame:
    """The map as a table: version, virtual_slot, shard, and the rows of the shard's earlier slots."""
    order = np.lexsort((np.arange(len(shard_of)), shard_of))
    before = np.cumsum(rows[order]) - rows[order]
    head = np.searchsorted(shard_of[order], shard_of[order])
    offset = np.zeros(len(shard_of), np.int64)
    offset[order] = before - before[head]
    table = [(version, int(s), int(shard_of[s]), int(offset[s])) for s in range(len(shard_of))]
    return spark.createDataFrame(table, "version int, virtual_slot int, shard int, offset long")


def write_map(frame: DataFrame, path: str, version: int) -> None:
    """One version of the map; versions are folders of their own and are never overwritten."""
    frame.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version:06d}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest unless one is named."""
    schema = "virtual_slot int, shard int, offset long, version int"
    every = spark.read.schema(schema).option("basePath", path).parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == version)


ADDED = ("virtual_slot", "version", "shard", "slot")


def place(found: DataFrame, slot_map: DataFrame, order: list | None = None) -> DataFrame:
    """``found`` (virtual_slot, ...) with version, shard and ``slot``, the record's place in its shard, gapless
    from 0. ``order`` orders the records of a slot, by id, digest and size if it isn't given."""
    order = ["doc_id", "text_crc32", "size"] if order is None else order
    number, entry = unused(found.columns, "__n"), unused(found.columns, "__entry")
    within = W.partitionBy("virtual_slot").orderBy(*order)
    numbered = found.withColumn(number, F.row_number().over(within) - 1)
    # The map is a fixed number of rows.
    entries = slot_map.select("virtual_slot", F.struct("version", "shard", "offset").alias(entry))
    return numbered.join(F.broadcast(entries), "virtual_slot").select(
        "virtual_slot",
        *[c for c, name in zip(all_columns(found), found.columns, strict=True) if name.lower() != "virtual_slot"],
        F.col(f"{entry}.version").alias("version"),
        F.col(f"{entry}.shard").alias("shard"),
        (F.col(f"{entry}.offset") + F.col(number)).cast("long").alias("slot"),
    )


def place_documents(docs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Whole documents with their place. Columns of theirs that are called as an added one is
    (``ADDED``) come back as ``input_`` and their name."""
    names = {c: unused([x for x in docs.columns if x != c], f"input_{c}") for c in docs.columns if c.lower() in ADDED}
    rows = docs.withColumnsRenamed(names)
    rows = rows.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text")))
    return place(rows, slot_map, ["doc_id", F.xxhash64("text")])
