"""Near-duplicates by HyperMinHash registers, banding and exact verification.

1. Each text gives the set of its distinct word shingles (64-bit hashes). The hashes are dealt to
   ``BUCKETS`` buckets by their first bits; a bucket keeps its least value, compressed to a count
   of leading zeros and some mantissa bits: 16 bits a register.
2. Texts with equal sets are one class. Everything below works on classes.
3. Empty registers are filled from other buckets of the same set, chosen by a fixed table, and
   ``BANDS`` groups of four registers are joined. In every bucket of equal bands the member of least
   id is the hub; (member, hub) pairs are compared by the collision-corrected Jaccard estimate
   and, unless that is out of reach, on full sets.
4. Connected components contract the verified links. A hub and all it shares a bucket with are its
   group; groups that still hold several components are finished off: every member outside the
   hub's component is compared, on full sets, with all members of other components, in blocks
   of bounded size. No pair that shares a band goes unseen, and a block gives no more links than it
   takes to join its components.

Nothing is capped: a bucket of any size costs a row for each member, and step 4 splits it.

Defined results: a null, empty or blank text has an empty set, forms its own component and is kept.
Fewer words than a shingle make one shingle of the whole sequence. Rows with equal id and text
are one document. A missing id counts as least. Any other column is left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm import words
from codewarden.llm.common import NO_ID, all_columns, matching, row_key, written
from codewarden.llm.components import connected

SHINGLE = 5
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 75
BUCKETS = 128
BANDS = 32
MANTISSA = 10
EMPTY = 0xFFFF
#: Bits of a hash below the bucket number that a register is made of; exact as a double.
VALUE_BITS = 53
#: Standard deviations by which an estimate may fall short before the full sets are compared.
SLACK = 5.0
#: Members of a group that one side of a block of the last comparison holds.
BLOCK = 512
#: Shared shingles that are counted at once within a block.
COLUMNS = 2048

SIGNED = "__id long, __text long, doc_id long, n_shingles long, node binary, regs binary, bands binary"


def shingle_sets(
    texts: pa.Array, size: int = SHINGLE
) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    hashes, first, _ = words.word_hashes(texts)
    offsets = list(range(size))
    full = words.window_hashes(hashes, offsets, salt=size)
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            short = words.window_hashes(hashes[a:b], offsets[: b - a], salt=100 + b - a)
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets, first


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of compressed registers for each set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    least = np.full(len(sets) * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    if sizes.sum():
        values = np.concatenate(sets)
        shift = np.uint64(64 - int(np.log2(BUCKETS)))
        cell = np.repeat(np.arange(len(sets)) * BUCKETS, sizes) + (values >> shift).astype(np.int64)
        low = (values >> np.uint64(64 - int(np.log2(BUCKETS)) - VALUE_BITS)) & np.uint64(
            2**VALUE_BITS - 1
        )
        np.minimum.at(least, cell, low)
    known = least <= np.uint64(2**VALUE_BITS - 1)
    held = np.where(known, least, 0)
    length = np.frexp(held.astype(np.float64))[1]  # bits of the value, 0 for 0
    zeros = VALUE_BITS - length
    spare = length - 1 - MANTISSA
    after = np.where(
        spare >= 0,
        held >> np.maximum(spare, 0).astype(np.uint64),
        held << np.maximum(-spare, 0).astype(np.uint64),
    )
    code = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (after & np.uint64(2**MANTISSA - 1))
    return np.where(known, code, EMPTY).astype(np.uint16).reshape(len(sets), BUCKETS)


def _donors(tries: int) -> np.ndarray:
    order = words.mix(np.arange(tries * BUCKETS, dtype=np.uint64) + np.uint64(0xD0)) % np.uint64(BUCKETS)
    return order.astype(np.int64).reshape(tries, BUCKETS)


DONORS = _donors(4 * BUCKETS)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with empty ones taken from the first full bucket in their row of the table."""
    out = regs.copy()
    rows, cols = np.nonzero(out == EMPTY)
    live = (regs != EMPTY).any(axis=1)[rows]
    rows, cols = rows[live], cols[live]
    for donors in DONORS:
        if not len(rows):
            break
        given = regs[rows, donors[cols]]
        got = given != EMPTY
        out[rows[got], cols[got]] = given[got]
        rows, cols = rows[~got], cols[~got]
    for row in np.unique(rows):  # a set of a few shingles that no try has met
        mine = cols[rows == row]
        out[row, mine] = regs[row][regs[row] != EMPTY][mine % (regs[row] != EMPTY).sum()]
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
    """Jaccard estimate of paired register rows and the number of buckets it rests on. The
    matches that two unrelated sets of these sizes have by chance are taken off."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    more, less = np.maximum(na, nb).astype(float), np.maximum(np.minimum(na, nb), 1).astype(float)
    ratio = 4 * more / less / np.square((1 + more) / less)
    chance = 0.169919487159739093975315012348630288992889 * BUCKETS / 2.0**MANTISSA * ratio
    return np.maximum(same - chance, 0) / np.maximum(used, 1), used


def in_reach(a, b, na, nb, percent: int = PERCENT) -> np.ndarray:
    """Pairs whose estimate and sizes leave a link possible."""
    goal = percent / 100
    guess, used = estimate(a, b, na, nb)
    short = SLACK * np.sqrt(goal * (1 - goal) / np.maximum(used, 1))
    return (guess >= goal - short) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """For each document the size of its set, a digest of it (``node``; null if empty), its
    registers and, as eight bytes each, its bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.strips(batches):
            sets, _ = shingle_sets(batch.column("text"), shingle)
            regs = registers(sets)
            full = filled(regs)
            a, b = words.seeds(2, salt=77)
            nodes = [
                None
                if not len(s)
                else np.array(
                    [words.mix(s * a).sum(dtype=np.uint64), words.mix(s ^ b).sum(dtype=np.uint64)]
                ).tobytes()
                for s in sets
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id"),
                    batch.column("__text"),
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.array([r.tobytes() for r in full], pa.binary()),
                ],
                names=[part.split()[0] for part in SIGNED.split(", ")],
            )

    rows = docs.select(
        F.col("text").cast("string").alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
    ).withColumns(row_key())
    return rows.mapInArrow(sign, SIGNED)


def sets_of(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, items): the full sets of documents that come as (node, text)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.strips(batches):
            sets, _ = shingle_sets(batch.column("text"), shingle)
            ends = np.cumsum([0, *[len(s) for s in sets]])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            items = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64())
            )
            yield pa.RecordBatch.from_arrays([batch.column("node"), items], names=["node", "items"])

    return docs.select("node", "text").mapInArrow(unpack, "node binary, items array<long>")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, node) that the estimate leaves in reach."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_reach(
                _rows(batch.column("regs_hub")),
                _rows(batch.column("regs_node")),
                batch.column("n_hub").to_numpy(),
                batch.column("n_node").to_numpy(),
                percent,
            )
            yield batch.select(["hub", "node"]).filter(pa.array(keep))

    def side(name):
        return nodes.select(
            F.col("node").alias(name),
            F.col("n").alias(f"n_{name}"),
            F.col("regs").alias(f"regs_{name}"),
        )

    sized = pairs.join(side("node"), "node").join(side("hub"), "hub")
    sized = sized.filter(
        100 * F.least("n_hub", "n_node") >= percent * F.greatest("n_hub", "n_node")
    )
    return sized.mapInArrow(look, "hub binary, node binary")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, node) that hold on full sets, as links (a, b)."""

    def side(name):
        return full.select(F.col("node").alias(name), F.col("items").alias(f"items_{name}"))

    both = pairs.join(side("node"), "node").join(side("hub"), "hub")
    shared = F.size(F.array_intersect("items_hub", "items_node"))
    union = F.size("items_hub") + F.size("items_node") - shared
    return both.filter(100 * shared >= percent * union).select(
        F.col("hub").alias("a"), F.col("node").alias("b")
    )


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``one`` with all of ``two``."""
    flat = [np.concatenate(sets) if sets else np.zeros(0, np.int64) for sets in (one, two)]
    common = np.intersect1d(flat[0], flat[1])
    out = np.zeros((len(one), len(two)), np.float32)
    if not len(common):
        return out
    sides = []
    for sets, values in ((one, flat[0]), (two, flat[1])):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        held = common[at] == values
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], owner[held][order], len(sets)))
    for begin in range(0, len(common), COLUMNS):
        tables = []
        for at, owner, rows in sides:
            lo, hi = np.searchsorted(at, [begin, begin + COLUMNS])
            table = np.zeros((rows, min(COLUMNS, len(common) - begin)), np.float32)
            table[owner[lo:hi], at[lo:hi] - begin] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _joins(block: pa.Table, percent: int) -> list[tuple[bytes, bytes]]:
    """The links between components of one block that it takes to join them."""
    asks = block.column("asks").to_numpy()
    parts = block.column("part").to_pylist()
    column = block.column("items").combine_chunks()
    sets = [s.values.to_numpy() for s in column]
    one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(one) or not len(two):
        return []
    shared = shared_counts([sets[i] for i in one], [sets[i] for i in two])
    sizes = np.array([len(s) for s in sets], np.float32)
    union = sizes[one][:, None] + sizes[two][None, :] - shared
    number = {part: n for n, part in enumerate(dict.fromkeys(parts))}
    of = np.array([number[part] for part in parts])
    linked = (100 * shared >= percent * union) & (of[one][:, None] != of[two][None, :])
    root = list(range(len(number)))

    def top(n: int) -> int:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    names, found = list(number), []
    pairs = np.stack([of[one][np.nonzero(linked)[0]], of[two][np.nonzero(linked)[1]]], axis=1)
    for a, b in np.unique(pairs, axis=0):
        x, y = top(int(a)), top(int(b))
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((names[a], names[b]))
    return found


def _left_over(groups: DataFrame, parts: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, found within hubs' groups (hub, node)."""
    members = groups.unionByName(groups.select("hub", F.col("hub").alias("node")).distinct())
    members = members.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    mixed = (
        members.groupBy("hub")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("part").alias("lo"),
            F.max("part").alias("hi"),
            F.max(F.when(F.col("node") == F.col("hub"), F.col("part"))).alias("hub_part"),
        )
        .filter("size > 2 AND lo <> hi")
        .select("hub", "size", "hub_part")
    )
    rows = written(
        members.join(mixed, "hub").withColumn("out", F.col("part") != F.col("hub_part")), "mixed"
    )
    if rows.isEmpty():
        return groups.select(F.col("hub").alias("a"), F.col("node").alias("b")).limit(0)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    # A member stands in one column of blocks; one outside the hub's component also runs along
    # a row of them. Members go only to rows of blocks that somebody runs along.
    asking = rows.filter("out").select("hub", "node", "part", "size", mine.alias("ask"))
    in_use = asking.groupBy("hub").agg(F.collect_set("ask").alias("rows_in_use"))
    asking = asking.select(
        "hub", "node", "part", "ask", F.explode(every).alias("col"), F.lit(True).alias("asks")
    )
    asked = rows.join(in_use, "hub").select(
        "hub",
        "node",
        "part",
        F.explode("rows_in_use").alias("ask"),
        mine.alias("col"),
        F.lit(False).alias("asks"),
    )
    key = ["hub", "ask", "col"]
    dealt = (
        asking.select(*key, "node", "part", "asks")
        .unionByName(asked.select(*key, "node", "part", "asks"))
        .join(full, "node")
        .select(*key, "part", "asks", "items")
        .repartition(*key)
        .sortWithinPartitions(*key)
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(block: list[pa.Table]) -> pa.RecordBatch:
            found = _joins(pa.concat_tables(block), percent)
            columns = [pa.array([f[n] for f in found], pa.binary()) for n in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        held: list[pa.Table] = []
        name = None
        for batch in batches:
            rows_ = pa.Table.from_batches([batch])
            names = list(zip(*[batch.column(k).to_pylist() for k in key], strict=True))
            begin = 0
            for at in range(1, len(names) + 1):
                if at < len(names) and names[at] == names[begin]:
                    continue
                if held and name != names[begin]:
                    yield links(held)
                    held = []
                name = names[begin]
                held.append(rows_.slice(begin, at - begin))
                begin = at
        if held:
            yield links(held)

    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): its key columns, ``doc_id``, ``n_shingles``,
    ``node``, ``component_id`` (least id that links reach) and ``first``, true for the one document
    of each component that stays."""
    signed = written(signatures(docs, shingle), "signatures")
    # The least row stands for its class; its text is what sets are taken from.
    nodes = written(
        signed.filter("node is not null")
        .groupBy("node")
        .agg(
            F.min(F.struct("__id", "__text")).alias("holder"),
            F.first("n_shingles").alias("n"),
            F.first("regs").alias("regs"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    banded = nodes.select(
        "node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "bands"
    ).select("node", "band", F.substring("bands", 8 * F.col("band") + 1, F.lit(8)).alias("key"))
    hubs = (
        banded.groupBy("band", "key")
        .agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
        .select("band", "key", "hub")
    )
    groups = written(
        banded.join(hubs, ["band", "key"]).filter("node <> hub").select("hub", "node").distinct(),
        "groups",
    )
    crowded = groups.select(F.explode(F.array("hub", "node")).alias("node")).distinct()
    holders = nodes.join(crowded, "node").select("node", "holder.__id", "holder.__text")
    texts = (
        docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id"))
        .withColumns(row_key())
        .join(holders, ["__id", "__text"])
        .dropDuplicates(["__id", "__text"])
    )
    full = written(sets_of(texts, shingle), "sets")
    links = written(_verified(_near(groups, nodes, percent), full, percent), "hub-links")
    parts = written(connected(links), "components")
    more = written(_left_over(groups, parts, full, percent), "other-links")
    if not more.isEmpty():
        # These links are between components.
        then = connected(more)
        every = parts.unionByName(
            then.select("node", F.col("node").alias("part")).join(parts, "node", "left_anti")
        )
        then = then.select(F.col("node").alias("part"), F.col("part").alias("then"))
        parts = every.join(then, "part", "left").select(
            "node", F.coalesce("then", "part").alias("part")
        )
        parts = written(parts, "components")
    placed = nodes.select("node", "holder").join(parts, "node")
    least = placed.groupBy("part").agg(F.min("holder").alias("least"))
    least = placed.join(least, "part").select("node", "least")
    heads = (
        nodes.select("node", "holder")
        .join(least, "node", "left")
        .select("node", F.coalesce("least", "holder").alias("least"))
    )
    alone = F.struct("__id", "__text")
    out = signed.select("__id", "__text", "doc_id", "n_shingles", "node").join(heads, "node", "left")
    out = out.withColumn("least", F.coalesce("least", alone))
    return out.select(
        "__id",
        "__text",
        "doc_id",
        "n_shingles",
        "node",
        F.nullif("least.__id", F.lit(NO_ID)).alias("component_id"),
        (F.col("least") == alone).alias("first"),
    )


def dedupe(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, one row of each group, in all their columns. Texts without words
    are linked with nothing, so each id of such a text stays."""
    stay = (
        near_duplicates(docs, shingle, percent)
        .filter("first")
        .select("__id", "__text")
        .distinct()
    )
    kept, key = matching(docs, stay, "left_semi")
    return kept.dropDuplicates([key]).select(*all_columns(docs))
