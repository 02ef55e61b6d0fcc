"""Packing several functions into sequences of a fixed length, and back.

There is one greedy order: where a pack closes depends on all functions before it. But where a
pack that starts at a given row ends depends on that row alone, so the order is cut in ranges of
rows, and each range says, for every row a pack may enter it at, where the range is left and after how
many packs. Those short tables are composed over the ranges; then every range knows its entry and
numbers its own packs. The result doesn't depend on how the order is cut. Tokens take no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions.numeric import PAD_LABEL, PAD_LOGIT
from codewarden.operators.ordered import running_totals
from codewarden.operators.sampling import HASH_RANGE, shuffle_key
from codewarden.support import materialize, stored

ROWS_PER_RANGE = 50_000
#: Ranges whose tables one task composes.
FAN = 1_000


class _Steps:
    """For each row of a range, where a pack that starts there ends; ``own`` rows are the
    range's, the others follow it."""

    def __init__(self, n: np.ndarray, own: int, seq_length: int, max_functions: int):
        self.own = own
        self.sums = np.concatenate([[0], np.cumsum(n + 1)])
        rows = np.arange(len(n))
        # The first row that would reach the sequence's length together with all before it.
        full = np.searchsorted(self.sums[1:] - 1, seq_length + self.sums[:-1], "left")
        self.next = np.maximum(rows + 1, np.minimum(full, rows + max_functions - 1))

    def _jumps(self):
        """(next, packs) over 1, 2, 4, ... packs, until every row has left the range."""
        size = max(int(self.next.max(initial=0)), len(self.next)) + 1
        jump, packs = np.arange(size), np.zeros(size, np.int64)
        jump[: self.own], packs[: self.own] = self.next[: self.own], 1
        while True:
            yield jump, packs
            if (jump >= self.own).all():
                return
            packs, jump = packs + packs[jump], jump[jump]

    def table(self, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the next range is entered, and how many packs start here, by entry row."""
        for jump, packs in self._jumps():
            pass
        entry = np.arange(entries)
        inside = entry < self.own
        at = np.where(inside, entry, 0)
        return (
            np.where(inside, jump[at], entry) - self.own,
            np.where(inside, packs[at], 0),
        )

    def starts(self, entry: int) -> np.ndarray:
        """The rows at which packs start, for a given entry."""
        if entry >= self.own:
            return np.zeros(0, np.int64)
        seen = np.zeros(max(int(self.next.max(initial=0)), len(self.next)) + 1, bool)
        seen[entry] = True
        for jump, _ in self._jumps():
            seen[jump[seen]] = True
        return np.flatnonzero(seen[: self.own])


def _by_range(rows: DataFrame, keys: Sequence[str], work, schema: str) -> DataFrame:
    """``work`` on the rows of each (keys), as ``applyInPandas`` would, but many short groups a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            found = batch[list(keys)].to_numpy()
            bounds = [0, *(np.flatnonzero((found[1:] != found[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            done = []
            for first, last in zip(bounds, bounds[1:]):
                if open_rows and (first or (open_rows[0][list(keys)].to_numpy()[0] != found[0]).any()):
                    done.append(work(pd.concat(open_rows, ignore_index=True)))
                    open_rows = []
                open_rows.append(batch.iloc[first:last])
            if done:
                yield pd.concat(done, ignore_index=True)
        if open_rows:
            yield work(pd.concat(open_rows, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _entries(tables: DataFrame, ranges: int, fan: int = FAN) -> DataFrame:
    """(epoch, range, entry, first_pack) from (epoch, range, exits, packs), ``ranges`` an epoch."""
    walked = "epoch int, range long, entry int, first_pack long"

    def walk(rows: pd.DataFrame, entry: int, pack: int) -> pd.DataFrame:
        found = []
        for row in rows.sort_values("range").itertuples():
            found.append((row.epoch, row.range, entry, pack))
            entry, pack = int(row.exits[entry]), pack + int(row.packs[entry])
        return pd.DataFrame(found, columns=["epoch", "range", "entry", "first_pack"])

    if ranges <= fan:
        return tables.groupBy("epoch").applyInPandas(lambda rows: walk(rows, 0, 0), walked)
    # Read by the levels above and by the walk: written, not composed again for each.
    tables = materialize(tables, "pack-tables")
    grouped = tables.withColumn("group", F.floor(F.col("range") / fan))

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("range")
        first = rows.iloc[0]
        at, packs = np.arange(len(first["exits"])), np.zeros(len(first["exits"]), np.int64)
        for exits, own in zip(rows["exits"], rows["packs"]):
            packs = packs + np.asarray(own)[at]
            at = np.asarray(exits)[at]
        return pd.DataFrame(
            {"epoch": [first["epoch"]], "range": [first["group"]], "exits": [at], "packs": [packs]}
        )

    upper = _by_range(
        grouped, ["epoch", "group"], compose, "epoch int, range long, exits array<int>, packs array<long>"
    )
    known = _entries(upper, -(-ranges // fan), fan).withColumnRenamed("range", "group")
    return _by_range(
        grouped.join(known, ["epoch", "group"]),
        ["epoch", "group"],
        lambda rows: walk(rows, int(rows["entry"].iloc[0]), int(rows["first_pack"].iloc[0])),
        walked,
    )


def pack_sequences(
    lengths: DataFrame,
    seq_length: int,
    max_functions: int = 200,
    seed: int = 0,
    epochs: int = 1,
    key: str = "idx",
    size: str = "n",
    rows_per_range: int = ROWS_PER_RANGE,
    fan: int = FAN,
) -> DataFrame:
    """Assign each function to a pack: (epoch, pack, slot, idx, n, last_pos).

    A function takes its tokens and one separator. A pack closes when the next function would
    reach the sequence length, or the number of functions would reach ``max_functions``.
    Functions that are as long as a sequence are left out. ``last_pos`` is the position of the
    function's last token. Each epoch has an order of its own.
    """
    # Lengths are what a tokeniser has counted: they are computed once, here. A filter before the
    # write would have them computed for itself.
    counted = lengths.select(F.col(key).cast("long").alias("idx"), F.col(size).cast("int").alias("n"))
    counted, rows = stored(counted, "lengths")
    fitting = counted.filter(F.col("n") < seq_length)
    own = max(rows_per_range, max_functions)
    cells = -(-rows // own) or 1
    epoch = F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch")
    keyed = fitting.select(epoch, "idx", "n").withColumn(
        "key", shuffle_key(F.col("idx"), F.col("epoch") - 1 + seed)
    )
    # Keys are evenly spread, so equal parts of their range are ranges of similar size.
    keyed = keyed.withColumn("__cell", F.floor(F.col("key") * cells / HASH_RANGE).cast("int"))
    placed = running_totals(
        keyed,
        ["key", "idx"],
        {"__at": F.lit(1).cast("long")},
        keys=["epoch"],
        cells=["__cell"],
        rows_per_range=own,
        most_rows=rows,
    )
    placed = placed.select("epoch", (F.col("__at") - 1).alias("at"), "idx", "n")
    if cells > 1:
        placed = materialize(placed, "pack-order")
    # The first rows of a range also follow the range before it.
    mine = F.floor(F.col("at") / own)
    follows = (F.col("at") % own < max_functions - 1) & (mine > 0)
    both = F.when(follows, F.array(mine, mine - 1)).otherwise(F.array(mine))
    ranged = placed.withColumn("range", F.explode(both))

    def steps(rows: pd.DataFrame) -> tuple[pd.DataFrame, _Steps]:
        rows = rows.sort_values("at")
        end = (int(rows["range"].iloc[0]) + 1) * own
        n = rows["n"].to_numpy(np.int64)
        return rows, _Steps(n, int((rows["at"] < end).sum()), seq_length, max_functions)

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        rows, found = steps(rows)
        exits, packs = found.table(max_functions)
        head = rows.iloc[0]
        return pd.DataFrame(
            {"epoch": [head["epoch"]], "range": [head["range"]], "exits": [exits], "packs": [packs]}
        )

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows, found = steps(rows)
        starts = found.starts(int(rows["entry"].iloc[0]))
        at = np.arange(len(rows))
        turn = np.searchsorted(starts, at, "right") - 1
        start = starts[np.maximum(turn, 0)] if len(starts) else np.zeros(len(rows), np.int64)
        # Rows before the entry belong to the range before, rows behind the last pack to the next.
        held = (turn >= 0) & (at < found.next[start])
        return pd.DataFrame(
            {
                "epoch": rows["epoch"].to_numpy(),
                "pack": rows["first_pack"].to_numpy() + turn,
                "slot": at - start,
                "idx": rows["idx"].to_numpy(),
                "n": rows["n"].to_numpy(),
                "last_pos": found.sums[at + 1] - found.sums[start] - 2,
            }
        )[held]

    if cells > 1:
        tables = _by_range(
            ranged, ["epoch", "range"], table, "epoch int, range long, exits array<int>, packs array<long>"
        )
        entered = ranged.join(_entries(tables, cells, fan), ["epoch", "range"])
    else:
        # Only the first range, which every epoch enters at its first row.
        entered = ranged.withColumns({"entry": F.lit(0), "first_pack": F.lit(0).cast("long")})
    return _by_range(
        entered, ["epoch", "range"], assign, "epoch int, pack long, slot int, idx long, n int, last_pos int"
    )


def emit_packs(
    packed: DataFrame,
    functions: DataFrame,
    seq_length: int,
    max_functions: int,
    separator: int,
    pad: int,
    weights: bool = False,
) -> DataFrame:
    """Packs as padded arrays: input_ids, labels, attention_mask and, if asked, weights.

    ``functions`` holds (idx, ids, target[, weight]). A group holds the functions of one pack,
    at most ``max_functions - 1`` of them and ``seq_length`` tokens.
    """
    item = ["slot", "ids", "target"] + (["weight"] if weights else [])
    rows = packed.select("epoch", "pack", "slot", "idx").join(functions, "idx")
    packs = rows.groupBy("epoch", "pack").agg(
        F.array_sort(F.collect_list(F.struct(*item))).alias("items")
    )

    def padded(values: Column, length: int, filler: Column) -> Column:
        missing = F.greatest(F.lit(0), length - F.size(values))
        return F.concat(values, F.array_repeat(filler, missing))

    tokens = F.flatten(
        F.transform("items", lambda x: F.concat(x["ids"], F.array(F.lit(separator))))
    )
    used = F.aggregate(
        "items", F.lit(0), lambda acc, x: acc + F.size(x["ids"]) + F.lit(1)
    )
    columns = {
        "input_ids": padded(tokens, seq_length, F.lit(pad)),
        "labels": padded(
            F.transform("items", lambda x: x["target"].cast("int")), max_functions, F.lit(PAD_LABEL)
        ),
        "attention_mask": F.concat(
            F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), seq_length - used)
        ),
    }
    if weights:
        columns["weights"] = padded(
            F.transform("items", lambda x: x["weight"].cast("double")),
            max_functions,
            F.lit(float(PAD_LABEL)),
        )
    return packs.select(
        "epoch", "pack", *[c.alias(name) for name, c in columns.items()]
    )


def pack_stats(packed: DataFrame, seq_length: int, keys: Sequence[str] = ("epoch",)) -> DataFrame:
    """Number of packs and functions, and the share of positions that hold a token or separator."""
    packs = packed.groupBy(*dict.fromkeys([*keys, "epoch", "pack"])).agg(
        F.count(F.lit(1)).alias("functions"), F.sum(F.col("n") + 1).alias("filled")
    )
    return packs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packs"),
        F.sum("functions").alias("functions"),
        (F.sum("filled") / (F.count(F.lit(1)) * F.lit(float(seq_length)))).alias("fill"),
    )


def pad_logits(packed_logits: DataFrame, max_functions: int, classes: int) -> DataFrame:
    """Per-function logits (epoch, pack, slot, logits) as one padded array a pack."""
    filler = F.array(*[F.lit(PAD_LOGIT) for _ in range(classes)])
    packs = packed_logits.groupBy("epoch", "pack").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("slot", "logits"))), lambda x: x["logits"]
        ).alias("logits")
    )
    missing = max_functions - F.size("logits")
    return packs.withColumn("logits", F.concat("logits", F.array_repeat(filler, missing)))


def unpack_predictions(pack_logits: DataFrame, packed: DataFrame) -> DataFrame:
    """Back to one row per function: the padded logits joined to the functions' slots."""
    slots = pack_logits.select(
        "epoch", "pack", F.posexplode_outer("logits").alias("slot", "logits")
    )
    return packed.join(slots, ["epoch", "pack", "slot"])
