"""Packing against a walk in plain Python, and its invariants."""

import random

import pytest
from pyspark.sql import functions as F

from codewarden.operators import packing
from codewarden.operators.sampling import HASH_FACTOR, HASH_RANGE, MIX_FACTOR, SEED_FACTOR


def key(idx, seed=0):
    spread = idx % 2**31 * HASH_FACTOR % HASH_RANGE
    salt = seed * SEED_FACTOR % HASH_RANGE
    return (spread ^ spread >> 15 ^ salt) * MIX_FACTOR % HASH_RANGE


def brute(lengths, seq_length, max_functions):
    """Packs of a list of (idx, n) in order."""
    packs, filled = [[]], 0
    for idx, n in lengths:
        if n >= seq_length:
            continue
        if packs[-1] and (filled + n >= seq_length or len(packs[-1]) + 1 >= max_functions):
            packs.append([])
            filled = 0
        packs[-1].append(idx)
        filled += n + 1
    return packs


def packs_of(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r["epoch"], r["pack"], r["slot"])):
        got.setdefault((r["epoch"], r["pack"]), []).append(r["idx"])
    return got


def test_worked_example(spark):
    # Lengths in the order of the walk; a pack of three functions holds two.
    want = [3, 4, 2, 9, 1, 10]
    ids = sorted(range(6), key=key)
    df = spark.createDataFrame(list(zip(ids, want)), "idx long, n int")
    got = packing.pack_sequences(df, 10, 3).collect()
    by_length = {r["n"]: r["pack"] for r in got}
    assert by_length == {3: 0, 4: 0, 2: 1, 9: 2, 1: 3}


@pytest.mark.parametrize("per_range", [3, 50, 1000])
@pytest.mark.parametrize("most", [1, 2, 6])
def test_any_ranges_give_the_one_greedy_order(spark, per_range, most):
    rng = random.Random(per_range)
    rows = [(i, rng.randrange(0, 70)) for i in range(700)]
    df = spark.createDataFrame(rows, "idx long, n int").repartition(5)
    found = packing.pack_sequences(df, 64, most, rows_per_range=per_range, fan=4).collect()
    rows.sort(key=lambda r: (key(r[0]), r[0]))
    want = {(1, i): pack for i, pack in enumerate(brute(rows, 64, most))}
    assert packs_of(found) == want
    lengths = dict(rows)
    for r in found:
        before = want[1, r["pack"]][: r["slot"] + 1]
        assert r["last_pos"] == sum(lengths[i] + 1 for i in before) - 2


def test_one_row_more_changes_nothing_before_it(spark):
    rows = sorted(((i, i * 7 % 40) for i in range(300)), key=lambda r: (key(r[0]), r[0]))
    less = spark.createDataFrame(rows[:-1], "idx long, n int")
    more = spark.createDataFrame(rows, "idx long, n int")
    one, two = (
        {(r["idx"], r["pack"], r["slot"]) for r in packing.pack_sequences(df, 64, 6, rows_per_range=40).collect()}
        for df in (less, more)
    )
    assert one < two and len(two) == len(one) + 1


def test_no_rows(spark):
    assert packing.pack_sequences(spark.createDataFrame([], "idx long, n int"), 64, 6).count() == 0


def test_invariants(spark):
    rng = random.Random(9)
    rows = {i: rng.randrange(0, 60) for i in range(500)}
    df = spark.createDataFrame(list(rows.items()), "idx long, n int")
    got = packing.pack_sequences(df, 50, 5, epochs=2).collect()
    for epoch in (1, 2):
        mine = [r for r in got if r["epoch"] == epoch]
        assert sorted(r["idx"] for r in mine) == sorted(i for i, n in rows.items() if n < 50)
    for pack in packs_of(got).values():
        assert sum(rows[i] + 1 for i in pack) <= 50 and 1 <= len(pack) <= 4
    for epoch in (1, 2):
        mine = [r["idx"] for r in got if r["epoch"] == epoch]
        walked = sorted(mine, key=lambda i: (key(i, epoch - 1), i))
        pack_of = {r["idx"]: r["pack"] for r in got if r["epoch"] == epoch}
        assert [pack_of[i] for i in walked] == sorted(pack_of.values())
    first, second = (sorted(range(500), key=lambda i: key(i, seed)) for seed in (0, 1))
    moved = sum(abs(first.index(i) - second.index(i)) > 50 for i in range(500))
    assert moved > 300  # another order, not the same one turned round


def test_emitted_arrays(spark):
    df = spark.createDataFrame(
        [(1, [5, 6], 1, 30.0), (2, [7], 0, 1.0)], "idx long, ids array<int>, target int, weight double"
    )
    sizes = df.select("idx", F.size("ids").alias("n"))
    packed = packing.pack_sequences(sizes, 8, 4)
    pack = packing.emit_packs(packed, df, 8, 4, separator=0, pad=9, weights=True).first()
    first = [5, 6, 0, 7, 0] if key(1) < key(2) else [7, 0, 5, 6, 0]
    assert pack["input_ids"] == first + [9, 9, 9]
    assert pack["attention_mask"] == [1] * 5 + [0] * 3
    assert sorted(pack["labels"]) == [-100, -100, 0, 1] and pack["labels"][2:] == [-100, -100]
    assert pack["weights"][2:] == [-100.0, -100.0]
    ends = [r["last_pos"] for r in packed.orderBy("slot").collect()]
    assert ends == ([1, 3] if key(1) < key(2) else [0, 3])


def test_unpacking_undoes_packing(spark):
    df = spark.range(100).select(F.col("id").alias("idx"), (F.col("id") % 13).cast("int").alias("n"))
    packed = packing.pack_sequences(df, 30, 5)
    logits = packed.select(
        "epoch", "pack", "slot", F.array(F.col("idx") * 1.0, F.lit(0.5)).alias("logits")
    )
    padded = packing.pad_logits(logits, 5, 2)
    assert {len(r["logits"]) for r in padded.collect()} == {5}
    back = packing.unpack_predictions(padded, packed).collect()
    assert sorted((r["idx"], r["logits"][0]) for r in back) == [(i, float(i)) for i in range(100)]



def test_tables_of_ranges_are_written_once_a_level(spark, monkeypatch):
    written, materialize = [], packing.materialize

    def counted(df, purpose):
        written.append(purpose)
        return materialize(df, purpose)

    monkeypatch.setattr(packing, "materialize", counted)
    lengths = spark.range(200).selectExpr("id AS idx", "cast(id * 37 % 60 AS int) AS n")
    cut = packing.pack_sequences(lengths, 100, 5, epochs=2, rows_per_range=10, fan=3)
    plain = packing.pack_sequences(lengths, 100, 5, epochs=2)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()))
    # 20 ranges, 7 and 3 groups of them.
    assert written.count("pack-tables") == 2
