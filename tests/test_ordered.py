"""Running totals and ranks give the same result however the order is cut."""

import random

import pytest
from pyspark.sql import functions as F

from codewarden.operators import classes, curves, lines, sampling
from codewarden.operators.ordered import (
    global_rank,
    rank_within,
    running_totals,
    with_ranges,
)


@pytest.fixture(scope="module")
def rows():
    """A third of all rows shares one score, and most of those one function."""
    rng = random.Random(5)
    out = []
    for i in range(3000):
        score = 0.25 if i % 3 == 0 else rng.randrange(400) / 400.0
        func = 7 if i % 3 == 0 and i % 5 else rng.randrange(50)
        out.append((score, func, i, i % 2))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "score double, func_id long, line_idx int, label int")


ORDER = ["score", "func_id", "line_idx"]


@pytest.mark.parametrize("size", [10_000, 500, 100, 25])
def test_rank(df, rows, size):
    ranked = global_rank(df, ORDER, rows_per_range=size).collect()
    want = {r: i + 1 for i, r in enumerate(sorted(rows))}
    assert {tuple(r[:4]): r["rank"] for r in ranked} == want


def test_ties_are_split(df, rows):
    cut, cells = with_ranges(df, ORDER, 100)
    largest = cut.groupBy(*cells).count().agg(F.max("count")).first()[0]
    assert len(cells) == 3
    assert largest <= 300  # while one score alone holds a third of 3000 rows


def test_ranges_follow_the_order(df, rows):
    cut, cells = with_ranges(df, ORDER, 100)
    got = cut.collect()
    by_order = sorted(got, key=lambda r: tuple(r[c] for c in ORDER))
    by_cell = [tuple(r[c] for c in cells) for r in by_order]
    assert by_cell == sorted(by_cell)


@pytest.mark.parametrize("size", [10_000, 100])
def test_totals_with_keys_and_grand(df, rows, size):
    got = running_totals(
        df,
        ORDER,
        {"sum": F.col("line_idx").cast("long")},
        keys=["label"],
        grand={"sum": "all"},
        rows_per_range=size,
    ).collect()
    for label in (0, 1):
        mine = sorted(r for r in rows if r[3] == label)
        total, want = 0, {}
        for r in mine:
            total += r[2]
            want[r] = total
        assert {tuple(r[:4]): r["sum"] for r in got if r["label"] == label} == want
        assert {r["all"] for r in got if r["label"] == label} == {total}


@pytest.mark.parametrize("size", [10_000, 400, 50])
def test_rank_within(df, rows, size):
    got = rank_within(df, ["func_id"], ["score", "line_idx"], rows_per_group=size).collect()
    for func in {r[1] for r in rows}:
        mine = sorted((r[0], r[2]) for r in rows if r[1] == func)
        want = {x: i + 1 for i, x in enumerate(mine)}
        assert {(r["score"], r["line_idx"]): r["rank"] for r in got if r["func_id"] == func} == want


def test_large_ids_beyond_double_precision(spark):
    base = 2**60
    rows = [(base + i,) for i in range(200)]
    df = spark.createDataFrame(rows, "idx long")
    ranked = global_rank(df, ["idx"], rows_per_range=10).collect()
    assert {r["idx"]: r["rank"] for r in ranked} == {base + i: i + 1 for i in range(200)}


@pytest.mark.parametrize("size", [10_000, 200, 40])
def test_curves_do_not_depend_on_the_cut(df, size):
    preds = df.select("label", F.col("score").alias("prob"))
    whole = curves.score_table(preds)
    cut = curves.score_table(preds, rows_per_range=size)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("size", [10_000, 100])
def test_walks_do_not_depend_on_the_cut(df, size):
    flaws = df.withColumn("label", (F.col("line_idx") % 7 == 0).cast("int"))
    a = lines.topk_effort(flaws, 0.2).collect()
    assert lines.topk_effort(flaws, 0.2, rows_per_range=size).collect() == a
    pos, neg = flaws.filter("func_id = 7"), flaws.filter("func_id <> 7")
    b = lines.topk_recall(pos, neg, 0.3).collect()
    assert lines.topk_recall(pos, neg, 0.3, rows_per_range=size).collect() == b


@pytest.mark.parametrize("size", [10_000, 100])
def test_samples_do_not_depend_on_the_cut(spark, size):
    df = spark.range(900).select(
        F.col("id").alias("idx"), (F.col("id") % 9 == 0).cast("int").alias("target")
    )
    a = sampling.balanced_sample(df, 600, seed=3).select("draw", "idx").collect()
    b = sampling.balanced_sample(df, 600, seed=3, rows_per_range=size).select("draw", "idx")
    assert sorted(a) == sorted(b.collect())
    assert len(a) == 600
    positives = sum(1 for r in a if r["idx"] % 9 == 0)
    assert 240 < positives < 360  # a ninth of the rows, half of the draws


@pytest.mark.parametrize("size", [10_000, 100])
def test_weighted_sample(spark, size):
    df = spark.range(300).select(
        F.col("id").alias("idx"),
        F.when(F.col("id") < 3, 100).when(F.col("id") % 2 == 0, 0).otherwise(1).alias("weight"),
    )
    got = sampling.weighted_sample(df, 2000, seed=1, rows_per_range=size).collect()
    assert sorted(r["draw"] for r in got) == list(range(2000))
    heavy = sum(1 for r in got if r["idx"] < 3)
    assert 1200 < heavy < 1480  # 300 of about 449 parts of the weight
    assert all(r["idx"] < 3 or r["idx"] % 2 for r in got)


@pytest.mark.parametrize("size", [10_000, 100])
def test_weighted_sample_of_balance_weights(spark, size):
    df = spark.range(900).select(
        F.col("id").alias("idx"), (F.col("id") % 9 == 0).cast("int").alias("target")
    )
    weighted = classes.balance_weights(df)
    got = sampling.weighted_sample(weighted, 600, seed=3, rows_per_range=size).collect()
    assert sorted(r["draw"] for r in got) == list(range(600))
    assert 240 < sum(r["target"] for r in got) < 360  # a ninth of the rows, half of the draws


def test_fractions_of_weights_count(spark):
    rows = [(0, 1.9), (1, 0.1), (2, 1e-300), (3, 0.0), (4, None)]
    df = spark.createDataFrame(rows, "idx long, weight double")
    got = [r["idx"] for r in sampling.weighted_sample(df, 4000, seed=1).collect()]
    assert len(got) == 4000 and set(got) == {0, 1} and 140 < got.count(1) < 260
    tiny = df.withColumn("weight", F.col("weight") * 1e-300)
    again = [r["idx"] for r in sampling.weighted_sample(tiny, 4000, seed=1).collect()]
    assert len(again) == 4000 and set(again) == {0, 1} and 140 < again.count(1) < 260
    assert sampling.weighted_sample(df.filter("idx > 2"), 10).collect() == []
    for bad in (-1.0, float("nan"), float("inf")):
        wrong = df.union(spark.createDataFrame([(9, bad)], df.schema))
        with pytest.raises(Exception, match="weight is negative, NaN or infinite"):
            sampling.weighted_sample(wrong, 10).collect()


def test_results_do_not_depend_on_partitions(spark, df):
    want = None
    for partitions in (1, 4, 37):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = sorted(map(tuple, global_rank(df.repartition(partitions), ORDER, rows_per_range=100).collect()))
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_missing_scores_stop_the_job(spark):
    for bad in (None, float("nan")):
        preds = spark.createDataFrame([(1, 0.5), (0, bad)], "label int, prob double")
        with pytest.raises(Exception, match="score is null or NaN"):
            curves.score_table(preds).collect()


def test_no_task_orders_all_rows(df):
    ranked = global_rank(df, ORDER, rows_per_range=100)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # Only the table of range totals is brought to one partition, behind its aggregate.
    assert plan.count("SinglePartition") == 1
    assert plan.count("hashpartitioning(__range0") >= 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
