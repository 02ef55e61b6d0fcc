from pyspark.sql import functions as F

from codewarden.operators import classes
from codewarden.operators.clean import status_as_class

ROWS = [
    (0, "A", "FIXED", "train"),
    (1, "A", "VULNERABLE", "train"),
    (2, "B", "VULNERABLE", "test"),
    (3, "A", "VULNERABLE", "test"),
    (4, "A", "VULNERABLE", "valid"),
    (5, "C", "VULNERABLE", "train"),
    (6, "Z", "NOT_VULNERABLE", "train"),
    (7, "Z", "NOT_VULNERABLE", "train"),
    (8, "Z", "NOT_VULNERABLE", "valid"),
    (9, "Z", "NOT_VULNERABLE", "test"),
]


def functions(spark):
    return spark.createDataFrame(ROWS, "idx long, cwe string, status string, split string")


def index_of(df):
    return {r["class"]: r["class_id"] for r in df.collect()}


def test_pruning(spark):
    df = functions(spark)
    # B occurs in the test split only: too rare to be seen in train, so it stays.
    _, index = classes.to_multiclass(df, min_count=2)
    assert index_of(index) == {"A": 0, "NOT_VULNERABLE": 1, "B": 2}
    _, index = classes.to_multiclass(df, min_count=2, complete=True)
    assert index_of(index) == {"A": 0, "NOT_VULNERABLE": 1}
    rows, index = classes.to_multiclass(df, ignored=["A"])
    assert index_of(index) == {"C": 0, "NOT_VULNERABLE": 1, "B": 2}
    assert {(r["idx"], r["target"]) for r in rows.collect()} == {
        (2, 2), (5, 0), (6, 1), (7, 1), (8, 1), (9, 1)
    }


def test_sets(spark):
    classed = status_as_class(functions(spark))
    names = lambda df: {r["class"] for r in df.collect()}
    assert names(classes.common_classes(classed)) == {"A", "NOT_VULNERABLE"}
    assert names(classes.incomplete_classes(classed)) == {"B", "C"}
    assert names(classes.rare_classes(classed, 2)) == {"C"}
    stats = classes.class_stats(classed)
    assert names(classes.ignore_set(stats, ["X"], complete=False, min_count=2)) == {"C", "X"}
    assert names(classes.ignore_set(stats)) == set()


def test_weights_sum_to_one(spark):
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(5)], "idx long, target int")
    got = {r["idx"]: r["weight"] for r in classes.balance_weights(df).collect()}
    assert got[0] == 0.5 and abs(sum(got.values()) - 1) < 1e-12


def test_a_side_beyond_the_bound_is_joined_without_broadcast(spark):
    from codewarden.support import small_side

    df = spark.range(50).select(F.col("id").cast("string").alias("class"))
    assert small_side(df, 10) is df
    assert small_side(df, 50).count() == 50
    wide = spark.range(9).select(F.repeat(F.lit("x"), 4_000_000).alias("class"))
    assert small_side(wide) is wide


def test_many_classes_are_numbered_in_ranges(spark):
    stats = classes.class_stats(status_as_class(functions(spark)))
    want = index_of(classes.class_index(stats))
    for rows_per_range in (1, 2):
        assert index_of(classes.class_index(stats, rows_per_range)) == want
