"""Registered queries: classes, set operations, order and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.operators import classes, sampling
from codewarden.operators.clean import status_as_class
from codewarden.plans import views
from codewarden.plans.registry import query, round_doubles, rounded
from codewarden.plans.views import sql

MIN_COUNT = 5
IGNORED = ("CWE-3",)


def _classed(spark, sf):
    return status_as_class(views.functions(spark, sf))


_STATS = """stats AS (SELECT class, count_if(split = 'train') AS train, count_if(split = 'test') AS test,
    count_if(split = 'valid') AS valid,
    min(CASE split WHEN 'train' THEN 0 WHEN 'test' THEN 1 ELSE 2 END * 10000000000 + idx) AS first_seen
  FROM classed GROUP BY class)"""


def _with_stats(body: str) -> str:
    return sql("", "classed").rstrip() + f",\n{_STATS}\n{body}"


_KEEP = (
    f"class NOT IN ('{IGNORED[0]}') AND (train = 0 OR train >= {MIN_COUNT}) "
    "AND train > 0 AND test > 0 AND valid > 0"
)


@query("class_counts", sql(
    "SELECT split, class, count(*) AS n FROM classed WHERE class <> 'CWE-3' GROUP BY split, class",
    "classed",
))
def class_counts(spark, sf):
    ignored = spark.createDataFrame([(c,) for c in IGNORED], "class string")
    return classes.class_counts(classes.ignore_anti(_classed(spark, sf), ignored))


@query(
    "class_index",
    _with_stats(
        "SELECT class, CAST(row_number() OVER (ORDER BY first_seen) - 1 AS INTEGER) AS class_id FROM stats"
    ),
)
def class_index(spark, sf):
    return classes.class_index(classes.class_stats(_classed(spark, sf)))


@query(
    "class_lookup",
    _with_stats(
        """SELECT idx, c.class, class_id FROM classed c LEFT JOIN (
             SELECT class, CAST(row_number() OVER (ORDER BY first_seen) - 1 AS INTEGER) AS class_id
             FROM stats WHERE train >= 5) i ON c.class = i.class"""
    ),
)
def class_lookup(spark, sf):
    classed = _classed(spark, sf)
    frequent = classes.class_stats(classed).filter(F.col("train") >= MIN_COUNT)
    return classes.class_lookup(classed, classes.class_index(frequent)).select(
        "idx", "class", "class_id"
    )


@query(
    "ignore_anti",
    sql("SELECT idx, class FROM classed WHERE class <> 'CWE-3'", "classed"),
)
def ignore_anti(spark, sf):
    ignored = spark.createDataFrame([(c,) for c in IGNORED], "class string")
    return classes.ignore_anti(_classed(spark, sf), ignored).select("idx", "class")


_SPLIT_CLASSES = "SELECT DISTINCT class FROM classed WHERE split = "
_COMMON = (
    f"{_SPLIT_CLASSES}'train' INTERSECT {_SPLIT_CLASSES}'test' INTERSECT {_SPLIT_CLASSES}'valid'"
)


@query("common_classes", sql(_COMMON, "classed"))
def common_classes(spark, sf):
    return classes.common_classes(_classed(spark, sf))


@query("all_classes", sql("SELECT DISTINCT class FROM classed", "classed"))
def all_classes(spark, sf):
    return classes.all_classes(_classed(spark, sf))


@query(
    "incomplete_classes",
    sql(f"SELECT DISTINCT class FROM classed EXCEPT ({_COMMON})", "classed"),
)
def incomplete_classes(spark, sf):
    return classes.incomplete_classes(_classed(spark, sf))


@query(
    "rare_classes",
    sql(
        f"""SELECT class FROM classed WHERE split = 'train' GROUP BY class
            HAVING count(*) < {MIN_COUNT}""",
        "classed",
    ),
)
def rare_classes(spark, sf):
    return classes.rare_classes(_classed(spark, sf), MIN_COUNT)


@query(
    "ignore_set",
    sql(
        f"""SELECT 'CWE-3' AS class UNION
            (SELECT DISTINCT class FROM classed EXCEPT ({_COMMON})) UNION
            SELECT class FROM classed WHERE split = 'train' GROUP BY class HAVING count(*) < {MIN_COUNT}""",
        "classed",
    ),
)
def ignore_set(spark, sf):
    stats = classes.class_stats(_classed(spark, sf))
    return classes.ignore_set(stats, IGNORED, complete=True, min_count=MIN_COUNT)


TO_MULTICLASS = _with_stats(
    f"""SELECT idx, split, c.class, status, target FROM (SELECT idx, split, class, status FROM classed) c
        JOIN (SELECT class, CAST(row_number() OVER (ORDER BY first_seen) - 1 AS INTEGER) AS target
              FROM stats WHERE {_KEEP}) i ON c.class = i.class"""
)


def multiclass(spark, sf):
    rewritten, index = classes.to_multiclass(
        views.functions(spark, sf), IGNORED, complete=True, min_count=MIN_COUNT
    )
    return rewritten.select("idx", "split", "class", "status", "target"), index


@query("to_multiclass", TO_MULTICLASS)
def to_multiclass(spark, sf):
    return multiclass(spark, sf)[0]


@query(
    "balance_weights",
    sql(
        """SELECT idx, label, round(1e6 / (count(*) OVER (PARTITION BY label)
             * (SELECT count(DISTINCT label) FROM scores)), 6) AS weight FROM scores""",
        "scores",
    ),
)
def balance_weights(spark, sf):
    weighted = classes.balance_weights(views.scores(spark, sf), "label")
    return weighted.select("idx", "label", rounded(F.col("weight") * 1e6).alias("weight"))


_DRAWN = views.shuffle_key_sql(14), views.shuffle_key_sql(15)
_BALANCED = sql(
    f"""SELECT d.draw, n.idx, n.target FROM (
          SELECT idx AS draw, {_DRAWN[0]} % (SELECT count(*) FROM sizes) AS pick, {_DRAWN[1]} AS key
          FROM range((SELECT count(*) FROM functions)) AS r(idx)) d
        JOIN (SELECT target, size, row_number() OVER (ORDER BY target) - 1 AS pick FROM sizes) s
          ON s.pick = d.pick
        JOIN (SELECT idx, target, row_number() OVER (PARTITION BY target ORDER BY idx) AS number
              FROM functions) n ON n.target = s.target AND n.number = d.key % s.size + 1""",
    "functions",
).replace("\nSELECT", ", sizes AS (SELECT target, count(*) AS size FROM functions GROUP BY target)\nSELECT", 1)


@query("balanced_sample", _BALANCED)
def balanced_sample(spark, sf):
    drawn = sampling.balanced_sample(views.functions(spark, sf), seed=7)
    return drawn.select("draw", "idx", "target")


# The same scaling as the operator's: whole numbers of 53 bits are summed, and the power of two that takes
# their sum, and a row's loss each, to 58 bits is what weights are multiplied by and rounded up.
_WEIGHTED = sql(
    f"""SELECT d.draw, w.idx, w.target FROM (
          SELECT idx AS draw, ({_DRAWN[0]} * 268435456 + ({_DRAWN[1]} >> 4))
            % (SELECT max(upto) FROM placed)::BIGINT AS point
          FROM range((SELECT count(*) FROM functions)) AS r(idx)) d
        JOIN placed w ON d.point >= w.upto - w.whole AND d.point < w.upto""",
    "functions",
).replace(
    "\nSELECT",
    """, given AS (SELECT idx, target, 1.0::DOUBLE / (count(*) OVER (PARTITION BY target) * 2.0) AS weight FROM functions),
power AS (SELECT 53 - (floor(log2(max(weight))) + 1) AS first FROM given),
scale AS (SELECT first + 58 - (floor(log2((sum(floor(weight * pow(2.0, first))::HUGEINT) + count(*))::DOUBLE)) + 1) AS power
  FROM given, power GROUP BY first),
placed AS (SELECT idx, target, whole, sum(whole) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM (SELECT idx, target, ceil(weight * pow(2.0, power))::BIGINT AS whole FROM given, scale))
SELECT""",
    1,
)


@query("weighted_sample", _WEIGHTED)
def weighted_sample(spark, sf):
    """Draws by the weights that balance the classes, as many as there are rows: an epoch of the sampler."""
    functions = views.functions(spark, sf)
    weighted = classes.balance_weights(functions)
    drawn = sampling.weighted_sample(weighted, functions.count(), seed=7)
    return drawn.select("draw", "idx", "target")


_KEY = views.shuffle_key_sql(3)


@query(
    "seeded_shuffle",
    sql(
        f"""SELECT idx, {_KEY} AS shuffle_key,
              row_number() OVER (ORDER BY {_KEY}, idx) - 1 AS position FROM code""",
        "code",
    ),
)
def seeded_shuffle(spark, sf):
    return sampling.seeded_shuffle(views.code(spark, sf).select("idx"), seed=3)


@query("limit_rows", "SELECT doc_id AS idx, text AS code FROM documents ORDER BY doc_id LIMIT 25")
def limit_rows(spark, sf):
    return sampling.limit_rows(views.code(spark, sf), 25)


@query(
    "class_portions_big",
    sql(
        "SELECT round(avg(label), 6) AS pos_portion, round(1 - avg(label), 6) AS neg_portion FROM scores",
        "scores",
    ),
)
def class_portions_big(spark, sf):
    return round_doubles(classes.class_portions(views.scores(spark, sf), "label"))
