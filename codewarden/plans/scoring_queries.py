"""Registered queries: losses, heads, pooling, bulk scoring and the baseline."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from codewarden.functions import numeric, text
from codewarden.operators import clean, heads, metrics, scoring
from codewarden.plans import views
from codewarden.plans.registry import query, round_doubles, rounded
from codewarden.plans.views import HEAD, sql


def _label():
    return F.col("label")


def _z():
    return F.col("logits")


# --- losses -------------------------------------------------------------------------------------


@query(
    "cross_entropy",
    sql("SELECT round(avg(-lp), 6) AS mean, round(sum(-lp), 4) AS total FROM log_probs", "log_probs"),
)
def cross_entropy(spark, sf):
    loss = numeric.cross_entropy(_z(), _label())
    return views.logits(spark, sf).agg(
        rounded(numeric.reduce_loss(loss)).alias("mean"),
        rounded(numeric.reduce_loss(loss, "sum"), 4).alias("total"),
    )


_FOCAL = "-pow(1 - exp(lp), 2.0) * lp"
_ALPHA = f"({_FOCAL}) * CASE label WHEN 0 THEN 0.25 ELSE 0.75 END"


@query(
    "focal_loss",
    sql(
        f"""SELECT round(avg({_FOCAL}), 6) AS mean, round(sum({_FOCAL}), 4) AS total,
              round(avg({_ALPHA}), 6) AS weighted FROM log_probs""",
        "log_probs",
    ),
)
def focal_loss(spark, sf):
    loss = numeric.focal_loss(_z(), _label())
    weighted = numeric.focal_loss(_z(), _label(), alpha=0.25)
    return views.logits(spark, sf).agg(
        rounded(numeric.reduce_loss(loss)).alias("mean"),
        rounded(numeric.reduce_loss(loss, "sum"), 4).alias("total"),
        rounded(numeric.reduce_loss(weighted)).alias("weighted"),
    )


@query("focal_loss_rows", sql(f"SELECT idx, round({_FOCAL}, 6) AS loss FROM log_probs", "log_probs"))
def focal_loss_rows(spark, sf):
    return views.logits(spark, sf).select(
        "idx", rounded(numeric.focal_loss(_z(), _label())).alias("loss")
    )


@query(
    "binary_log_loss",
    sql(
        """SELECT round(avg(-(label * ln(p + 1e-10) + (1 - label) * ln(1 - p + 1e-10))), 6) AS loss
           FROM (SELECT label, prob / 2 AS p FROM scores)""",
        "scores",
    ),
)
def binary_log_loss(spark, sf):
    loss = numeric.binary_log_loss(_label(), F.col("prob") / 2)
    return views.scores(spark, sf).agg(rounded(numeric.reduce_loss(loss)).alias("loss"))


def _bce(z: str, y: str) -> str:
    return f"greatest({z}, 0) - {z} * {y} + ln(1 + exp(-abs({z})))"


@query(
    "bce_with_logits",
    sql(
        f"""SELECT idx, round({_bce('z0', '(1 - label)')}, 6) AS l0, round({_bce('z1', 'label')}, 6) AS l1
            FROM logits""",
        "logits",
    ),
)
def bce_with_logits(spark, sf):
    loss = numeric.bce_with_logits(_z(), F.array(1 - _label(), _label()))
    rows = views.logits(spark, sf).select("idx", loss.alias("l"))
    return round_doubles(rows.select("idx", F.col("l")[0].alias("l0"), F.col("l")[1].alias("l1")))


_WEIGHT = "CASE WHEN status = 'NOT_VULNERABLE' THEN 1.0 ELSE 30.0 END"


@query(
    "weighted_loss",
    sql(
        f"""SELECT round(avg(-lp * {_WEIGHT}), 6) AS mean, round(sum(-lp * {_WEIGHT}), 3) AS total
            FROM log_probs""",
        "log_probs",
    ),
)
def weighted_loss(spark, sf):
    rows = clean.status_weight(views.logits(spark, sf), 30.0)
    loss, weight = numeric.cross_entropy(_z(), _label()), F.col("weight")
    return rows.agg(
        rounded(numeric.reduce_loss(loss, "mean", weight)).alias("mean"),
        rounded(numeric.reduce_loss(loss, "sum", weight), 3).alias("total"),
    )


@query(
    "eval_loss",
    """SELECT round(avg(batch_loss), 6) AS eval_loss FROM (SELECT avg(value) AS batch_loss FROM (
         SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch FROM events)
       GROUP BY batch)""",
)
def eval_loss(spark, sf):
    losses = views.table(spark, sf, "events").select("event_id", F.col("value").alias("loss"))
    return round_doubles(metrics.eval_loss(losses, 64, "event_id"))


# --- heads and pooling ----------------------------------------------------------------------------


def _dot(vec: str, mod: int, off: int) -> str:
    """Product with a weight row whose entry i is (i % mod - off) / 10, as in the head."""
    return (
        f"list_sum(list_transform({vec}, lambda x, i: CAST(x AS DOUBLE) * (((i - 1) % {mod}) - {off}) / 10.0))"
    )


@query(
    "linear_head",
    sql(
        f"""SELECT vec_id, round(z0, 6) AS z0, round(z1 + 0.5, 6) AS z1,
              round(1 / (1 + exp(z0 - z1 - 0.5)), 6) AS p1
            FROM (SELECT vec_id, {_dot('embedding', 7, 3)} AS z0, {_dot('embedding', 5, 2)} AS z1
                  FROM embeddings)""",
    ),
)
def linear_head(spark, sf):
    scored = heads.apply_head(
        views.table(spark, sf, "embeddings"), HEAD, [0.0, 0.5], vector="embedding"
    )
    return round_doubles(
        scored.select(
            "vec_id",
            _z()[0].alias("z0"),
            _z()[1].alias("z1"),
            F.col("probs")[1].alias("p1"),
        )
    )


_MASK = "CASE WHEN pos % 5 = 4 THEN 0 ELSE 1 END"


@query(
    "max_pool",
    sql(
        f"""SELECT func_id, CAST(d AS INTEGER) AS dim, round(max(CASE WHEN {_MASK} = 1 THEN CAST(vec[d + 1] AS DOUBLE)
              ELSE 0 END), 6) AS value FROM vectors, generate_series(0, 63) AS g(d) GROUP BY func_id, d""",
        "vectors",
    ),
)
def max_pool(spark, sf):
    masked = views.vectors(spark, sf).withColumn(
        "mask", F.when(F.col("pos") % 5 == 4, 0).otherwise(1)
    )
    pooled = heads.max_pool(masked, "mask")
    rows = pooled.select("func_id", F.posexplode_outer("vec").alias("dim", "value"))
    return round_doubles(rows)


@query(
    "max_pool_projected",
    sql(
        f"""SELECT func_id, round(max(CASE WHEN {_MASK} = 1 THEN z0 ELSE 0 END), 6) AS z0,
              round(max(CASE WHEN {_MASK} = 1 THEN z1 ELSE 0 END), 6) AS z1
            FROM (SELECT func_id, pos, {_dot('vec', 7, 3)} AS z0, {_dot('vec', 5, 2)} AS z1 FROM vectors)
            GROUP BY func_id""",
        "vectors",
    ),
)
def max_pool_projected(spark, sf):
    masked = views.vectors(spark, sf).withColumn(
        "mask", F.when(F.col("pos") % 5 == 4, 0).otherwise(1)
    )
    vec = F.col("vec")
    pooled = heads.max_pool(masked, "mask", HEAD)
    return round_doubles(pooled.select("func_id", vec[0].alias("z0"), vec[1].alias("z1")))


def _as_text(vec: str) -> str:
    return f"array_to_string(list_transform({vec}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ' ')"


def _vector_text(name: str = "vec"):
    """Vector as whole millionths, so both engines write it alike."""
    return F.array_join(
        F.transform(
            name, lambda x: F.round(x.cast("double") * 1000000.0).cast("long").cast("string")
        ),
        " ",
    ).alias(name)


@query(
    "cls_pool", sql(f"SELECT func_id, {_as_text('vec')} AS vec FROM vectors WHERE pos = 0", "vectors")
)
def cls_pool(spark, sf):
    return heads.cls_pool(views.vectors(spark, sf)).select("func_id", _vector_text())


@query(
    "last_token_pool",
    sql(
        f"""SELECT v.func_id AS seq_id, CAST(row_number() OVER (PARTITION BY v.func_id ORDER BY v.pos) - 1 AS INTEGER)
              AS segment, v.pos, {_as_text('v.vec')} AS vec
            FROM vectors v JOIN vectors s ON s.func_id = v.func_id AND s.pos = v.pos + 1
            WHERE s.token_id = 0 AND v.token_id <> 0""",
        "vectors",
    ),
)
def last_token_pool(spark, sf):
    vectors = views.vectors(spark, sf).withColumnRenamed("func_id", "seq_id")
    # Sequences of ten positions by construction of the view.
    sequences = vectors.groupBy("seq_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"]
        ).alias("ids")
    )
    return heads.last_token_pool(vectors, sequences, separator=0).select(
        "seq_id", "segment", "pos", _vector_text()
    )


# --- scoring --------------------------------------------------------------------------------------


def load_length_scorer():
    """A scorer by text length; it cannot handle lengths divisible by 211."""

    def score(rows: pd.DataFrame):
        lengths = rows["code"].str.len()
        if (lengths % 211 == 0).any():
            raise ValueError("length divisible by 211")
        return (lengths % 1000) / 1000.0

    return score


_SCORED = """(SELECT doc_id AS idx, CASE WHEN length(text) % 211 <> 0 THEN length(text) % 1000 / 1000.0 END AS prob,
    CASE WHEN length(text) % 211 = 0 THEN 'length divisible by 211' END AS error FROM documents)"""


@query("score_with", f"SELECT idx, round(CAST(prob AS DOUBLE), 6) AS prob, error FROM {_SCORED}")
def score_with(spark, sf):
    return round_doubles(
        scoring.score_with(views.code(spark, sf), load_length_scorer, inputs=["code"])
    )


@query(
    "score_skips",
    f"SELECT count(prob) AS scored, count(*) - count(prob) AS skipped FROM {_SCORED}",
)
def score_skips(spark, sf):
    return scoring.skip_count(
        scoring.score_with(views.code(spark, sf), load_length_scorer, inputs=["code"])
    )


_ONE = scoring.ONE
_STEPS = 10


def _margin(step: int) -> str:
    """(idx, setting, m) of rows and settings, with the weights after ``step`` steps."""
    return f"""SELECT p.*, (i.w + coalesce(dot, 0)::DOUBLE / greatest(norm, 1.0)) / {_ONE} AS m
      FROM (SELECT d.idx, d.split, d.target, d.weight, d.norm, s.setting, sum(w.w * f.tf) AS dot
            FROM rows_ d CROSS JOIN settings s LEFT JOIN tf f ON f.idx = d.idx
            LEFT JOIN w{step} w ON w.setting = s.setting AND w.bucket = f.bucket
            GROUP BY ALL) p
      JOIN w{step} i ON i.setting = p.setting AND i.bucket = -1"""


def _step(step: int) -> str:
    """Errors, gradients and weights of a step."""
    return f"""
e{step} AS MATERIALIZED (
  SELECT idx, setting, norm, floor(weight * (1 / (1 + exp(-m)) - target) * {_ONE} + 0.5)::BIGINT AS e
  FROM ({_margin(step)}) WHERE split = 'train'),
g{step} AS MATERIALIZED (
  SELECT setting, f.bucket, sum(floor(e * f.tf / greatest(norm, 1.0) + 0.5)::BIGINT)::DOUBLE AS g
  FROM e{step} JOIN tf f USING (idx) GROUP BY ALL
  UNION ALL SELECT setting, -1, sum(e)::DOUBLE FROM e{step} GROUP BY ALL),
d{step} AS MATERIALIZED (
  SELECT w.setting, w.bucket, w.w, w.a, coalesce(g.g, 0) / (SELECT mass FROM total)
    + CASE WHEN w.bucket < 0 THEN 0.0 ELSE s.reg END * w.w AS slope
  FROM w{step} w JOIN settings s USING (setting) LEFT JOIN g{step} g ON g.setting = w.setting AND g.bucket = w.bucket),
w{step + 1} AS MATERIALIZED (
  SELECT setting, bucket, a + slope * slope AS a, w - floor({scoring.RATE} * {_ONE}
    * (slope / sqrt(CASE WHEN a + slope * slope > 0 THEN a + slope * slope ELSE 1 END)) + 0.5)::BIGINT AS w
  FROM d{step})"""


_BASELINE = sql(
    f"""SELECT 'baseline' AS run, setting AS epoch, reg, round(valid_auc, 6) AS valid_auc, chosen,
          round(CASE WHEN chosen THEN test_auc END, 6) AS test_auc
        FROM (SELECT *, setting = coalesce(first(setting) OVER (ORDER BY valid_auc DESC NULLS LAST, setting), -1)
                AND valid_auc IS NOT NULL AS chosen
              FROM settings LEFT JOIN (
                SELECT setting, max(auc) FILTER (split = 'valid') AS valid_auc, max(auc) FILTER (split = 'test') AS test_auc
                FROM areas GROUP BY setting) USING (setting))""",
    "functions",
).replace(
    "\nSELECT 'baseline'",
    f""",
settings AS (SELECT * FROM (VALUES (1, 0.0::DOUBLE), (2, 0.01::DOUBLE), (3, 0.1::DOUBLE)) AS v(setting, reg)),
tf AS MATERIALIZED (
  SELECT idx, split, ('0x' || substr(md5(word), 1, 8))::BIGINT % 16384 AS bucket, count(*) AS tf
  FROM (SELECT idx, split, unnest(regexp_extract_all(code, '{text.WORD}')) AS word FROM functions) GROUP BY ALL),
rows_ AS MATERIALIZED (
  SELECT f.idx, f.split, f.target, CASE WHEN f.status = 'NOT_VULNERABLE' THEN 1.0 ELSE 3.0 END::DOUBLE AS weight,
    coalesce(sqrt(sum(t.tf * t.tf)::DOUBLE), 0.0) AS norm
  FROM functions f LEFT JOIN tf t USING (idx) GROUP BY ALL),
total AS (SELECT sum(floor(weight * {_ONE} + 0.5)::BIGINT)::DOUBLE / {_ONE} AS mass FROM rows_ WHERE split = 'train'),
w0 AS MATERIALIZED (
  SELECT setting, bucket, 0.0::DOUBLE AS a, 0::BIGINT AS w FROM settings
  CROSS JOIN (SELECT DISTINCT bucket FROM tf WHERE split = 'train' UNION ALL SELECT -1)),"""
    + ",".join(_step(n) for n in range(_STEPS))
    + f""",
probs AS MATERIALIZED (
  SELECT setting, split, target, floor(1 / (1 + exp(-m)) * 1e6 + 0.5) / 1e6 AS prob
  FROM ({_margin(_STEPS)}) WHERE split <> 'train'),
areas AS (
  SELECT setting, split, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc
  FROM (SELECT *, sum(neg) OVER (PARTITION BY setting, split ORDER BY prob) - neg AS below
        FROM (SELECT setting, split, prob, sum(target)::DOUBLE AS pos, sum(1 - target)::DOUBLE AS neg
              FROM probs GROUP BY ALL))
  GROUP BY ALL)
SELECT 'baseline'""",
)


@query("train_baseline", _BASELINE)
def train_baseline(spark, sf):
    functions = clean.status_weight(views.functions(spark, sf), 3.0)
    return round_doubles(scoring.train_baseline(functions, max_iter=_STEPS))
