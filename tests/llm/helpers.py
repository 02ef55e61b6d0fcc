"""Small documents for the operators' edge cases."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def docs(spark, texts, extra=False):
    """Documents of (id, text) or (id, text, source) rows; ``extra`` adds columns whose names the
    operators use themselves."""
    rows = [(*row, *["s0"][: 3 - len(row)]) for row in texts]
    frame = spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA
    )
    if extra:
        for name in ("node", "score", "key", "bin", "size", "slot", "shard", "hash", "at", "line", "part"):
            frame = frame.selectExpr("*", f"'x' AS {name}")
    return frame


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


EDGES = [(None, None), (None, "lost and found"), (1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word")]
