"""The given tables seen as labelled functions, predictions, token scores and so on.

Each view exists twice, as a DataFrame and as SQL text, with the same definition. Derived columns
use whole-number arithmetic, so both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.support import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The texts, whose tokens and lines take long to work on."""
    return spread(table(spark, sf, "documents").select("doc_id", "text", "source"))


def functions(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as labelled functions."""
    docs = documents(spark, sf)
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    digit = F.col("doc_id") % 10
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("idx"),
        F.col("text").alias("code"),
        F.col("toxic").cast("int").alias("target"),
        F.concat(F.lit("CWE-"), F.regexp_replace("source", "[^0-9]", "")).alias("cwe"),
        F.when(F.col("toxic") == 1, "VULNERABLE")
        .when(F.col("doc_id") % 2 == 0, "NOT_VULNERABLE")
        .otherwise("FIXED")
        .alias("status"),
        F.when(digit.isin(0, 1, 2), "test")
        .when(digit.isin(3, 4, 5), "valid")
        .otherwise("train")
        .alias("split"),
    )


def code(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as (idx, code)."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("idx"), F.col("text").alias("code")
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled functions with a probability that leans towards the label."""
    prob = (F.col("idx") * 7919 % 700 + 300 * F.col("target")) / 1000.0
    return functions(spark, sf).withColumn("prob", prob)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """One prediction per line item, with many ties."""
    label = (F.col("l_returnflag") == "R").cast("int")
    points = F.col("l_quantity").cast("int") * 10 + F.col("l_orderkey") % 10 + 40 * label
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"),
        label.alias("label"),
        (points / 600.0).alias("prob"),
    )


def class_probs(spark: SparkSession, sf: str) -> DataFrame:
    """Three class probabilities per document, and a class label."""
    a, b, c = (F.col("doc_id") % m + 1 for m in (7, 11, 13))
    total = (a + b + c).cast("double")
    return documents(spark, sf).select(
        F.col("doc_id").alias("idx"),
        (F.col("doc_id") % 3).cast("int").alias("label"),
        F.array(a / total, b / total, c / total).alias("probs"),
    )


def line_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document with a score and a flaw label."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("func_id"),
        F.posexplode_outer(text.code_lines(F.col("text"))).alias("line_idx", "line"),
    ).select(
        "func_id",
        "line_idx",
        "line",
        (((F.col("func_id") * 31 + F.col("line_idx") * 17) % 97 + 1) / 97.0).alias("score"),
        ((F.col("func_id") + F.col("line_idx")) % 13 == 0).cast("int").alias("label"),
    )


def line_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`line_rows` with the lines of a document as one array."""
    lines = F.transform(
        text.code_lines(F.col("text")),
        lambda line, i: F.struct(
            line.alias("line"),
            (((F.col("doc_id") * 31 + i * 17) % 97 + 1) / 97.0).alias("score"),
            ((F.col("doc_id") + i) % 13 == 0).cast("int").alias("label"),
        ),
    )
    return documents(spark, sf).select(
        F.col("doc_id").alias("func_id"), lines.alias("lines")
    )


def marked_text(col: str = "text") -> F.Column:
    """Text whose line ends are written as separate line-mark tokens."""
    return F.replace(F.col(col), F.lit("\n"), F.lit(f" {text.LINE_MARK} "))


def token_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Scored word and line-mark tokens of each document, as one array; some scores are 0."""
    tokens = F.transform(
        text.word_tokens(marked_text()),
        lambda t, i: F.struct(
            t.alias("token"), (((F.col("doc_id") + i) % 19) / 19.0).alias("score")
        ),
    )
    return documents(spark, sf).select(
        F.col("doc_id").alias("func_id"), "text", tokens.alias("tokens")
    )


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        F.col("doc_id").alias("idx"), F.size(text.word_tokens(F.col("text"))).alias("n")
    )


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    """Largest value per event type and hour of day, as a log of runs and epochs."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("run"), F.hour("ts").alias("epoch"))
        .agg(F.max("value").alias("value"))
    )


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Two logits and a label per line item."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.array(F.col("l_discount") * 10.0 - 0.5, F.col("l_tax") * 10.0).alias("logits"),
        F.when(F.col("l_linestatus") == "O", "NOT_VULNERABLE")
        .otherwise("VULNERABLE")
        .alias("status"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as the token vectors of functions of ten tokens."""
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("long").alias("func_id"),
        (F.col("vec_id") % 10).cast("int").alias("pos"),
        F.when(F.col("label") % 3 == 0, 0).otherwise(F.col("label")).cast("int").alias("token_id"),
        F.col("embedding").alias("vec"),
    )


def attention(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as attention weights of small functions."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("func_id"),
        F.col("l_linenumber").alias("head"),
        (F.col("l_suppkey") % 8).cast("int").alias("q"),
        (F.col("l_partkey") % 16).cast("int").alias("k"),
        (F.col("l_quantity") / 50.0).alias("weight"),
    )


HEAD = [[((i % 7) - 3) / 10.0 for i in range(64)], [((i % 5) - 2) / 10.0 for i in range(64)]]

WS = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\p{Z}]+"
# Written out here as well, so that a slip in the library does not pass unseen.
_WORD_CHARS = (
    r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"
    r"\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"
)
WORD = rf"[{_WORD_CHARS}]+|[^{_WORD_CHARS}\s\x{{000B}}\x{{0085}}\p{{Z}}]+"

# View name -> (views it builds on, SQL).
_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "functions": (
        (),
        """SELECT d.doc_id AS idx, d.text AS code, CAST(l.toxic AS INTEGER) AS target,
             'CWE-' || regexp_replace(d.source, '[^0-9]', '', 'g') AS cwe,
             CASE WHEN l.toxic = 1 THEN 'VULNERABLE' WHEN d.doc_id % 2 = 0 THEN 'NOT_VULNERABLE'
                  ELSE 'FIXED' END AS status,
             CASE WHEN d.doc_id % 10 IN (0, 1, 2) THEN 'test'
                  WHEN d.doc_id % 10 IN (3, 4, 5) THEN 'valid' ELSE 'train' END AS split
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "classed": (
        ("functions",),
        """SELECT *, CASE WHEN status = 'NOT_VULNERABLE' THEN status ELSE cwe END AS class
           FROM functions""",
    ),
    "code": ((), "SELECT doc_id AS idx, text AS code FROM documents"),
    "predictions": (
        ("functions",),
        """SELECT *, CAST((idx * 7919) % 700 + 300 * target AS DOUBLE) / 1000.0 AS prob
           FROM functions""",
    ),
    "scores": (
        (),
        """SELECT l_orderkey * 8 + l_linenumber AS idx, CAST(l_returnflag = 'R' AS INTEGER) AS label,
             CAST(CAST(l_quantity AS INTEGER) * 10 + l_orderkey % 10
                  + 40 * CAST(l_returnflag = 'R' AS INTEGER) AS DOUBLE) / 600.0 AS prob
           FROM lineitem""",
    ),
    # Distinct scores with the rows at, at or below, and above them.
    "curve": (
        ("scores",),
        """SELECT score, pos, neg, p, n, pos_le, neg_le,
             p - pos_le + pos AS tp, n - neg_le + neg AS fp
           FROM (SELECT prob AS score, CAST(sum(label) AS DOUBLE) AS pos,
                   CAST(sum(1 - label) AS DOUBLE) AS neg,
                   CAST(sum(sum(label)) OVER () AS DOUBLE) AS p,
                   CAST(sum(sum(1 - label)) OVER () AS DOUBLE) AS n,
                   CAST(sum(sum(label)) OVER (ORDER BY prob) AS DOUBLE) AS pos_le,
                   CAST(sum(sum(1 - label)) OVER (ORDER BY prob) AS DOUBLE) AS neg_le
                 FROM scores GROUP BY prob)""",
    ),
    "class_probs": (
        (),
        """SELECT idx, label, [CAST(a AS DOUBLE) / CAST(a + b + c AS DOUBLE),
                CAST(b AS DOUBLE) / CAST(a + b + c AS DOUBLE),
                CAST(c AS DOUBLE) / CAST(a + b + c AS DOUBLE)] AS probs
           FROM (SELECT doc_id AS idx, CAST(doc_id % 3 AS INTEGER) AS label, doc_id % 7 + 1 AS a,
                   doc_id % 11 + 1 AS b, doc_id % 13 + 1 AS c FROM documents)""",
    ),
    "class_preds": (
        ("class_probs",),
        "SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred FROM class_probs",
    ),
    "line_rows": (
        (),
        """SELECT doc_id AS func_id, CAST(i - 1 AS INTEGER) AS line_idx, lines[i] AS line,
             CAST((doc_id * 31 + (i - 1) * 17) % 97 + 1 AS DOUBLE) / 97.0 AS score,
             CAST((doc_id + i - 1) % 13 = 0 AS INTEGER) AS label
           FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i
                 FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
    ),
    "ranked_in_function": (
        ("line_rows",),
        """SELECT *, row_number() OVER (PARTITION BY func_id ORDER BY score DESC, line_idx) - 1 AS rank,
             count(*) OVER (PARTITION BY func_id) AS total_lines,
             CAST(sum(label) OVER (PARTITION BY func_id) AS BIGINT) AS flaw_lines
           FROM line_rows""",
    ),
    "ranked_lines": (
        ("line_rows",),
        """SELECT *, row_number() OVER (ORDER BY score DESC, func_id, line_idx) AS rank,
             sum(label) OVER (ORDER BY score DESC, func_id, line_idx) AS caught,
             sum(label) OVER () AS flaws, count(*) OVER () AS total
           FROM line_rows""",
    ),
    "token_rows": (
        (),
        f"""SELECT doc_id AS func_id, i - 1 AS pos, tokens[i] AS token, len(tokens) AS n,
             CAST((doc_id + i - 1) % 19 AS DOUBLE) / 19.0 AS score
           FROM (SELECT doc_id, tokens, unnest(generate_series(1, len(tokens))) AS i
                 FROM (SELECT doc_id,
                         regexp_extract_all(replace(text, chr(10), ' Ċ '), '{WORD}') AS tokens
                       FROM documents))""",
    ),
    # Stretches between closing tokens, and the lines they yield with carried text.
    "stretches": (
        ("token_rows",),
        """SELECT func_id, stretch, coalesce(sum(score) FILTER (NOT closing), 0.0) AS total,
             max(score) FILTER (closing) AS closing_score,
             coalesce(string_agg(token, '' ORDER BY pos) FILTER (NOT closing), '') AS piece,
             bool_or(closing) AS closed
           FROM (SELECT *, coalesce(sum(CAST(closing AS INTEGER)) OVER (PARTITION BY func_id ORDER BY pos
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch
                 FROM (SELECT *, (token IN ('Ċ', 'ĊĊ') OR pos = n - 1) AS closing FROM token_rows))
           GROUP BY func_id, stretch""",
    ),
    "token_lines": (
        ("stretches",),
        """SELECT func_id, CAST(line_no AS INTEGER) AS line_idx,
             string_agg(piece, '' ORDER BY stretch) AS line,
             max(CASE WHEN total <> 0 THEN total + closing_score END) AS score
           FROM (SELECT *, coalesce(sum(CAST(total <> 0 AS INTEGER)) OVER (PARTITION BY func_id
                        ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no
                 FROM stretches)
           GROUP BY func_id, line_no HAVING bool_or(total <> 0)""",
    ),
    "lengths": (
        (),
        f"""SELECT doc_id AS idx, CAST(len(regexp_extract_all(text, '{WORD}')) AS INTEGER) AS n
            FROM documents""",
    ),
    "metric_log": (
        (),
        """SELECT event_type AS run, CAST(hour(ts) AS INTEGER) AS epoch, max(value) AS value
           FROM events GROUP BY 1, 2""",
    ),
    "logits": (
        (),
        """SELECT l_orderkey * 8 + l_linenumber AS idx, CAST(l_returnflag = 'R' AS INTEGER) AS label,
             l_discount * 10.0 - 0.5 AS z0, l_tax * 10.0 AS z1,
             CASE WHEN l_linestatus = 'O' THEN 'NOT_VULNERABLE' ELSE 'VULNERABLE' END AS status
           FROM lineitem""",
    ),
    "log_probs": (
        ("logits",),
        """SELECT *, (CASE label WHEN 0 THEN z0 ELSE z1 END) - ln(exp(z0) + exp(z1)) AS lp FROM logits""",
    ),
    "vectors": (
        (),
        """SELECT vec_id // 10 AS func_id, CAST(vec_id % 10 AS INTEGER) AS pos,
             CAST(CASE WHEN label % 3 = 0 THEN 0 ELSE label END AS INTEGER) AS token_id, embedding AS vec
           FROM embeddings""",
    ),
    "attention": (
        (),
        """SELECT l_orderkey AS func_id, l_linenumber AS head, CAST(l_suppkey % 8 AS INTEGER) AS q,
             CAST(l_partkey % 16 AS INTEGER) AS k, l_quantity / 50.0 AS weight FROM lineitem""",
    ),
    "shuffled": (
        ("lengths",),
        """SELECT idx, n, row_number() OVER (ORDER BY {key}, idx) AS turn FROM lengths WHERE n < 512""",
    ),
    # Greedy packing as a walk over the whole order, with 512 positions and 8 functions a pack.
    "packed": (
        ("shuffled",),
        """SELECT idx, n, turn, 0::BIGINT AS pack, 0 AS slot, n - 1 AS last_pos
           FROM shuffled WHERE turn = 1
           UNION ALL
           SELECT s.idx, s.n, s.turn,
             CASE WHEN w.last_pos + 2 + s.n >= 512 OR w.slot + 2 >= 8 THEN w.pack + 1 ELSE w.pack END,
             CASE WHEN w.last_pos + 2 + s.n >= 512 OR w.slot + 2 >= 8 THEN 0 ELSE w.slot + 1 END,
             CASE WHEN w.last_pos + 2 + s.n >= 512 OR w.slot + 2 >= 8 THEN s.n - 1
                  ELSE w.last_pos + 1 + s.n END
           FROM packed w JOIN shuffled s ON s.turn = w.turn + 1""",
    ),
}


def shuffle_key_sql(seed: int | str) -> str:
    """SQL of the shuffle key for a seed, given as a number or as an expression."""
    spread = "(idx % 2147483648 * 2654435761 % 4294967296)"
    return f"(xor(xor({spread}, {spread} >> 15), {seed} * 40503) * 1597334677 % 4294967296)"


def sql(body: str, *uses: str) -> str:
    """``body`` behind the views it uses, in the order they build on each other."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in _SQL[name][0]:
            need(other)
        if name not in needed:
            needed.append(name)

    for name in uses:
        need(name)
    if not needed:
        return body
    texts = {name: _SQL[name][1].replace("{key}", shuffle_key_sql(0)) for name in needed}
    views = ",\n".join(f"{name} AS ({text})" for name, text in texts.items())
    return f"WITH RECURSIVE {views}\n{body}"
