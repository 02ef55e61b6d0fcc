"""Registered queries: line-level localisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.operators import lines
from codewarden.plans import views
from codewarden.plans.metric_queries import function_results
from codewarden.plans.registry import query, round_doubles, rounded
from codewarden.plans.row_queries import FLAW_TEXT, joined_flaws
from codewarden.plans.views import WORD, sql

FRACTIONS = (0.05, 0.2, 0.5)
CONSTANTS = (1, 5, 10)
_FRACTIONS = "(SELECT CAST(unnest([0.05, 0.2, 0.5]) AS DOUBLE) AS fraction)"
_CONSTANTS = "(SELECT CAST(unnest([1, 5, 10]) AS INTEGER) AS k)"


# --- token scores -------------------------------------------------------------------------------


_TOKEN_SCORE = """token_score AS (SELECT func_id, k AS pos, sum(weight) AS score FROM attention GROUP BY func_id, k)"""


@query(
    "attention_token_score",
    sql("", "attention").rstrip()
    + f", {_TOKEN_SCORE} SELECT func_id, pos, round(score, 6) AS score FROM token_score",
)
def attention_token_score(spark, sf):
    return round_doubles(lines.attention_token_score(views.attention(spark, sf)))


@query(
    "clean_special_scores",
    sql("", "attention").rstrip()
    + f""", {_TOKEN_SCORE} SELECT func_id, pos, round(CASE WHEN pos = first OR pos = last THEN 0.0
          ELSE score END, 6) AS score FROM (SELECT *, min(pos) OVER (PARTITION BY func_id) AS first,
            max(CASE WHEN score <> 0 THEN pos END) OVER (PARTITION BY func_id) AS last FROM token_score)""",
)
def clean_special_scores(spark, sf):
    scores = lines.attention_token_score(views.attention(spark, sf))
    return round_doubles(lines.clean_special_scores(scores))


@query(
    "drop_special_tokens",
    sql(
        """SELECT func_id, pos, token FROM (SELECT func_id, pos, CASE WHEN pos % 10 = 0 THEN '<s>'
             WHEN pos % 10 = 9 THEN '<pad>' ELSE token END AS token FROM token_rows)
           WHERE token NOT IN ('<s>', '</s>', '<unk>', '<pad>')""",
        "token_rows",
    ),
)
def drop_special_tokens(spark, sf):
    marked = F.transform(
        "tokens",
        lambda p, i: F.struct(
            F.when(i % 10 == 0, "<s>")
            .when(i % 10 == 9, "<pad>")
            .otherwise(p["token"])
            .alias("token"),
            i.cast("long").alias("pos"),
        ),
    )
    kept = views.token_arrays(spark, sf).select(
        "func_id", F.inline_outer(lines.drop_special_tokens(marked))
    )
    return kept.filter(F.col("pos").isNotNull()).select("func_id", "pos", "token")


@query(
    "attribution_token_score",
    sql(
        """SELECT func_id, pos, round(total / sqrt(sum(total * total) OVER (PARTITION BY func_id)), 6) AS score
           FROM (SELECT func_id, pos, list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE))) AS total
                 FROM vectors)""",
        "vectors",
    ),
)
def attribution_token_score(spark, sf):
    return round_doubles(lines.attribution_token_score(views.vectors(spark, sf)))


@query(
    "pair_token_scores",
    sql("SELECT func_id, pos, token, round(score, 6) AS score FROM token_rows", "token_rows"),
)
def pair_token_scores(spark, sf):
    scored = views.token_arrays(spark, sf).select(
        "func_id",
        lines.pair_token_scores(
            F.transform("tokens", lambda p: p["token"]), F.transform("tokens", lambda p: p["score"])
        ).alias("pairs"),
    )
    rows = scored.select("func_id", F.posexplode_outer("pairs").alias("pos", "pair"))
    return rows.filter(F.col("pos").isNotNull()).select(
        "func_id",
        F.col("pos").cast("long").alias("pos"),
        "pair.token",
        rounded("pair.score").alias("score"),
    )


# --- lines ----------------------------------------------------------------------------------------


@query(
    "line_scores",
    sql(
        "SELECT func_id, line_idx, line, round(score, 6) AS score FROM token_lines", "token_lines"
    ),
)
def line_scores(spark, sf):
    scored = lines.line_scores(views.token_arrays(spark, sf))
    rows = scored.select("func_id", F.posexplode_outer("lines").alias("line_idx", "x"))
    return rows.filter(F.col("line_idx").isNotNull()).select("func_id", "line_idx", "x.line", rounded("x.score").alias("score"))


@query(
    "line_scores_rows",
    sql(
        "SELECT func_id, CAST(line_idx AS BIGINT) AS line_idx, line, round(score, 6) AS score FROM token_lines",
        "token_lines",
    ),
)
def line_scores_rows(spark, sf):
    rows = views.token_arrays(spark, sf).select(
        "func_id", F.posexplode_outer("tokens").alias("pos", "t")
    )
    tokens = rows.filter(F.col("pos").isNotNull()).select("func_id", "pos", "t.token", "t.score")
    return round_doubles(lines.line_scores_rows(tokens))


def _wanted(spark, sf):
    """Token arrays beside the joined flaw texts of the same document."""
    tokens = views.token_arrays(spark, sf).select("func_id", "tokens")
    return tokens.join(joined_flaws(spark, sf), "func_id")


_WANTED = f"""wanted AS (SELECT func_id, array_to_string(list_filter(regexp_extract_all('@ ' || flaw, '{WORD}'),
    lambda t: t <> '@'), '') AS flaw
  FROM (SELECT func_id, unnest(string_split(regexp_replace(flaws, '^[/~]+|[/~]+$', '', 'g'), '/~/')) AS flaw
        FROM {FLAW_TEXT})),
spelled AS (SELECT func_id, string_agg(replace(replace(token, 'Ġ', ''), 'ĉ', 'Ċ'), '' ORDER BY pos) AS code
  FROM token_rows GROUP BY func_id),
verified AS (SELECT DISTINCT w.func_id, flaw FROM wanted w JOIN spelled s ON w.func_id = s.func_id
  WHERE contains(code, flaw)),
labelled AS (SELECT t.func_id, line_idx, line, score,
    CAST(EXISTS (SELECT 1 FROM verified v WHERE v.func_id = t.func_id AND v.flaw = t.line) AS INTEGER) AS label
  FROM token_lines t WHERE func_id IN (SELECT func_id FROM verified)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY func_id ORDER BY score DESC, line_idx) - 1 AS rank,
    count(*) OVER (PARTITION BY func_id) AS total_lines FROM labelled)"""


def _located(body: str) -> str:
    return sql("", "line_rows", "token_lines").rstrip() + f",\n{_WANTED}\n{body}"


@query(
    "verify_flaws",
    _located(
        """SELECT func_id, CAST(count(*) AS INTEGER) AS wanted, CAST(count_if(contains(code, flaw)) AS INTEGER)
             AS verified FROM wanted JOIN spelled USING (func_id) GROUP BY func_id"""
    ),
)
def verify_flaws(spark, sf):
    wanted = F.transform(
        text.parse_flaw_lines(F.col("flaws")),
        lambda line: F.array_join(text.encode_flaw_line(line), ""),
    )
    spelled = F.array_join(
        F.transform("tokens", lambda p: text.strip_token_marks(p["token"])), ""
    )
    ready = _wanted(spark, sf).select("func_id", wanted.alias("texts"), spelled.alias("code"))
    return ready.filter(F.size("texts") > 0).select(
        "func_id",
        F.size("texts").alias("wanted"),
        F.size(lines.verified_flaws(F.col("texts"), F.col("code"))).alias("verified"),
    )


@query(
    "label_lines",
    sql("SELECT func_id, line_idx, round(score, 6) AS score, label FROM label_input", "line_rows")
    .replace(
        "SELECT func_id, line_idx, round",
        """, label_input AS (SELECT func_id, line_idx, score, CAST(line IN (SELECT line FROM line_rows f
             WHERE f.func_id = r.func_id AND f.label = 1) AS INTEGER) AS label FROM line_rows r)
           SELECT func_id, line_idx, round""",
    ),
)
def label_lines(spark, sf):
    flaws = F.transform(F.filter("lines", lambda x: x["label"] == 1), lambda x: x["line"])
    labelled = views.line_arrays(spark, sf).select(
        "func_id", lines.label_lines(F.col("lines"), flaws).alias("lines")
    )
    rows = labelled.select("func_id", F.posexplode_outer("lines").alias("line_idx", "x"))
    return rows.select("func_id", "line_idx", rounded("x.score").alias("score"), "x.label")


@query(
    "rank_in_function",
    sql(
        "SELECT func_id, line_idx, CAST(rank AS INTEGER) AS rank FROM ranked_in_function",
        "ranked_in_function",
    ),
)
def rank_in_function(spark, sf):
    ranked = views.line_arrays(spark, sf).select(
        "func_id", F.posexplode_outer(lines.ranked_lines(F.col("lines"))).alias("rank", "x")
    )
    return ranked.select("func_id", "x.line_idx", "rank")


@query(
    "rank_in_function_rows",
    sql("SELECT func_id, line_idx, rank FROM ranked_in_function", "ranked_in_function"),
)
def rank_in_function_rows(spark, sf):
    from codewarden.operators.ordered import rank_within

    rows = views.line_rows(spark, sf).select("func_id", "line_idx", (-F.col("score")).alias("key"))
    ranked = rank_within(rows, ["func_id"], ["key", "line_idx"])
    return ranked.select("func_id", "line_idx", (F.col("rank") - 1).alias("rank"))


_EVAL = """SELECT func_id, fraction, CAST(total_lines AS INTEGER) AS total_lines,
    CAST(count(*) AS INTEGER) AS flaw_lines,
    CAST(count_if(rank < trunc(total_lines * fraction)) AS INTEGER) AS hits,
    CAST(min(rank) AS INTEGER) AS first_flaw, CAST(max(rank) AS INTEGER) AS last_flaw
  FROM {ranked}, {fractions} WHERE label = 1 GROUP BY func_id, fraction, total_lines"""
_TOPK = """SELECT func_id, k, CAST(count(*) AS INTEGER) AS flaw_lines,
    CAST(count_if(rank < k) AS INTEGER) AS hits, count_if(rank < k) > 0 AS located
  FROM {ranked}, {constants} WHERE label = 1 GROUP BY func_id, k"""


@query(
    "line_eval",
    sql(_EVAL.format(ranked="ranked_in_function", fractions=_FRACTIONS), "ranked_in_function"),
)
def line_eval(spark, sf):
    return lines.line_eval(views.line_arrays(spark, sf), FRACTIONS)


@query(
    "topk_localized",
    sql(_TOPK.format(ranked="ranked_in_function", constants=_CONSTANTS), "ranked_in_function"),
)
def topk_localized(spark, sf):
    return lines.topk_localized(views.line_arrays(spark, sf), CONSTANTS)


@query(
    "flaw_in_topk",
    sql(
        """SELECT func_id, line_idx, rank < 5 AS in_top FROM ranked_in_function WHERE label = 1""",
        "ranked_in_function",
    ),
)
def flaw_in_topk(spark, sf):
    ranked = views.line_arrays(spark, sf).select(
        "func_id", F.posexplode_outer(lines.ranked_lines(F.col("lines"))).alias("rank", "x")
    )
    return ranked.filter("x.label = 1").select(
        "func_id", "x.line_idx", (F.col("rank") < 5).alias("in_top")
    )


@query("localize", _located(_EVAL.format(ranked="ranked", fractions=_FRACTIONS)))
def localize(spark, sf):
    return lines.localize(_wanted(spark, sf), FRACTIONS, CONSTANTS)[0]


@query("localize_topk", _located(_TOPK.format(ranked="ranked", constants=_CONSTANTS)))
def localize_topk(spark, sf):
    return lines.localize(_wanted(spark, sf), FRACTIONS, CONSTANTS)[1]


@query(
    "localize_rejects",
    _located(
        """SELECT doc_id AS func_id, coalesce(code, '') AS code FROM documents LEFT JOIN spelled ON doc_id = func_id
           WHERE doc_id NOT IN (SELECT func_id FROM verified)"""
    ),
)
def localize_rejects(spark, sf):
    rejects = lines.localize(_wanted(spark, sf), FRACTIONS, CONSTANTS)[2]
    return rejects.select("func_id", "code")


# --- over all lines -------------------------------------------------------------------------------


def _rows(spark, sf):
    return views.line_rows(spark, sf).drop("line")


@query(
    "rank_lines",
    sql(
        "SELECT func_id, line_idx, round(score, 6) AS score, label, rank FROM ranked_lines",
        "ranked_lines",
    ),
)
def rank_lines(spark, sf):
    return round_doubles(lines.rank_lines(_rows(spark, sf)))


@query(
    "topk_fraction",
    sql(
        """SELECT func_id, line_idx, rank FROM ranked_lines WHERE rank <= trunc(total * 0.2)""",
        "ranked_lines",
    ),
)
def topk_fraction(spark, sf):
    top = lines.top_lines(_rows(spark, sf), fraction=0.2)
    return top.select("func_id", "line_idx", "rank")


@query(
    "topk_constant",
    sql("SELECT func_id, line_idx, rank FROM ranked_lines WHERE rank <= 100", "ranked_lines"),
)
def topk_constant(spark, sf):
    top = lines.top_lines(_rows(spark, sf), k=100)
    return top.select("func_id", "line_idx", "rank")


@query(
    "topk_effort",
    sql(
        """SELECT inspected_lines, round(inspected_lines / total, 4) AS effort FROM (
             SELECT coalesce(min(CASE WHEN caught = trunc(flaws * 0.2) THEN rank END), max(total))
               AS inspected_lines, max(total) AS total FROM ranked_lines)""",
        "ranked_lines",
    ),
)
def topk_effort(spark, sf):
    return lines.topk_effort(_rows(spark, sf), 0.2)


@query(
    "topk_recall",
    sql(
        """SELECT CAST(sum(label) FILTER (rank <= trunc(total * 0.01)) AS BIGINT) AS caught_lines,
             round(sum(label) FILTER (rank <= trunc(total * 0.01)) / sum(label), 4) AS recall
           FROM (SELECT label, count(*) OVER () AS total, row_number() OVER (
                   ORDER BY (func_id * 7919 % 700 + 300) / 1000.0 <= 0.5, score DESC, func_id, line_idx)
                   AS rank FROM line_rows)""",
        "line_rows",
    ),
)
def topk_recall(spark, sf):
    rows = _rows(spark, sf)
    positive = (F.col("func_id") * 7919 % 700 + 300) / 1000.0 > 0.5
    return lines.topk_recall(rows.filter(positive), rows.filter(~positive), 0.01)


_RESULTS = """results AS (SELECT *, CAST(sum(num_lines) OVER w AS BIGINT) AS read, sum(gain) OVER w AS caught,
    sum(num_lines) OVER () AS total, sum(num_flaw_lines) OVER () AS flaws
  FROM (SELECT func_id, num_lines, num_flaw_lines, prob,
          CASE WHEN prob > 0.5 THEN num_flaw_lines ELSE 0 END AS gain
        FROM (SELECT func_id, count_if(length(line) > 0) AS num_lines, sum(label) AS num_flaw_lines,
                (func_id * 7919 % 700 + 300) / 1000.0 AS prob FROM line_rows GROUP BY func_id))
  WINDOW w AS (ORDER BY prob DESC, func_id ROWS UNBOUNDED PRECEDING))"""


@query(
    "topk_effort_pred",
    sql("", "line_rows").rstrip()
    + f""", {_RESULTS} SELECT CAST(inspected AS BIGINT) AS inspected_lines,
          round(inspected / total, 4) AS effort FROM (
            SELECT coalesce(min(CASE WHEN caught >= trunc(flaws * 0.2) THEN read END), max(total)) AS inspected,
              max(total) AS total FROM results)""",
)
def topk_effort_pred(spark, sf):
    return lines.topk_effort_pred(function_results(spark, sf), 0.2)


@query(
    "topk_recall_pred",
    sql("", "line_rows").rstrip()
    + f""", {_RESULTS} SELECT CAST(caught AS BIGINT) AS caught_lines, round(caught / flaws, 4) AS recall FROM (
            SELECT coalesce(sum(gain) FILTER (read <= trunc(total * 0.2)), 0) AS caught,
              max(flaws) AS flaws FROM results)""",
)
def topk_recall_pred(spark, sf):
    return lines.topk_recall_pred(function_results(spark, sf), 0.2)
