"""Line-level localisation: token scores to line scores, labels, ranks and effort measures.

A function is one row and its tokens, lines and ranks are arrays of that row, so everything that
concerns a single function runs without a shuffle. Only measures over the ranked lines of all
functions order data globally, in ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.functions.binding import bind, emit
from codewarden.operators.ordered import ROWS_PER_RANGE, global_rank, running_totals
from codewarden.support import checked_score, materialize, small_side, truncated

#: Positions of a function that one row may hold.
WHOLE = 1 << 16


# --- token scores -------------------------------------------------------------------------


def attention_token_score(attention: DataFrame) -> DataFrame:
    """Weight each key position receives, summed over heads and query positions."""
    return attention.groupBy("func_id", F.col("k").alias("pos")).agg(
        F.sum("weight").alias("score")
    )


def attribution_token_score(attributions: DataFrame) -> DataFrame:
    """Sum of each attribution vector, scaled by the norm of the function's sums."""
    summed = attributions.select(
        "func_id",
        "pos",
        F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double")).alias("total"),
    )
    norm = F.sqrt(F.sum(F.col("total") ** 2).over(W.partitionBy("func_id")))
    return summed.select(
        "func_id", "pos", (F.col("total") / F.nullif(norm, F.lit(0.0))).alias("score")
    )


def clean_special_scores(token_scores: DataFrame, padding: bool = True) -> DataFrame:
    """Zero the score of the first token, and of the last one.

    With padding, the last token is the last whose score is not 0.
    """
    function = W.partitionBy("func_id")
    last = F.max(F.when(F.col("score") != 0, F.col("pos"))) if padding else F.max("pos")
    edges = token_scores.withColumns(
        {"__first": F.min("pos").over(function), "__last": last.over(function)}
    )
    at_edge = (F.col("pos") == F.col("__first")) | F.coalesce(
        F.col("pos") == F.col("__last"), F.lit(False)
    )
    return edges.withColumn(
        "score", F.when(at_edge, 0.0).otherwise(F.col("score"))
    ).drop("__first", "__last")


def clean_special_array(scores: Column, padding: bool = True) -> Column:
    """:func:`clean_special_scores` on the score array of one function."""
    if padding:
        last = F.array_max(
            F.transform(scores, lambda x, i: F.when((x != 0) & (i > 0), i))
        )
    else:
        last = F.size(scores) - 1
    return bind(
        F.coalesce(last, F.lit(0)),
        lambda at: F.transform(
            scores, lambda x, i: F.when((i == 0) | (i == at), F.lit(0.0)).otherwise(x)
        ),
    )


def pair_token_scores(tokens: Column, scores: Column) -> Column:
    return F.zip_with(tokens, scores, lambda t, s: F.struct(t.alias("token"), s.alias("score")))


def drop_special_tokens(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: ~p["token"].isin(text.SPECIAL_TOKENS))


def gather_token_scores(token_scores: DataFrame, max_tokens: int = 512) -> DataFrame:
    """Long token scores as one array a function.

    A group is one model input, whose length the model bounds. A position beyond
    ``max_tokens`` stops the job before anything is gathered.
    """
    problem = F.lit(f"a function has more than {max_tokens} tokens")
    bounded = token_scores.filter(
        F.when(F.col("pos") < max_tokens, True).otherwise(F.raise_error(problem))
    )
    return bounded.groupBy("func_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "token", "score"))),
            lambda x: F.struct(x["token"].alias("token"), x["score"].alias("score")),
        ).alias("tokens")
    )


# --- lines --------------------------------------------------------------------------------


def line_scores(df: DataFrame, tokens: str = "tokens", out: str = "lines") -> DataFrame:
    """Add the array of scored lines (line, score) spelled by the scored tokens.

    A line ends at a separator token or at the last token, whose own score is added. A stretch
    whose tokens sum to 0 yields no line, and its text moves on to the next line; the closing
    token's text belongs to no line.
    """
    return df.withColumn(out, bind(F.col(tokens), _lines_of))


def _lines_of(pairs: Column) -> Column:
    separators = text.LINE_SEPARATORS

    def between(after: Column, end: Column) -> Column:
        return F.slice(pairs, after + 2, end - after - 1)

    def with_previous(ends: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(-1)), ends), 1, F.size(ends))
        return F.zip_with(before, ends, lambda a, e: F.struct(a.alias("after"), e.alias("end")))

    closing = F.filter(
        F.transform(
            pairs,
            lambda p, i: F.when(p["token"].isin(separators) | (i == F.size(pairs) - 1), i),
        ),
        lambda i: i.isNotNull(),
    )
    stretches = F.transform(
        bind(closing, with_previous),
        lambda s: F.struct(
            s["end"].alias("end"),
            F.aggregate(
                between(s["after"], s["end"]), F.lit(0.0), lambda acc, p: acc + p["score"]
            ).alias("total"),
        ),
    )

    def to_lines(live: Column) -> Column:
        spans = bind(F.transform(live, lambda s: s["end"]), with_previous)
        return F.zip_with(
            spans,
            live,
            lambda span, s: F.struct(
                F.array_join(
                    F.transform(
                        F.filter(
                            between(span["after"], span["end"]),
                            lambda p: ~p["token"].isin(separators),
                        ),
                        lambda p: p["token"],
                    ),
                    "",
                ).alias("line"),
                (s["total"] + F.get(pairs, s["end"])["score"]).alias("score"),
            ),
        )

    return bind(F.filter(stretches, lambda s: s["total"] != 0), to_lines)


def line_scores_rows(tokens: DataFrame, chunk: int = 4096, whole: int = WHOLE) -> DataFrame:
    """:func:`line_scores` for tokens that come as rows, for functions of any length.

    ``tokens`` holds (func_id, pos, token, score), the positions counting from 0. Rows are gathered,
    ``whole`` positions at most, in one shuffle, and written so. A function of one such part is an array
    already; a longer one is cut in chunks of positions, so no task holds a whole one and only the text
    of a single line is gathered. Returns (func_id, line_idx, line, score).
    """
    known = tokens.filter(F.col("func_id").isNotNull())
    parts = known.groupBy("func_id", F.floor(F.col("pos") / whole).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "token", "score"))).alias("tokens")
    )
    parts = materialize(parts, "tokens")
    long = small_side(parts.filter("part > 0").select("func_id").distinct())
    short = parts.join(long, "func_id", "left_anti")
    scored = line_scores(short).select("func_id", F.posexplode_outer("lines").alias("line_idx", "x"))
    found = scored.filter(F.col("line_idx").isNotNull()).select(
        "func_id", F.col("line_idx").cast("long").alias("line_idx"), "x.line", "x.score"
    )
    if long.isEmpty():
        return found
    rows = parts.join(long, "func_id", "left_semi").select("func_id", F.inline("tokens"))
    return found.unionByName(_line_scores_in_chunks(rows, chunk))


def _line_scores_in_chunks(tokens: DataFrame, chunk: int) -> DataFrame:
    last = tokens.groupBy("func_id").agg(F.max("pos").alias("__last"))
    closing = F.col("token").isin(text.LINE_SEPARATORS) | (F.col("pos") == F.col("__last"))
    marked = tokens.join(last, "func_id").withColumns(
        {"__closes": closing.cast("long"), "__chunk": F.floor(F.col("pos") / chunk)}
    )
    counted = running_totals(
        marked.drop("__last"), ["pos"], {"__upto": F.col("__closes")}, keys=["func_id"], cells=["__chunk"]
    )
    inside = F.col("__closes") == 0
    pieces = counted.groupBy("func_id", (F.col("__upto") - F.col("__closes")).alias("stretch")).agg(
        F.coalesce(F.sum(F.when(inside, F.col("score"))), F.lit(0.0)).alias("total"),
        F.max(F.when(~inside, F.col("score"))).alias("closing"),
        _joined_in_order("pos", F.when(inside, F.col("token"))).alias("piece"),
    )
    live = F.col("total") != 0
    numbered = running_totals(
        pieces.withColumn("__chunk", F.floor(F.col("stretch") / chunk)),
        ["stretch"],
        {"__lines": live.cast("long")},
        keys=["func_id"],
        cells=["__chunk"],
    )
    line_idx = F.col("__lines") - live.cast("long")
    found = numbered.groupBy("func_id", line_idx.alias("line_idx")).agg(
        _joined_in_order("stretch", F.col("piece")).alias("line"),
        F.max(F.when(live, F.col("total") + F.col("closing"))).alias("score"),
    )
    return found.filter(F.col("score").isNotNull())


def _joined_in_order(order: str, part: Column) -> Column:
    """Aggregate: the non-null parts joined in the order of a column."""
    pairs = F.collect_list(F.when(part.isNotNull(), F.struct(F.col(order), part.alias("part"))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["part"]), "")


def verified_flaws(flaws: Column, code: Column) -> Column:
    """Those flaw texts that occur inside the function's text."""
    return bind(code, lambda whole: F.filter(flaws, lambda flaw: F.contains(whole, flaw)))


def label_lines(lines: Column, flaws: Column) -> Column:
    """Add to each line its label: 1 if its text equals a flaw line."""

    def labelled(known: Column) -> Column:
        return F.transform(
            lines,
            lambda x: F.struct(
                x["line"].alias("line"),
                x["score"].alias("score"),
                F.coalesce(F.array_contains(known, x["line"]), F.lit(False))
                .cast("int")
                .alias("label"),
            ),
        )

    return bind(flaws, labelled)


def flaw_line_match(lines: DataFrame, flaws: DataFrame) -> DataFrame:
    """Long form of :func:`label_lines`: (func_id, line) pairs joined to the distinct flaws."""
    known = flaws.select("func_id", "line").distinct().withColumn("__flaw", F.lit(1))
    joined = lines.join(known, ["func_id", "line"], "left")
    return joined.withColumn("label", F.coalesce("__flaw", F.lit(0))).drop("__flaw")


def ranked_lines(lines: Column) -> Column:
    """Lines of a function by falling score, ties in line order, with their line index.

    ``lines`` has fields score and label.
    """
    keyed = F.transform(
        lines,
        lambda x, i: F.struct(
            (-x["score"]).alias("key"),
            i.alias("line_idx"),
            x["score"].alias("score"),
            x["label"].alias("label"),
        ),
    )
    return F.array_sort(keyed)


def flaw_ranks(lines: Column) -> Column:
    """0-based ranks of a function's flaw lines."""
    return F.filter(
        F.transform(ranked_lines(lines), lambda x, r: F.when(x["label"] == 1, r)),
        lambda r: r.isNotNull(),
    )


def line_eval(df: DataFrame, fractions: Sequence[float], lines: str = "lines") -> DataFrame:
    """Per function and fraction: flaws within the top lines, and how many lines come before
    the first (initial false alarm) and the last flaw. Functions without flaw lines drop out."""
    wanted = F.array(*[F.lit(float(f)) for f in fractions])

    def measured(known: Column) -> Column:
        total = F.size(known)

        def at(ranks: Column) -> Column:
            return F.transform(
                F.when(F.size(ranks) > 0, wanted),
                lambda f: F.struct(
                    f.alias("fraction"),
                    total.alias("total_lines"),
                    F.size(ranks).alias("flaw_lines"),
                    F.size(F.filter(ranks, lambda r: r < truncated(total * f))).alias("hits"),
                    F.array_min(ranks).alias("first_flaw"),
                    F.array_max(ranks).alias("last_flaw"),
                ),
            )

        return bind(flaw_ranks(known), at)

    return emit(df, bind(F.col(lines), measured), ["func_id"], "fraction")


def topk_localized(df: DataFrame, ks: Sequence[int], lines: str = "lines") -> DataFrame:
    """Per function and constant k: flaws among the first k lines, and whether there is any."""
    wanted = F.array(*[F.lit(int(k)) for k in ks])

    def measured(ranks: Column) -> Column:
        def at(k: Column) -> Column:
            hits = F.size(F.filter(ranks, lambda r: r < k))
            return F.struct(
                k.alias("k"),
                F.size(ranks).alias("flaw_lines"),
                hits.alias("hits"),
                (hits > 0).alias("located"),
            )

        return F.transform(F.when(F.size(ranks) > 0, wanted), at)

    return emit(df, bind(flaw_ranks(F.col(lines)), measured), ["func_id"], "k")


def localize(df: DataFrame, fractions: Sequence[float], ks: Sequence[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Token scores to localisation measures: (line_eval, topk_localized, rejects).

    ``df`` holds (func_id, tokens array<struct<token, score>>, flaws joined by the separator).
    Functions none of whose flaws occurs in their text are the rejects. Scored lines and checked
    flaws are written once, and all three outputs are read from there.
    """
    stripped = F.transform(
        "tokens",
        lambda p: F.struct(
            text.strip_token_marks(p["token"]).alias("token"), p["score"].alias("score")
        ),
    )
    spelled = F.array_join(F.transform("tokens", lambda p: p["token"]), "")
    wanted = F.transform(
        text.parse_flaw_lines(F.col("flaws")),
        lambda line: F.array_join(text.encode_flaw_line(line), ""),
    )
    checked = (
        df.withColumn("tokens", stripped)
        .withColumn("wanted", wanted)
        .withColumn("code", spelled)
        .withColumn("verified", verified_flaws(F.col("wanted"), F.col("code")))
    )
    labelled = F.when(
        F.size("verified") > 0,
        label_lines(bind(F.col("tokens"), _lines_of), F.col("verified")),
    )
    checked = materialize(
        checked.select("func_id", "wanted", "code", "verified", labelled.alias("lines")), "localized"
    )
    found = checked.select("func_id", "lines")
    missed = F.when(F.size("verified") == 0, F.array(F.struct("code", "wanted")))
    rejects = emit(checked, missed, ["func_id"], "code")
    return line_eval(found, fractions), topk_localized(found, ks), rejects


# --- measures over the lines of all functions ---------------------------------------------


def rank_lines(
    lines: DataFrame, ascending: bool = False, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """All functions' lines in one order by score, numbered from 1; ties by function and line."""
    sign = 1.0 if ascending else -1.0
    keyed = lines.withColumn("__key", checked_score(F.col("score")) * sign)
    order = ["__key", "func_id", "line_idx"]
    return global_rank(keyed, order, "rank", rows_per_range).drop("__key")


def top_lines(
    lines: DataFrame,
    fraction: float | None = None,
    k: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """The first k lines by falling score, or the given fraction of all of them, with their rank.

    The first k are a limit, numbered afterwards; a fraction takes its total from the ranking.
    """
    keyed = lines.withColumn("__key", -checked_score(F.col("score")))
    order = ["__key", "func_id", "line_idx"]
    if k is not None:
        first = keyed.orderBy(*order).limit(k)
        rank = F.row_number().over(W.orderBy(*order)).cast("long")
        return first.withColumn("rank", rank).drop("__key")
    ranked = running_totals(
        keyed,
        order,
        {"rank": F.lit(1).cast("long")},
        grand={"rank": "__lines"},
        rows_per_range=rows_per_range,
    )
    wanted = truncated(F.col("__lines") * float(fraction))
    return ranked.filter(F.col("rank") <= wanted).drop("__key", "__lines")


def topk_effort(
    lines: DataFrame, fraction: float, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Share of lines read until the given fraction of flaw lines is found.

    The count of flaws is compared after each row and for equality: a target of 0 is met by a
    clean first row only. A target that is never met costs all rows.
    """
    keyed = lines.withColumn("__key", -checked_score(F.col("score")))
    walked = running_totals(
        keyed,
        ["__key", "func_id", "line_idx"],
        {"__read": F.lit(1).cast("long"), "__caught": (F.col("label") == 1).cast("long")},
        grand={"__read": "__lines", "__caught": "__flaws"},
        rows_per_range=rows_per_range,
    )
    met = F.col("__caught") == truncated(F.col("__flaws") * float(fraction))
    inspected = F.coalesce(F.min(F.when(met, F.col("__read"))), F.max("__lines"))
    return walked.agg(
        inspected.alias("inspected_lines"),
        F.round(inspected / F.max("__lines"), 4).alias("effort"),
    )


def topk_recall(
    positives: DataFrame,
    negatives: DataFrame,
    fraction: float,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Share of flaw lines found when reading that fraction of all lines: the lines of functions
    predicted vulnerable first, then the others, each by falling score."""
    lines = positives.withColumn("__phase", F.lit(0)).unionByName(
        negatives.withColumn("__phase", F.lit(1))
    )
    keyed = lines.withColumn("__key", -checked_score(F.col("score")))
    walked = running_totals(
        keyed,
        ["__phase", "__key", "func_id", "line_idx"],
        {"__read": F.lit(1).cast("long"), "__caught": (F.col("label") == 1).cast("long")},
        grand={"__read": "__lines", "__caught": "__flaws"},
        rows_per_range=rows_per_range,
    )
    within = F.col("__read") <= truncated(F.col("__lines") * float(fraction))
    caught = F.sum(F.when(within & (F.col("label") == 1), 1).otherwise(0))
    flaws = F.nullif(F.max("__flaws"), F.lit(0))
    return walked.agg(caught.alias("caught_lines"), F.round(caught / flaws, 4).alias("recall"))


def _walk_functions(results: DataFrame, rows_per_range: int) -> DataFrame:
    keyed = results.withColumn("__key", -checked_score(F.col("prob"), "prob"))
    predicted = F.when(F.col("pred") == 1, F.col("num_flaw_lines")).otherwise(0)
    walked = running_totals(
        keyed.withColumn("__all_flaws", F.col("num_flaw_lines")),
        ["__key", "func_id"],
        {
            "__read": F.col("num_lines").cast("long"),
            "__caught": predicted.cast("long"),
            "__flaws_to": F.col("__all_flaws").cast("long"),
        },
        grand={"__read": "__lines", "__flaws_to": "__flaws"},
        rows_per_range=rows_per_range,
    )
    return walked.withColumn("__gain", predicted)


def topk_effort_pred(
    results: DataFrame, fraction: float, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Share of lines read, whole functions by falling probability, until the given fraction of
    flaw lines lies in functions predicted vulnerable."""
    walked = _walk_functions(results, rows_per_range)
    met = F.col("__caught") >= truncated(F.col("__flaws") * float(fraction))
    inspected = F.coalesce(F.min(F.when(met, F.col("__read"))), F.max("__lines"))
    return walked.agg(
        inspected.alias("inspected_lines"),
        F.round(inspected / F.max("__lines"), 4).alias("effort"),
    )


def topk_recall_pred(
    results: DataFrame, fraction: float, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Share of flaw lines in functions predicted vulnerable that fit the line budget whole."""
    walked = _walk_functions(results, rows_per_range)
    within = F.col("__read") <= truncated(F.col("__lines") * float(fraction))
    caught = F.sum(F.when(within, F.col("__gain")).otherwise(0))
    flaws = F.nullif(F.max("__flaws"), F.lit(0))
    return walked.agg(caught.alias("caught_lines"), F.round(caught / flaws, 4).alias("recall"))
