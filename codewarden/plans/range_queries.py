"""The code that runs at scale, on small tables: the same queries with ranges so short, and sides
so small, that every table is cut and joined. Rows and SQL are those of the plain forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.operators import (
    classes,
    curves,
    lines,
    metrics,
    ordered,
    packing,
    running,
    sampling,
    vocab,
)
from codewarden.plans import class_queries, line_queries, metric_queries, packing_queries, views
from codewarden.plans.registry import ORACLE, query, round_doubles

ROWS = 300


def _again(name: str):
    """Register the ranged form of a query beside it, with its SQL."""
    return query(f"{name}_ranges", ORACLE[name])


@_again("rank_lines")
def rank_lines(spark, sf):
    return round_doubles(lines.rank_lines(line_queries._rows(spark, sf), rows_per_range=ROWS))


@_again("topk_fraction")
def topk_fraction(spark, sf):
    top = lines.top_lines(line_queries._rows(spark, sf), fraction=0.2, rows_per_range=ROWS)
    return top.select("func_id", "line_idx", "rank")


@_again("topk_effort")
def topk_effort(spark, sf):
    return lines.topk_effort(line_queries._rows(spark, sf), 0.2, ROWS)


@_again("topk_recall")
def topk_recall(spark, sf):
    rows = line_queries._rows(spark, sf)
    positive = (F.col("func_id") * 7919 % 700 + 300) / 1000.0 > 0.5
    return lines.topk_recall(rows.filter(positive), rows.filter(~positive), 0.01, ROWS)


@_again("roc_auc")
def roc_auc(spark, sf):
    table = curves.score_table(views.scores(spark, sf), rows_per_range=ROWS)
    return round_doubles(curves.roc_auc(table))


@_again("seeded_shuffle")
def seeded_shuffle(spark, sf):
    ids = views.code(spark, sf).select("idx")
    return sampling.seeded_shuffle(ids, seed=3, rows_per_range=ROWS)


@_again("running_report")
def running_report(spark, sf):
    events = metric_queries.running_events(spark, sf)
    return round_doubles(
        running.running_report(
            events, "event_id", skipped="skip", score="score", rows_per_range=ROWS
        )
    )


@_again("rank_in_function_rows")
def rank_in_function_rows(spark, sf):
    rows = views.line_rows(spark, sf).select("func_id", "line_idx", (-F.col("score")).alias("key"))
    ranked = ordered.rank_within(rows, ["func_id"], ["key", "line_idx"], rows_per_group=20)
    return ranked.select("func_id", "line_idx", (F.col("rank") - 1).alias("rank"))


@_again("balanced_sample")
def balanced_sample(spark, sf):
    drawn = sampling.balanced_sample(views.functions(spark, sf), seed=7, rows_per_range=ROWS)
    return drawn.select("draw", "idx", "target")


@_again("encode_vocab")
def encode_vocab(spark, sf):
    encoded = vocab.train_and_encode(views.code(spark, sf))[1]
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return encoded.select("idx", ids.alias("ids"))


@_again("class_index")
def class_index(spark, sf):
    return classes.class_index(classes.class_stats(class_queries._classed(spark, sf)), 3)


# Ranges of rows, and of ranges, so few that all levels of the composition run.
PACK_RANGES = {"rows_per_range": 50, "fan": 4}


@_again("pack_sequences")
def pack_sequences(spark, sf):
    lengths = views.lengths(spark, sf)
    packed = packing.pack_sequences(
        lengths, packing_queries.LENGTH, packing_queries.FUNCTIONS, **PACK_RANGES
    )
    return packed.select("pack", "slot", "idx", "n")


@_again("pack_epochs")
def pack_epochs(spark, sf):
    lengths = views.lengths(spark, sf)
    packed = packing.pack_sequences(
        lengths, packing_queries.LENGTH, packing_queries.FUNCTIONS, epochs=3, **PACK_RANGES
    )
    return round_doubles(packing.pack_stats(packed, packing_queries.LENGTH))


@_again("emit_packs")
def emit_packs(spark, sf):
    rows = packing_queries.functions(spark, sf)
    return packing_queries.shown(packing_queries.emitted(rows, **PACK_RANGES))
