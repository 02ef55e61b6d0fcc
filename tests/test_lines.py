"""Line-level operators against direct evaluation on small functions."""

import random

import pytest
from pyspark.sql import functions as F

from codewarden.operators import lines, ordered

TOKENS = "func_id long, tokens array<struct<token:string,score:double>>"
SEP = "Ċ"


def scored(spark, pairs):
    df = spark.createDataFrame([(1, pairs)], TOKENS)
    return [tuple(x) for x in lines.line_scores(df).first()["lines"]]


def brute(pairs):
    """Lines of scored tokens, spelled out token by token."""
    out, text, total = [], "", 0.0
    for i, (token, score) in enumerate(pairs):
        ends = token in (SEP, " " + SEP, SEP * 2, " " + SEP * 2)
        if (ends or i == len(pairs) - 1) and total != 0:
            out.append((text, total + score))
            text, total = "", 0.0
        elif not ends:
            text, total = text + token, total + score
    return out


def test_line_with_sum_zero_moves_on(spark):
    assert scored(spark, [("a", 0.0), (SEP, 5.0), ("b", 1.0), (SEP, 0.0)]) == [("ab", 1.0)]


def test_last_token_closes_the_line(spark):
    assert scored(spark, [("a", 1.0), ("b", 2.0)]) == [("a", 3.0)]
    assert scored(spark, [("a", 0.0), ("b", 2.0)]) == []
    assert scored(spark, []) == []


def test_lines_against_direct_evaluation(spark):
    rng = random.Random(4)
    words = ["x", "y", SEP, SEP * 2, "z", " " + SEP]
    rows = [
        (i, [(rng.choice(words), float(rng.choice([-1, 0, 0, 1, 2]))) for _ in range(rng.randrange(40))])
        for i in range(200)
    ]
    got = lines.line_scores(spark.createDataFrame(rows, TOKENS)).collect()
    for r in got:
        assert [tuple(x) for x in r["lines"]] == brute(rows[r["func_id"]][1])


@pytest.mark.parametrize("chunk", [3, 4096])
def test_lines_of_rows_agree(spark, chunk):
    rng = random.Random(6)
    words = ["x", "y", SEP, "z", SEP * 2]
    rows = {
        i: [(rng.choice(words), float(rng.choice([0, 0, 1, 2]))) for _ in range(rng.randrange(1, 60))]
        for i in range(60)
    }
    flat = [(i, p, t, s) for i, pairs in rows.items() for p, (t, s) in enumerate(pairs)]
    df = spark.createDataFrame(flat, "func_id long, pos int, token string, score double")
    got = {}
    for r in lines.line_scores_rows(df, chunk).orderBy("func_id", "line_idx").collect():
        assert r["line_idx"] == len(got.setdefault(r["func_id"], []))
        got[r["func_id"]].append((r["line"], r["score"]))
    assert got == {i: brute(pairs) for i, pairs in rows.items() if brute(pairs)}


def test_lines_of_rows_are_written_once_unless_long(spark, monkeypatch):
    written, materialize = [], lines.materialize

    def counted(df, purpose):
        written.append(purpose)
        return materialize(df, purpose)

    monkeypatch.setattr(lines, "materialize", counted)
    monkeypatch.setattr(ordered, "materialize", counted)
    rng = random.Random(8)
    rows = {
        i: [(rng.choice(["x", SEP, "z"]), float(rng.choice([0, 1, 2]))) for _ in range(rng.randrange(1, 40))]
        for i in range(40)
    }
    flat = [(i, p, t, s) for i, pairs in rows.items() for p, (t, s) in enumerate(pairs)]
    df = spark.createDataFrame(flat, "func_id long, pos int, token string, score double")
    want = {(i, n, *line) for i, pairs in rows.items() for n, line in enumerate(brute(pairs))}
    assert {tuple(r) for r in lines.line_scores_rows(df).collect()} == want
    assert written == ["tokens"]
    # Some functions are one part, others are cut.
    assert {tuple(r) for r in lines.line_scores_rows(df, 4, whole=20).collect()} == want
    assert len(written) > 2


LINES = "func_id long, lines array<struct<line:string,score:double,label:int>>"


def test_line_eval(spark):
    scores = [0.1, 0.9, 0.5, 0.9, 0.2]
    rows = [(1, [(str(i), s, int(i in (2, 3))) for i, s in enumerate(scores)]), (2, [("a", 1.0, 0)])]
    df = spark.createDataFrame(rows, LINES)
    got = {r["fraction"]: r for r in lines.line_eval(df, [0.2, 0.4, 0.65]).collect()}
    # Ranked lines: 1, 3, 2, 4, 0; the flaws are at ranks 1 and 2.
    assert {f: r["hits"] for f, r in got.items()} == {0.2: 0, 0.4: 1, 0.65: 2}
    assert {(r["func_id"], r["first_flaw"], r["last_flaw"]) for r in got.values()} == {(1, 1, 2)}
    top = {r["k"]: (r["hits"], r["located"]) for r in lines.topk_localized(df, [1, 2, 10]).collect()}
    assert top == {1: (0, False), 2: (1, True), 10: (2, True)}


def ranked(spark, labels):
    """Lines whose scores fall in the given order of labels."""
    rows = [(1, i, 1.0 - i / 100.0, x) for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, "func_id long, line_idx int, score double, label int")


@pytest.mark.parametrize(
    "labels, fraction, want",
    [
        ([1, 0, 0, 0], 0.0, 4),  # target 0 is passed by the first flaw and never met
        ([0, 1, 0, 0], 0.0, 1),
        ([0, 1, 0, 1], 0.5, 2),
        ([0, 1, 0, 1], 1.0, 4),
    ],
)
def test_topk_effort(spark, labels, fraction, want):
    got = lines.topk_effort(ranked(spark, labels), fraction).first()
    assert got["inspected_lines"] == want
    assert got["effort"] == round(want / len(labels), 4)


def test_topk_recall_reads_positives_first(spark):
    pos = ranked(spark, [0, 1])
    neg = ranked(spark, [1, 1, 0]).withColumn("func_id", F.lit(2)).withColumn("score", F.col("score") + 5)
    got = lines.topk_recall(pos, neg, 0.6).first()  # three lines: both positives, one negative
    assert (got["caught_lines"], got["recall"]) == (2, 0.6667)


def test_function_walks(spark):
    rows = [(1, 10, 2, 0.9, 1), (2, 5, 1, 0.8, 0), (3, 20, 3, 0.7, 1)]
    df = spark.createDataFrame(
        rows, "func_id long, num_lines int, num_flaw_lines int, prob double, pred int"
    )
    effort = lines.topk_effort_pred(df, 0.5).first()  # 3 of 6 flaws need the third function
    assert (effort["inspected_lines"], effort["effort"]) == (35, 1.0)
    recall = lines.topk_recall_pred(df, 0.5).first()  # 17 lines hold the first two functions
    assert (recall["caught_lines"], recall["recall"]) == (2, 0.3333)


def test_special_scores(spark):
    df = spark.createDataFrame(
        [(1, 0, 3.0), (1, 1, 2.0), (1, 2, 1.0), (1, 3, 0.0)], "func_id long, pos int, score double"
    )
    got = lines.clean_special_scores(df).orderBy("pos").collect()
    assert [r["score"] for r in got] == [0.0, 2.0, 0.0, 0.0]
    last = lines.clean_special_scores(df, padding=False).orderBy("pos").collect()
    assert [r["score"] for r in last] == [0.0, 2.0, 1.0, 0.0]
    array = spark.createDataFrame([([3.0, 2.0, 1.0, 0.0],)], "s array<double>")
    for padding, want in ((True, [0.0, 2.0, 0.0, 0.0]), (False, [0.0, 2.0, 1.0, 0.0])):
        assert array.select(lines.clean_special_array(F.col("s"), padding)).first()[0] == want


def test_gathering_refuses_oversized_functions(spark):
    df = spark.createDataFrame([(1, 0, "a", 1.0), (1, 9, "b", 1.0)], "func_id long, pos int, token string, score double")
    assert len(lines.gather_token_scores(df, 10).first()["tokens"]) == 2
    with pytest.raises(Exception, match="more than 5 tokens"):
        lines.gather_token_scores(df, 5).collect()


def test_localize(spark):
    tokens = [("Ġint", 0.1), ("x", 0.2), (SEP, 0.0), ("y", 0.9), ("++", 0.5), ("ĉ", 0.0), ("z", 0.1), (SEP, 0.0)]
    rows = [(1, tokens, "/~/y++/~/gone/~/"), (2, tokens, "nothing"), (3, tokens, None)]
    df = spark.createDataFrame(rows, TOKENS + ", flaws string")
    evaluated, top, rejects = lines.localize(df, [0.5], [1])
    got = evaluated.collect()
    assert [(r["func_id"], r["total_lines"], r["flaw_lines"], r["hits"], r["first_flaw"]) for r in got] == [(1, 3, 1, 1, 0)]
    assert [(r["func_id"], r["located"]) for r in top.collect()] == [(1, True)]
    assert sorted(r["func_id"] for r in rejects.collect()) == [2, 3]
