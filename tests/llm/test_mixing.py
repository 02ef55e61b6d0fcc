import pytest

from codewarden.llm import mixing
from tests.llm.helpers import EDGES, docs, words


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def brute_targets(sizes):
    """Excess reshared by weight until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return goal | share
        for s in over:
            goal[s] = 3.0 * sizes[s]
            left -= goal[s]
        open_ -= over
    return goal


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 1000, "c": 500, None: 7},
        {"a": 1, "b": 1, "c": 10_000},
        {"a": 5},
        {"a": 100, "b": 100, "c": 100, "d": 3, "e": 0},
        {None: 0},
    ],
)
def test_targets_equal_a_plain_loop(spark, sizes):
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


@pytest.mark.parametrize("bins", [1, 16, 4096])
def test_taken_words_come_near_their_targets(spark, monkeypatch, bins):
    monkeypatch.setattr(mixing, "BINS", bins)
    rows = [(n, words(n, 1 + n % 40), f"s{n % 4 if n % 3 else 0}") for n in range(400)]
    found = mixing.choose(mixing.records(docs(spark, rows), labels(spark))).collect()
    assert len(found) == 400
    by = {}
    for r in found:
        assert 0 <= r.copies <= 3
        by.setdefault(r.source, []).append(r)
    for mine in by.values():
        taken = sum(r["size"] * r.copies for r in mine)
        assert abs(taken - mine[0].target) <= max(r["size"] for r in mine) / 2 + 1e-6
        # Complete epochs first, then the least keys.
        most, least = max(r.copies for r in mine), min(r.copies for r in mine)
        assert most - least <= 1
        if most > least:
            last = max(r.key for r in mine if r.copies == most)
            assert all(r.copies == most for r in mine if r.key < last)


def test_number_of_bins_does_not_matter(spark, monkeypatch):
    frame, marks = docs(spark, [(n, words(n, 5 + n % 9), f"s{n % 3}") for n in range(90)]), labels(spark)
    seen = []
    for bins in (1, 7, 4096):
        monkeypatch.setattr(mixing, "BINS", bins)
        seen.append(sorted((r.doc_id, r.copies) for r in mixing.choose(mixing.records(frame, marks)).collect()))
    assert seen[0] == seen[1] == seen[2]


def test_quality_moves_documents_forward(spark):
    rows = [(n, "a b c", "s0") for n in range(600)]
    marks = labels(spark, [(n, n % 2, 0) for n in range(600)] + [(0, None, 0)])
    keys = {r.doc_id: r.key for r in mixing.records(docs(spark, rows), marks).collect()}
    good = sum(keys[n] for n in keys if n % 2) / 300
    bad = sum(keys[n] for n in keys if not n % 2) / 300
    assert bad / good == pytest.approx(4, rel=0.35)


def test_mix_repeats_rows(spark):
    rows = [(n, words(n, 10), "big") for n in range(100)] + [(200, "one two", "a"), (201, "three", "a")]
    frame = docs(spark, rows, extra=True)
    taken = {r.doc_id: r.copies for r in mixing.choose(mixing.records(frame, labels(spark))).collect()}
    mixed = mixing.mix(frame, labels(spark))
    assert mixed.columns == frame.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in taken.items() if n}
    assert got[200] == got[201] == 3


def test_edges_and_empty(spark):
    rows = [(i, t, s) for (i, t), s in zip(EDGES, [None, "", "a", "a", None, "b", "b"])]
    found = mixing.choose(mixing.records(docs(spark, rows, extra=True), labels(spark, [(None, 1, 0)]))).collect()
    assert len(found) == len(rows)
    assert sorted((r["size"], str(r.source)) for r in found)[-2:] == [(1, "b"), (3, "")]
    assert mixing.mix(docs(spark, []), labels(spark)).count() == 0
