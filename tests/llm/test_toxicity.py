import zlib

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from codewarden.llm import recurrent, toxicity
from codewarden.llm.queries import QUERIES
from tests.llm.helpers import EDGES, docs, words

SF = "/root/testdata/sf0.01"


def test_gradients():
    network = recurrent.Network(3)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    r = np.random.default_rng(0)
    network.weights["word"] += 0.1 * r.normal(size=network.weights["word"].shape)
    lexicon = recurrent.Lexicon(pa.array(["some words in a row, and some more", "x", words(1, 40)]))
    _, start, length = recurrent.windows(lexicon.first)
    index, live = recurrent.gather(lexicon, start, length)
    weight = np.linspace(-1, 1, len(start))
    live = live.astype(np.float64)

    def loss():
        return float((network.forward(lexicon, index, live, {}) * weight).sum())

    keep = {}
    network.forward(lexicon, index, live, keep)
    grads = network.backward(lexicon, live, keep, weight)
    for name in ("xf", "xb", "cf", "gf", "gb", "nf", "nb", "pool", "query", "out", "bias"):
        w = network.weights[name]
        for _ in range(3):
            at = tuple(r.integers(n) for n in w.shape)
            w[at] += 1e-5
            up = loss()
            w[at] -= 2e-5
            down = loss()
            w[at] += 1e-5
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-8)


def test_windows_overlap_and_cover_every_word():
    first = np.array([0, 0, 5, 5 + recurrent.WINDOW, 300])
    owner, start, length = recurrent.windows(first)
    for text in range(4):
        mine = owner == text
        seen = {w for s, n in zip(start[mine], length[mine]) for w in range(s, s + n)}
        assert seen == set(range(first[text], first[text + 1]))
        assert (np.diff(start[mine]) == recurrent.STRIDE).all() and mine.any()


def test_held_out_accuracy(spark):
    labels = ds.dataset(f"{SF}/labels.parquet").to_table().to_pylist()
    toxic = {r["doc_id"]: r["toxic"] for r in labels}
    rows = {r.doc_id: r for r in QUERIES["op4_bigru"](spark, SF).collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.predicted == int(r.score >= 0.5) for r in rows.values())
    held = [i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out for i in held)
    assert np.mean([rows[i].predicted == toxic[i] for i in held]) >= 0.85


def test_a_word_far_into_a_long_text_is_found(spark):
    texts = [f"{words(n, 20 + n % 30)} {'nastyword' if n % 2 else 'plainword'} {words(n + 999, 20)}" for n in range(200)]
    sample = pa.table({"text": texts, "toxic": [n % 2 for n in range(200)]})
    scorer = toxicity.Scorer(sample)
    long = words(5, 5000).split()
    got = scorer.scores(pa.array([" ".join([*long, "nastyword", *long]), " ".join(long), "", None]))
    assert got[0] > 0.5 > got[1] and got[2] == got[3]
    again = toxicity.Scorer(sample).scores(pa.array([texts[0], texts[1]]))
    assert (again == scorer.scores(pa.array([texts[0], texts[1]]))).all()


def test_edges(spark):
    frame = docs(spark, EDGES, extra=True)
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (None, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    sample = toxicity.learning_texts(frame, labels)
    assert [r.toxic for r in sample.collect()] == [1]
    scorer = toxicity.learn(sample)
    assert {r.score for r in toxicity.score(frame, scorer).collect()} == {1.0}
    nothing = toxicity.learn(toxicity.learning_texts(docs(spark, []), labels))
    assert toxicity.keep_below(frame, nothing, 0.5).count() == len(EDGES)
    assert toxicity.keep_below(frame, nothing, 0.5).columns == frame.columns
    assert toxicity.score(docs(spark, []), nothing).count() == 0


def test_a_text_is_toxic_if_one_of_its_ids_is(spark):
    frame = docs(spark, [(1, "same words"), (2, "same words"), (3, "other words")])
    marks = [(1, 1, 0), (2, 1, 1), (3, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    sample = toxicity.learning_texts(frame, labels).collect()
    assert {(r.text, r.toxic) for r in sample} == {("same words", 1), ("other words", 0)}


def test_learning_texts_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    frame = docs(spark, [(n, f"{n:03d}" + "x" * 97) for n in range(100)])
    labels = spark.createDataFrame([(n, 1, n % 2) for n in range(100)], "doc_id long, quality int, toxic int")
    sample = toxicity.learning_texts(frame, labels).collect()
    assert sorted(r.toxic for r in sample) == [0] * 10 + [1] * 10


def test_phrases_of_half_a_window_are_whole_in_one():
    first = np.array([0, 400])
    _, start, length = recurrent.windows(first)
    for n in range(400 - 16):
        assert any(s <= n and n + 17 <= s + size for s, size in zip(start, length))
