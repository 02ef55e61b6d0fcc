"""Toxicity by a bidirectional gated recurrent network over all overlapping windows of a text.

Labels say that a document is toxic, not where. Training therefore picks windows: at first those whose
words speak most for the label (counts over the learning texts against chance), then those the network itself
scores highest, against random and high-scoring windows of clean documents. A document's score is that of
its highest window, brought to 0..1 so that 0.5 parts the learning texts that were held back.

The network is fitted on at most 1.5 times ``PER_LABEL`` texts of each label, of at most ``SAMPLE_CHARS``
characters each and ``SAMPLE_BYTES`` in all, the first by a hash of their id: a documented bound that keeps
training in one task.
Scoring goes over every window of every text; a long text is scored window by window.

Null texts, empty texts and texts without words have one empty window and get its score. Labels other
than 0 and 1 are not learned from; a document with both counts as toxic. Without learning texts of
both labels every score is the share of toxic ones, or 0 if there are none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.llm.recurrent import Adam, Lexicon, Network, gather, windows

PER_LABEL = 1500
SAMPLE_CHARS = 16_000
#: Bytes of learning texts of each label.
SAMPLE_BYTES = 8_000_000
#: Learning texts kept out of training to set the threshold.
HELD_BACK = 0.25
ROUNDS = 6
EPOCHS = 2
BATCH = 256
STEPS = 24
#: Share of clean texts that a toxic text's best window has to outscore to be learned from.
USUAL = 0.9
#: Standard deviations that a word's count may be above its share by chance.
CHANCE = 2.5
RATE = 0.01
#: Clean documents for each toxic one when the threshold is set.
CLEAN_PER_TOXIC = 9.0
#: Logits from the threshold to a score of 0.73.
SOFTNESS = 1.0
#: Bytes of text that a task scores at once.
STRIP_BYTES = 4_000_000


def learning_texts(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(text, toxic, place, doc_id) of a bounded number of labelled texts, each text once and toxic if
    any of its ids is; the last two order them."""
    marks = (
        labels.filter("toxic IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    found = None
    for toxic in (0, 1):
        # Half as many again, for the long and the repeated ones that go below.
        some = (
            marks.filter(F.col("toxic") == toxic)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(per_label + per_label // 2)
        )
        found = some if found is None else found.unionByName(some)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).filter(F.length("text") <= SAMPLE_CHARS)
    # At most 3 * PER_LABEL rows of two numbers.
    each = texts.join(F.broadcast(found), "doc_id").groupBy("text")
    least = F.min(F.struct(F.xxhash64("doc_id").alias("place"), "doc_id")).alias("least")
    each = each.agg(F.max("toxic").alias("toxic"), least).select("text", "toxic", "least.*")
    along = W.partitionBy("toxic").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.sum(F.octet_length("text")).over(along)
    return each.withColumn("upto", upto).filter(F.col("upto") <= SAMPLE_BYTES).drop("upto")


NO_TEXTS = pa.table({"text": pa.array([], pa.string()), "toxic": pa.array([], pa.int32())})


def learn(sample: DataFrame, seed: int = 1) -> "Scorer":
    """The network fitted on ``learning_texts``. The fit is one task on an executor, over a sample that is
    bounded by ``PER_LABEL`` and ``SAMPLE_BYTES``; the driver sees the network alone."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        texts = NO_TEXTS
        if rows:
            by_place = [("place", "ascending"), ("doc_id", "ascending")]
            texts = pa.Table.from_batches(rows).sort_by(by_place).combine_chunks()
        model = pickle.dumps(Scorer(texts, seed))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(found["model"]) if found else Scorer(NO_TEXTS, seed)


def _evidence(lexicon: Lexicon, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How far each word's number of toxic texts is above what chance gives it, in standard
    deviations beyond ``CHANCE``, squared: a few words that tell outweigh many that might."""
    pairs = np.unique(lexicon.of * np.int64(len(toxic)) + owner)
    word, text = pairs // len(toxic), pairs % len(toxic)
    bad = np.bincount(word, toxic[text], len(lexicon.hashes))
    good = np.bincount(word, 1 - toxic[text], len(lexicon.hashes))
    share = (bad + good) / len(toxic)
    spread = np.sqrt(np.maximum(toxic.sum() * share * (1 - share), 1e-9))
    beyond = (bad - toxic.sum() * share) / spread - CHANCE
    return np.where(bad + good >= 3, np.square(np.maximum(beyond, 0)), 0)


def _highest(scores: np.ndarray, owner: np.ndarray, wanted: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` best windows of each wanted text."""
    order = np.lexsort((-scores, owner))
    own = owner[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    return order[(place < most) & wanted[own]]


class Scorer:
    """A trained network with its threshold."""

    def __init__(self, sample: pa.Table, seed: int = 1):
        toxic = sample.column("toxic").to_numpy().astype(np.float64)
        self.network, self.shift, self.constant = None, 0.0, None
        if len(toxic) < 8 or toxic.min() == toxic.max():
            self.constant = float(toxic.mean()) if len(toxic) else 0.0
            return
        lexicon = Lexicon(sample.column("text"))
        owner, start, length = windows(lexicon.first)
        r = np.random.default_rng(seed)
        back = np.zeros(len(toxic), bool)
        for label in (0, 1):
            mine = r.permutation(np.flatnonzero(toxic == label))
            back[mine[: int(HELD_BACK * len(mine))]] = True
        learn = ~back
        of_text = np.repeat(np.arange(len(toxic)), np.diff(lexicon.first))
        seen = learn[of_text]
        part = Lexicon.__new__(Lexicon)
        part.hashes, part.of = lexicon.hashes, lexicon.of[seen]
        evidence = _evidence(part, of_text[seen], toxic)
        running = np.concatenate([[0.0], np.cumsum(evidence[lexicon.of])])
        guide = running[start + length] - running[start]
        network = Network(seed)
        # Words that tell stand out from the start; training moves them like all weights.
        telling = np.flatnonzero(evidence > 0)
        first = np.minimum(np.sqrt(evidence[telling]), 4.0) / 2
        np.maximum.at(network.weights["word"][:, 0], lexicon.word[telling], first.astype(np.float32))
        adam = Adam(network.weights, RATE)
        for round_ in range(ROUNDS):
            scores = guide if round_ == 0 else network.logits(lexicon, start, length)
            best = np.full(len(toxic), -np.inf)
            np.maximum.at(best, owner, scores)
            # A label without anything toxic in sight teaches nothing: such texts wait.
            usual = np.quantile(best[learn & (toxic == 0)], USUAL)
            sure = learn & (toxic == 1) & (best > usual)
            bad = _highest(scores, owner, sure if sure.any() else learn & (toxic == 1), 1)
            hard = _highest(scores, owner, learn & (toxic == 0), 2)
            clean = np.flatnonzero((learn & (toxic == 0))[owner])
            easy = r.choice(clean, min(len(clean), 2 * len(bad)), replace=False)
            chosen = np.concatenate([bad, hard, easy])
            target = (np.arange(len(chosen)) < len(bad)).astype(np.float32)
            # Small samples get smaller batches, so that they see as many steps.
            batch = int(np.clip(len(chosen) // STEPS, 16, BATCH))
            heavy = np.clip((len(chosen) - len(bad)) / max(len(bad), 1) / 4, 1, 8)
            for _ in range(EPOCHS):
                order = r.permutation(len(chosen))
                for a in range(0, len(order), batch):
                    mine = order[a : a + batch]
                    index, live = gather(lexicon, start[chosen[mine]], length[chosen[mine]])
                    keep: dict = {}
                    logit = network.forward(lexicon, index, live, keep)
                    error = (1 / (1 + np.exp(-logit)) - target[mine]) / len(mine)
                    error = np.where(target[mine] == 1, heavy, 1) * error
                    adam.step(network.backward(lexicon, live, keep, error.astype(np.float32)))
        top = np.full(len(toxic), -np.inf)
        np.maximum.at(top, owner, network.logits(lexicon, start, length))
        self.network, self.shift = network, _threshold(top[back], toxic[back])

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        lexicon = Lexicon(texts)
        owner, start, length = windows(lexicon.first)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, self.network.logits(lexicon, start, length))
        return 1 / (1 + np.exp(-np.clip((top - self.shift) / SOFTNESS, -30, 30)))


def _threshold(top: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap that costs least, a clean text counting ``CLEAN_PER_TOXIC`` times
    as much in all as its label's share of the sample."""
    order = np.argsort(top, kind="stable")
    top, toxic = top[order], toxic[order]
    weight = CLEAN_PER_TOXIC * toxic.sum() / max((1 - toxic).sum(), 1)
    missed = np.concatenate([[0], np.cumsum(toxic)])
    flagged = weight * ((1 - toxic).sum() - np.concatenate([[0], np.cumsum(1 - toxic)]))
    cost = missed + flagged
    best = np.flatnonzero(cost == cost.min())
    edges = np.concatenate([[top[0] - 1], top, [top[-1] + 1]])
    return float((edges[best[0]] + edges[best[-1] + 1]) / 2)


def _in_strips(texts: pa.Array, scorer: Scorer) -> np.ndarray:
    """Scores of a batch, some millions of characters at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // STRIP_BYTES)) + 1), len(texts)]
    found = [scorer.scores(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.concatenate(found)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _in_strips(batch.column("text"), scorer)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_below(docs: DataFrame, scorer: Scorer, limit: float) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``, in all their columns; no shuffle."""

    at = [c.lower() for c in docs.columns].index("text")
    # Python stages take no names with dots.
    plain = docs.toDF(*[f"c{n}" for n in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            yield batch.filter(pa.array(_in_strips(texts, scorer) < limit))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
