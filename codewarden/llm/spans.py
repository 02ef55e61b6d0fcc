"""Substring dedup over sliding sentence spans.

A text is cut in sentences: at ``.``, ``!`` or ``?`` before white space, and at line ends. A sentence of more
than ``PIECE`` words goes on as pieces of that many words, so a long passage without a full stop
still has several. From every sentence on, a run of ``RUN`` consecutive sentences, or of as many more as
``LEAST_WORDS`` words take, is hashed (a text with fewer than ``RUN`` sentences is one run, if it has
the words).

A passage may start inside a sentence, where other pieces stand in each text. So a text is also
cut before each word with the least hash among some ``NEAR`` words in a row that hold it (the last of
equals). That depends on the words nearby only, and at most ``NEAR`` words lie between two cuts.
From every cut on, the words up to the first cut behind ``LONG_WORDS`` words are hashed as a
run. Two copies of a passage agree in its cuts but for ``NEAR - 1`` words at each end, so a passage of
4 * ``NEAR`` + ``LONG_WORDS`` - 3 words (49) always has an equal run, wherever it starts, and no more than
2 * ``NEAR`` - 2 words at its start and at its end stay. Ends of texts are cuts, too.

The hashes of all texts are joined. The first place of a run, by id, text and place, stays; every word
under another place of it goes. Only hashes seen twice, told by a bit table of bounded size, leave
the scan with their places; a fuller table lets more of them through, and never loses one.

Words are compared lower-cased (A-Z) and without regard to white space. What stays of a text is its
own bytes. Null texts stay null, empty ones empty. Rows with equal id and text are one document: they
get the same text. A missing id sorts first. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm import decontaminate, words
from codewarden.llm.common import row_key, written

RUN = 3
PIECE = 16
LEAST_WORDS = 8
#: Cuts by content: words that are compared, and words of a run at least.
NEAR = 9
LONG_WORDS = 16

STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?"]] = True


class Sentences:
    """The sentences of a batch of texts: hashes, word counts and byte bounds."""

    def __init__(self, texts: pa.Array):
        self.raw, self.bounds, self.known = words.text_bytes(texts)
        starts, ends, first = words.word_spans(self.raw, self.bounds)
        hashes = words.hash_spans(self.raw, starts, ends)
        n = len(starts)
        breaks = np.flatnonzero(self.raw == 10)
        begins = np.zeros(n + 1, bool)
        begins[first] = True
        if n:
            broken = np.searchsorted(breaks, starts[1:]) > np.searchsorted(breaks, ends[:-1])
            after = STOPS[self.raw[ends[:-1] - 1]] | broken
            begins[1:n] |= after
        head = np.flatnonzero(begins[:n])
        size = np.diff(np.append(head, n))
        # Long sentences go on as pieces.
        inside = np.arange(n) - np.repeat(head, size)
        self.heads = head = np.flatnonzero(inside % PIECE == 0)
        self.sizes = np.diff(np.append(head, n))
        inside = (np.arange(n) - np.repeat(head, self.sizes)).astype(np.uint64)
        each = words.mix(hashes + inside * np.uint64(0x9E3779B97F4A7C15))
        self.hashes = words.mix(np.add.reduceat(each, head)) if n else np.zeros(0, np.uint64)
        self.first = np.searchsorted(head, first)
        self.words, self.starts, self.word_first = hashes, starts, first

    def runs(self):
        """(hash, text number, number of the first word, words) of all runs."""
        heads = np.append(self.heads, len(self.words))
        for found, owner, at, upto in self._sentence_runs():
            yield found, owner, heads[at] - self.word_first[owner], heads[upto] - heads[at]
        yield self._content_runs()

    def _content_runs(self):
        h, first = self.words, self.word_first
        n, counts = len(h), np.diff(first)
        owner = np.repeat(np.arange(len(counts)), counts)
        before, behind = np.arange(n) - first[:-1][owner], first[1:][owner] - 1 - np.arange(n)
        # How many words in a row on each side are no less, up to NEAR - 1.
        width = np.ones(n, np.int8)
        left, right = np.ones(n, bool), np.ones(n, bool)
        for k in range(1, min(NEAR, n)):
            left[:k] = False
            left[k:] &= (before[k:] >= k) & (h[:-k] >= h[k:])
            right[n - k :] = False
            right[: n - k] &= (behind[:-k] >= k) & (h[k:] > h[:-k])
            width += left
            width += right
        cuts = np.flatnonzero((width >= NEAR) | (before == 0))
        bounds = np.unique(np.append(cuts, first))
        place = np.searchsorted(bounds, cuts + LONG_WORDS)
        upto = bounds[np.minimum(place, len(bounds) - 1)]
        owner = owner[cuts]
        whole = (place < len(bounds)) & (upto <= first[1:][owner])
        cuts, upto, owner = cuts[whole], upto[whole], owner[whole]
        return _run_hashes(h, cuts, upto, 900), owner, cuts - first[owner], upto - cuts

    def _sentence_runs(self):
        """(hash, text number, first sentence, sentence behind the last) of runs of sentences."""
        total = np.concatenate([[0], np.cumsum(self.sizes)])
        counts = np.diff(self.first)
        owner = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(self.hashes))
        # A run of short sentences goes on until it has the words.
        upto = np.maximum(at + RUN, np.searchsorted(total, total[at] + LEAST_WORDS))
        whole = upto <= self.first[1:][owner]
        at, upto, owner = at[whole], upto[whole], owner[whole]
        out = [(_run_hashes(self.hashes, at, upto, 500), owner, at, upto)]
        for n in range(1, RUN):
            texts = np.flatnonzero(counts == n)
            at = self.first[texts]
            long = total[at + n] - total[at] >= LEAST_WORDS
            texts, at = texts[long], at[long]
            out.append((_run_hashes(self.hashes, at, at + n, 500), texts, at, at + n))
        return out


def _run_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each run items[start:end]; runs of any lengths may overlap."""
    sums = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * words._power_table(words._BASE, len(items) + 1)[: len(items)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * words._power_table(words._INVERSE, len(items) + 1)[starts]
    return words.mix(found + words.mix((ends - starts).astype(np.uint64) + np.uint64(salt << 32)))


RUNS = "hash long, __id long, __text long, at int, size int"


def _known(bits_of: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    table, bits = bits_of
    slot = hashes >> np.uint64(64 - bits)
    word = table[(slot >> np.uint64(6)).astype(np.int64)]
    return (word >> (slot & np.uint64(63))) & np.uint64(1) == 1


def hashes_seen_twice(docs: DataFrame) -> DataFrame:
    """(hash) of all runs that stand at two places or more, rows with equal keys counted apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.strips(batches):
            for hashes, *_ in Sentences(batch.column("text")).runs():
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["hash"])

    found = docs.select("text").mapInArrow(scan, "hash long")
    return found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")


def runs(docs: DataFrame, seen: tuple[np.ndarray, int]) -> DataFrame:
    """The runs, of documents that come with key columns and ``text``, whose hashes are in a bit table."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.strips(batches):
            for hashes, owner, at, size in Sentences(batch.column("text")).runs():
                in_table = _known(seen, hashes)
                owner = owner[in_table]
                keys = [batch.column(k).take(pa.array(owner)) for k in ("__id", "__text")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[in_table].view(np.int64)),
                        *keys,
                        pa.array(at[in_table].astype(np.int32)),
                        pa.array(size[in_table].astype(np.int32)),
                    ],
                    names=[part.split()[0] for part in RUNS.split(", ")],
                )

    return docs.select("__id", "__text", "text").mapInArrow(scan, RUNS)


def repeats(docs: DataFrame) -> DataFrame:
    """(key columns, at, size): all runs that are not the first of their hash."""
    twice = written(hashes_seen_twice(docs), "hashes")
    found = written(runs(docs, decontaminate._filter_bits(twice)), "runs")
    place = F.struct("__id", "__text", "at")
    again = (
        found.groupBy("hash")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter("first <> last")
        .select("hash", "first")
    )
    return (
        found.join(again, "hash")
        .filter(place != F.col("first"))
        .select("__id", "__text", "at", "size")
    )


CUT = "__id long, __text long, cut_text string, sentences int, removed int"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.strips(batches):
        texts = batch.column("text")
        marks = batch.column("marks").to_pylist()
        found = Sentences(texts)
        out, counts, gone = [], np.diff(found.first), []
        for i, text in enumerate(texts):
            base, upto = found.word_first[i], found.word_first[i + 1]
            drop = np.zeros(upto - base, bool)
            for mark in marks[i] or ():
                drop[mark["at"] : mark["at"] + mark["size"]] = True
            if not drop.any():
                gone.append(0)
                out.append(text.as_py())
                continue
            heads = found.heads[found.first[i] : found.first[i + 1]] - base
            gone.append(int(np.logical_or.reduceat(drop, heads).sum()))
            # A word owns the bytes up to the next one.
            edges = np.append(found.starts[base:upto], found.bounds[i + 1])
            edges[0] = found.bounds[i]
            turns = np.flatnonzero(np.diff(np.concatenate([[True], drop, [True]])))
            kept = [
                found.raw[edges[a] : edges[b]].tobytes() for a, b in turns.reshape(-1, 2).tolist()
            ]
            out.append(b"".join(kept).decode().rstrip())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("__id"),
                batch.column("__text"),
                pa.array(out, pa.string()),
                pa.array(counts, pa.int32()),
                pa.array(gone, pa.int32()),
            ],
            names=[part.split()[0] for part in CUT.split(", ")],
        )


def cut_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: key columns, ``cut_text`` (what stays), ``sentences`` and ``removed``
    (how many of them lost words)."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns(row_key()).select("__id", "__text", "text")
    # Marks of one text meet in one row: no more of them than it has sentences and cuts.
    marks = (
        repeats(rows)
        .groupBy("__id", "__text")
        .agg(F.collect_set(F.struct("at", "size")).alias("marks"))
    )
    return rows.join(marks, ["__id", "__text"], "left").mapInArrow(_cut, CUT)
