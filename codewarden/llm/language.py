"""Language by rank-order profiles: out-of-place distance of a document's most frequent n-grams.

A text is lower-cased, everything but letters becomes a gap, and the n-grams of one to ``GRAM``
characters are counted, gaps at word edges included. Profiles are the ``PROFILE`` most frequent
n-grams of all learning texts of a language. A document's n-grams are ranked the same way; the
distance to a profile is the sum, over the document's n-grams, of how far each is out of place, and
``PROFILE`` for one that is not there. The nearest language wins.

Ties: equal counts rank by code points, equal distances go to the least language name. Null texts and
texts without a letter are ``und`` with score 0, and so is everything while no profile is learned.
Texts without a language, and null texts, are not learned from. Texts of any length are counted
whole, and in strips that bound the memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRAM = 3
PROFILE = 300
UNKNOWN = "und"
#: Characters whose n-grams are counted in one go.
STRIP = 1 << 20
#: Bits of one code point in an n-gram's number; gaps count as 1.
BITS = 21

_letter_table = np.zeros(0x110000, np.int8)  # 1 letter, -1 other, 0 not looked at yet


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters; each is looked up once in a process."""
    found = _letter_table[codes]
    for code in np.unique(codes[found == 0]):
        _letter_table[code] = 1 if chr(code).isalpha() else -1
    return _letter_table[codes] > 0


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Numbers of the distinct n-grams of a text, their counts, and whether it has a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _is_letter(codes)
    if not kept.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), False
    # Letters as they are; a run of anything else is one gap, and so are both ends.
    letters = np.where(kept, codes, 1).astype(np.uint64)
    stays = kept.copy()
    stays[1:] |= kept[:-1]
    line = np.concatenate([[1], letters[stays], [1] if kept[-1] else []])
    line = line.astype(np.uint64)
    parts, totals = [], []
    for begin in range(0, len(line), STRIP):
        strip = line[begin : begin + STRIP + GRAM - 1]
        own = min(STRIP, len(line) - begin)
        grams = [strip[:own][strip[:own] != 1]]
        number = strip
        for n in range(2, GRAM + 1):
            number = (number[:-1] << np.uint64(BITS)) | strip[n - 1 :]
            usable = number[:own]
            if n > 2:  # a gap may stand at the edges only
                usable = usable[strip[1 : 1 + len(usable)] != 1]
            grams.append(usable)
        part, count = np.unique(np.concatenate(grams), return_counts=True)
        parts.append(part)
        totals.append(count)
    if len(parts) == 1:
        return parts[0], totals[0], True
    grams, where = np.unique(np.concatenate(parts), return_inverse=True)
    return grams, np.bincount(where, np.concatenate(totals)).astype(np.int64), True


def _ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ``PROFILE`` most frequent, most frequent first; ``grams`` are in ascending order."""
    if len(grams) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        some = counts >= least
        grams, counts = grams[some], counts[some]
    return grams[np.argsort(-counts, kind="stable")[:PROFILE]]


def profiles(texts: DataFrame) -> DataFrame:
    """(lang, gram, place): the ranked n-grams of each language of ``texts`` (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            sums: dict[str, list] = {}
            for text, lang in zip(batch.column("text"), langs, strict=True):
                grams, counts, _ = gram_counts(text.as_py())
                sums.setdefault(lang, []).append((grams, counts))
            for lang, found in sums.items():
                grams, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                total = np.bincount(where, np.concatenate([c for _, c in found]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(grams), pa.string()),
                        pa.array(grams.view(np.int64)),
                        pa.array(total.astype(np.int64)),
                    ],
                    names=["lang", "gram", "n"],
                )

    known = texts.select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).filter("text IS NOT NULL AND lang IS NOT NULL")
    sums = (
        known.mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return sums.withColumn("place", place).filter(F.col("place") <= PROFILE).drop("n")


class RankModel:
    """Learned profiles: at most ``PROFILE`` rows for each language."""

    def __init__(self, learned: DataFrame):
        rows = learned.collect()
        self.langs = sorted({r["lang"] for r in rows})
        number = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))
        self.places = np.full((len(self.grams), len(self.langs)), -1, np.int64)
        for r in rows:
            at = np.searchsorted(self.grams, np.uint64(r["gram"]))
            self.places[at, number[r["lang"]]] = r["place"] - 1

    def classify(self, text: str | None) -> tuple[str, float]:
        grams, counts, lettered = gram_counts(text or "")
        if not lettered or not self.langs:
            return UNKNOWN, 0.0
        ranked = _ranked(grams, counts)
        at = np.minimum(np.searchsorted(self.grams, ranked), len(self.grams) - 1)
        places = np.where((self.grams[at] == ranked)[:, None], self.places[at], -1)
        out = np.where(places < 0, PROFILE, np.abs(places - np.arange(len(ranked))[:, None]))
        total = out.sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], 1.0 - float(total[best]) / (PROFILE * len(ranked))


def identify(docs: DataFrame, model: RankModel) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for each row of ``docs`` (doc_id, text)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.classify(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")
