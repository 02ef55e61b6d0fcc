"""Spelling variants: words grouped under the more frequent word that is one edit away.

The vocabulary is counted over whole texts: runs of letters (A-Z, a-z and U+00C0 to U+00FF), A-Z
lower-cased. Where a checksum of document and word says so, a letter is taken out, so
that there are slips to group; words of ``LEAST_LENGTH`` letters seen ``LEAST_COUNT`` times stay.

Near words are found by two searches in full-text indexes (``fm_index``): one matches a word's right half exactly and
goes on to the left with one edit, the other its left half and goes on to the right. A single edit leaves one half
whole, so nothing is missed. The vocabulary is dealt to shards by the half that a search needs whole:
a word stands in the shards of the halves by which words of its own length, or one more or less, would ask
for it, and asks in those of its own. A shard is one index of some ``ROWS`` rows. A half that more words
share than that is dealt in blocks, and its words ask in each of them. A pair found by both searches counts at the
first. What leaves a shard is one row a word and side: how many, and the best.

Roots: a word points at its form if that is at least twice as frequent, so chains are at most as long as
counts have bits; they are followed by doubling, each round a table.

Defined results: null texts have no words; a null id is spelled as nothing. Repeated rows count each time. Words of any
length take part. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import written
from codewarden.llm.fm_index import DelimitedIndex
from codewarden.support import small_side

LETTERS = re.compile("[a-zÀ-ÿ]+")
SLIP = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Rows of a shard: words it holds or is asked for.
ROWS = 100_000
LEAST_SHARDS = 64
#: Distinct words a task counts before it passes them on, and characters read at once.
HELD = 400_000
SLICE = 1 << 22
RIGHT, LEFT = 0, 1


def _runs(text: str) -> Iterator[list[str]]:
    """All words of a text, some millions of characters at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE
        inside = LETTERS.match(text, end) if end < len(text) else None
        end = inside.end() if inside else end
        yield LETTERS.findall(text, at, end)
        at = end


def slip(word: str, head: int) -> str:
    """``word``, or what is left of it where its checksum, begun with ``head``, tells a letter to go."""
    h = zlib.crc32(word.encode(), head)
    if h % SLIP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all documents (doc_id, text)."""

    def counted(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            lowered = pc.ascii_lower(batch.column("text"))
            for doc_id, text in zip(batch.column("doc_id"), lowered, strict=True):
                here: Counter = Counter()
                for words in _runs(text.as_py() or ""):
                    here.update(words)
                head = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                for word, n in here.items():
                    word = slip(word, head)
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
                if len(total) > HELD:
                    yield counted(total)
                    total = Counter()
        yield counted(total)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    every = rows.mapInArrow(count, "word string, n long")
    return every.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _routed(words: DataFrame, rows: int) -> DataFrame:
    """(shard, half, block, side, word, n, held, asks): where words stand and where they ask."""
    lengths = f"filter(array(length(word) - 1, length(word), length(word) + 1), x -> x >= {LEAST_LENGTH})"
    size = {RIGHT: "x - x div 2", LEFT: "x div 2"}
    take = {RIGHT: "right", LEFT: "left"}
    sides = [
        f"""transform(array_distinct(transform({lengths}, x -> {size[side]})), k -> named_struct(
              'side', {side}, 'half', {take[side]}(word, int(k)),
              'asks', k = {size[side].replace("x", "length(word)")}))"""
        for side in (RIGHT, LEFT)
    ]
    entries = words.withColumn("entry", F.explode(F.expr(f"concat({', '.join(sides)})"))).select("word", "n", "entry.*")
    shards = max(LEAST_SHARDS, -(-words.count() * 4 // rows))
    shard = F.pmod(F.xxhash64("side", "half"), F.lit(shards)).cast("int")
    entries = entries.withColumn("shard", shard)
    plain = entries.select(
        "shard", F.lit("").alias("half"), F.lit(0).alias("block"), "side", "word", "n", F.lit(True).alias("held"), "asks"
    )
    # Only where a shard is overfull can one half fill several.
    full = entries.groupBy("shard").count().filter(F.col("count") > 2 * rows).select("shard")
    if full.isEmpty():
        return plain
    hot = (
        entries.join(small_side(full), "shard", "left_semi")
        .groupBy("side", "half")
        .count()
        .filter(F.col("count") > rows)
        .select("side", "half", F.ceil(F.col("count") / rows).cast("int").alias("blocks"))
    )
    marked = entries.join(small_side(hot), ["side", "half"], "left")
    cold = marked.filter("blocks IS NULL").select(
        "shard", F.lit("").alias("half"), F.lit(0).alias("block"), "side", "word", "n", F.lit(True).alias("held"), "asks"
    )
    dealt = marked.filter("blocks IS NOT NULL")
    home = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    held = dealt.select("shard", "half", home.alias("block"), "side", "word", "n", F.lit(True).alias("held"), F.lit(False).alias("asks"))
    asking = dealt.filter("asks").select(
        "shard", "half", every.alias("block"), "side", "word", "n", F.lit(False).alias("held"), F.lit(True).alias("asks")
    )
    return cold.unionByName(held).unionByName(asking)


def _letters(words: list[str], backwards: bool) -> list[bytes]:
    """Words as bytes, one a letter, in the direction that the index reads."""
    raw = [w.encode("latin-1") for w in words]
    return [w[::-1] for w in raw] if backwards else raw


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _distinct(words: pa.ChunkedArray, counts: pa.ChunkedArray) -> dict[str, int]:
    return dict(zip(words.to_pylist(), counts.to_pylist(), strict=True))


def near_in_shard(rows: pa.Table) -> pa.Table:
    """``NEAR`` of the words that ask in one shard and one direction."""
    backwards = rows.column("side")[0].as_py() == LEFT
    held, asks = rows.filter(rows.column("held")), rows.filter(rows.column("asks"))
    count_of = _distinct(held.column("word"), held.column("n"))
    spelled = list(count_of)
    raw = _letters(spelled, backwards)
    order = sorted(range(len(raw)), key=raw.__getitem__)
    index = DelimitedIndex([raw[i] for i in order])
    words = np.array(spelled, object)[order]
    counts = np.array(list(count_of.values()), np.int64)[order]
    turn = np.empty(len(words), np.int64)  # places of the words in code point order
    turn[np.argsort(words, kind="stable")] = np.arange(len(words))
    asking = np.array(list(_distinct(asks.column("word"), asks.column("n"))), object)
    asked = _letters(asking.tolist(), backwards)
    lengths = np.array([len(w) for w in asked], np.int64)
    out = [NEAR.empty_table()]
    for length in np.unique(lengths):
        mine = np.flatnonzero(lengths == length)
        letters = np.frombuffer(b"".join(asked[i] for i in mine), np.uint8).reshape(len(mine), length)
        loose = int(length - length // 2 if backwards else length // 2)
        row, word = index.one_edit(letters, loose)
        if backwards:
            # These have the right half too: the other side counts them.
            other = ~index.begins_with(word, letters[row, :loose])
            row, word = row[other], word[other]
        if not len(row):
            continue
        by = np.lexsort((turn[word], -counts[word], row))
        row, word = row[by], word[by]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        columns = [
            pa.array(asking[mine[row[first]]], pa.string()),
            pa.array(np.diff(first, append=len(row))),
            pa.array(counts[word[first]]),
            pa.array(words[word[first]], pa.string()),
        ]
        out.append(pa.Table.from_arrays(columns, schema=NEAR))
    return pa.concat_tables(out).combine_chunks()


def near_words(words: DataFrame, rows: int = ROWS) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near words: how many, and the most
    frequent of them, the first in code point order among several."""
    found = (
        _routed(words, rows)
        .groupBy("shard", "half", "block", "side")
        .applyInArrow(near_in_shard, "word string, n_near long, best_n long, best string")
    )
    # Most frequent first, then by the word.
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("b")
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best)
        .select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))
    )


def follow(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, to) without circles: ``to`` followed to its last, by doubling."""
    links = written(links, "spelling-links")
    while True:
        then = links.select(F.col("word").alias("to"), F.col("to").alias("then"))
        moved = written(
            links.join(then, "to", "left").select(
                "word", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")
            ),
            "spelling-links",
        )
        links = moved.select("word", "to")
        if moved.filter("moved").isEmpty():
            return links.withColumnRenamed("to", "root")


def variants(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs`` (doc_id, text)."""
    words = written(vocabulary(docs), "spelling-words")
    enough = F.col("best_n") >= 2 * F.col("n")
    found = written(
        words.join(near_words(words, rows), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best")).alias("form"),
            F.when(enough, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = follow(found.filter("form IS NOT NULL").select("word", F.col("form").alias("to")))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
