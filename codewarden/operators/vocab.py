"""Word vocabulary: training and encoding."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.support import BROADCAST_ROWS, materialize, pieces, small_rows

# Special tokens in id order, and the vocabulary's size and frequency limits.
SPECIAL = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]"]
VOCAB_SIZE = 50_257
MIN_COUNT = 2

# A tokenizer is any column function from text to an array of strings, also a pandas UDF.
Tokenizer = Callable[[Column], Column]


def train_vocab(
    df: DataFrame,
    code: str = "code",
    size: int = VOCAB_SIZE,
    min_count: int = MIN_COUNT,
    tokenize: Tokenizer = text.word_tokens,
) -> DataFrame:
    """(token, id): the special tokens, then the most frequent words; equal counts by word.

    Word counts are combined before the shuffle. The least count that gets in is read off the
    number of words per count, so only the words that are kept, fewer than ``size``, and the ties
    at that count are ordered.
    """
    counts = (
        df.select(F.explode_outer(tokenize(F.col(code))).alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _most_frequent(counts, size, min_count)


def _most_frequent(counts: DataFrame, size: int, min_count: int) -> DataFrame:
    """The vocabulary (token, id) of words with counts (token, n)."""
    counts = materialize(counts.filter(F.col("n") >= min_count), "word-counts")
    room = size - len(SPECIAL)
    # How many words have each count: few rows, which give the least count that still gets in.
    by_falling = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    last = (
        steps.withColumn("upto", F.sum("words").over(by_falling))
        .filter(F.col("upto") > room)
        .agg(F.max("n").alias("n"), F.max(F.struct("n", (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
        .first()
    )
    if last["n"] is None:
        kept = counts
    else:
        # Whole counts above it; of the words that have it, only as many as there is room for.
        ties = counts.filter(F.col("n") == last["n"])
        kept = counts.filter(F.col("n") > last["n"]).unionByName(
            ties.orderBy("token").limit(room - last["at"]["before"])
        )
    by_count = W.orderBy(F.desc("n"), "token")
    words = kept.select(
        "token", (F.row_number().over(by_count) + (len(SPECIAL) - 1)).alias("id")
    )
    special = counts.sparkSession.createDataFrame(
        list(zip(SPECIAL, range(len(SPECIAL)))), "token string, id int"
    )
    return special.union(words)


def _lookup_in_batches(names: pa.Array, ids: np.ndarray, unknown: int) -> Callable[[Column], Column]:
    """A column function from arrays of tokens to arrays of ids, one hash lookup for a batch."""

    numbers = np.append(ids, unknown).astype(np.int32)

    @F.arrow_udf("array<int>")
    def look(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        found, done = np.empty(sizes.sum(), np.int32), 0
        for part in pieces(lists.flatten()):
            at = pc.fill_null(pc.index_in(part, value_set=names), len(ids))
            found[done : done + len(part)] = numbers[at.to_numpy(zero_copy_only=False)]
            done += len(part)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(ends), pa.array(found), mask=pc.is_null(lists)
        )

    return look


CHUNKED = "struct<chunk: bigint, words: array<string>, counts: array<bigint>, places: array<int>>"


def _in_chunks(lists: pa.Array, rows: pa.Array) -> pa.Array:
    """Arrays of tokens as places in the distinct words of a chunk of neighbouring rows. A chunk is named
    by the number of its first row, which alone holds its words and how often they occur."""
    parts, done = [], 0
    for part in pieces(lists):
        size = len(part)
        coded = part.flatten().dictionary_encode(null_encoding="encode")
        lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        words = coded.dictionary
        counts = np.bincount(coded.indices.to_numpy(), minlength=len(words))
        first = pa.array(np.where(np.arange(size + 1) > 0, len(words), 0), pa.int32())
        others = pa.array(np.arange(size) > 0)
        fields = [
            pa.array(np.full(size, rows[done].as_py() if size else 0), pa.int64()),
            pa.ListArray.from_arrays(first, words, mask=others),
            pa.ListArray.from_arrays(first, pa.array(counts, pa.int64()), mask=others),
            pa.ListArray.from_arrays(pa.array(ends), coded.indices, mask=pc.is_null(part)),
        ]
        parts.append(pa.StructArray.from_arrays(fields, names=["chunk", "words", "counts", "places"]))
        done += size
    return pa.concat_arrays(parts)


def _once(vocab: DataFrame) -> DataFrame:
    """Every word of a vocabulary once, with its least id."""
    return vocab.filter(F.col("token").isNotNull()).groupBy("token").agg(F.min("id").alias("id"))


def vocab_lookup(
    df: DataFrame,
    vocab: DataFrame,
    tokens: str | Column = "tokens",
    out: str = "ids",
    unknown: int = 0,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the array of ids of an array of tokens; unknown and missing words get the id
    ``unknown``, a missing array stays missing. A word that is listed twice has its least id.

    A vocabulary that is seen to be small goes to the executors and is looked up batch by batch; a
    larger one is joined to the distinct words of chunks of rows, and each row takes its ids from its chunk.
    """
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    vocab = _once(vocab)
    rows = small_rows(vocab, max_rows)
    if rows is None:
        return _chunk_ids(_chunked(df, tokens), vocab, out, unknown)
    names = pa.array([r["token"] for r in rows], pa.string())
    ids = np.array([r["id"] for r in rows], np.int64)
    return df.withColumn(out, _lookup_in_batches(names, ids, unknown)(tokens))


def _chunked(df: DataFrame, tokens: Column) -> DataFrame:
    """``df`` with ``__chunk``, ``__words``, ``__counts`` and ``__places`` (see :func:`_in_chunks`), written once,
    so a row keeps its chunk whatever is computed again."""
    coded = df.withColumn("__row", F.monotonically_increasing_id())
    coded = coded.withColumn("__coded", F.arrow_udf(_in_chunks, CHUNKED)(tokens, F.col("__row")))
    parts = [F.col(f"__coded.{name}").alias(f"__{name}") for name in ("chunk", "words", "counts", "places")]
    return materialize(coded.select(*[F.col(f"`{c}`") for c in df.columns], *parts), "tokens")


def _chunk_words(rows: DataFrame) -> DataFrame:
    """(__chunk, __place, token, n): a row for each distinct word of a chunk, with its count there."""
    held = rows.filter(F.col("__words").isNotNull())
    words = held.select("__chunk", F.posexplode(F.arrays_zip("__words", "__counts")).alias("__place", "x"))
    return words.select("__chunk", "__place", F.col("x.__words").alias("token"), F.col("x.__counts").alias("n"))


def _chunk_ids(rows: DataFrame, vocab: DataFrame, out: str, unknown: int) -> DataFrame:
    """Rows in chunks with their ids ``out``; ``vocab`` has a word once."""
    found = (
        _chunk_words(rows)
        .join(vocab, "token", "left")
        .withColumn("id", F.coalesce("id", F.lit(unknown)).cast("int"))
    )
    placed = F.sort_array(F.collect_list(F.struct("__place", "id")))
    ids = found.groupBy("__chunk").agg(F.transform(placed, lambda x: x["id"]).alias("__ids"))
    joined = rows.drop("__words", "__counts").join(ids, "__chunk", "left")
    joined = joined.withColumn(out, F.transform("__places", lambda at: F.get("__ids", at)))
    return joined.drop("__chunk", "__places", "__ids")


def encode_vocab(
    df: DataFrame,
    vocab: DataFrame,
    code: str = "code",
    out: str = "ids",
    unknown: int = 0,
    tokenize: Tokenizer = text.word_tokens,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Text to ids with a trained vocabulary."""
    return vocab_lookup(df, vocab, tokenize(F.col(code)), out, unknown, max_rows)


def train_and_encode(
    df: DataFrame,
    code: str = "code",
    out: str = "ids",
    unknown: int = 0,
    size: int = VOCAB_SIZE,
    min_count: int = MIN_COUNT,
    tokenize: Tokenizer = text.word_tokens,
) -> tuple[DataFrame, DataFrame]:
    """:func:`train_vocab`, and ``df`` encoded with it, for a vocabulary of any size.

    Texts are tokenised once: words are counted, and looked up, by chunks of rows that are written.
    """
    rows = _chunked(df, tokenize(F.col(code)))
    words = _chunk_words(rows).filter(F.col("token").isNotNull())
    vocab = _most_frequent(words.groupBy("token").agg(F.sum("n").alias("n")), size, min_count)
    return vocab, _chunk_ids(rows, _once(vocab), out, unknown)


def corpus_lines(df: DataFrame, code: str = "code") -> DataFrame:
    """All lines that are not empty, one a row."""
    return df.select(F.explode_outer(text.code_lines(F.col(code))).alias("line")).filter(
        F.length("line") > 0
    )
