"""Text, encoding and numeric expressions on hand-made values."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codewarden.functions import encoding, numeric, text
from codewarden.operators import clean, vocab


def value(spark, column, **fields):
    names = list(fields)
    schema = ", ".join(f"{n} {fields[n][1]}" for n in names) or "x int"
    row = tuple(fields[n][0] for n in names) or (0,)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw", ["a b\u001c\nc", "  x  ", "\u000b a　\u0085b\t", "", " ", "é  ü"]
)
def test_whitespace_is_that_of_python(spark, raw):
    got = value(spark, text.normalize_whitespace(F.col("s")), s=(raw, "string"))
    assert got == " ".join(raw.split())


@pytest.mark.parametrize(
    "raw, want",
    [("/~/ x = 1 /~/y/~/", ["x = 1", "y"]), (None, []), ("a/~/~b", ["a", "~b"]), ("x", ["x"])],
)
def test_flaw_lines(spark, raw, want):
    assert value(spark, text.parse_flaw_lines(F.col("s")), s=(raw, "string")) == want


def test_flaw_line_tokens(spark):
    got = value(spark, text.encode_flaw_line(F.col("s")), s=("a.b @ c", "string"))
    assert got == ["a", ".", "b", "c"]


def test_labels_and_prompts(spark):
    assert value(spark, text.yes_no_label(F.col("t"), " YES"), t=(1, "int")) == " YES"
    assert value(spark, text.yes_no_label(F.col("t")), t=(0, "int")) == "NO"
    prompt = value(spark, text.make_prompt(F.col("s")), s=("a\n b", "string"))
    assert prompt == "Question: a b\n\nAnswer: "
    assert value(spark, text.escape_braces(F.col("s")), s=("{{x}}", "string")) == "{ {x} }"


def test_names(spark):
    ts = F.to_timestamp_ntz(F.lit("2024-02-03 04:05:06"))
    assert value(spark, text.run_folder(ts)) == "2024-02-03_04-05-06"
    assert value(spark, text.run_folder(ts, "base")) == "2024-02-03_04-05-06_base"
    name = text.output_name(ts, F.lit("/in/data.tar.gz"), F.lit("test.jsonl"))
    assert value(spark, name) == "2024-02-03-04-05-06__data__test.txt"


IDS = "array<int>"


def test_truncate(spark):
    ten = list(range(10))
    assert value(spark, encoding.truncate(F.col("a"), 10), a=(ten, IDS)) == ten[:9]
    assert value(spark, encoding.truncate(F.col("a"), 11), a=(ten, IDS)) == ten


def test_encodings(spark):
    fixed = encoding.encode_fixed(F.col("a"), 6, first=100, last=200, pad=1)
    assert value(spark, fixed, a=([5, 6], IDS)) == [100, 5, 6, 200, 1, 1]
    assert value(spark, fixed, a=([5, 6, 7, 8, 9], IDS)) == [100, 5, 6, 7, 8, 200]
    single = encoding.encode_single(F.col("a"), 4, pad=1)
    assert value(spark, single, a=([5, 6, 7, 8], IDS)) == [5, 6, 7, 1]
    assert value(spark, single, a=([5], IDS)) == [5, 1, 1, 1]
    assert value(spark, encoding.single_mask(F.col("a"), 4), a=([5, 6, 7, 8], IDS)) == [1, 1, 1, 0]
    assert value(spark, encoding.attention_mask(F.col("a"), 1), a=([5, 1, 1], IDS)) == [1, 0, 0]
    reference = encoding.reference_ids(F.lit(5), first=0, ref=1, last=2)
    assert value(spark, reference) == [0, 1, 1, 1, 2]


def test_segments(spark):
    ids = [5, 6, 0, 7, 0, 0, 8]
    got = value(spark, encoding.segments(F.col("a"), [0]), a=(ids, IDS))
    assert [tuple(r) for r in got] == [(0, 2), (3, 4)]
    assert value(spark, encoding.segment_ends(F.col("a"), 0), a=(ids, IDS)) == [1, 3]
    assert value(spark, encoding.segments(F.col("a"), [0]), a=([], IDS)) == []
    assert value(spark, encoding.segment_ends(F.col("a"), 0), a=([0, 0], IDS)) == []
    cells = encoding.mask_cells(encoding.segments(F.col("a"), [0]))
    assert value(spark, cells, a=(ids, IDS)) == 5


def test_probabilities(spark):
    logits = ([1.0, 2.0, 0.5], "array<double>")
    exps = [math.exp(x) for x in logits[0]]
    want = [e / sum(exps) for e in exps]
    assert value(spark, numeric.softmax(F.col("z")), z=logits) == pytest.approx(want)
    huge = value(spark, numeric.softmax(F.col("z")), z=([1000.0, 0.0], "array<double>"))
    assert huge == [1.0, 0.0]
    assert value(spark, numeric.argmax_class(F.col("z")), z=([1.0, 3.0, 3.0], "array<double>")) == 1
    loss = numeric.cross_entropy(F.col("z"), F.lit(0))
    assert value(spark, loss, z=logits) == pytest.approx(-math.log(want[0]))
    focal = numeric.focal_loss(F.col("z"), F.lit(1), gamma=0.0, alpha=[0.1, 0.2, 0.7])
    assert value(spark, focal, z=logits) == pytest.approx(-0.2 * math.log(want[1]))
    with pytest.raises(NotImplementedError):
        numeric.reduce_loss(F.lit(1.0), "none")


def test_truncate_or_drop(spark):
    df = spark.createDataFrame([(1, ["x"] * 10), (2, ["x"] * 9)], "idx long, tokens array<string>")
    cut = {r["idx"]: len(r["tokens"]) for r in clean.truncate_or_drop(df, 10).collect()}
    assert cut == {1: 9, 2: 9}
    assert [r["idx"] for r in clean.truncate_or_drop(df, 10, ignore_large=True).collect()] == [2]


def test_flags_and_alignment(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "idx long, skip boolean")
    assert sorted(r["idx"] for r in clean.exclude_by_flag(df, "skip").collect()) == [2, 3]
    assert clean.exclude_by_flag(df, None).count() == 3
    preds = spark.createDataFrame([(1, 0.5), (2, 0.5)], "idx long, prob double")
    with pytest.raises(Exception, match="no partner for idx 3"):
        clean.align_predictions(df, preds).collect()


def test_vocabulary_against_counting(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, code string")
    counts = {}
    for t in texts:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    ranked = sorted((w for w in counts if counts[w] >= 2), key=lambda w: (-counts[w], w))[:95]
    want = dict(zip(vocab.SPECIAL + ranked, range(100)))
    trained = vocab.train_vocab(df, size=100)
    assert {r["token"]: r["id"] for r in trained.collect()} == want
    encoded = vocab.encode_vocab(df, trained).orderBy("idx").collect()
    assert [r["ids"] for r in encoded] == [[want.get(w, 0) for w in t.split()] for t in texts]


def test_large_vocabularies_are_joined(spark):
    words = spark.range(50).select(
        F.concat(F.lit("w"), F.col("id")).alias("token"), F.col("id").cast("int").alias("id")
    )
    rows = [(1, ["w3", "no", "w49", "w3"]), (2, [])]
    df = spark.createDataFrame(rows, "idx long, tokens array<string>")
    for max_rows in (10, 100):
        found = vocab.vocab_lookup(df, words, unknown=-1, max_rows=max_rows).collect()
        assert {r["idx"]: r["ids"] for r in found} == {1: [3, -1, 49, 3], 2: []}


def test_both_lookups_agree_on_repeated_keys_and_nulls(spark):
    words = spark.createDataFrame([("a", 5), ("b", 6), ("a", 9), (None, 7)], "token string, id int")
    rows = [(1, ["a", "z"]), (1, ["b"]), (2, None), (3, [None, "a"]), (None, ["b"])]
    df = spark.createDataFrame(rows, "idx long, tokens array<string>")
    want = [(None, [6]), (1, [5, 0]), (1, [6]), (2, None), (3, [0, 5])]
    for max_rows in (1, 100):
        found = vocab.vocab_lookup(df, words, max_rows=max_rows).collect()
        assert sorted(((r["idx"], r["ids"]) for r in found), key=str) == sorted(want, key=str)


def test_vocabulary_is_cut_within_ties(spark):
    lines = [(n, f"{'x ' * (5 - n // 2)} t{n}") for n in range(8)] + [(9, "t0 t1 t2 t3 t4 t5 t6 t7")]
    df = spark.createDataFrame(lines, "idx long, code string")
    whole = [r["token"] for r in vocab.train_vocab(df).orderBy("id").collect()]
    for size in range(6, len(whole) + 2):
        cut = [r["token"] for r in vocab.train_vocab(df, size=size).orderBy("id").collect()]
        assert cut == whole[:size]


def test_vocabulary_matches_the_tokenizer_library(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(3)
    alphabet = ["int", "x", "==", "y;", "é", "foo_1", "(", ")", "→", "if(x", "a.b"]
    alphabet += ["हिन्दी", "cafe\u0301", "a‿b", "x²", "½", "Ⅷ", "a\u200db", "ⓐ1", "a\u00a0b", "日本語。"]
    texts = [" ".join(rng.choice(alphabet) for _ in range(30)) for _ in range(20)]
    pre = tokenizers.pre_tokenizers.Whitespace()
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, code string")
    got = df.select("idx", text.word_tokens(F.col("code")).alias("t")).orderBy("idx").collect()
    assert [r["t"] for r in got] == [[w for w, _ in pre.pre_tokenize_str(t)] for t in texts]


def test_a_tokenizer_can_be_passed(spark):
    def characters(code):
        return F.split(code, "")

    df = spark.createDataFrame([(1, "aba")], "idx long, code string")
    trained = vocab.train_vocab(df, tokenize=characters)
    assert {r["token"]: r["id"] for r in trained.collect()}["a"] == 5
    encoded = vocab.encode_vocab(df, trained, tokenize=characters).first()["ids"]
    assert encoded == [5, 0, 5]
    prompts = spark.createDataFrame([("ab",), ("a",)], "prompt string")
    fits = clean.fits_context(prompts, 5, tokenize=characters).collect()
    assert [r["fits"] for r in fits] == [False, True]


def test_lookup_unpacks_little_of_a_batch_at_once():
    look = vocab._lookup_in_batches(pa.array(["a", "b"]), np.array([5, 6]), 0).func
    lists = pa.array([["a", "c", None, "b"], None, []])
    assert look(lists).to_pylist() == [[5, 0, 0, 6], None, []]
    many = pa.ListArray.from_arrays(pa.array([0, 4_000_000, 8_000_000], pa.int32()), pa.array(["a", "c"] * 4_000_000))
    tracemalloc.start()
    got = look(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The ids themselves are 32 MB.
    assert len(got.flatten()) == 8_000_000 and peak < 48e6


def test_a_large_vocabulary_is_joined_to_the_words_of_chunks(spark):
    rows = [(i, [f"w{(i + j) % 7}" for j in range(100)]) for i in range(200)] + [(200, None), (201, []), (202, [None])]
    df = spark.createDataFrame(rows, "idx long, tokens array<string>").coalesce(2)
    chunked = vocab._chunked(df, F.col("tokens"))
    joined = vocab._chunk_words(chunked)
    # 20,001 tokens in two chunks of 7 words and a null.
    assert joined.count() <= 2 * 8 and joined.agg(F.sum("n")).first()[0] == 20_001
    words = spark.createDataFrame([(f"w{i}", 10 + i) for i in range(5)], "token string, id int")
    want = {i: t if t is None else [10 + int(w[1]) if w and w < "w5" else -1 for w in t] for i, t in rows}
    for max_rows in (1, 100):
        found = vocab.vocab_lookup(df, words, unknown=-1, max_rows=max_rows).collect()
        assert {r["idx"]: r["ids"] for r in found} == want


def test_chunks_end_within_a_batch():
    many = [[f"{i}-{j}" for j in range(100)] for i in range(8000)] + [None, []]
    got = vocab._in_chunks(pa.array(many), pa.array(range(50, 8052))).to_pylist()
    assert len({r["chunk"] for r in got}) > 1
    words = {r["chunk"]: r["words"] for r in got if r["words"] is not None}
    first = [i + 50 for i, r in enumerate(got) if r["words"] is not None]
    assert first == sorted(words)
    assert [t if (t := r["places"]) is None else [words[r["chunk"]][p] for p in t] for r in got] == many
    assert vocab._in_chunks(pa.array([], pa.list_(pa.string())), pa.array([], pa.int64())).to_pylist() == []


def test_training_and_encoding_tokenise_a_text_once(spark):
    texts = ["b a a", None, "", "c b", "a [UNK] d"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, code string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(code):
        seen.add(1)
        return None if code is None else code.split()

    trained, encoded = vocab.train_and_encode(df, size=8, tokenize=words)
    got = {r["idx"]: r["ids"] for r in encoded.collect()}
    assert seen.value == len(texts)
    want = vocab.train_vocab(df, size=8, tokenize=words)
    assert sorted(trained.collect()) == sorted(want.collect())
    assert got == {r["idx"]: r["ids"] for r in vocab.encode_vocab(df, want, tokenize=words).collect()}
