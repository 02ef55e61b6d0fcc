"""The operators of this folder as registered queries, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.llm import (
    decontaminate,
    hamming,
    language,
    licences,
    mixing,
    mixing_sql,
    near_dup,
    perspectives,
    secrets,
    slots,
    spans,
    spelling,
    toxicity,
    whitening,
)
from codewarden.llm.common import fold, table, written
from codewarden.support import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_perspectives", perspectives.PERSPECTIVES_SQL)
def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as each of its speakers sees it, with the learned stretches."""
    found = perspectives.perspectives(table(spark, sf_dir, "conversations"))
    span = lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))
    return found.withColumn("spans", F.array_join(F.transform("spans", span), " "))


@query("op2_virtual_slots")
def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23: a first map of the slots, and its edited second version."""
    found = written(slots.records(table(spark, sf_dir, "documents")), "slots")
    weight, rows = slots.slot_totals(found)
    path = shared_dir(spark, "llm-slot-map")
    shard_of = slots.first_map(24)
    slots.write_map(slots.map_frame(spark, shard_of, rows, 1).drop("version"), path, 1)
    shard_of = slots.rebalance(shard_of, weight, 24)
    slots.write_map(slots.map_frame(spark, shard_of, rows, 2).drop("version"), path, 2)
    placed = slots.place(found, slots.read_map(spark, path))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "version",
    )


@query("op3_spaced_seeds")
def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that leaks a benchmark item, with the item and where it stands."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "first_word", "last_word")


@query("op4_bigru")
def op4_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four fifths of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = fold("doc_id", 5) != 0
    sample = toxicity.learning_texts(docs.filter(learn), labels.filter(learn))
    found = toxicity.score(docs, toxicity.learn(sample))
    return found.select(
        "doc_id",
        (~learn).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op5_sentence_spans")
def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences that an earlier document has in a run."""
    docs = table(spark, sf_dir, "documents")
    cut = spans.cut_repeats(docs)
    return cut.selectExpr(
        "nullif(__id, -9223372036854775808) AS doc_id", "cut_text AS text", "sentences", "removed"
    )


@query("op6_rank_order")
def op6_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = language.RankModel(language.profiles(docs.filter(fold("doc_id", 3) != 1)))
    found = language.identify(docs, model)
    held_out = (fold("doc_id", 3) == 1).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


@query("op7_licence_digests", licences.scan_sql(licences.public_licences()))
def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical digest of every document, and every public licence text or notice found."""
    known = licences.known_licences(spark, licences.public_licences())
    return licences.scan(table(spark, sf_dir, "documents"), known)


@query("op7_licence_digests_public", licences.scan_sql(licences.public_licences()))
def op7_licence_digests_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The former name of ``op7_licence_digests``, from when that looked up seven texts."""
    return op7_licence_digests(spark, sf_dir)


@query("op8_exponential_keys", mixing_sql.MIXED)
def op8_exponential_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    found = mixing.records(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixing.choose(found).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken
    )


@query("op9_hyperminhash")
def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id", "n_shingles", "component_id", "doc_id <=> component_id AS kept"
    )


@query("op10_multi_index", hamming.SEARCH_SQL)
def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors, by sign bits, of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return hamming.search(vectors, vectors.filter(F.col("vec_id") % hamming.EVERY == 0))


@query("op11_structural")
def op11_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets of every document, looks and proven structures alike."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    spelled = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
        F.exists("spans", lambda s: ~s["kind"].isin(*secrets.BASE_KINDS)).alias("confirmed"),
    )


@query("op12_fm_index")
def op12_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with the more frequent word it varies, and where such steps end."""
    found = spelling.variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_lanczos")
def op13_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first components of all distinct vectors, at unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
