"""The corpus pipeline: documents in, a mixed and sharded training corpus out.

Each stage works on everything its predecessor kept and is written as Parquet before the next one
reads it, so a lost executor never costs more than the stage that is running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codewarden.llm import decontaminate, mixing, near_dup, slots, toxicity
from codewarden.llm.common import table, written
from codewarden.support import shared_dir

#: Scores from here on are toxic.
TOXIC = 0.5
SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on all labels, does not hold for toxic."""
    sample = toxicity.learning_texts(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, toxicity.learn(sample), TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.dedupe(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with ``virtual_slot``, ``shard``, the place in it (``slot``), and the slot map's ``version``; columns
    that had these names come back as ``input_`` and their name."""
    found = written(slots.records(docs).select("virtual_slot", "size"), "slots")
    weight, rows = slots.slot_totals(found)
    path = shared_dir(spark, "llm-slot-map")
    first = slots.first_map(SHARDS)
    slots.write_map(slots.map_frame(spark, first, rows, 1).drop("version"), path, 1)
    edited = slots.rebalance(first, weight, SHARDS)
    slots.write_map(slots.map_frame(spark, edited, rows, 2).drop("version"), path, 2)
    return slots.place_documents(docs, slots.read_map(spark, path))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Networks, registers and slot maps have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
