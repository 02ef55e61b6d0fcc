from pyspark.sql import functions as F

import corpus_pipeline
from codewarden.llm import decontaminate, near_dup, slots

SF = "/root/testdata/sf0.001"


def test_stages_and_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity",
        "near_dedup",
        "decontamination",
        "mixing",
        "sharding",
    ]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns
        before, after = {r.doc_id for r in kept.collect()}, after.cache()
        now = {r.doc_id for r in after.collect()}
        assert now <= before and len(now) > 0.6 * len(before)
        kept = after
    groups = near_dup.near_duplicates(kept)
    assert groups.filter("doc_id <> component_id").isEmpty()
    assert decontaminate.leaks(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).isEmpty()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(rows[0].asDict())
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    copies = {}
    for r in rows:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3


def test_edges(spark):
    """Nulls, empty texts, repeated rows and columns with names the stages use pass through all stages."""
    from tests.llm.helpers import EDGES
    from tests.llm.helpers import docs as small

    names = ["copies", "__id", "__id2", "__text", "__source", "__key", "shard", "slot", "version", "offset", "node", "hash"]
    names += ["entry", "virtual_slot", "a.b", "__copies", "__n", "source_size", "key"]
    kept = small(spark, EDGES)
    for name in names:
        kept = kept.withColumn(name, F.concat(F.lit(f"{name}:"), F.coalesce(F.col("text"), F.lit("none"))))
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == columns
    name, stage = corpus_pipeline.STAGES[-1]
    kept = stage(spark, kept, SF)
    assert {"shard", "slot", "version", "virtual_slot"} <= set(kept.columns)
    rows = kept.collect()
    assert rows
    for row in rows:
        for name in names:
            at = f"input_{name}" if name in slots.ADDED else name
            assert row[at] == f"{name}:{'none' if row['text'] is None else row['text']}"
    empty = small(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
