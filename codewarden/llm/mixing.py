"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Targets: sources in code point order, null last, weigh 5, 2, 1 and so on; together they share the size
of all documents; none gets more than ``MOST`` times its own size, and what is over goes to the others by
weight. That is a water level: sources in order of cap / weight are capped until the level of
the rest lies under the next cap.

Choice: a document's key is ``-ln(u) / quality``, u in (0, 1) from a hash of its id. Complete epochs take every
document of a source; the rest of the target is taken in order of the keys up to the document that
brings the sum nearest to it. No source is ever sorted as a whole: keys fall in ``BINS`` bins, sizes are
summed for each source and bin, and only the one bin in which a source's target ends is sorted. The
result of that is a last key for each source, and every document is held against it.

Size: words, runs of characters other than space and 0x09-0x0D; a null text has none. Quality:
``QUALITY`` by the label, which counts as its highest where there are several. Rows with equal id,
source and text are one record, taken all or none; ties in the key go by id, then by text. Empty sources have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.llm.common import all_columns, row_key, unused, written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Chance weights of documents by quality label: good, bad, unlabelled.
QUALITY = {1: 2.0, 0: 0.5, None: 1.0}
BINS = 4096
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) from an id: 52 bits of an md5, so that SQL can say the same."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def records(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """(key columns, doc_id, source, size, key, bin) of all documents, written once."""
    marks = (
        labels.filter("quality IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg(F.max("quality").alias("quality"))
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text"),
    ).withColumns(row_key())
    rows = rows.select("__id", "__text", "doc_id", "source", size(F.col("text")).alias("size"))
    quality = (
        F.when(F.col("quality") == 1, QUALITY[1])
        .when(F.col("quality") == 0, QUALITY[0])
        .otherwise(QUALITY[None])
    )
    keyed = rows.join(marks, "__id", "left").withColumn(
        "key", -F.log(uniform(F.col("doc_id"), seed)) / quality
    )
    # 1 - exp(-key) grows with the key and fills (0, 1) evenly for weight 1.
    place = F.least(F.lit(BINS - 1), F.floor((1 - F.exp(-F.col("key"))) * BINS)).cast("int")
    return written(keyed.drop("quality").withColumn("bin", place), "mixing")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(1))
    levels = caps.withColumns(
        {
            "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "heavy": F.sum("weight").over(onward),
        }
    )
    levels = levels.withColumn(
        "capped", F.col("cap") * F.col("heavy") <= F.col("left") * F.col("weight")
    )
    # Caps stop at the first source that stays below its own; it sets the level for the rest.
    # That is the one with the most weight from it on.
    level = F.max(F.when(~F.col("capped"), F.struct("heavy", "left"))).over(whole)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.col("level.left").cast("double") * F.col("weight") / F.col("level.heavy")
    )
    return levels.withColumn("level", level).select("source", "source_size", target.alias("target"))


def plan(found: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: its size, target, complete epochs, and the last key that the rest takes."""
    bins = found.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    sizes = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    goals = targets(sizes, weights, most)
    epochs = F.coalesce(
        F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)
    ).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    # The bin in which the rest ends, at most BINS rows a source.
    same = F.col("b.source").eqNullSafe(F.col("g.source"))
    before = W.partitionBy("b.source").orderBy("b.bin").rowsBetween(W.unboundedPreceding, -1)
    ending = (
        bins.alias("b")
        .join(goals.alias("g"), same)
        .select(
            F.col("b.source").alias("source"),
            F.col("b.bin").alias("bin"),
            F.col("b.bin_size").alias("bin_size"),
            F.col("g.rest").alias("rest"),
            F.coalesce(F.sum("b.bin_size").over(before), F.lit(0)).alias("before"),
        )
        .filter("rest > before AND rest <= before + bin_size")
    )
    same = F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bin") == F.col("e.bin"))
    along = W.partitionBy("r.source", "r.bin").orderBy("r.key", "r.__id", "r.__text")
    last = (
        found.alias("r")
        .join(ending.alias("e"), same)
        .select(
            F.col("r.source").alias("source"),
            F.struct("r.key", "r.__id", "r.__text").alias("place"),
            (F.col("e.before") + F.sum("r.size").over(along) - F.col("r.size") / 2.0).alias("middle"),
            F.col("e.rest").alias("rest"),
        )
        .filter("middle <= rest")
        .groupBy("source")
        .agg(F.max("place").alias("last"))
    )
    joined = goals.alias("g").join(
        ending.select("source", "bin").alias("e"),
        F.col("g.source").eqNullSafe(F.col("e.source")),
        "left",
    )
    joined = joined.join(last.alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")), "left")
    return joined.select(
        "g.source", "source_size", "target", "epochs", F.col("bin").alias("last_bin"), "last"
    )


def choose(found: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``found`` with ``source_size``, ``target`` and ``copies``, how often the mix has each document."""
    goals = written(plan(found, weights, most), "mixing-plan")
    same = F.col("r.source").eqNullSafe(F.col("g.source"))
    place = F.struct("r.key", "r.__id", "r.__text")
    # Up to the last key: whole bins before its bin, and the keys up to it within.
    more = F.when(F.col("r.bin") < F.col("g.last_bin"), 1).when(
        (F.col("r.bin") == F.col("g.last_bin")) & (place <= F.col("g.last")), 1
    )
    return (
        found.alias("r")
        .join(goals.alias("g"), same)
        .select("r.*", "source_size", "target", (F.col("epochs") + F.coalesce(more, F.lit(0))).alias("copies"))
    )


def mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Documents without words
    are taken with their source's order like all others."""
    key, copies = unused(docs.columns, "__key"), unused(docs.columns, "__copies")
    record = [F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")]
    taken = (
        choose(records(docs, labels))
        .filter("copies > 0")
        .select(F.struct("__id", "__text", *record).alias(key), F.col("copies").alias(copies))
        .dropDuplicates([key])
    )
    own = F.struct(*[c.alias(k) for k, c in row_key().items()], *record)
    rows = docs.withColumn(key, own).join(taken, key)
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return rows.withColumn(copies, repeated).select(*all_columns(docs))
