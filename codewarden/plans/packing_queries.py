"""Registered queries: packing functions into sequences, segments, and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.functions import encoding
from codewarden.operators import heads, packing
from codewarden.plans import views
from codewarden.plans.registry import query, round_doubles
from codewarden.plans.row_queries import length_ids
from codewarden.plans.views import WORD, sql
from codewarden.support import materialize

LENGTH = 512
FUNCTIONS = 8
SEPARATOR = 0
PAD = 0


def _packed(spark, sf):
    return packing.pack_sequences(views.lengths(spark, sf), LENGTH, FUNCTIONS)


@query("pack_sequences", sql("SELECT CAST(pack AS BIGINT) AS pack, slot, idx, n FROM packed", "packed"))
def pack_sequences(spark, sf):
    return _packed(spark, sf).select("pack", "slot", "idx", "n")


@query("slot_ends", sql("SELECT idx, pack, slot, last_pos FROM packed", "packed"))
def slot_ends(spark, sf):
    return _packed(spark, sf).select("idx", "pack", "slot", "last_pos")


@query(
    "pack_stats",
    sql(
        """SELECT count(*) AS packs, CAST(sum(functions) AS BIGINT) AS functions,
             round(sum(filled) / (count(*) * 512.0), 6) AS fill
           FROM (SELECT count(*) AS functions, sum(n + 1) AS filled FROM packed GROUP BY pack)""",
        "packed",
    ),
)
def pack_stats(spark, sf):
    return round_doubles(packing.pack_stats(_packed(spark, sf), LENGTH).drop("epoch"))


_EPOCHS = f"""shuffled_epochs AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY key, idx) AS turn
  FROM (SELECT epoch, idx, n, {views.shuffle_key_sql('(epoch - 1)')} AS key
        FROM lengths, generate_series(1, 3) AS e(epoch) WHERE n < 512)),
walked AS (SELECT epoch, n, turn, 0 AS pack, 0 AS slot, n - 1 AS last_pos
  FROM shuffled_epochs WHERE turn = 1
  UNION ALL
  SELECT s.epoch, s.n, s.turn,
    CASE WHEN w.last_pos + 2 + s.n >= 512 OR w.slot + 2 >= 8 THEN w.pack + 1 ELSE w.pack END,
    CASE WHEN w.last_pos + 2 + s.n >= 512 OR w.slot + 2 >= 8 THEN 0 ELSE w.slot + 1 END,
    CASE WHEN w.last_pos + 2 + s.n >= 512 OR w.slot + 2 >= 8 THEN s.n - 1 ELSE w.last_pos + 1 + s.n END
  FROM walked w JOIN shuffled_epochs s ON s.epoch = w.epoch AND s.turn = w.turn + 1)"""


@query(
    "pack_epochs",
    sql("", "lengths").rstrip()
    + f""",
{_EPOCHS}
SELECT CAST(epoch AS INTEGER) AS epoch, count(*) AS packs, CAST(sum(functions) AS BIGINT) AS functions,
  round(sum(filled) / (count(*) * 512.0), 6) AS fill
FROM (SELECT epoch, count(*) AS functions, sum(n + 1) AS filled FROM walked GROUP BY epoch, pack)
GROUP BY epoch""",
)
def pack_epochs(spark, sf):
    packed = packing.pack_sequences(views.lengths(spark, sf), LENGTH, FUNCTIONS, epochs=3)
    return round_doubles(packing.pack_stats(packed, LENGTH))


def functions(spark, sf):
    """Ids, their number, label and weight of every document, tokenised once."""
    rows = length_ids(spark, sf).select(
        "idx",
        "ids",
        F.size("ids").alias("n"),
        (F.col("idx") % 2).cast("int").alias("target"),
        (F.col("idx") % 3 + 1).cast("double").alias("weight"),
    )
    return materialize(rows, "functions")


def emitted(rows, **ranges):
    packed = packing.pack_sequences(rows.select("idx", "n"), LENGTH, FUNCTIONS, **ranges)
    return packing.emit_packs(packed, rows, LENGTH, FUNCTIONS, SEPARATOR, PAD, weights=True)


def _emitted(spark, sf):
    return emitted(functions(spark, sf))


_IDS = f"(SELECT doc_id, list_transform(regexp_extract_all(text, '{WORD}'), lambda t: length(t) + 9) AS ids FROM documents)"
_EMITTED = f"""emitted AS (SELECT pack,
    string_agg(array_to_string(list_concat(ids, [0]), ' '), ' ' ORDER BY slot)
      || repeat(' 0', CAST(512 - sum(n + 1) AS INTEGER)) AS input_ids,
    string_agg(CAST(idx % 2 AS VARCHAR), ' ' ORDER BY slot)
      || repeat(' -100', CAST(8 - count(*) AS INTEGER)) AS labels,
    repeat('1', CAST(sum(n + 1) AS INTEGER)) || repeat('0', CAST(512 - sum(n + 1) AS INTEGER))
      AS attention_mask,
    string_agg(CAST(idx % 3 + 1 AS VARCHAR) || '.0', ' ' ORDER BY slot)
      || repeat(' -100.0', CAST(8 - count(*) AS INTEGER)) AS weights
  FROM packed JOIN {_IDS} ON idx = doc_id GROUP BY pack)"""
_POSITIONS = """positions AS (SELECT pack, i - 1 AS pos, CAST(ids[i] AS INTEGER) AS id,
    CAST(lag(ids[i]) OVER (PARTITION BY pack ORDER BY i) AS INTEGER) AS before
  FROM (SELECT pack, ids, unnest(generate_series(1, len(ids))) AS i
        FROM (SELECT pack, string_split(input_ids, ' ') AS ids FROM emitted)))"""


def _with_emitted(body: str, *more: str) -> str:
    return sql("", "packed").rstrip() + ",\n" + ",\n".join([_EMITTED, *more]) + "\n" + body


def _text(name: str, sep: str = " "):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), sep).alias(name)


def shown(packs):
    return packs.select(
        "pack", _text("input_ids"), _text("labels"), _text("attention_mask", ""), _text("weights")
    )


@query("emit_packs", _with_emitted("SELECT * FROM emitted"))
def emit_packs(spark, sf):
    return shown(_emitted(spark, sf))


@query(
    "segment_ends",
    _with_emitted(
        """SELECT pack, CAST(row_number() OVER (PARTITION BY pack ORDER BY pos) - 1
             AS INTEGER) AS segment, CAST(pos - 1 AS INTEGER) AS pos
           FROM positions WHERE id = 0 AND before <> 0""",
        _POSITIONS,
    ),
)
def segment_ends(spark, sf):
    packs = _emitted(spark, sf).withColumn("seq_id", F.col("pack"))
    return heads.segment_ends(packs, SEPARATOR, "input_ids").select(
        F.col("seq_id").alias("pack"), "segment", "pos"
    )


@query(
    "segments",
    _with_emitted(
        """SELECT pack, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) + 1 AS INTEGER) AS last
           FROM (SELECT *, sum(CAST(id = 0 AS INTEGER)) OVER (PARTITION BY pack ORDER BY pos) AS run,
                   max(CASE WHEN id = 0 THEN pos END) OVER (PARTITION BY pack) AS last_sep
                 FROM positions) WHERE id <> 0 AND pos < last_sep GROUP BY pack, run""",
        _POSITIONS,
    ),
)
def segments(spark, sf):
    ranges = encoding.segments(F.col("input_ids"), [SEPARATOR, PAD])
    return (
        _emitted(spark, sf)
        .select("pack", F.inline_outer(ranges))
        .filter(F.col("first").isNotNull())
    )


@query(
    "segment_mask_cells",
    _with_emitted(
        """SELECT pack, CAST(sum(size * size) AS BIGINT) AS cells FROM (
             SELECT pack, count(*) AS size
             FROM (SELECT *, sum(CAST(id = 0 AS INTEGER)) OVER (PARTITION BY pack ORDER BY pos) AS run,
                     max(CASE WHEN id = 0 THEN pos END) OVER (PARTITION BY pack) AS last_sep
                   FROM positions) WHERE id <> 0 AND pos < last_sep GROUP BY pack, run)
           GROUP BY pack""",
        _POSITIONS,
    ),
)
def segment_mask_cells(spark, sf):
    ranges = encoding.segments(F.col("input_ids"), [SEPARATOR, PAD])
    packs = _emitted(spark, sf).select("pack", ranges.alias("ranges"))
    return packs.select("pack", encoding.mask_cells(F.col("ranges")).alias("cells")).filter(
        F.col("cells") > 0
    )


@query(
    "unpack_predictions",
    sql(
        """SELECT idx, pack, slot, round(n / 100.0, 6) AS z0,
             round(idx % 7 / 7.0, 6) AS z1 FROM packed""",
        "packed",
    ),
)
def unpack_predictions(spark, sf):
    packed = _packed(spark, sf)
    # Logits any scorer could give: padded to whole packs, then brought back to functions.
    scored = packed.select(
        "epoch",
        "pack",
        "slot",
        F.array(F.col("n") / 100.0, F.col("idx") % 7 / 7.0).alias("logits"),
    )
    padded = packing.pad_logits(scored, FUNCTIONS, classes=2)
    z = F.col("logits")
    back = packing.unpack_predictions(padded, packed)
    return round_doubles(
        back.select("idx", "pack", "slot", z[0].alias("z0"), z[1].alias("z1"))
    )
