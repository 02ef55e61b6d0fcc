"""Chat formatting with rotated perspectives, in DataFrame operations only.

For every speaker of a conversation the dialogue is rendered with that speaker as the assistant, the
others as named users and system messages as they are. The mask marks what a model learns from: the
speaker's own contents with their end marks.

A conversation is cut in parts of ``PART`` turn numbers, and a part is one row, so a conversation of
any length is spread over many rows and no task holds it whole; parts in order make up the
dialogue. Masks are character spans within their part. Speakers are counted by a distinct (with a
map-side combine) and joined to the parts, a join that adaptive execution splits for a long dialogue.

Defined results: messages go by turn, then role, then text; a missing turn comes last, in a part of its
own. Rows that repeat a message in all four columns are one message; ``rows`` counts them. A missing
role is the speaker ``unknown``; a missing text is an empty message; a missing conversation id is a
conversation of its own. Roles ``system`` take no perspective; a conversation of system messages only gives
no rows. Marks that stand in a content or a name are taken apart, so a message cannot end itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 64
SYSTEM = "system"
UNKNOWN = "unknown"
#: Where messages without a turn stand.
NO_TURN = 2**62


def plain(text: Column) -> Column:
    """A content or name in which no mark can be read."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _message(message: Column, me: Column) -> Column:
    """Header, content with its end mark, and whether the content is learned from."""
    role, text = message["role"], message["text"]
    mine = role == me
    header = (
        F.when(role == SYSTEM, F.lit("<|system|>\n"))
        .when(mine, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user|>"), plain(role), F.lit("\n")))
    )
    return F.struct(
        header.alias("header"),
        F.concat(plain(text), F.lit("<|end|>\n")).alias("body"),
        mine.alias("mine"),
    )


def perspectives(messages: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, speaker, part, rows, messages, text, spans) from (conv_id, turn, role, text);
    ``spans`` are (start, end) of the learned stretches, in characters of ``text``."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN))
    role = F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit(UNKNOWN))
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        turn.alias("turn"),
        role.alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parts = (
        rows.groupBy("conv_id", "turn", "role", "text")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("conv_id", F.floor(F.col("turn") / part).cast("long").alias("part"))
        .agg(
            F.sum("rows").alias("rows"),
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"),
        )
    )
    speakers = (
        rows.filter(F.col("role") != SYSTEM)
        .select(F.col("conv_id").alias("of"), F.col("role").alias("speaker"))
        .distinct()
    )
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    lines = seen.select(
        "conv_id",
        "speaker",
        "part",
        "rows",
        F.transform("said", lambda m: _message(m, F.col("speaker"))).alias("lines"),
    )
    # One pass over a part's messages: end of each, then the spans of the speaker's own.
    length = lambda m: F.length(m["header"]) + F.length(m["body"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, m):
        begin, end = state["at"] + F.length(m["header"]), state["at"] + length(m)
        # The line break after the end mark is not learned.
        span = F.struct(begin.alias("start"), (end - 1).alias("end"))
        own = F.when(m["mine"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), own.alias("spans"))

    return lines.select(
        "conv_id",
        "speaker",
        "part",
        "rows",
        F.size("lines").alias("messages"),
        F.array_join(F.transform("lines", lambda m: F.concat(m["header"], m["body"])), "").alias("text"),
        F.aggregate("lines", start, step, lambda state: state["spans"]).alias("spans"),
    )


PERSPECTIVES_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, coalesce(turn, {NO_TURN})::BIGINT AS turn,
    coalesce(nullif(trim(role), ''), '{UNKNOWN}') AS role, coalesce(text, '') AS text
  FROM conversations
),
said AS (
  SELECT conv_id, floor(turn / {PART}.0)::BIGINT AS part, turn, role, text, count(*) AS n
  FROM rows_ GROUP BY ALL
),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM rows_ WHERE role <> '{SYSTEM}'),
lines AS (
  SELECT s.*, p.speaker, s.role = p.speaker AS mine,
    CASE WHEN s.role = '{SYSTEM}' THEN '<|system|>' WHEN s.role = p.speaker THEN '<|assistant|>'
         ELSE '<|user|>' || replace(s.role, '<|', '< |') END || chr(10) AS header,
    replace(s.text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM said s JOIN speakers p ON p.conv_id IS NOT DISTINCT FROM s.conv_id
),
placed AS (
  SELECT *, sum(length(header) + length(body)) OVER (
    PARTITION BY conv_id, speaker, part ORDER BY turn, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS till
  FROM lines
)
SELECT conv_id, speaker, part, sum(n)::BIGINT AS rows, count(*)::INTEGER AS messages,
  string_agg(header || body, '' ORDER BY turn, role, text) AS text,
  coalesce(string_agg(CASE WHEN mine THEN (till - length(body))::BIGINT || '-' || (till - 1)::BIGINT END,
    ' ' ORDER BY turn, role, text), '') AS spans
FROM placed GROUP BY conv_id, speaker, part
"""
