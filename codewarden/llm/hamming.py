"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes, a bit an element, are cut in segments of ``WIDTH`` bits, and every segment's value is an index key. A code within
distance ``segments * r + a`` of a query differs from it in at most r bits of one of the segments 0 to a, or
in at most r - 1 bits of another, so once the keys within those radii are looked up, all codes up to that
distance are seen.
Radii grow round by round; a query is done when its kth verified distance is covered, which
proves that no code outside can be nearer.

Codes that many vectors share are one index row with the ``k`` least ids: no more of them can be in a top k.
The cut happens before the shuffle. Queries of the same code are searched once. A round's
best lists are tables in the shared folder. Candidates are verified in the join that finds them: only codes at most as far
as a query's kth so far leave it, each once. Joins are merged by key: many rounds of small broadcasts
would pile up on the driver.

Defined results: a vector's code has bit i set if its element i is above 0 (missing elements and NaN count as
not above). Null vectors and null ids have no code: they are not found and find nothing. Ties go
to the lesser id; repeated ids count once. A query finds itself unless ``skip_self``. With fewer than k codes all are
returned. Codes are as long as the longest vector; the bits of what a shorter one lacks are not set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.llm.common import written

#: Bits of a number of a code, segments in it, bits of a segment.
BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
K = 10
#: Every row whose id is divisible by this is a query.
EVERY = 50


def _steps(segments: int) -> list[tuple[int, int, int]]:
    """(radius, first and last segment) of each round; look-ups are many from radius 2 on, so half of the
    segments grow at a time."""
    half = segments // 2
    later = [(r, *part) for r in range(2, WIDTH + 1) for part in ((0, half - 1), (half, segments - 1))]
    return [(r, 0, segments - 1) for r in (0, 1)] + later


def numbers_of(*vectors: DataFrame) -> int:
    """How many numbers of ``BITS`` bits a code needs for the longest vector."""
    longest = [v.agg(F.max(F.size("embedding"))).first()[0] or 0 for v in vectors]
    return max(1, -(-max(longest) // BITS))


def code(embedding: Column, numbers: int) -> Column:
    """Sign bits of a vector, as ``numbers`` whole numbers."""

    def number(n: int) -> Column:
        bits = F.transform(
            F.slice(embedding, n * BITS + 1, BITS),
            lambda x, i: F.when(
                (x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)
            ).otherwise(F.lit(0).cast("long")),
        )
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.when(embedding.isNotNull(), F.struct(*[number(n).alias(f"n{n}") for n in range(numbers)]))


def codes(vectors: DataFrame, numbers: int) -> DataFrame:
    """(id, code) of (vec_id, embedding)."""
    return vectors.select(
        F.col("vec_id").cast("long").alias("id"), code(F.col("embedding"), numbers).alias("code")
    ).filter("id IS NOT NULL AND code IS NOT NULL")


def _segment(of_code: Column, segment: Column, numbers: int) -> Column:
    """The value of a segment, numbered over all numbers of a code."""
    number = of_code["n0"]
    for n in range(1, numbers):
        number = F.when(segment >= n * SEGMENTS, of_code[f"n{n}"]).otherwise(number)
    shifted = F.call_function("shiftrightunsigned", number, (segment % SEGMENTS * WIDTH).cast("int"))
    return shifted.bitwiseAND(F.lit(2**WIDTH - 1).cast("long")).cast("int")


def _distance(a: Column, b: Column, numbers: int) -> Column:
    apart = F.bit_count(a["n0"].bitwiseXOR(b["n0"]))
    for n in range(1, numbers):
        apart = apart + F.bit_count(a[f"n{n}"].bitwiseXOR(b[f"n{n}"]))
    return apart.cast("int")


def index(found: DataFrame, k: int, numbers: int) -> tuple[DataFrame, DataFrame]:
    """(code, ids) with the k least ids of each distinct code, and (segment, value, code, n) with
    the number of those ids."""
    least = F.row_number().over(W.partitionBy("code").orderBy("id"))
    # A window cut at a rank: Spark keeps k rows a code in each task before the shuffle.
    few = found.distinct().withColumn("n", least).filter(F.col("n") <= k)
    holders = written(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    every = F.explode(F.sequence(F.lit(0), F.lit(numbers * SEGMENTS - 1)))
    keys = holders.select("code", F.size("ids").alias("n"), every.alias("segment"))
    value = _segment(F.col("code"), F.col("segment"), numbers).alias("value")
    return holders, written(keys.select("segment", value, "code", "n"), "segments")


def _first_reached(query: Column, found: Column, segment: Column, radius: int, numbers: int) -> Column:
    """Whether no segment before ``segment`` in this round, and none in the rounds before, led from ``query`` to
    the code ``found``. Segments before it were looked up within ``radius``, in this round or the one before;
    those behind it within ``radius - 1``."""
    new = F.lit(True)
    for other in range(numbers * SEGMENTS):
        at = F.lit(other)
        apart = _segment(query, at, numbers).bitwiseXOR(_segment(found, at, numbers))
        bits = F.bit_count(apart)
        new = new & ~F.when(at < segment, bits <= radius).otherwise(bits <= radius - 1)
    return new


def _masks(radius: int) -> Column:
    """All values of a segment with ``radius`` bits, as one constant of the plan."""
    every = [str(x) for x in range(2**WIDTH) if x.bit_count() == radius]
    return F.split(F.lit(",".join(every)), ",").cast("array<int>")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The codes that hold the k nearest ids of each query code."""
    # Ids at a distance below; ties among codes are settled by id at the end.
    below = W.partitionBy("query").orderBy("distance").rangeBetween(W.unboundedPreceding, -1)
    counted = found.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return counted.filter(F.col("before") < k).drop("before")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, skip_self: bool = False) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of ``vectors`` for each of ``queries``, both
    (vec_id, embedding)."""
    need = k + 1 if skip_self else k
    numbers = numbers_of(vectors, queries)
    last_segment = numbers * SEGMENTS - 1
    asked = written(codes(queries, numbers).distinct(), "queries")
    holders, segments = index(codes(vectors, numbers), need, numbers)
    total = holders.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    # Until k are known every distance can win.
    open_ = asked.select(F.col("code").alias("query"), F.lit(numbers * BITS + 1).alias("limit")).distinct()
    best = None
    done = []
    for radius, first, last in _steps(last_segment + 1):
        probes = open_.select(
            "query", "limit", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("segment")
        ).select("query", "limit", "segment", F.explode(_masks(radius)).alias("mask"))
        probes = probes.select(
            "query",
            "limit",
            "segment",
            _segment(F.col("query"), F.col("segment"), numbers).bitwiseXOR(F.col("mask")).alias("value"),
        ).alias("p")
        held = segments.hint("merge").alias("h")
        distance = _distance(F.col("p.query"), F.col("h.code"), numbers)
        # Verified in the join: what can't be among the k nearest any more doesn't leave it, and a code
        # that several segments lead to leaves it once, from the first that reaches it so far.
        near = distance < F.col("p.limit")
        new = _first_reached(F.col("p.query"), F.col("h.code"), F.col("p.segment"), radius, numbers)
        same = (F.col("p.segment") == F.col("h.segment")) & (F.col("p.value") == F.col("h.value"))
        seen = probes.join(held, same & near & new).select(
            "p.query", "h.code", "h.n", distance.alias("distance")
        )
        if best is not None:
            seen = seen.unionByName(best.join(open_.select("query").hint("merge"), "query", "left_semi"))
        best = written(_best(seen, need), "best")
        # Ids at distances that this radius covers; every id counts as covered at the last.
        covered = (last_segment + 1) * radius + last
        sure = F.sum(F.when(F.col("distance") <= covered, F.col("n"))).alias("sure")
        # The kth distance so far: codes as far away can still win by a lesser id.
        kth = F.when(F.sum("n") >= need, F.max("distance") + 1).alias("kth")
        known = best.groupBy("query").agg(sure, kth)
        state = written(
            open_.join(known.hint("merge"), "query", "left").select(
                "query",
                F.coalesce("kth", F.lit(numbers * BITS + 1)).alias("limit"),
                (F.coalesce("sure", F.lit(0)) >= min(need, total)).alias("done"),
            ),
            "state",
        )
        done.append(best.join(state.filter("done").select("query").hint("merge"), "query", "left_semi"))
        open_ = state.filter("NOT done").select("query", "limit")
        if open_.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    near = found.join(holders.hint("merge"), "code").select("query", "distance", F.explode("ids").alias("id"))
    order = W.partitionBy("query").orderBy("distance", "id")
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= need)
    hits = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(near.hint("merge"), "query")
    if skip_self:
        hits = hits.filter("id <> query_id")
    order = W.partitionBy("query_id").orderBy("distance", "id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance")


SEARCH_SQL = f"""
WITH codes AS (
  SELECT e.vec_id AS id,
    list_sum(list_transform(range(0, 32), lambda i: CASE WHEN e.embedding[i + 1] > 0
      AND NOT isnan(e.embedding[i + 1]) THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS lo,
    list_sum(list_transform(range(0, 32), lambda i: CASE WHEN e.embedding[i + 33] > 0
      AND NOT isnan(e.embedding[i + 33]) THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS hi
  FROM embeddings e WHERE e.vec_id IS NOT NULL AND e.embedding IS NOT NULL
),
pairs AS (
  SELECT q.id AS query_id, c.id,
    (bit_count(xor(q.lo, c.lo)) + bit_count(xor(q.hi, c.hi)))::INTEGER AS distance
  FROM (SELECT DISTINCT * FROM codes WHERE id % {EVERY} = 0) q, (SELECT DISTINCT * FROM codes) c
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM pairs
)
SELECT query_id, rank, id, distance FROM ranked WHERE rank <= {K}
"""
