import random

import pytest

from codewarden.llm import hamming

SCHEMA = "vec_id long, embedding array<float>"


def vectors(seed, n, flips=6, groups=5):
    r = random.Random(seed)
    centres = [[r.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(groups)]
    rows = []
    for i in range(n):
        v = list(centres[i % groups])
        for at in r.sample(range(64), r.randrange(flips + 1)):
            v[at] = -v[at]
        rows.append((i, v))
    return rows


def brute(rows, queries, k, skip_self=False):
    bits = {i: sum(1 << b for b, x in enumerate(v) if x is not None and x > 0) for i, v in rows if v is not None and i is not None}
    out = set()
    for q, v in queries:
        if q is None or v is None:
            continue
        code = sum(1 << b for b, x in enumerate(v) if x is not None and x > 0)
        near = sorted(((code ^ c).bit_count(), i) for i, c in bits.items() if not (skip_self and i == q))
        out |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])}
    return out


def found(spark, rows, queries, k=10, skip_self=False):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "'x' AS id")
    asked = spark.createDataFrame(queries, SCHEMA)
    return {tuple(r) for r in hamming.search(frame, asked, k, skip_self).collect()}


@pytest.mark.parametrize("skip_self", [False, True])
def test_nearest_equal_brute_force(spark, skip_self):
    rows = vectors(1, 300)
    assert found(spark, rows, rows[::50], 10, skip_self) == brute(rows, rows[::50], 10, skip_self)


def test_copies_nulls_short_and_few(spark):
    rows = vectors(2, 12, 2, 1) + [(100 + n, [1.0] * 64) for n in range(30)]
    rows += [(None, [1.0] * 64), (200, None), (201, [1.0, None, float("nan")]), (100, [1.0] * 64)]
    queries = [(100, [1.0] * 64), (0, rows[0][1]), (200, None)]
    assert found(spark, rows, queries, 5) == brute(rows, queries, 5)
    few = rows[:3]
    assert found(spark, few, few, 10) == brute(few, few, 10)


def test_empty(spark):
    assert found(spark, [], [(1, [1.0] * 64)]) == set()
    assert found(spark, vectors(1, 5), []) == set()


def test_vectors_longer_than_a_number(spark):
    r = random.Random(3)
    centres = [[r.choice((-1.0, 1.0)) for _ in range(100)] for _ in range(3)]
    rows = []
    for i in range(120):
        v = list(centres[i % 3])
        # Most differ behind the 64th element only.
        for at in r.sample(range(60 if i % 4 else 0, 100), r.randrange(7)):
            v[at] = -v[at]
        rows.append((i, v))
    rows += [(500, [1.0] * 70), (501, [1.0] * 70 + [-1.0] * 30)]
    assert found(spark, rows, rows[::20], 8) == brute(rows, rows[::20], 8)
