import numpy as np
import pytest

from codewarden.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=16):
    """The contract's rows from a dense eigendecomposition."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = max((len(v) for _, v in kept), default=0)
    grid = np.array([np.floor(64 * np.pad(np.float32(v).astype(float), (0, size - len(v)))) for _, v in kept])
    x = grid.astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, s = len(distinct), distinct.sum(axis=0)
    centred = distinct - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > 1e-12 * values[0]).sum())
    white = (x - s / n) @ vectors[:, :k] / np.sqrt(values[:k])
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(axis=1), white, values[:k] / values.sum()


def check(spark, rows, components=16, tolerance=1e-9):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS grid", "'x' AS n", "'x' AS sums")
    found = whitening.whiten(frame, components).toPandas()
    ids, n, deviation, white, explained = brute(rows, components)
    k = white.shape[1]
    assert len(found) == len(ids) * k and (found["n"] == n).all()
    assert found["identity_error"].max() < 1e-9
    got = found.groupby("component")["explained"].first()
    assert list(got.index) == list(range(1, k + 1)) and np.allclose(got, explained, rtol=1e-9)
    per_row = {}
    for row in found.itertuples():
        per_row.setdefault((row.vec_id, row.deviation), {}).setdefault(row.component, row.whitened)
    mine = np.array([[per_row[i, d][c] for c in range(1, k + 1)] for i, d in zip(ids, deviation)])
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < tolerance
    return found


def test_equals_dense_eigenvectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=24) * np.linspace(4, 0.3, 24)).tolist()) for i in range(400)]
    check(spark, rows + rows[:50])


def test_nulls_copies_and_short_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=6) * [9, 7, 5, 3, 2, 1]).tolist()) for i in range(60)]
    rows += [(i + 100, rows[0][1]) for i in range(200)]
    rows += [(7000, None), (7001, [1.0, None, 2.0, 1.0, 1.0, 1.0]), (7002, [float("nan")] * 6)]
    rows += [(7003, [float("inf")] + [1.0] * 5), (7004, [1.0, 2.0]), (7005, [])]
    check(spark, rows)


def test_dependent_columns_give_fewer_components(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(80, 3)) * [8, 4, 2]
    base = np.round(base * 64) / 64
    rows = [(i, [*v, v[0], v[1], 1.0]) for i, v in enumerate(base.tolist())]
    found = check(spark, rows)
    assert found["component"].max() == 3


def test_repeated_eigenvalues_are_all_found(spark):
    # Corners of a box: every eigenvalue comes three times; components are free within them.
    corners = [[(4.0 if j < 3 else 2.0) * x - (2 if j < 3 else 1) for j, x in enumerate(c)] for c in np.ndindex(*[2] * 6)]
    found = whitening.whiten(spark.createDataFrame(list(enumerate(corners)), SCHEMA), 4).toPandas()
    assert np.allclose(found.groupby("component")["explained"].first(), [4 / 15] * 3 + [1 / 15])
    assert found["identity_error"].max() < 1e-9


def test_wide_space_stops_early_and_is_right(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=120) * 0.5 ** np.arange(120) * 1000).tolist()) for i in range(300)]
    check(spark, rows, 5, 1e-7)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]])
def test_no_spread_no_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_deviation_is_exact_or_an_error():
    model = whitening.Whitening(10**6, [3 * 10**8], np.ones((1, 1)), np.ones(1), 1.0)
    assert model.deviation(np.array([[700]])).tolist() == [(10**6 * 700 - 3 * 10**8) ** 2]
    with pytest.raises(OverflowError):
        model.deviation(np.array([[2**40]]))
