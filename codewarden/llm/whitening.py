"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries are put on a grid, ``floor(GRID * c)``; ``OFFSET`` is added to what the caller sees and cancels out
of every result. Each distinct grid vector is one row of the fitted matrix X, centred by exact column sums.
A step takes a right vector v to ``Xv`` and back by ``X'u``, both orthogonalised against all
earlier ones; the singular values of the small bidiagonal matrix, squared and divided by the rows, are the
covariance's eigenvalues, and its right singular vectors give the components.

Right vectors have as many entries as an embedding and stay on the driver. Left vectors have one entry a
row of X and are never stored: a task gets every row's entries of all left vectors again from the row itself, by
the recursion that made them, so a lost executor costs a pass and no state. A step is one pass
over X; it sends one row of sums a task back, and tasks are at most ``WAVES`` times the cluster's slots.

A run ends when the wanted triplets are settled or the space is used up. One start vector sees one
direction of each repeated singular value, so further runs start outside of what is known until one shows
nothing larger.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are dropped; null ids stay.
Vectors shorter than the longest count as if zeros followed. Components of eigenvalue zero (to rounding) are not
given, so equal vectors only, one vector or an empty table give no rows. A grid entry beyond 2**52 or
a deviation beyond a long stops the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import written

GRID = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Tasks of a pass for each task slot of the cluster.
WAVES = 2
#: Residual of a settled triplet, against the largest singular value.
SETTLED = 1e-14
#: The same for a value that is only held against a larger one.
ROUGHLY = 1e-4
#: Norms below this, against the largest singular value, count as zero.
NOTHING = 1e-12
LARGEST = 2.0**52
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, grid) of the rows that take part, all of one length."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        F.col("embedding").isNotNull() & F.forall("embedding", entry)
    )
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0

    def on_grid(c):
        value = F.floor(c.cast("double") * GRID)
        return F.when(F.abs(c.cast("double")) * GRID < LARGEST, value.cast("long")).otherwise(
            F.raise_error(F.lit("an embedding's entry is too large")).cast("long")
        )

    missing = F.array_repeat(F.lit(0).cast("long"), longest - F.size("embedding"))
    return kept.select("vec_id", F.concat(F.transform("embedding", on_grid), missing).alias("grid"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch's vectors as rows of whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _pass(fit: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``sums`` of every batch of the fitted rows, added up; one row a task comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = sums(_matrix(batch.column("grid")))
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    tasks = WAVES * fit.sparkSession.sparkContext.defaultParallelism
    rows = fit.coalesce(tasks).mapInArrow(run, "sums binary").collect()
    return np.sum([np.frombuffer(r["sums"], np.float64) for r in rows], axis=0)


def _column_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each column: halves of 32 bits, so that no sum of longs overflows."""

    def halves(grid: np.ndarray) -> np.ndarray:
        high, low = grid >> 32, grid & 0xFFFFFFFF
        return np.concatenate([[len(grid)], high.sum(axis=0), low.sum(axis=0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (2 * size + 1)
        for batch in batches:
            if batch.num_rows:
                total = [a + int(b) for a, b in zip(total, halves(_matrix(batch.column("grid"))), strict=True)]
        text = " ".join(map(str, total))
        yield pa.RecordBatch.from_arrays([pa.array([text])], names=["sums"])

    tasks = WAVES * fit.sparkSession.sparkContext.defaultParallelism
    total = [0] * (2 * size + 1)
    for row in fit.coalesce(tasks).mapInArrow(run, "sums string").collect():
        total = [a + int(b) for a, b in zip(total, row["sums"].split(), strict=True)]
    return total[0], [(h << 32) + low for h, low in zip(total[1 : size + 1], total[size + 1 :], strict=True)]


def left_vectors(rows: np.ndarray, right: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Every row's entries of the left vectors: U with ``U upper = rows right``, column by column."""
    out = rows @ right
    for j in range(out.shape[1]):
        if upper[j, j] == 0:
            out[:, j] = 0
        else:
            out[:, j] = (out[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _start(known: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """A direction outside of ``known``'s columns."""
    v = r.normal(size=len(known))
    for _ in range(3):
        v = v / np.linalg.norm(v)
        v = v - known @ (known.T @ v)
    return v / np.linalg.norm(v)


def bidiagonalise(
    fit: DataFrame, mean: np.ndarray, locked: np.ndarray, enough: Callable, r: np.random.Generator
) -> tuple[np.ndarray, np.ndarray, float]:
    """Singular values, falling, with their right vectors, and the sum of squares of X. ``locked``
    directions, orthonormal columns that X'X keeps apart from the rest, are left out. ``enough(values,
    residuals)`` says when to stop before the space is used up."""
    size = len(mean)
    most = size - locked.shape[1]
    right, upper, back = np.zeros((size, 0)), np.zeros((0, 0)), np.zeros((size, 0))
    v, beta, square = _start(locked, r), 0.0, 0.0
    while True:
        k = right.shape[1]

        def sums(grid: np.ndarray, right=right, upper=upper, v=v, beta=beta, k=k) -> np.ndarray:
            rows = grid - mean
            left = left_vectors(rows, right, upper)
            u = rows @ v
            if k:
                u = u - beta * left[:, -1]
            return np.concatenate([[np.vdot(rows, rows), u @ u], left.T @ u, rows.T @ u])

        found = _pass(fit, sums)
        square, overlap, product = found[0], found[2 : k + 2], found[k + 2 :]
        # u loses what it has of earlier left vectors, and X'u follows from their products.
        alpha = float(np.sqrt(max(found[1] - overlap @ overlap, 0.0)))
        product = product - back @ overlap
        scale = max(float(np.linalg.norm(upper, 2)) if k else 0.0, alpha)
        column = np.zeros(k + 1)
        column[:k] = overlap
        if k:
            column[k - 1] += beta
        column[k] = alpha if alpha > NOTHING * max(scale, np.sqrt(square)) else 0.0
        upper = np.vstack([np.hstack([upper, column[:k, None]]), np.zeros((1, k + 1))])
        upper[k, k] = column[k]
        product = product / column[k] if column[k] else np.zeros(size)
        right, back = np.column_stack([right, v]), np.column_stack([back, product])
        k += 1
        every = np.column_stack([locked, right])
        v = product - (column[k - 1] * right[:, -1])
        for _ in range(2):
            v = v - every @ (every.T @ v)
        beta = float(np.linalg.norm(v))
        bidiagonal = np.diag(np.diag(upper)) + np.diag(np.diag(upper, 1), 1)
        p, values, q = np.linalg.svd(bidiagonal)
        if k == most or enough(values, beta * np.abs(p[-1])):
            return values, right @ q.T, square
        if beta > NOTHING * max(values[0], np.sqrt(square)):
            v = v / beta
        else:
            v, beta = _start(every, r), 0.0


@dataclass
class Whitening:
    """What a fit knows: rows, column sums, components as columns, eigenvalues, trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, grid: np.ndarray) -> np.ndarray:
        return grid - np.array([s / self.n for s in self.sums])

    def whiten(self, grid: np.ndarray) -> np.ndarray:
        return self.centred(grid) @ self.components / np.sqrt(self.values)

    def deviation(self, grid: np.ndarray) -> np.ndarray:
        """Sum of squares of ``n * x - sum``, in whole numbers."""
        most = self.n * int(np.abs(grid).max(initial=0)) + max(map(abs, self.sums), default=0)
        if len(self.sums) * most * most < 2**63:
            gap = self.n * grid - np.array(self.sums, np.int64)
            return (gap * gap).sum(axis=1)
        gap = self.n * grid.astype(object) - np.array(self.sums, object)
        total = (gap * gap).sum(axis=1)
        if max(total, default=0) >= 2**63:
            raise OverflowError("a vector's deviation does not fit a long")
        return total.astype(np.int64)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, seed: int = 1) -> Whitening | None:
    """The fit over ``fit`` (grid), one row for each distinct vector; None without rows."""
    first = fit.select(F.size("grid").alias("size")).first()
    if first is None or first["size"] == 0:
        return None
    n, sums = _column_sums(fit, first["size"])
    mean = np.array([s / n for s in sums])
    r = np.random.default_rng(seed)
    wanted = min(components, len(mean))
    values, vectors, square = bidiagonalise(
        fit,
        mean,
        np.zeros((len(mean), 0)),
        lambda s, rest: len(s) > wanted and bool((rest[:wanted] <= SETTLED * s[0]).all()),
        r,
    )
    spent = vectors.shape[1] == len(mean)
    values, vectors = values[:wanted], vectors[:, :wanted]
    while not spent:
        least = values[-1]
        more, others, _ = bidiagonalise(
            fit,
            mean,
            vectors,
            # What stays below the least known value needn't be settled as far.
            lambda s, rest: bool(rest[0] <= (SETTLED if s[0] > least else ROUGHLY) * s[0]),
            r,
        )
        if more[0] <= least * (1 + 1e-12):
            break
        both, all_vectors = np.append(values, more[0]), np.column_stack([vectors, others[:, 0]])
        order = np.argsort(-both, kind="stable")[:wanted]
        values, vectors = both[order], all_vectors[:, order]
    there = values > 1e-10 * max(values[0], 1e-300)
    if square == 0 or not there.any():
        return None
    model = Whitening(n, sums, vectors[:, there], values[there] ** 2 / n, square / n)
    centre = _pass(fit, lambda grid: model.whiten(grid).sum(axis=0)) / n

    def products(grid: np.ndarray) -> np.ndarray:
        white = model.whiten(grid) - centre
        return (white.T @ white).ravel()

    size = int(there.sum())
    covariance = _pass(fit, products).reshape(size, size) / n
    model.identity_error = float(np.abs(covariance - np.eye(size)).max())
    return model


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every usable row of ``vectors`` (vec_id, embedding) on each component: ``OUT``."""
    rows = usable(vectors)
    # A distinct list: copies meet in the map-side combine.
    fit = written(rows.select("grid").distinct(), "whitening")
    model = fit_whitening(fit, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.values)
        for batch in batches:
            grid = _matrix(batch.column("grid"))
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(grid)), size)))
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(grid))),
                pa.array(np.full(len(grid) * size, model.n)),
                pa.array(np.repeat(model.deviation(grid), size)),
                pa.array(model.whiten(grid).ravel()),
                pa.array(np.tile(model.values / model.trace, len(grid))),
                pa.array(np.full(len(grid) * size, model.identity_error)),
            ]
            names = [part.split()[0] for part in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, OUT)
