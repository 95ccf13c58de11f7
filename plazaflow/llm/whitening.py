"""Whitening of embeddings by block Lanczos, without a covariance matrix.

Entries c become whole numbers x = floor(1024 c) + 100000, so counts, sums and squared deviations are exact. All that is
needed of the covariance V is its product with a block of vectors: a pass in which each task adds up XᵀXv of its rows,
centred before they are multiplied. Partial sums are added in two levels, in the order of tasks.

Block Lanczos: each product is made orthogonal to all earlier blocks, twice, and its directions are the next block. Where
directions run out (a breakdown), random ones take their place, orthogonal to all before, so that no eigenvector hides in a
space that the first block can't reach. The basis' Ritz vectors are accepted when their residuals, which need no further
pass, are ``TOLERANCE`` of the largest eigenvalue or no longer fall, at the latest when the basis spans all dimensions. The
trace, for explained shares, is the sum of the squared deviations. The driver holds the basis (dimensions x vectors), never rows.

Vectors that are null or empty or hold a null or a non-finite entry are left out, and so are those of another length than
most have (ties: the longer). Components whose eigenvalue is under 1e-12 of the largest have no whitened value and are not
returned, so equal vectors alone give no rows. A deviation past 64 bits is null; sums don't have that limit. Rows keep their
ids, null or repeated ones too, and each counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

SCALE, SHIFT = 1024, 100_000
TOLERANCE = 1e-13
#: Rows of partial sums that come to the driver in a pass, at most.
SLOTS = 64
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the vectors that count, and their length."""
    vector = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector")).where(vector.isNotNull() & (F.size(vector) > 0) & ~bad)
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    return rows.where(F.size("vector") == d), d


def whole(column: pa.Array, d: int) -> np.ndarray:
    """The x-vectors of a batch: 64-bit integers, or Python's where they are too large."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    if not c.size or np.abs(c).max() < 2**40:
        return np.floor(c * SCALE).astype(np.int64) + SHIFT
    of = lambda v: (int(v) * SCALE if abs(v) >= 2**53 else int(np.floor(v * SCALE))) + SHIFT
    return np.array([[of(v) for v in row] for row in c.tolist()], dtype=object)


def sums(x: np.ndarray) -> list[int]:
    """Exact sums by dimension; 64-bit entries are below 2**51, so that a batch of 4,096 rows fits."""
    out = [0] * x.shape[1]
    for at in range(0, len(x), 4096):
        out = [a + int(b) for a, b in zip(out, x[at : at + 4096].sum(axis=0), strict=True)]
    return out


def deviations(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, list[int | None], int]:
    """n x - S of each row as doubles over n, each row's squared length of n x - S (None past 64 bits), and the sum of those, exact."""
    most = max((abs(int(x.max())), abs(int(x.min())))) if x.size else 0
    if n * (most + 1) + max(map(abs, total), default=0) < 2**55 and x.dtype != object:
        t = x * n - np.array(total, np.int64)
        # in two digits of 28 bits, whose products can be added up in 64 bits
        a, b = t >> 28, t & (2**28 - 1)
        parts = [(p * q).sum(axis=1) for p, q in ((a, a), (a, b), (b, b))] if x.shape[1] <= 64 else [(p.astype(object) * q).sum(axis=1) for p, q in ((a, a), (a, b), (b, b))]
        squares = [(int(p) << 56) + (int(q) << 29) + int(r) for p, q, r in zip(*parts, strict=True)]
        centred = t / n
    else:
        t = x.astype(object) * n - np.array(total, object)
        squares = [sum(int(v) ** 2 for v in row) for row in t]
        centred = np.array([[int(v) / n for v in row] for row in t], float).reshape(len(t), x.shape[1])
    return centred, [s if s < 2**63 else None for s in squares], sum(squares)


Work = Callable[[pa.RecordBatch], tuple[list[int], np.ndarray]]


def added(rows: DataFrame, work: Work, integers: int, shape: tuple[int, ...]) -> tuple[list[int], np.ndarray]:
    """The sums over all batches of ``work``'s exact integers and of its arrays; each task gives one row, and those are added by task number."""
    fields = ["part", "integers", "doubles"]

    def row(part: int, whole_numbers: list[int], doubles: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([list(map(str, whole_numbers))], pa.list_(pa.string())), pa.array([doubles.tobytes()], pa.binary())], fields)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, real = [0] * integers, np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                more, array = work(batch)
                exact, real = [a + b for a, b in zip(exact, more, strict=True)], real + array
        yield row(TaskContext.get().partitionId(), exact, real)

    def of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, real, some = [0] * integers, np.zeros(shape), False
        for batch in batches:
            for numbers, doubles in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                some, exact, real = True, [a + int(b) for a, b in zip(exact, numbers, strict=True)], real + np.frombuffer(doubles).reshape(shape)
        if some:
            yield row(TaskContext.get().partitionId(), exact, real)

    schema = "part int, integers array<string>, doubles binary"
    tasks = in_batches(rows, per_task, schema)
    slots = tasks.repartition(SLOTS, F.col("part") % SLOTS).sortWithinPartitions("part")
    exact, real = [0] * integers, np.zeros(shape)
    for r in sorted(in_batches(slots, of_tasks, schema).collect()):
        exact, real = [a + int(b) for a, b in zip(exact, r.integers, strict=True)], real + np.frombuffer(r.doubles).reshape(shape)
    return exact, real


def orthonormal(block: np.ndarray, basis: np.ndarray, width: int, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Up to ``width`` directions of ``block`` orthogonal to ``basis``, filled up with random ones where it has too few."""
    room = min(width, len(basis) - basis.shape[1])
    clean = lambda b: b - basis @ (basis.T @ b)
    u, s, _ = np.linalg.svd(clean(clean(block)), full_matrices=False)
    found = u[:, s > 1e-11 * scale][:, :room]
    while found.shape[1] < room:
        all_before = np.hstack([basis, found])
        fresh = rng.standard_normal((len(basis), room - found.shape[1]))
        for _ in range(3):
            fresh -= all_before @ (all_before.T @ fresh)
        u, s, _ = np.linalg.svd(fresh, full_matrices=False)
        found = np.hstack([found, u[:, s > 1e-8]])
    # once more, as small directions have lost some of their right angles
    return np.linalg.qr(clean(found))[0]


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, width: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric operator, their unit eigenvectors as columns, and the residuals' lengths."""
    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.standard_normal((d, min(width, d))))[0]
    basis, image, last = np.empty((d, 0)), np.empty((d, 0)), np.inf
    while True:
        new = product(block)
        basis, image = np.hstack([basis, block]), np.hstack([image, new])
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        ritz = basis @ vectors
        residuals = np.linalg.norm(image @ vectors - ritz * values, axis=0)
        worst, scale = residuals.max(), max(abs(values[0]), 1e-300)
        settled = basis.shape[1] >= k and (worst <= TOLERANCE * scale or (worst <= 1e-11 * scale and worst > last / 2))
        if settled or basis.shape[1] >= d:
            return values, ritz / np.linalg.norm(ritz, axis=0), residuals
        last = worst
        block = orthonormal(new, basis, width, scale, rng)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: exact count and sums, axes as columns by falling eigenvalue, and how far its values are from white."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float


def fit(rows: DataFrame, d: int, *, k: int = 8, width: int = 16) -> Whitening:
    """Fits on (vec_id, vector) rows of length ``d``; ``width`` vectors go through the rows in a pass."""

    def counted(batch: pa.RecordBatch) -> tuple[list[int], np.ndarray]:
        return [batch.num_rows, *sums(whole(batch.column(1), d))], np.zeros(0)

    (n, *total), _ = added(rows, counted, d + 1, (0,))
    if not n or not d:
        return Whitening(n, total, np.empty((d, 0)), np.empty(0), 0.0, np.empty(0), 0.0)
    spread = [0]

    def product(block: np.ndarray) -> np.ndarray:
        def work(batch: pa.RecordBatch) -> tuple[list[int], np.ndarray]:
            centred, _, squared = deviations(whole(batch.column(1), d), n, total)
            return [squared], centred.T @ (centred @ block)

        (spread[0],), out = added(rows, work, 1, block.shape)
        return out / n

    values, axes, residuals = block_lanczos(product, d, min(k, d), width)
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    real = values > 1e-12 * max(values[0], 0.0)
    values, axes, residuals = values[real], (axes * sign)[:, real], residuals[real]
    scaled = axes / np.sqrt(values)

    def second_moments(batch: pa.RecordBatch) -> tuple[list[int], np.ndarray]:
        y = deviations(whole(batch.column(1), d), n, total)[0] @ scaled
        return [], np.vstack([y.T @ y, y.sum(axis=0)])

    _, moments = added(rows, second_moments, 0, (len(values) + 1, len(values)))
    mean = moments[-1] / n
    error = np.abs(moments[:-1] / n - np.outer(mean, mean) - np.eye(len(values))).max(initial=0.0)
    return Whitening(n, total, axes, values, float(Fraction(spread[0], n**3)), residuals, float(error))


def whitened(rows: DataFrame, d: int, model: Whitening) -> DataFrame:
    """A row for each vector and component, from 1."""
    k = len(model.values)
    scaled, share = model.axes / np.sqrt(model.values), model.values / model.trace if model.trace else model.values

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            centred, squares, _ = deviations(whole(batch.column(1), d), model.n, model.sums)
            r = batch.num_rows
            of_row = np.repeat(np.arange(r), k)
            columns = [batch.column(0).take(pa.array(of_row)), np.tile(np.arange(1, k + 1, dtype=np.int32), r), np.full(r * k, model.n, np.int64), pa.array(squares, pa.int64()).take(pa.array(of_row)),
                       (centred @ scaled).ravel(), np.tile(share, r), np.full(r * k, model.identity_error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], OUT.replace(",", "").split()[::2])

    return in_batches(rows, work, OUT)


def whiten(df: DataFrame, *, k: int = 8, width: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector that counts, fitted on the same."""
    rows, d = usable(df, id_col, vec_col)
    return whitened(rows, d, fit(rows, d, k=k, width=width))
