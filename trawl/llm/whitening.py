"""Whitening of embeddings on their leading principal components, found by spectrum slicing.

The covariance is gathered by Spark, over the distinct vectors; only its d x d entries reach the
driver. There the factorisation L D Lᵀ of the covariance less a shift tells, by the signs of D, how
many eigenvalues lie above the shift. Bisection by these counts isolates each leading eigenvalue,
Rayleigh quotient iteration converges to it cubically, and two more counts around the result certify
that it is the eigenvalue of that number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.tables import let_workers_import, stored

SCALE = 256
COMPONENTS = 4
#: Scaled entries beyond this have no exact whole part in double precision.
EXACT = 2.0 ** 53
#: Bound that keeps the growth of L small (Bunch and Parlett).
PIVOT = (1 + 17 ** 0.5) / 8
EPS = float(np.finfo(float).eps)
#: Rayleigh quotient iterations before the interval is halved again; three or four do, as a rule.
MOST_ITERATIONS = 12


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above ``shift``: the positive part of the inertia."""
    rest, above = matrix - shift * np.eye(len(matrix)), 0
    while len(rest):
        size, diagonal = np.abs(rest), np.abs(np.diagonal(rest))
        i, j = divmod(int(size.argmax()), len(rest))
        if size[i, j] == 0:
            break
        p = int(diagonal.argmax())
        if diagonal[p] >= PIVOT * size[i, j]:
            above += int(rest[p, p] > 0)
            others = np.arange(len(rest)) != p
            column = rest[others, p]
            rest = rest[np.ix_(others, others)] - np.outer(column, column) / rest[p, p]
        else:
            # A block with a dominant off-diagonal entry has one eigenvalue of each sign.
            above += 1
            others = (np.arange(len(rest)) != i) & (np.arange(len(rest)) != j)
            columns = rest[np.ix_(others, [i, j])]
            rest = rest[np.ix_(others, others)] - columns @ np.linalg.solve(rest[np.ix_([i, j], [i, j])], columns.T)
    return above


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """A unit vector along the solution for a shift that may be an eigenvalue itself."""
    nudge = 0.0
    while True:
        try:
            x = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), right)
            if np.isfinite(x).all():
                return x / np.linalg.norm(x)
        except np.linalg.LinAlgError:
            pass
        nudge = 2 * nudge + EPS * max(abs(shift), EPS)


def _without(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in found:
            x = x - (x @ other) * other
    return x / np.linalg.norm(x)


class Slices:
    """Counts of eigenvalues above the shifts tried so far."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.norm = matrix, float(np.abs(matrix).sum(axis=1).max())
        self.tolerance = 4 * len(matrix) * EPS * self.norm
        top = self.norm + self.tolerance or 1.0
        self.counts = {-top: len(matrix), top: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_above(self.matrix, shift)
        return self.counts[shift]

    def interval(self, number: int) -> tuple[float, float]:
        """The narrowest known interval that holds the eigenvalue of this number, from 1 by falling size."""
        low = max(shift for shift, count in self.counts.items() if count >= number)
        return low, min(shift for shift, count in self.counts.items() if count < number and shift > low)

    def halve(self, number: int) -> None:
        self.above(sum(self.interval(number)) / 2)

    def isolated(self, number: int) -> bool:
        low, high = self.interval(number)
        return self.counts[low] == number and self.counts[high] == number - 1

    def certified(self, value: float, number: int) -> bool:
        """Whether counts close to ``value`` show it to be the eigenvalue of this number."""
        return self.above(value + self.tolerance) < number <= self.above(value - self.tolerance)


def _iterate(slices: Slices, number: int, found: list[np.ndarray]) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of the interval of an eigenvalue; None if it leaves it."""
    matrix = slices.matrix
    low, high = slices.interval(number)
    middle = (low + high) / 2
    start = np.cos(np.arange(len(matrix)) * (number + 0.5)) + 0.01 * number
    x = _without(_solved(matrix, middle, _without(start, found)), found)
    x = _without(_solved(matrix, middle, x), found)
    best, best_left = None, np.inf
    for _ in range(MOST_ITERATIONS):
        value = float(x @ matrix @ x)
        left = float(np.linalg.norm(matrix @ x - value * x))
        if left >= best_left and best_left <= slices.tolerance:
            # Cubic convergence has ended in rounding.
            break
        if left < best_left:
            best, best_left = (value, x), left
        x = _without(_solved(matrix, value if low < value < high else middle, x), found)
    value, x = best
    inside = low - slices.tolerance <= value <= high + slices.tolerance
    return best if inside and best_left <= slices.tolerance and slices.certified(value, number) else None


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, at most ``k``, and their unit vectors as columns.

    Eigenvalues that are zero to double precision are left out. Of equal eigenvalues any orthogonal
    vectors may come.
    """
    slices, values, vectors = Slices(matrix), [], []
    for number in range(1, min(k, len(matrix)) + 1 if matrix.any() else 0):
        while True:
            low, high = slices.interval(number)
            narrow = high - low <= slices.tolerance
            if slices.isolated(number) or narrow:
                pair = _iterate(slices, number, vectors)
                if pair is not None or narrow:
                    break
            slices.halve(number)
        if pair is None:
            raise ArithmeticError(f"eigenvalue {number} was not certified")
        if pair[0] <= slices.tolerance:
            break
        values.append(pair[0])
        vectors.append(pair[1] if pair[1][np.abs(pair[1]).argmax()] > 0 else -pair[1])
    return np.array(values), np.array(vectors).reshape(len(vectors), len(matrix)).T


def _usable(vector: Column, scale: float) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < EXACT))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def scaled(vectors: DataFrame, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the usable rows, x being the whole parts of the scaled entries."""
    vector = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), vector.alias("vector")).filter(_usable(F.col("vector"), scale))
    return rows.select("vec_id", F.transform("vector", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(fit: DataFrame, dim: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part(rows)`` over all rows of the fit list: each task sends one small matrix."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += part(_matrix(batch, dim))
        at = np.indices(shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["i", "j", "value"])

    let_workers_import(fit.sparkSession)
    parts = fit.mapInArrow(add, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    summed = np.zeros(shape)
    for row in parts.collect():
        summed[row.i, row.j] = row.value
    return summed


def _exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = _matrix(batch, dim)
            rows += len(x)
            narrow = not len(x) or int(np.abs(x).max()) < 2 ** 62 // len(x)
            total += (x if narrow else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim), pa.int64()), pa.array([rows] * dim, pa.int64()), pa.array([str(t) for t in total])],
            names=["i", "rows", "total"])

    let_workers_import(fit.sparkSession)
    parts = fit.mapInArrow(add, "i long, rows long, total string")
    sums = parts.groupBy("i").agg(F.sum("rows").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = sums.orderBy("i").collect()
    return found[0].rows, [int(row.total) for row in found]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The exact sums of squares of n*x - S; null where they have more than 38 digits."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if largest * largest * x.shape[1] < 2 ** 63:
        away = n * x - np.array(sums)
        return pa.array((away * away).sum(axis=1)).cast(pa.decimal128(38, 0))
    away = n * x.astype(object) - np.array(sums, object)
    exact = [int(total) for total in (away * away).sum(axis=1)]
    from decimal import Decimal

    return pa.array([Decimal(total) if total < 10 ** 38 else None for total in exact], pa.decimal128(38, 0))


def whiten(
    vectors: DataFrame, k: int = COMPONENTS, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: each usable row on each component.

    x is the whole part of ``scale`` times an entry. Mean, covariance V and its eigenvalues e are
    those of the ``n`` distinct x-vectors. ``whitened`` is x less the mean, projected on the
    component, over sqrt(e); ``explained`` is e over the trace of V; ``deviation`` the exact sum of
    squares of n*x - S, S being the sums, as ``decimal(38,0)``, null beyond that.
    ``identity_error`` tells how far the covariance of the whitened vectors is from the identity.

    Left out are null and empty vectors, those that hold a null, NaN, infinite or, scaled, an entry
    of 2^53 or more, and those of another length than most usable ones have (of equally many, the
    longer). Components are numbered from 1 by falling e, at most ``k``; there are fewer if V has
    fewer eigenvalues that are not zero to double precision, and no rows at all for a single
    distinct vector or an empty table. Rows with null or repeated ids are rows like others.
    """
    usable = scaled(vectors, scale, id_col, vec_col)
    kind = dict(usable.dtypes)["vec_id"]
    schema = (f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    lengths = usable.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = lengths.dim
    usable = usable.filter(F.size("x") == dim)
    # Copies collapse before the shuffle.
    fit = stored(usable.select("x").distinct())
    n, sums = _exact_sums(fit, dim)
    mean = np.array([total / n for total in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = _summed(fit, dim, (dim, dim), scatter) / n
    values, axes = leading((covariance + covariance.T) / 2, k)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)

    def whitened(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ axes / np.sqrt(values)

    size = len(values)
    centre = _summed(fit, dim, (1, size), lambda x: whitened(x).sum(axis=0, keepdims=True)) / n

    def white_scatter(x: np.ndarray) -> np.ndarray:
        centred = whitened(x) - centre
        return centred.T @ centred

    error = float(np.abs(_summed(fit, dim, (size, size), white_scatter) / n - np.eye(size)).max())
    explained = values / np.trace(covariance)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            again = pa.array(np.repeat(np.arange(len(x)), size))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(again), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(again), n)), _deviations(x, n, sums).take(again), pa.array(whitened(x).ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(again), error)),
            ], names=[field.split()[0] for field in schema.split(", ")])

    return usable.mapInArrow(rows, schema)
