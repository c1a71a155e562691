"""Whitening of embeddings by spectrum slicing (operator 12).

Method: entries become whole numbers, ``floor(64 c) + 1000000``.  One pass sums them
exactly, a second adds up the products of centred vectors in each task; what leaves the
cluster is one covariance matrix, whose size is that of a vector and not of the table.
Its leading eigenvalues are isolated by inertia: the number of positive entries in D of
an LDLᵀ factorisation of V - sI (symmetric pivoting, blocks of one and two) is the number
of eigenvalues above s, by Sylvester's law, so bisection on s slices the spectrum until
each slice holds one eigenvalue, or several that are equal to working precision.
Within a slice Rayleigh quotient iteration finds a vector, with what has been found in the
spectrum projected out; it converges cubically.  Counts on both sides of each
eigenvalue then certify its number.  Rows are projected where they are read.

Defined results: rows whose vector is null or holds null or non-finite entries take no
part, nor do entries beyond ``LARGEST`` in size (their products leave double
precision) and vectors of another length than most have (of equally frequent lengths,
the longest); an empty vector has no components.  Components of a variance that is zero
to working precision cannot be whitened and are left out, so one row, or equal rows
alone, give none; an empty table gives no rows.  Null ids are ids; repeated rows count each.
A deviation beyond the range of a long is null.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 2.0**36
_ROWS = 4096  # rows that a task holds at once


@dataclass(frozen=True)
class Fit:
    """What whitening needs to know of a table: length of the vectors, rows, sums, eigenvalues, components (as columns) and the trace."""

    length: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


# --- the spectrum of a symmetric matrix -------------------------------------------------


def eigenvalues_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above the shift: the positive entries in D of LDLᵀ of a - shift I."""
    m = a - shift * np.eye(len(a))
    ratio, above = (1 + math.sqrt(17)) / 8, 0
    while (n := len(m)):
        # The largest entry of all decides between a pivot of one row and one of two.
        diagonal = np.abs(np.diagonal(m))
        p = int(diagonal.argmax())
        off = np.abs(np.tril(m, -1))
        q, r = divmod(int(off.argmax()), n)
        if diagonal[p] == 0 and off[q, r] == 0:
            return above  # what is left is zero: eigenvalues equal to the shift
        if diagonal[p] >= ratio * off[q, r]:
            above += bool(m[p, p] > 0)
            rest = np.arange(n) != p
            column = m[rest, p]
            m = m[np.ix_(rest, rest)] - np.outer(column, column) / m[p, p]
        else:
            above += 1  # a block of two with such a pivot has one eigenvalue of each sign
            rest = (np.arange(n) != q) & (np.arange(n) != r)
            columns = m[np.ix_(rest, [q, r])]
            m = m[np.ix_(rest, rest)] - columns @ np.linalg.solve(m[np.ix_([q, r], [q, r])], columns.T)
        m = (m + m.T) / 2
    return above


def slices(a: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, count) from the top down that hold the leading eigenvalues, until ``most`` are held or the spectrum ends; one each where precision allows."""
    reach = np.abs(a).sum(axis=1).max(initial=0.0)  # no eigenvalue is beyond it
    floor = max(reach, np.finfo(float).tiny) * len(a) * np.finfo(float).eps
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = eigenvalues_above(a, shift)
        return counts[shift]

    found: list[tuple[float, float, int]] = []
    todo = [(4 * floor, 1.000001 * reach + floor)]
    while todo and sum(c for _, _, c in found) < most:
        low, high = todo.pop()
        count = above(low) - above(high)
        if count <= 0:
            continue
        if count == 1 or high - low <= 8 * floor:
            found.append((low, high, count))
            continue
        middle = (low + high) / 2
        todo += [(low, middle), (middle, high)]
    return found


def _narrowed(a: np.ndarray, low: float, high: float) -> tuple[float, float]:
    """A tenth of a slice of one eigenvalue, or less, by further counts."""
    width, top = (high - low) / 16, eigenvalues_above(a, high)
    while high - low > width:
        middle = (low + high) / 2
        low, high = (middle, high) if eigenvalues_above(a, middle) > top else (low, middle)
    return low, high


def _iterated(a: np.ndarray, low: float, high: float, found: list[np.ndarray], seed: int) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of a slice; null if it ends outside."""
    n, eps = len(a), np.finfo(float).eps
    scale = np.abs(a).sum(axis=1).max()
    x = np.random.default_rng(seed).standard_normal(n)

    def cleaned(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for y in found:
                x = x - (y @ x) * y
        return x / np.linalg.norm(x)

    x, shift = cleaned(x), (low + high) / 2
    for k in range(60):
        m = a - shift * np.eye(n)
        try:
            y = np.linalg.solve(m, x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue itself
            y = np.linalg.solve(m + scale * eps * np.eye(n), x)
        if not np.isfinite(y).all():
            y = np.linalg.solve(m + scale * eps * np.eye(n), x)
        x = cleaned(y)
        value = float(x @ a @ x)
        residual = np.linalg.norm(a @ x - value * x)
        if residual <= 4 * n * eps * scale and k:
            # A wide slice holds its eigenvalue well inside or at a counted border; a narrow one to working precision.
            margin = 16 * n * eps * scale if high - low <= 64 * n * eps * scale else 0.0
            return (value, x) if low - margin <= value <= high + margin else None
        # Inverse iteration first: the quotient is used as a shift only where it lies in the slice.
        shift = value if low < value < high and k else (low + high) / 2
    return None


def leading_components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest positive eigenvalues of a symmetric matrix, falling, and their unit vectors as columns; counts certify the numbering."""
    scale = np.abs(a).sum(axis=1).max(initial=0.0)
    tolerance = 64 * max(len(a), 1) * np.finfo(float).eps * scale
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for low, high, count in slices(a, most):
        near = []
        for k in range(count):
            at = (low, high)
            for attempt in range(40):
                got = _iterated(a, *at, vectors, 1000 * len(vectors) + attempt)
                if got is not None:
                    break
                at = _narrowed(a, *at) if count == 1 else at
            else:
                raise ArithmeticError(f"no eigenvector for the slice {low!r} to {high!r}")
            near.append(got)
            vectors.append(got[1])
        values += [v for v, _ in near]
        if count > 1:  # within a slice of equal eigenvalues: falling quotients
            order = sorted(near, key=lambda x: -x[0])
            vectors[-count:], values[-count:] = [x for _, x in order], [v for v, _ in order]
    for k, value in enumerate(values):
        if not eigenvalues_above(a, value + tolerance) <= k < eigenvalues_above(a, value - tolerance):
            raise ArithmeticError(f"counts contradict the number {k + 1} of the eigenvalue {value!r}")
    return np.array(values[:most]), np.array(vectors[:most]).T.reshape(len(a), -1)


# --- passes over the table ------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch], length: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers of the vectors that take part, in blocks of one length each."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            ids, lists = part.column(0), part.column(1)
            sizes = np.array(lists.value_lengths().fill_null(-1))
            flat = lists.flatten().cast(pa.float64())
            values = flat.to_numpy(zero_copy_only=False)  # nulls are NaN here
            starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])[:-1]
            for size in np.unique(sizes[sizes > 0]) if length is None else [length]:
                rows = np.flatnonzero(sizes == size)
                if not len(rows):
                    continue
                block = values[starts[rows][:, None] + np.arange(size)]
                fine = (np.abs(block) <= LARGEST).all(axis=1)  # false for NaN
                yield ids.take(pa.array(rows[fine])), np.floor(SCALE * block[fine]).astype(np.int64) + SHIFT


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n, from exact whole parts: S = q n + r, so x - S/n = (x - q) - r/n."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return (x - whole).astype(float) - np.array([(s % n) / n for s in sums])


def sums_by_length(rows: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Number of rows and exact sums for each length of vectors."""
    schema = pa.schema([("length", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches):
            # Sums of a block fit: LARGEST times SCALE times its rows is under 2**55.
            size = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)),
                                              pa.array(np.full(size, len(x), np.int64)), pa.array(x.sum(axis=0))], schema=schema)

    got = (rows.mapInArrow(add, "length int, place int, n bigint, total bigint").groupBy("length", "place")
           .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    # Only the length that most rows have is of use.
    best = got.where(F.col("place") == 0).orderBy(F.desc("n"), F.desc("length")).limit(1).select("length").collect()
    if not best or not best[0][0]:
        return {}
    told = sorted(got.where(F.col("length") == best[0][0]).collect(), key=lambda r: r.place)
    return {best[0][0]: (told[0].n, tuple(int(r.total) for r in told))}


def products(rows: DataFrame, fit: Fit, whitened: bool = False) -> np.ndarray:
    """The covariance of the centred vectors, or of what whitening makes of them: products added up in each task, then over the cluster."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, fit.length):
            y = _centred(x, fit.n, fit.sums)
            if whitened:
                y = y @ fit.vectors / np.sqrt(fit.values)
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], schema=schema)

    size = len(fit.values) if whitened else fit.length
    out = np.zeros((size, size))
    for r in rows.mapInArrow(multiply, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.total / fit.n
    return out


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))


def fit_whitening(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """Three passes over all rows: sums, covariance, and that of the whitened rows.  Null if no row takes part."""
    rows = _vectors(table, id_col, vector_col)
    known = sums_by_length(rows)
    if not known:
        return None
    length, (n, sums) = next(iter(known.items()))
    bare = Fit(length, n, sums, np.zeros(0), np.zeros((length, 0)), 0.0)
    v = products(rows, bare)
    values, vectors = leading_components(v, components)
    # Variances that rounding alone may have made count as zero.
    sound = values > length * 1e-13 * values.max(initial=0.0)
    found = Fit(length, n, sums, values[sound], vectors[:, sound], float(np.trace(v)))
    if not len(found.values):
        return found
    error = float(np.abs(products(rows, found, whitened=True) - np.eye(len(found.values))).max())
    return Fit(length, n, sums, found.values, found.vectors, found.trace, error)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - S)², exact."""
    most = max(max(abs(n * int(x[:, k].max()) - s), abs(n * int(x[:, k].min()) - s)) for k, s in enumerate(sums)) if len(x) else 0
    if most * most * len(sums) < 2**63:
        far = n * (x - np.array([s // n for s in sums], dtype=np.int64)) - np.array([s % n for s in sums], dtype=np.int64)
        return (far * far).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


def whitened(table: DataFrame, fit: Fit | None, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each component: id, component (from 1), n, deviation, whitened, explained and identity_error."""
    kind = table.schema[id_col].dataType
    layout = f"`{id_col}` {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if fit is None or not len(fit.values):
            return
        k = len(fit.values)
        for ids, x in _blocks(batches, fit.length):
            y = _centred(x, fit.n, fit.sums) @ fit.vectors / np.sqrt(fit.values)
            m, rows = len(x), np.repeat(np.arange(len(x)), k)
            deviations = pa.array(_deviations(x, fit.n, fit.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n, np.int64)),
                 deviations.take(pa.array(rows)), pa.array(y.ravel()), pa.array(np.tile(fit.values / fit.trace, m)), pa.array(np.full(m * k, fit.identity_error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _vectors(table, id_col, vector_col).mapInArrow(project, layout)
