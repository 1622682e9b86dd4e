"""Whitening of embeddings: principal components of the distinct quantised vectors.

An entry c of a vector becomes the integer floor(``scale`` * c). The components are fitted on
the list of distinct integer vectors, each once, so thousands of copies of a vector do not
turn the axes. Four passes over tables that Spark deals out:

1. rows become compact integer vectors, and copies are combined before the one shuffle;
2. number, sums, least and largest values per dimension, exact;
3. the scatter matrix of the centred vectors: every task adds up its own matrix, rows of the
   matrices are dealt by row number and added, and one matrix of dimensions x dimensions
   is left, whatever the number of vectors;
4. every row is projected.

The scatter C is factored as C = L L' by a Cholesky with diagonal pivots, which also finds
its rank. One-sided Jacobi rotations then make the columns of L orthogonal (L J = U S), so
that C = U S^2 U': the squared norms of the rotated columns are the eigenvalues and the
columns divided by their norms the components. C itself is never diagonalised, and small
eigenvalues keep their relative precision.

Nulls: rows whose vector is null, is empty, or holds null, NaN or infinite entries are left
out. So are rows whose length differs from the most frequent one (of equally frequent ones
the longest), as no covariance is defined over them. Entries beyond 64 bits are held at
their ends. A null id keeps its rows; repeated rows stay. Components without variance are
not returned, so copies of a single vector give no rows, as an empty table does. Extra
columns are left out. The sign of a component makes its entry of the largest size positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgrain.session import stored

_TYPES = (np.int16, np.int32, np.int64)
_ENDS = np.iinfo(np.int64)


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c) as 64-bit integers; values beyond them are held at the ends."""
    x = np.floor(values.astype(np.float64) * scale)
    inside = np.abs(x) < 2.0**63
    return np.where(inside, np.where(inside, x, 0).astype(np.int64), np.where(x > 0, _ENDS.max, _ENDS.min))


def packed(x: np.ndarray) -> bytes:
    """A vector in the narrowest type that holds it, after that type's number."""
    for n, kind in enumerate(_TYPES):
        info = np.iinfo(kind)
        if x.min() >= info.min and x.max() <= info.max:
            return bytes([n]) + x.astype(kind).tobytes()
    raise AssertionError


def unpacked(values: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(v, _TYPES[v[0]], offset=1) for v in values], np.int64)


def vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """key, size and x (packed) of the rows whose vector has entries, all of them finite."""
    plain = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    schema = plain.select("key", F.lit(0).alias("size"), F.lit(b"").alias("x")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten()
            bad = flat.is_null().to_numpy(zero_copy_only=False) | ~np.isfinite(
                flat.fill_null(0).to_numpy(zero_copy_only=False)
            )
            sizes = np.array(column.value_lengths().fill_null(0))
            ends = np.cumsum(sizes)
            faults = np.concatenate([[0], np.cumsum(bad)])
            fine = (sizes > 0) & (faults[ends] == faults[ends - sizes])
            x = quantised(flat.fill_null(0).to_numpy(zero_copy_only=False)[~np.repeat(~fine, sizes)], scale)
            ends = np.cumsum(sizes[fine])
            made = [packed(x[b - n : b]) for b, n in zip(ends.tolist(), sizes[fine].tolist())]
            kept = batch.column(0).filter(pa.array(fine))
            columns = [kept, pa.array(sizes[fine].astype(np.int32)), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return plain.mapInArrow(run, schema)


@dataclass(frozen=True)
class Moments:
    """Exact figures of the fit list: number of vectors, and per dimension sum and range."""

    n: int
    sums: list[int]
    least: list[int]
    most: list[int]

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def in_long(self) -> bool:
        """Whether no deviation can leave 64 bits."""
        wide = [max(abs(self.n * a - s), abs(self.n * b - s)) for s, a, b in zip(self.sums, self.least, self.most)]
        return sum(w * w for w in wide) < 2**63


def moments(fit: DataFrame) -> Moments:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpacked(batch.column(0).to_pylist())
            # Sums of halves of 32 bits stay within 64 bits for two billion rows of a batch.
            sums = [(int(a) << 32) + int(b) for a, b in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
            a, b = x.min(0), x.max(0)
            n += len(x)
            total = sums if total is None else [p + q for p, q in zip(total, sums)]
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        if n:
            # Decimal text: a sum may need more than 64 bits.
            columns = [np.arange(len(total), dtype=np.int32), [n] * len(total), list(map(str, total)), low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "n", "total", "low", "high"])

    found = (
        fit.select("x")
        .mapInArrow(run, "dim int, n long, total string, low long, high long")
        .groupBy("dim")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
        .orderBy("dim")
        .collect()  # one row per dimension
    )
    columns = [[int(r[c]) for r in found] for c in ("total", "low", "high")]
    return Moments(found[0]["n"] if found else 0, *columns)


def summed_outer(rows: DataFrame, size: int, made) -> np.ndarray:
    """Sum of the matrices (``size`` x ``size``) that ``made`` gives for arrays of vectors.

    A task adds up one matrix of its own. The matrices meet row by row, each row in one
    place; the driver gets ``size`` rows.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                total += made(unpacked(batch.column(0).to_pylist()))
        yield _matrix_rows(range(size), total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[i] = held.get(i, 0) + row.values.to_numpy()
        yield _matrix_rows(held, np.array([*held.values()]).reshape(len(held), size))

    schema = "i int, v array<double>"
    met = rows.select("x").mapInArrow(own, schema).repartition("i").mapInArrow(add, schema)
    matrix = np.zeros((size, size))
    for r in met.collect():
        matrix[r["i"]] = r["v"]
    return matrix


def _matrix_rows(numbers, matrix: np.ndarray) -> pa.RecordBatch:
    rows = pa.ListArray.from_arrays(
        pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel())
    )
    return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.int32()), rows], names=["i", "v"])


def pivoted_cholesky(c: np.ndarray) -> np.ndarray:
    """L (rows in the order of ``c``, a column for each step) with L L' = c.

    The largest remaining diagonal entry is the next pivot. It ends when what remains is
    rounding, so there are as many columns as the matrix has rank.
    """
    rest, size = c.astype(np.float64).copy(), len(c)
    columns: list[np.ndarray] = []
    bound = size * np.finfo(np.float64).eps * (np.diag(c).max() if size else 0.0)
    for _ in range(size):
        diagonal = np.diag(rest)
        p = int(np.argmax(diagonal))
        if diagonal[p] <= bound:
            break
        column = rest[:, p] / np.sqrt(diagonal[p])
        columns.append(column)
        rest -= np.outer(column, column)
        rest[p, :] = rest[:, p] = 0
    return np.stack(columns, 1) if columns else np.zeros((size, 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` rotated from the right until its columns are orthogonal, largest first.

    Pairs of columns are taken in rounds of a tournament, in which all pairs are disjoint,
    so a round is a few operations on arrays. It ends after a sweep without rotations.
    """
    a = factor.copy()
    n = a.shape[1]
    players = list(range(n + n % 2))
    eps = np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(max(len(players) - 1, 0)):
            half = len(players) // 2
            pairs = [(i, j) for i, j in zip(players[:half], players[half:][::-1]) if i < n and j < n]
            players = [players[0], players[-1], *players[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            todo = np.abs(xy) > eps * np.sqrt(xx * yy)
            if not todo.any():
                continue
            turned = True
            i, j, x, y = i[todo], j[todo], x[:, todo], y[:, todo]
            zeta = (yy[todo] - xx[todo]) / (2 * xy[todo])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.hypot(1, t)
            a[:, i], a[:, j] = cos * (x - t * y), cos * (y + t * x)
        if not turned:
            break
    order = np.argsort(-(a * a).sum(0), kind="stable")
    return a[:, order]


@dataclass(frozen=True)
class Whitening:
    """``axes`` has a column per component; ``eigenvalues`` and ``trace`` are those of the covariance."""

    moments: Moments
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.moments.centre) @ self.axes / np.sqrt(self.eigenvalues)


def fit(rows: DataFrame, components: int = 4) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors of ``vectors``, and the rows it holds for."""
    sizes = rows.groupBy("size").agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if usual is None:
        return None, rows
    size = usual["size"]
    alike = rows.where(F.col("size") == size)
    distinct = stored(alike.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "vectors")
    found = moments(distinct)
    centre = found.centre

    def scatter(x: np.ndarray) -> np.ndarray:
        d = x - centre
        return d.T @ d

    c = summed_outer(distinct, size, scatter)
    turned = one_sided_jacobi(pivoted_cholesky(c))
    norms = (turned * turned).sum(0)
    real = norms > size * np.finfo(np.float64).eps * norms.max(initial=0)
    axes = (turned[:, real] / np.sqrt(norms[real]))[:, :components]
    if not axes.shape[1]:
        return None, alike
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    eigenvalues = norms[real][:components] / found.n
    held = Whitening(found, axes, eigenvalues, float(np.trace(c)) / found.n, 0.0)

    def squares(x: np.ndarray) -> np.ndarray:
        """Products of the whitened values, which are centred, and their sums."""
        w = held.project(x)
        w = np.hstack([w, np.ones((len(w), 1))])
        return w.T @ w

    m = summed_outer(distinct, axes.shape[1] + 1, squares)
    mean = m[-1, :-1] / found.n
    error = np.abs(m[:-1, :-1] / found.n - np.outer(mean, mean) - np.eye(len(mean))).max()
    return Whitening(found, axes, eigenvalues, held.trace, float(error)), alike


_OUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(
    rows: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """A row for each remaining row of ``rows`` and component.

    ``deviation`` is the exact sum over the dimensions of (n x - S)^2, null beyond 38 digits.
    """
    made = stored(vectors(rows, key, vector, scale), "quantised")
    model, alike = fit(made, components)
    kind = rows.select(F.col(key).alias(key)).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, {_OUT}"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # dimensions x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        of = held.moments
        sums, short = np.array(of.sums, object), of.in_long()
        k = len(held.eigenvalues)
        explained = held.eigenvalues / held.trace
        for batch in batches:
            rows_ = batch.num_rows
            if not rows_:
                continue
            x = unpacked(batch.column(1).to_pylist())
            if short:
                d = of.n * x - sums.astype(np.int64)
                deviation = (d * d).sum(1).tolist()
            else:  # beyond 64 bits: Python's integers
                d = of.n * x.astype(object) - sums
                deviation = [v if v < 10**38 else None for v in (d * d).sum(1)]
            again = np.repeat(np.arange(rows_), k)
            exact = pa.array([None if v is None else str(v) for v in deviation], pa.string()).cast(pa.decimal128(38, 0))
            columns = [
                batch.column(0).take(pa.array(again)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)),
                pa.array(np.full(rows_ * k, of.n)),
                exact.take(pa.array(again)),
                pa.array(held.project(x).ravel()),
                pa.array(np.tile(explained, rows_)),
                pa.array(np.full(rows_ * k, held.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, *(c.split()[0] for c in _OUT.split(", "))]
    return alike.select("key", "x").mapInArrow(run, schema)
