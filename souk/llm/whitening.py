"""Embedding whitening: principal components of long coordinates.

A component c of a vector becomes the long x = floor(scale * c) + shift. The
covariance V of the x-vectors is gathered in passes over the table, each of
which leaves one small partial result per task: counts and exact sums first,
then the scatter of the centred vectors, d(d+1)/2 numbers for d dimensions.
Sums are exact, so x - S/n is centred without cancellation before anything
is multiplied.

On the driver, the scatter A is factored once as P' A P = L L' by Cholesky
with diagonal pivoting (it stops where the rest is rounding, which gives the
rank), and one-sided Jacobi turns the columns of L against each other until
they are orthogonal: L J = U Z, hence A = U Z^2 U'. The squared column norms
are the eigenvalues, the normalised columns the components; the products
L'L, whose squared condition would cost half the digits, are never formed.
Only d^2 numbers reach the driver, whatever the number of rows.

A last pass before the result measures the covariance of the whitened
coordinates themselves: ``identity_error`` is its largest distance from the
identity.

Defined results: rows whose vector is null, empty, or holds null or
non-finite entries are dropped; of vectors of different lengths, those of
the most frequent length take part (ties: the longer). Null ids and repeated
rows are kept, each row its own. Entries of 2^42 or more in size count as
2^42. Components without variance (rank below the number asked for, equal
vectors, a single row) are not returned, so a table of equal vectors gives no
row, nor does an empty one. A ``deviation`` beyond a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import slices, staged

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
# Rows that a task holds as numbers at once.
BLOCK = 4096
_LOW = 26
_MOST = float(2**52)


# --- the factorisation (d x d, on the driver) ---------------------------------


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (d x rank) with L L' = a; rows in the order of ``a``, triangular in the
    order of the pivots."""
    d = len(a)
    rest = np.diag(a).astype(np.float64).copy()
    least = d * np.finfo(np.float64).eps * max(rest.max(initial=0.0), 0.0)
    factor = np.zeros((d, d))
    free = np.ones(d, bool)
    for k in range(d):
        pivot = int(np.argmax(np.where(free, rest, -np.inf)))
        if not rest[pivot] > least:
            return factor[:, :k]
        column = np.where(free, a[:, pivot] - factor[:, :k] @ factor[pivot, :k], 0.0)
        factor[:, k] = column / np.sqrt(rest[pivot])
        factor[pivot, k] = np.sqrt(rest[pivot])
        free[pivot] = False
        rest = rest - factor[:, k] ** 2
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues of factor factor', falling; unit eigenvectors as columns).

    A round turns disjoint pairs of columns at once (round-robin pairing); a
    sweep of rounds meets every pair. It ends after a sweep without a turn."""
    u = factor.copy()
    m = u.shape[1]
    ring = np.arange(m + m % 2)
    tolerance = np.finfo(np.float64).eps * np.sqrt(max(len(u), 1))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            real = (p < m) & (q < m)
            p, q = p[real], q[real]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            left, right = u[:, p], u[:, q]
            alpha, beta = (left**2).sum(0), (right**2).sum(0)
            gamma = (left * right).sum(0)
            turn = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            safe = np.where(turn, gamma, 1.0)
            zeta = (beta - alpha) / (2.0 * safe)
            tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            tangent = np.where(turn, tangent, 0.0)
            cosine = 1.0 / np.hypot(1.0, tangent)
            sine = cosine * tangent
            u[:, p], u[:, q] = cosine * left - sine * right, sine * left + cosine * right
        if not turned:
            break
    norms = np.sqrt((u**2).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, u[:, order] / norms[order]


# --- vectors in tasks ----------------------------------------------------------


def usable(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors as double) for each length among the rows that
    take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    whole = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    out = []
    for d in np.unique(lengths[whole]):
        at = np.flatnonzero(whole & (lengths == d))
        out.append((at, flat[(ends[at] - d)[:, None] + np.arange(d)]))
    return out


def coordinates(vectors: np.ndarray, scale: float, shift: int) -> np.ndarray:
    return np.clip(np.floor(scale * vectors), -_MOST, _MOST).astype(np.int64) + shift


@dataclass
class Whitening:
    """A fitted whitening: ``n`` vectors, exact sums, components as columns."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    scale: float
    shift: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S)^2 of each row, None beyond a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        near = x - whole
        size = np.abs(near).astype(np.float64)
        small = ((self.n * (size + 1.0)) ** 2).sum(axis=1) < 2.0**62
        large = ((self.n * np.maximum(size - 1.0, 0.0)) ** 2).sum(axis=1) > 2.0**64
        out = (((self.n * near[small] - rest) ** 2).sum(axis=1)).tolist()
        result: list[int | None] = [None] * len(x)
        for i, v in zip(np.flatnonzero(small), out):
            result[i] = v
        for i in np.flatnonzero(~small & ~large):
            exact = sum((self.n * int(v) - r) ** 2 for v, r in zip(near[i].tolist(), rest.tolist()))
            result[i] = exact if exact < 2**63 else None
        return result


def _blocks(batches, length: int | None, scale: float, shift: int):
    """(record batch, row numbers, coordinates), a block of rows at a time."""
    for batch in slices(batches, BLOCK):
        for at, vectors in usable(batch.column("_vector")):
            if length is None or vectors.shape[1] == length:
                yield batch, at, coordinates(vectors, scale, shift)


# --- passes --------------------------------------------------------------------


def _sums(rows: DataFrame, scale: float, shift: int) -> tuple[int, list[int]]:
    """(n, exact sum of each dimension) of the most frequent length."""

    def run(batches):
        found: dict[int, list] = {}
        for _, at, x in _blocks(batches, None, scale, shift):
            high, low = x >> _LOW, x & ((1 << _LOW) - 1)  # neither sum overflows
            n, highs, lows = found.get(x.shape[1], (0, 0, 0))
            found[x.shape[1]] = (n + len(at), highs + high.sum(0), lows + low.sum(0))
        for d, (n, highs, lows) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int64()), pa.array(range(d), pa.int64()),
                 pa.array([n] * d, pa.int64()), pa.array(highs), pa.array(lows)],
                names=["length", "dim", "n", "high", "low"],
            )

    parts = rows.select("_vector").mapInArrow(run, "length long, dim long, n long, high long, low long")
    total = staged(
        parts.groupBy("length", "dim").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))), "whiten-sums"
    )
    most = total.filter("dim = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if most is None:
        return 0, []
    chosen = total.filter(F.col("length") == most["length"]).orderBy("dim").collect()  # one row per dimension
    return most["n"], [(r["high"] << _LOW) + r["low"] for r in chosen]


def _products(rows: DataFrame, model: Whitening, values) -> np.ndarray:
    """Sum over all vectors of v v', v = ``values`` of the coordinates."""
    length = len(model.sums)

    def run(batches):
        total = None
        for _, _, x in _blocks(batches, length, model.scale, model.shift):
            v = values(x)
            total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                names=["i", "j", "v"],
            )

    parts = rows.select("_vector").mapInArrow(run, "i int, j int, v double")
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # d (d + 1) / 2
    out = np.zeros((max((r["j"] for r in found), default=-1) + 1,) * 2)
    for r in found:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def fit(rows: DataFrame, vector_col: str, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of all rows that take part; None if there is none."""
    rows = rows.select(F.col(vector_col).alias("_vector"))
    n, sums = _sums(rows, scale, shift)
    if not n:
        return None
    d = len(sums)
    model = Whitening(n, sums, np.ones(d), np.eye(d), 0.0, scale, shift)
    scatter = _products(rows, model, model.centred)
    values, vectors = one_sided_jacobi(pivoted_cholesky(scatter))
    model.eigenvalues, model.components = values[:components] / n, vectors[:, :components]
    model.trace = float(np.trace(scatter)) / n
    return model


def identity_error(rows: DataFrame, model: Whitening, vector_col: str) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the
    identity, measured over the table."""
    rows = rows.select(F.col(vector_col).alias("_vector"))

    def values(x):  # the ones gather the sums beside the products
        return np.column_stack([model.whitened(x), np.ones(len(x))])

    total = _products(rows, model, values) / model.n
    mean = total[-1, :-1]
    return float(np.abs(total[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))


def apply(rows: DataFrame, model: Whitening | None, id_col: str, vector_col: str, error: float = 0.0) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one
    row for each row that takes part and each component."""
    rows = rows.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).alias("_vector"))
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k = 0 if model is None else len(model.eigenvalues)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few vectors

    def run(batches):
        fitted = shared.value
        share = fitted.eigenvalues / fitted.trace
        for batch, at, x in _blocks(batches, len(fitted.sums), fitted.scale, fitted.shift):
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fitted.n, np.int64)),
                    pa.array(fitted.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(fitted.whitened(x).ravel()),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=names,
            )

    return rows.mapInArrow(run, schema)


def whiten(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    scale: float = SCALE,
    shift: int = SHIFT,
) -> DataFrame:
    """Fit over all rows, then ``apply``; equal for all rows since the
    components are computed once."""
    model = fit(rows, vector_col, components, scale, shift)
    error = identity_error(rows, model, vector_col) if model and len(model.eigenvalues) else 0.0
    return apply(rows, model, id_col, vector_col, error)
