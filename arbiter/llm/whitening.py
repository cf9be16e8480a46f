"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Entries become integers, so that sums and the scatter about the (rounded)
mean are exact whatever the order of the tasks; the fit list has every distinct
vector once.  Only the d x d covariance reaches the driver: its pivoted Cholesky
factor L (V = P L L' P') is rotated by one-sided Jacobi until its columns are
orthogonal.  Their squared norms are the eigenvalues of V, the normalised
columns its components; V itself is never rotated, so small eigenvalues keep
their relative accuracy.

A vector counts as equal to another by its integers, so a group of copies adds
one row to the shuffle per task, and one to the fit list.

Edge cases: rows whose vector is null, or holds nulls, entries that are not
finite or too large for a long, are dropped; so are vectors whose length is not
the most common one of the fit list (ties: the longest); rows with a null id and
repeated rows stay; components without variance are left out, so an empty
table, a single vector or empty vectors give no components and no rows;
``deviation`` is null where it does not fit a long (``deviation_exact`` holds
it as a decimal, null over 38 digits); the input's columns are packed in one
struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.llm.common import written
from arbiter.llm.vectors import product, scaled, size_of

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows whose products are summed at once.
ROWS = 4096
_EXACT = pa.decimal128(38, 0)
MOST = 10**38


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L L'; the largest remaining diagonal entry is the next pivot, L stops where none is left."""
    a, d = v.copy(), len(v)
    order = np.arange(d)
    factor = np.zeros((d, d))
    least = d * np.finfo(float).eps * max(float(np.diag(a).max(initial=0.0)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if not a[p, p] > least:
            return factor[:, :k], order
        for m in (a, factor):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(columns: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns rotated in pairs until all are orthogonal; a sweep meets every pair once, disjoint pairs together."""
    x = columns.copy()
    n = x.shape[1]
    seats = np.arange(n + n % 2)  # a tournament: the first seat stays, the others move on
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            real = (p < n) & (q < n)
            p, q = p[real], q[real]
            a, b, c = ((x[:, i] * x[:, j]).sum(axis=0) for i, j in ((p, p), (q, q), (p, q)))
            turn = np.abs(c) > 1e-16 * np.sqrt(a * b)
            if turn.any():
                p, q, a, b, c = p[turn], q[turn], a[turn], b[turn], c[turn]
                turned |= bool((np.abs(c) > 4 * np.finfo(float).eps * np.sqrt(a * b)).any())
                zeta = (b - a) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                sin = cos * t
                x[:, p], x[:, q] = cos * x[:, p] - sin * x[:, q], sin * x[:, p] + cos * x[:, q]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    return x


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of a covariance, the largest first; directions without variance are left out."""
    factor, order = pivoted_cholesky(v)
    rotated = np.zeros_like(factor)
    rotated[order] = one_sided_jacobi(factor)
    norms = np.sqrt((rotated**2).sum(axis=0))
    by = np.argsort(-norms, kind="stable")
    components = rotated[:, by] / norms[by]
    largest = np.abs(components).argmax(axis=0) if components.size else np.zeros(0, int)
    return norms[by] ** 2, components * np.sign(components[largest, np.arange(components.shape[1])])


@dataclass
class Basis:
    """What the fit list says: n vectors with sums ``s``, their covariance's components and eigenvalues."""

    n: int
    s: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def middle(self) -> np.ndarray:
        """The rounded-down mean, and what sums exceed it by."""
        return np.array([s // self.n for s in self.s], np.int64)

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        """Rows of integers centred, projected on the first ``k`` components and divided by their deviations."""
        middle = self.middle
        rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.s, middle, strict=True)])
        return ((x - middle) - rest) @ self.components[:, :k] / np.sqrt(self.values[:k])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the sum over dimensions of (n * x - s)^2, exact."""
        middle = self.middle
        rest = np.array([s - self.n * int(m) for s, m in zip(self.s, middle, strict=True)], object)
        y = x - middle
        if self.n * (size_of(y) + 1) < 1 << 52 and x.shape[1] <= 256:
            v = y * self.n - rest.astype(np.int64)
            high, low = v >> 26, v & ((1 << 26) - 1)
            parts = ((h * o).sum(axis=1).tolist() for h, o in ((high, high), (high, low), (low, low)))
            return [(a << 52) + (b << 27) + c for a, b, c in zip(*parts, strict=True)]
        return [int(r) for r in ((y.astype(object) * self.n - rest) ** 2).sum(axis=1)]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Packed rows of ``d`` longs."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, d)


def _summed(fit: DataFrame, d: int, add) -> dict[tuple[int, int], int]:
    """{(i, j): sum} over the fit list of the integer matrices that ``add`` makes of its rows; one set of sums a task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = add(_matrix(batch.column("x").slice(a, ROWS), d)).astype(object)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            found = pa.array([Decimal(int(v)) for v in total.ravel()], _EXACT)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), found], ["i", "j", "v"])

    found = fit.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    return {(r.i, r.j): int(r.v) for r in found.collect()}


def distinct_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """(x, d): each distinct integer vector once, packed as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths, values = scaled(batch.column(0), SCALE)
            packed = (values + SHIFT).tobytes()
            ends = np.cumsum(lengths) * 8
            found = [packed[b - n : b] for b, n in zip(ends.tolist(), (lengths * 8).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(lengths, pa.int32())], ["x", "d"])

    return rows.select(F.col(f"`{vector_col}`").cast("array<double>").alias("v")).mapInArrow(run, "x binary, d int").distinct()


def fit_basis(rows: DataFrame, vector_col: str) -> tuple[Basis | None, int]:
    """The basis of all distinct vectors of the most common length, and this length."""
    fit = written(distinct_vectors(rows, vector_col), "whiten-fit")
    common = fit.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not common or not common[0].d:
        return None, 0
    d, n = common[0].d, common[0]["count"]
    fit = fit.where(F.col("d") == d)
    sums = _summed(fit, d, lambda x: product(np.ones((1, len(x)), np.int64), x))
    s = [sums[0, i] for i in range(d)]
    middle = np.array([v // n for v in s], np.int64)
    scatter = _summed(fit, d, lambda x: product((x - middle).T, x - middle))
    rest = [v - n * int(m) for v, m in zip(s, middle, strict=True)]
    # n^2 times the covariance, as whole numbers; only the division rounds.
    v = np.array([[(n * scatter[i, j] - rest[i] * rest[j]) / n**2 for j in range(d)] for i in range(d)])
    values, components = eigen(v)
    total = sum(n * scatter[i, i] - rest[i] ** 2 for i in range(d)) / n**2
    basis = Basis(n, s, values, components, values / total if total else values)
    k = min(COMPONENTS, len(values))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                w = basis.whitened(_matrix(batch.column("x").slice(a, ROWS), d), k)
                total += np.concatenate([w.T @ w, w.sum(axis=0)[None]])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    if k:
        found = np.zeros((k + 1, k))
        for r in fit.select("x").mapInArrow(squares, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            found[r.i, r.j] = r.v
        mean = found[k] / n
        basis.identity_error = float(np.abs(found[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return basis, d


def whiten(rows: DataFrame, vector_col: str = "embedding", payload: Column | None = None, n_components: int = COMPONENTS) -> DataFrame:
    """(row, n, deviation, deviation_exact, whitened, explained, identity_error); ``whitened`` and ``explained`` are arrays by component."""
    payload = payload if payload is not None else F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    basis, d = fit_basis(rows, vector_col)
    k = min(n_components, len(basis.values)) if basis else 0
    table = rows.select(payload.alias("row"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fields = [("n", T.LongType()), ("deviation", T.LongType()), ("deviation_exact", T.DecimalType(38, 0)), ("whitened", T.ArrayType(T.DoubleType())), ("explained", T.ArrayType(T.DoubleType())), ("identity_error", T.DoubleType())]
    schema = T.StructType([table.schema["row"], *(T.StructField(c, t) for c, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                row, lengths, values = scaled(batch.column("v"), SCALE)
                fits = lengths == d
                x = values[np.repeat(fits, lengths)].reshape(-1, d) + SHIFT
                deviation = basis.deviations(x)
                w = pa.array(basis.whitened(x, k).ravel())
                edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
                columns = [batch.column("row").take(pa.array(row[fits])), pa.array([basis.n] * len(x), pa.int64())]
                columns += [pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()), pa.array([Decimal(v) if v < MOST else None for v in deviation], _EXACT)]
                columns += [pa.ListArray.from_arrays(edges, w), pa.ListArray.from_arrays(edges, pa.array(np.tile(basis.explained[:k], len(x)))), pa.array([basis.identity_error] * len(x), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return table.mapInArrow(run, schema) if k else rows.sparkSession.createDataFrame([], schema)


def op12_whiten(spark, sf_dir: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), payload=F.struct("vec_id"))
    each = found.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(
        "row.vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error", "deviation_exact"
    )
