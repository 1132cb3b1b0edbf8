"""Embedding whitening with components from spectral divide and conquer over QDWH polar decompositions.

A vector's entries become the long values floor(scale * c) + offset. The fit list holds each distinct vector of them once, so that
copies weigh nothing. Spark adds up its sums, then its covariance: every task keeps one matrix of merged centred moments, matrix
rows are merged by their number, and the driver gets a d x d matrix. There the polar factor of the shifted covariance gives the
projector on the eigenvalues above the shift; the two invariant subspaces are split again until each has one dimension. The
components (d x ``components`` numbers) go to the tasks, which whiten every row.

Rows whose vector is null or holds null, infinite or NaN entries take no part; nor do those whose length is not the commonest of the
fit list (of equally common lengths the longer counts). Each remaining row, repeated ids and null ids included, gives a row per
component. Components with an eigenvalue of zero to working precision are left out: a table with fewer than two different vectors
gives no rows. Entries, sums and deviations beyond 64 bits raise an error. A component's largest entry is positive. Other columns
are not read. Work on the driver grows with the dimension alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import staged
from tapeloom.runtime import ship

EPS = float(np.finfo(float).eps)
MOMENTS = "i int, n long, mean array<double>, scatter array<double>"


class SingularShift(ArithmeticError):
    """The shift meets an eigenvalue, so that the polar factor has no definite sign there."""


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the dynamically weighted Halley iteration (QDWH)."""
    d = len(a)
    eye = np.eye(d)
    x = a / np.linalg.norm(a)
    r = np.linalg.qr(x, mode="r")
    if not np.abs(np.diag(r)).min() > EPS:
        raise SingularShift
    low = min(1.0, 1 / (np.linalg.norm(np.linalg.inv(r), 1) * np.sqrt(d)))  # at most the least singular value of x
    for _ in range(30):
        square = low * low
        part = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + part)
        wa = root + np.sqrt(8 - 4 * part + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        before = x
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:d] @ q[d:].T)
        else:
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if np.linalg.norm(x - before) <= (5 * EPS) ** (1 / 3) and 1 - low <= 10 * EPS:
            return x
    return x


def _split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvalues above and below ``shift``; None if all are on one side."""
    d = len(a)
    above = (polar_factor(a - shift * np.eye(d)) + np.eye(d)) / 2
    if np.linalg.norm(above @ above - above) > 1e-10 * d:
        raise SingularShift
    k = round(float(np.trace(above)))
    if not 0 < k < d:
        return None
    upper, _ = np.linalg.qr(above @ rng.normal(size=(d, k)))
    upper, _ = np.linalg.qr(above @ upper)
    rest = rng.normal(size=(d, d - k))
    for _ in range(2):
        rest = rest - above @ rest
        rest, _ = np.linalg.qr(rest - upper @ (upper.T @ rest))
    return upper, rest


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    d = len(a)
    rng = np.random.default_rng(0)
    size = float(np.linalg.norm(a)) or 1.0
    parts, todo = [], [np.eye(d)] if d else []
    while todo:
        basis = todo.pop()
        block = basis.T @ a @ basis
        block = (block + block.T) / 2
        k = len(block)
        mean = float(np.trace(block)) / k
        spread = float(np.linalg.norm(block - mean * np.eye(k)))
        if k == 1 or spread <= 4 * EPS * size:
            parts.append(basis)  # one eigenvalue, or equal ones, for which any basis will do
            continue
        # Eigenvalues that are not all equal lie on both sides of their mean.
        shifts = [float(np.median(np.diag(block))), mean, *(mean + s * spread * 10.0**-e for e in (4, 3, 2, 6, 8) for s in (1, -1) if k > 1)]
        halves = None
        for shift in shifts:
            try:
                halves = _split(block, shift, rng)
            except (SingularShift, np.linalg.LinAlgError):
                continue
            if halves:
                break
        if halves is None:
            parts.append(basis)
            continue
        todo += [basis @ halves[1], basis @ halves[0]]
    vectors, _ = np.linalg.qr(np.hstack(parts)) if parts else (np.zeros((0, 0)), None)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    return values[order], vectors * np.where(vectors[top, np.arange(d)] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """Count and sums of the fit list, and its leading components."""

    n: int
    sums: list[int]
    components: np.ndarray  # d x k
    values: np.ndarray
    explained: np.ndarray
    scale: int
    offset: int
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: long values where they fit, Python integers elsewhere."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if most < 2**61:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S) squared, exact."""
        y = self.centred(x)
        if y.size and max(abs(int(y.max())), abs(int(y.min()))) ** 2 * y.shape[1] >= 2**62:
            y = y.astype(object)
        return (y * y).sum(axis=1)

    def differences(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.differences(x) @ (self.components / np.sqrt(self.values))


def integers(vectors: DataFrame, vector_col: str, scale: int, offset: int, *kept) -> DataFrame:
    """Columns ``kept`` and x of the rows whose vector is whole and finite."""
    def finite(c):
        return F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))  # NaN is above infinity

    vector = F.col(vector_col)
    rows = vectors.where(vector.isNotNull() & F.forall(vector, finite))
    return rows.select(*kept, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(offset)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _merge(a: tuple, b: tuple) -> tuple:
    """Merged (n, mean, scatter) of two sets; a scatter is the whole matrix or, with its number as fourth, one row of it."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    across = np.outer(gap, gap) if a[2].ndim == 2 else gap[a[3]] * gap
    return (n, a[1] + gap * (b[0] / n), a[2] + b[2] + across * (a[0] * b[0] / n), *a[3:])


def moments(fit: DataFrame, values: Callable[[np.ndarray], np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (divisor n, centred before multiplying) of ``values`` over the rows of ``fit``."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in it:
            if batch.num_rows:
                x = values(_matrix(batch.column(0)))
                mean = x.mean(axis=0)
                one = (len(x), mean, (x - mean).T @ (x - mean))
                held = one if held is None else _merge(held, one)
        if held:
            n, mean, scatter = held
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "n": pa.array([n] * size, pa.int64()),
                                              "mean": [mean] * size, "scatter": list(scatter)})

    def combine(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in it:
            for i, n, mean, row in zip(*(c.to_pylist() for c in batch.columns)):
                one = (n, np.array(mean), np.array(row), i)
                held[i] = _merge(held[i], one) if i in held else one
        if held:
            yield pa.RecordBatch.from_pydict({"i": pa.array(held, pa.int32()), "n": pa.array([v[0] for v in held.values()], pa.int64()),
                                              "mean": [v[1] for v in held.values()], "scatter": [v[2] for v in held.values()]})

    rows = sorted(fit.mapInArrow(partial, MOMENTS).repartition("i").mapInArrow(combine, MOMENTS).collect())
    return np.array(rows[0]["mean"]), np.array([r["scatter"] for r in rows]) / rows[0]["n"]


def fit(vectors: DataFrame, vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000, components: int = 16) -> Whitening:
    """The components of the distinct vectors of ``vectors``."""
    ship(vectors.sparkSession)
    listed = staged(integers(vectors, vector_col, scale, offset).distinct(), "fit-list")
    lengths = listed.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths or lengths[0]["d"] == 0:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), scale, offset)
    d, n = lengths[0]
    listed = listed.where(F.size("x") == d)
    sums = listed.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    model = Whitening(n, [r["s"] for r in sums], np.zeros((d, 0)), np.zeros(0), np.zeros(0), scale, offset)
    _, covariance = moments(listed, model.differences, d)
    values, found = eigen(covariance)
    k = min(components, int((values > d * EPS * max(values[0], 0.0)).sum()))
    model.components, model.values = found[:, :k], values[:k]
    model.explained = values[:k] / np.trace(covariance) if k else np.zeros(0)
    if k:
        _, again = moments(listed, model.whitened, k)
        model.identity_error = float(np.abs(again - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    ship(vectors.sparkSession)
    d, k = model.components.shape
    rows = integers(vectors, vector_col, model.scale, model.offset, F.col(id_col).alias("id")).where((F.size("x") == d) & F.lit(k > 0))
    id_type = rows.schema["id"].dataType.simpleString()
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1))
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                       pa.array(np.full(m * k, model.n, np.int64)), pa.array([int(v) for v in np.repeat(model.deviations(x), k)], pa.int64()),
                       pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
