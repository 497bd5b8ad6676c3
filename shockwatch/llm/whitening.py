"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Vectors are put on a grid of ``scale`` steps a unit (x = floor(scale * c), a long), the fit is made on
every different grid vector once, and all sums that fix it are distributed:

* mean: exact integer sums per dimension;
* scatter: every task multiplies blocks of centred rows, the tasks' matrices are added up in Spark,
  and only the sum, dimensions^2 numbers whatever the rows, comes to the driver;
* scatter = L L' by Cholesky with diagonal pivoting; a dimension of which only rounding is left ends there;
  rotations then make the columns of L itself orthogonal (never a product of it, so small eigenvalues
  keep their digits): norms^2 are eigenvalues of the scatter, columns over norms the components;
* the whitened fit list is read once more, and its covariance held against the identity.

Defined cases: rows with a null vector or a null or non-finite entry are dropped, as are vectors with
another number of dimensions than most (the larger number on a tie) and empty ones; zero vectors,
repeated rows and null ids stay; entries beyond the range of a long are put to its end; directions
without variance are no components, so a table with one different vector gives an empty result, as an
empty table does; the sign of a component makes its largest entry positive; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

SCALE, BLOCK, SWEEPS = 256, 4096, 60
EXACT = "decimal(38,0)"


class Whitening(NamedTuple):
    """A fit: rows of ``components`` are unit eigenvectors by falling ``eigenvalues``."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def on_grid(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows that take part, stored."""
    entries = F.col(vector).cast("array<double>")
    rows = table.select(F.col(id_column).cast("long").alias("id"), entries.alias("vec")).filter(
        "size(vec) > 0 and forall(vec, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")
    most = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return store(rows.filter(F.size("vec") == (most["d"] if most else 0)).select(
        "id", F.transform("vec", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(0)).alias("x")), "whitening-grid")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one matrix, without a copy where there is nothing to skip."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield matrix(batch.slice(at, BLOCK).column("x"))


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and their exact sum per dimension."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for x in blocks(batches):
            wide = int(np.abs(x.astype(float)).max()) >= 1 << 50
            sums = x.astype(object).sum(0) if wide else x.sum(0).astype(object)
            n, total = n + len(x), sums if total is None else total + sums
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(total)), pa.int32()), "n": [n] * len(total),
                                              "s": [str(v) for v in total]})

    found = fit.select("x").mapInArrow(part, "dim int, n long, s string").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast(EXACT)).alias("s")).collect()
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in sorted(found, key=lambda r: r["dim"])]


def gram(fit: DataFrame, centred: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray:
    """Sum of outer products of the centred rows: a matrix per task, added up in Spark."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for x in blocks(batches):
            rows = centred(x)
            total += rows.T @ rows
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "v": pa.array(list(total))})

    out = np.zeros((dims, dims))
    for r in fit.select("x").mapInArrow(part, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy(
            "i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"], r["j"]] = r["v"]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L', its rows in the order of ``a``; as many columns as the rank."""
    left, dims = a.copy(), len(a)
    factor, rounding = np.zeros((dims, dims)), 64 * dims * np.finfo(float).eps * a.diagonal()
    open_rows = np.ones(dims, bool)
    for k in range(dims):
        open_rows &= left.diagonal() > rounding
        if not open_rows.any():
            return factor[:, :k]
        pivot = int(np.where(open_rows, left.diagonal(), -np.inf).argmax())
        open_rows[pivot] = False
        column = np.where(open_rows, left[:, pivot], 0) / np.sqrt(left[pivot, pivot])
        column[pivot] = np.sqrt(left[pivot, pivot])
        factor[:, k] = column
        left -= np.outer(column, column) * np.outer(open_rows, open_rows)
    return factor


def rotated(factor: np.ndarray) -> np.ndarray:
    """The factor with orthogonal columns: rounds of disjoint pairs, each turned until no product is left."""
    columns = factor.shape[1]
    work = np.zeros((columns + columns % 2, len(factor)))  # a column of the factor per row; an odd one rests
    work[:columns] = factor.T
    order, limit = np.arange(len(work)), 4 * np.finfo(float).eps
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(work) - 1):
            p, q = order[:len(work) // 2], order[:len(work) // 2 - 1:-1]
            a, b = work[p], work[q]
            alpha, beta, product = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            size = np.sqrt(alpha * beta)
            turn = np.abs(product) > limit * size
            worst = max(worst, (np.abs(product[turn]) / size[turn]).max(initial=0))
            zeta = np.divide(beta - alpha, 2 * product, out=np.zeros_like(beta), where=turn)
            tangent = np.where(turn, np.copysign(1, zeta) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            cosine = 1 / np.hypot(1, tangent)
            sine = cosine * tangent
            work[p], work[q] = cosine[:, None] * a - sine[:, None] * b, sine[:, None] * a + cosine[:, None] * b
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if worst == 0:
            return work[:columns].T
    raise ValueError(f"columns not orthogonal after {SWEEPS} sweeps: {worst}")


def fit_whitening(fit: DataFrame) -> Whitening:
    """Fit on stored different rows ``x``."""
    n, sums = exact_sums(fit)
    mean = np.array([float(s / Decimal(n)) for s in map(Decimal, sums)])
    scatter = gram(fit, lambda x: x - mean, len(mean)) if n else np.zeros((0, 0))
    columns = rotated(pivoted_cholesky(scatter))
    norms = np.sqrt((columns**2).sum(0))
    by_size = np.argsort(-norms, kind="stable")
    components = (columns / norms).T[by_size]
    for row in components:
        row *= np.copysign(1, row[np.abs(row).argmax()])
    return Whitening(n, sums, mean, components, norms[by_size] ** 2 / max(n, 1), float(scatter.trace()) / max(n, 1))


def whiteners(found: Whitening, most: int) -> np.ndarray:
    """A row per component, at most ``most``: what centred vectors are multiplied with."""
    return found.components[:most] / np.sqrt(found.eigenvalues[:most, None])


def identity_error(fit: DataFrame, found: Whitening, most: int) -> float:
    """How far the covariance of the whitened fit list is from the identity, at most."""
    turn, mean = whiteners(found, most), found.mean
    k = len(turn)
    ones = gram(fit, lambda x: np.concatenate([(x - mean) @ turn.T, np.ones((len(x), 1))], 1), k + 1)
    middle = ones[k, :k] / found.n  # zero but for rounding; taken off before the rows are multiplied
    covariance = gram(fit, lambda x: (x - mean) @ turn.T - middle, k) / found.n
    return float(np.abs(covariance - np.eye(k)).max(initial=0))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n*x - S)^2, exact; null beyond 38 digits."""
    reach = n * int(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums)) + n
    if reach * reach * x.shape[1] < 1 << 62:
        y = n * x - np.array(sums, np.int64)
        return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def whiten(table: DataFrame, most: int = 4, id_column: str = "vec_id", vector: str = "embedding",
           scale: int = SCALE) -> DataFrame:
    """Per row that takes part and component: the projection on it, whitened, and the figures of the fit.

    vec_id, component (from 1), n, deviation (decimal(38,0)), whitened, explained, identity_error.
    """
    rows = on_grid(table, id_column, vector, scale)
    fit = store(rows.select("x").distinct(), "whitening-fit")
    found = fit_whitening(fit)
    k = min(most, len(found.components))
    error = identity_error(fit, found, k) if k else 0.0
    schema = f"vec_id long, component int, n long, deviation {EXACT}, whitened double, explained double"
    if not k:
        return rows.limit(0).selectExpr("id as vec_id", "0 as component", "0L as n", f"cast(0 as {EXACT}) as deviation",
                                        "0D as whitened", "0D as explained", "0D as identity_error")
    turn, n, sums, mean = whiteners(found, k), found.n, found.sums, found.mean
    shares = found.eigenvalues[:k] / found.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrix(part.column("x"))
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n)), deviations(x, n, sums).take(each),
                    pa.array(((x - mean) @ turn.T).ravel()), pa.array(np.tile(shares, len(x)))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(project, schema).withColumn("identity_error", F.lit(error))


def report(table: DataFrame) -> DataFrame:
    """The contract's columns: ``deviation`` as a long, null beyond its range."""
    return whiten(table).withColumn("deviation", F.col("deviation").try_cast("long"))
