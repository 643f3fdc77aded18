"""Many small dense matrices at once: a row is a matrix (batch, a), flattened by rows; Arrow batches go through stacked
numpy routines, so no shuffle is needed and memory follows the batch size, not the number of matrices.

Cases: a null matrix gives null results; a matrix that a routine refuses (singular, not positive definite) gives NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors in one matrix (unit lower part below the diagonal) and the row order, pivots chosen by absolute value."""
    a, (m, n, _) = a.copy(), a.shape
    order, at = np.tile(np.arange(n), (m, 1)), np.arange(m)
    for k in range(n):
        p = k + np.abs(a[:, k:, k]).argmax(1)
        for x in (a, order):
            x[at, k], x[at, p] = x[at, p].copy(), x[at, k].copy()
        with np.errstate(divide="ignore", invalid="ignore"):
            a[:, k + 1 :, k] /= a[:, k, k][:, None]
        a[:, k + 1 :, k + 1 :] -= a[:, k + 1 :, k, None] * a[:, k, None, k + 1 :]
    return a, order.astype(float)


def triangular(a: np.ndarray, b: np.ndarray, lower: bool = True) -> np.ndarray:
    """x with T x = b, T being the lower or upper triangle of a."""
    n, x = a.shape[1], b.astype(float).copy()
    for k in range(n) if lower else reversed(range(n)):
        known = slice(0, k) if lower else slice(k + 1, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            x[:, k] = (x[:, k] - (a[:, k, known] * x[:, known]).sum(1)) / a[:, k, k]
    return x


def tridiagonal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with A x = b by one sweep down and one up; only the three diagonals of a are read, no pivots are taken."""
    n, d, x = a.shape[1], np.einsum("mii->mi", a).copy(), b.astype(float).copy()
    for k in range(1, n):
        w = a[:, k, k - 1] / d[:, k - 1]
        d[:, k] -= w * a[:, k - 1, k]
        x[:, k] -= w * x[:, k - 1]
    x[:, n - 1] /= d[:, n - 1]
    for k in reversed(range(n - 1)):
        x[:, k] = (x[:, k] - a[:, k, k + 1] * x[:, k + 1]) / d[:, k]
    return x


def eigenvalues(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary parts, ordered by both."""
    w = np.sort_complex(np.linalg.eigvals(a))
    return w.real, w.imag


#: Routines of stacked matrices: f(a) or f(a, b), and the names of what they give.
ONE: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "lu": (lu, ("factors", "order")),
    "qr": (np.linalg.qr, ("q", "r")),
    "svd": (np.linalg.svd, ("u", "s", "vt")),
    "cholesky": (np.linalg.cholesky, ("l",)),
    "inverse": (np.linalg.inv, ("inverse",)),
    "pseudo_inverse": (np.linalg.pinv, ("inverse",)),
    "determinant": (np.linalg.det, ("determinant",)),
    "eigenvalues": (eigenvalues, ("re", "im")),
}
TWO: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "gemv": (lambda a, b: (a @ b[:, :, None])[:, :, 0], ("y",)),
    "solve": (lambda a, b: np.linalg.solve(a, b[:, :, None])[:, :, 0], ("x",)),
    "least_squares": (lambda a, b: (np.linalg.pinv(a) @ b[:, :, None])[:, :, 0], ("x",)),
    "lower_solve": (triangular, ("x",)),
    "upper_solve": (lambda a, b: triangular(a, b, False), ("x",)),
    "tridiagonal_solve": (tridiagonal, ("x",)),
}


def _alone(f: Callable, args: list[np.ndarray]) -> list[tuple | None]:
    """Results one matrix at a time; None where the routine refuses."""
    out = []
    for k in range(len(args[0])):
        try:
            found = f(*(x[k : k + 1] for x in args))
            out.append(tuple(np.asarray(y)[0] for y in (found if isinstance(found, tuple) else (found,))))
        except np.linalg.LinAlgError:
            out.append(None)
    return out


def apply(df: DataFrame, routine: str, n: int, columns: int | None = None) -> DataFrame:
    """(batch, the routine's results as arrays) for rows (batch, a) of n x columns matrices, or (batch, a, b) with
    vectors b where the routine takes two."""
    two = routine in TWO
    f, names = (TWO if two else ONE)[routine]
    inputs = ["a", "b"] if two else ["a"]
    m = columns or n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(c).to_pylist() for c in inputs]
            there = [k for k in range(b.num_rows) if all(x[k] is not None for x in lists)]
            out: list[list] = [[None] * b.num_rows for _ in names]
            if there:
                args = [np.array([x[k] for k in there], float) for x in lists]
                args[0] = args[0].reshape(-1, n, m)
                try:
                    found = f(*args)
                    made = list(zip(*(np.asarray(y) for y in (found if isinstance(found, tuple) else (found,)))))
                except np.linalg.LinAlgError:
                    made = _alone(f, args)
                for k, row in zip(there, made):
                    for o, value in zip(out, row or [np.array([np.nan])] * len(names)):
                        o[k] = np.ravel(value).tolist()
            yield pa.RecordBatch.from_arrays([b.column("batch"), *(pa.array(o, pa.list_(pa.float64())) for o in out)], names=["batch", *names])

    kind = dict(df.dtypes)["batch"]
    return df.select("batch", *inputs).mapInArrow(run, ", ".join([f"batch {kind}", *(f"`{c}` array<double>" for c in names)]))


def gemm(a: DataFrame, b: DataFrame, n: int, alpha: float = 1.0) -> DataFrame:
    """(batch, c) of alpha A B for square matrices of one batch each, JVM-side: a join on batch and higher-order functions."""
    cell = f"transform(sequence(0, {n * n - 1}), p -> aggregate(sequence(0, {n - 1}), 0D, (s, k) -> s + a[(p div {n}) * {n} + k] * b[k * {n} + p % {n}]) * {float(alpha)}D)"
    return a.select("batch", "a").join(b.select("batch", F.col("a").alias("b")), "batch").select("batch", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.expr(cell)).alias("c"))
