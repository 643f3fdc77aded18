"""Vector operations and iterative solvers; a vector is (i, x), and one number a step comes to the driver: joins with
vectors are merged, as a broadcast would send one through the driver in each step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilefold.functions.staging import saved


def dot(x: DataFrame, y: DataFrame) -> float:
    return x.join(y.select("i", F.col("x").alias("y")).hint("merge"), "i").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0))).first()[0]


def norms(x: DataFrame) -> DataFrame:
    """One row: sum and greatest of absolute values, and the Euclidean length."""
    a = F.abs("x")
    return x.agg(F.sum(a).alias("one"), F.max(a).alias("largest"), F.sqrt(F.sum(a * a)).alias("two"))


def axpby(alpha: float, x: DataFrame, beta: float, y: DataFrame) -> DataFrame:
    """alpha x + beta y; absent entries are 0."""
    both = x.select("i", (F.col("x") * alpha).alias("x")).unionByName(y.select("i", (F.col("x") * beta).alias("x")))
    return both.groupBy("i").agg(F.sum("x").alias("x"))


def times(a: DataFrame, x: DataFrame) -> DataFrame:
    return a.join(x.select(F.col("i").alias("j"), "x").hint("merge"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def _saved(x: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    return saved(x, "vectors", instead_of)


def conjugate_gradients(a: DataFrame, b: DataFrame, steps: int = 100, tolerance: float = 1e-10, precondition: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """x with A x = b for a symmetric positive definite A; b is a vector with an entry for every row. `precondition` gives
    M^-1 r for a residual r, M being near A (factors.Factors.solve); it has to be symmetric positive definite too."""
    near = precondition or (lambda r: r)
    x, r = b.select("i", F.lit(0.0).alias("x")), _saved(b)
    p = _saved(near(r))
    rz = dot(r, p)
    for _ in range(steps):
        if dot(r, r) <= tolerance**2:
            break
        ap = _saved(times(a, p))
        alpha = rz / dot(p, ap)
        x, r = _saved(axpby(1.0, x, alpha, p), x), _saved(axpby(1.0, r, -alpha, ap), r)
        z = near(r)
        rz, before = dot(r, z), rz
        p = _saved(axpby(1.0, z, rz / before, p), p)
    return x


def jacobi(a: DataFrame, b: DataFrame, steps: int = 20) -> DataFrame:
    """So many sweeps of x = D^-1 (b - (A - D) x) from 0."""
    d = a.where("i = j").groupBy("i").agg(F.sum("v").alias("d"))
    off, x = a.where("i <> j"), b.select("i", F.lit(0.0).alias("x"))
    for _ in range(steps):
        x = _saved(axpby(1.0, b, -1.0, times(off, x)).join(d, "i").select("i", (F.col("x") / F.col("d")).alias("x")), x)
    return x


def gauss_seidel(a: DataFrame, b: DataFrame, colours: DataFrame, sweeps: int = 10, omega: float = 1.0) -> DataFrame:
    """Sweeps of successive over-relaxation from 0, colour by colour: rows of one colour (node, colour) do not meet.

    Rows without a colour have no neighbours and are solved last.
    """
    d = a.where("i = j").groupBy("i").agg(F.sum("v").alias("d"))
    off, x = a.where("i <> j"), _saved(b.select("i", F.lit(0.0).alias("x")))
    rows = _saved(b.select("i", F.col("x").alias("b")).join(d, "i").join(colours.select(F.col("node").alias("i"), "colour"), "i", "left").withColumn("colour", F.coalesce("colour", F.lit(-1))))
    order = sorted(r[0] for r in rows.select("colour").distinct().collect())
    for _ in range(sweeps):
        for c in [*(k for k in order if k >= 0), *(k for k in order if k < 0)]:
            own = rows.where(F.col("colour") == c)
            sums = times(off.join(own.select("i"), "i", "left_semi"), x).withColumnRenamed("x", "s")
            new = own.join(sums, "i", "left").select("i", ((F.col("b") - F.coalesce("s", F.lit(0.0))) / F.col("d")).alias("n"))
            x = _saved(x.join(new, "i", "left").select("i", F.when(F.col("n").isNull(), F.col("x")).otherwise((1 - omega) * F.col("x") + omega * F.col("n")).alias("x")), x)
    return x


def triangular_solve(t: DataFrame, b: DataFrame) -> DataFrame:
    """x with T x = b for a triangular T (lower or upper) with a full diagonal and a b of all rows.

    In each round the rows are solved whose other columns all are, so rounds follow the longest chain of rows.
    """
    d = t.where("i = j").groupBy("i").agg(F.sum("v").alias("d"))
    off = _saved(t.where("i <> j").groupBy("i", "j").agg(F.sum("v").alias("v")))
    waits = off.groupBy("i").agg(F.count("*").alias("waits"))
    open_ = _saved(b.select("i", F.col("x").alias("r")).join(d, "i").join(waits, "i", "left").withColumn("waits", F.coalesce("waits", F.lit(0))))
    done = None
    while True:
        ready = _saved(open_.where("waits = 0").select("i", (F.col("r") / F.col("d")).alias("x")))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        told = off.join(ready.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("s"), F.count("*").alias("n"))
        left = open_.where("waits > 0").join(told, "i", "left")
        open_ = _saved(left.select("i", (F.col("r") - F.coalesce("s", F.lit(0.0))).alias("r"), "d", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits")), open_)
    if not open_.isEmpty():
        raise ValueError("the matrix is not triangular")
    return done if done is not None else b.select("i", "x")


def gmres(a: DataFrame, b: DataFrame, restart: int = 15, cycles: int = 10, tolerance: float = 1e-10, precondition: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """x with A x = b for any regular A, by restarted minimal residuals; the small least-squares problem is the driver's.
    `precondition` gives M^-1 r; the residuals of A M^-1 are those of A itself."""
    import numpy as np

    near = precondition or (lambda r: r)
    x = b.select("i", F.lit(0.0).alias("x"))
    for _ in range(cycles):
        r = _saved(axpby(1.0, b, -1.0, times(a, x)))
        beta = dot(r, r) ** 0.5
        if beta <= tolerance:
            break
        basis = [_saved(r.select("i", (F.col("x") / beta).alias("x")))]
        h = np.zeros((restart + 1, restart))
        k = 0
        while k < restart:
            w = _saved(times(a, near(basis[k])))
            for n, q in enumerate(basis):  # modified Gram-Schmidt
                h[n, k] = dot(w, q)
                w = _saved(axpby(1.0, w, -h[n, k], q), w)
            h[k + 1, k] = dot(w, w) ** 0.5
            k += 1
            if h[k, k - 1] <= tolerance:
                break
            basis.append(_saved(w.select("i", (F.col("x") / float(h[k, k - 1])).alias("x"))))
        e = np.zeros(k + 1)
        e[0] = beta
        step = None
        for y, q in zip(np.linalg.lstsq(h[: k + 1, :k], e, rcond=None)[0], basis):
            own = q.select("i", (F.col("x") * float(y)).alias("x"))
            step = own if step is None else step.unionByName(own)
        x = _saved(axpby(1.0, x, 1.0, near(_saved(step.groupBy("i").agg(F.sum("x").alias("x"))))), x)
    return x


def damped_product(a: DataFrame, b: DataFrame, omega: float) -> DataFrame:
    """(i, j, v) of B - omega D^-1 A B, D being the diagonal of A."""
    d = a.where("i = j").groupBy("i").agg(F.sum("v").alias("d"))
    scaled = a.join(d, "i").select("i", F.col("j").alias("k"), (F.col("v") / F.col("d") * -omega).alias("a"))
    made = scaled.join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("b")), "k").select("i", "j", (F.col("a") * F.col("b")).alias("v"))
    return b.select("i", "j", "v").unionByName(made).groupBy("i", "j").agg(F.sum("v").alias("v"))
