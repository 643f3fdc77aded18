"""Eigenvalues of symmetric tridiagonal matrices by bisection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilefold.functions.staging import saved

#: Parts into which an interval is cut in one round.
SPLIT = 16


#: Numbers of one diagonal that are counted over at once.
CELLS = 1 << 20


def below(x: np.ndarray, diagonals: list[np.ndarray], squares: list[np.ndarray]) -> np.ndarray:
    """How many eigenvalues of each matrix are less than each number of its row of x: the negative pivots of the matrix
    less that number. `squares` has the squared entries beside the diagonal, with a 0 ahead. Rows go in the order of their
    lengths, so that those which are not at their end are the last ones."""
    lengths = np.array([len(d) for d in diagonals])
    order = np.argsort(lengths, kind="stable")
    lengths, n, at = lengths[order], np.zeros(x.shape, np.int32), 0
    while at < len(order):
        # as many rows as fit with their longest one
        upto = at + max(1, int(np.count_nonzero(np.arange(1, len(order) - at + 1) * lengths[at:] <= CELLS)))
        own, size = order[at:upto], lengths[at:upto]
        d, s = (np.zeros((size[-1], len(own))) for _ in range(2))
        row, place = np.repeat(np.arange(len(own)), size), np.concatenate([np.arange(m) for m in size])
        d[place, row], s[place, row] = (np.concatenate([v[k] for k in own]) for v in (diagonals, squares))
        q, found, points = np.ones((len(own), x.shape[1])), np.zeros((len(own), x.shape[1]), np.int32), x[own]
        first = np.searchsorted(size, np.arange(size[-1]), side="right")
        with np.errstate(over="ignore", invalid="ignore"):
            for k in range(size[-1]):
                f = first[k]
                p = d[k, f:, None] - points[f:] - s[k, f:, None] / q[f:]
                p[p == 0] = -1e-300
                q[f:] = p
                found[f:] += p < 0
        n[own], at = found, upto
    return n


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of intervals (batch, low, width, under, upto, d, s) that hold eigenvalues."""
    for b in batches:
        if not b.num_rows:
            continue
        low, width, under, upto = (b.column(c).to_numpy() for c in ("low", "width", "under", "upto"))
        rows = [np.split(b.column(c).flatten().to_numpy(), np.cumsum(b.column(c).value_lengths().to_numpy())[:-1]) for c in ("d", "s")]
        inner = below(low[:, None] + np.arange(1, SPLIT) * width[:, None], *rows)
        n = np.concatenate([under[:, None], inner, upto[:, None]], 1).astype(np.int32)
        k, p = np.nonzero(n[:, 1:] > n[:, :-1])
        out = [b.column("batch").take(pa.array(k)), pa.array(low[k] + p * width[k]), pa.array(low[k] + (p + 1) * width[k]), pa.array(n[k, p]), pa.array(n[k, p + 1])]
        yield pa.RecordBatch.from_arrays(out, names=["batch", "low", "high", "under", "upto"])


def tridiagonal_eigenvalues(matrices: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(batch, k, value): the eigenvalues, ascending from k = 0, of each matrix (batch, d, e): arrays of the diagonal and,
    one shorter, of what is beside it.

    Intervals that hold eigenvalues are rows, at first one a matrix by its rows' sums. Each round cuts them all into SPLIT
    parts and keeps those in which the counts of smaller eigenvalues differ, so the work follows the eigenvalues that are
    wanted and any task takes any interval. A matrix travels with its intervals as two arrays, so it must fit in a row.
    Eigenvalues closer than the tolerance share an interval and come out equal. An empty matrix has none.
    """
    sides = F.concat(F.array(F.lit(0.0)), F.col("e").cast("array<double>"))
    m = matrices.where(F.size("d") > 0).select("batch", F.col("d").cast("array<double>").alias("d"), F.transform(sides, lambda v: v * v).alias("s"), F.transform(sides, lambda v: F.abs(v)).alias("a"))
    reach = lambda sign: F.zip_with("d", F.zip_with("a", F.concat(F.slice("a", 2, F.size("a")), F.array(F.lit(0.0))), lambda p, q: p + q), lambda d, r: d + sign * r)
    m = saved(m.select("batch", "d", "s", F.array_min(reach(-1)).alias("low"), F.array_max(reach(1)).alias("high")), "spectra")
    widest = m.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    live = m.select("batch", (F.col("low") - tolerance).alias("low"), (F.col("high") + tolerance).alias("high"), F.lit(0).alias("under"), F.size("d").alias("upto"))
    kinds = f"batch {dict(m.dtypes)['batch']}, low double, high double, under int, upto int"
    if widest is not None:
        for _ in range(max(1, math.ceil(math.log((widest + 2 * tolerance) / tolerance, SPLIT)))):
            width = (F.col("high") - F.col("low")) / SPLIT
            met = live.join(m.select("batch", "d", "s"), "batch").withColumn("width", width)
            live = saved(met.select("batch", "low", "width", "under", "upto", "d", "s").mapInArrow(_parts, kinds), "spectra", instead_of=live)
    each = live.select("batch", F.explode(F.sequence("under", F.col("upto") - 1)).alias("k"), ((F.col("low") + F.col("high")) / 2).alias("value"))
    return each
