"""Filters of images (i, j, v) by square tiles with borders: one shuffle deals each place to its tile and to those whose
border it is in, and a task works on one tile with its border at a time, however many places a filter looks at."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilefold.operators import graph as G

#: Side of a tile without its border.
SIDE = 64


def by_tiles(image: DataFrame, f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], border: int, outputs: str, side: int = SIDE) -> DataFrame:
    """(i, j, outputs): f(values, present) of each tile and its border of so many places gives arrays of the same shape, by
    name; absent places are 0 there. Places must not repeat."""
    ends = lambda c: F.sequence(F.floor((F.col(c) - border) / side), F.floor((F.col(c) + border) / side))
    dealt = image.select("i", "j", F.col("v").cast("double").alias("v"), F.explode(ends("i")).alias("ti")).select("*", F.explode(ends("j")).alias("tj"))
    wide = side + 2 * border
    named = [x.split() for x in outputs.split(",")]

    def run(table: pa.Table) -> pa.Table:
        i, j, v, ti, tj = (table.column(c).to_numpy() for c in ("i", "j", "v", "ti", "tj"))
        values, present = np.zeros((wide, wide)), np.zeros((wide, wide), bool)
        r, c = i - ti * side + border, j - tj * side + border
        values[r, c], present[r, c] = v, True
        made = f(values, present)
        own = (r >= border) & (r < side + border) & (c >= border) & (c < side + border)
        return pa.table({"i": i[own], "j": j[own], **{n: made[n][r[own], c[own]].astype({"double": "f8", "bigint": "i8", "int": "i4"}[t]) for n, t in named}})

    return dealt.groupBy("ti", "tj").applyInArrow(run, f"i bigint, j bigint, {outputs}")


def _shifted(a: np.ndarray, di: int, dj: int) -> np.ndarray:
    """b with b[i, j] = a[i + di, j + dj], 0 beyond the ends."""
    out = np.zeros_like(a)
    n, m = a.shape
    out[max(0, -di) : n - max(0, di), max(0, -dj) : m - max(0, dj)] = a[max(0, di) : n - max(0, -di), max(0, dj) : m - max(0, -dj)]
    return out


def bilateral(image: DataFrame, radius: int = 2, spread: float = 2.0, contrast: float = 50.0) -> DataFrame:
    """(i, j, v): means of the places around, weighted by nearness and by likeness of the values."""

    def f(v: np.ndarray, present: np.ndarray) -> dict[str, np.ndarray]:
        total, weights = np.zeros_like(v), np.zeros_like(v)
        for di in range(-radius, radius + 1):
            for dj in range(-radius, radius + 1):
                other = _shifted(v, di, dj)
                w = np.exp(-(di * di + dj * dj) / (2 * spread * spread) - (other - v) ** 2 / (2 * contrast * contrast)) * _shifted(present, di, dj)
                total += w * other
                weights += w
        return {"v": total / np.where(weights > 0, weights, 1)}

    return by_tiles(image, f, radius, "v double")


# fixed values: weights of the smoothing and of the two gradients
SMOOTH = ((1, 2, 1), (2, 4, 2), (1, 2, 1))
DOWN = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))


def thin_gradients(image: DataFrame) -> DataFrame:
    """(i, j, size): the size of the gradient of the smoothed image where it is a ridge along its direction, else 0.

    Whole numbers throughout, for an image of such: sixteenfold smoothing, sums of the gradients' absolute values, and
    directions by eighths of a turn, of which 5 to 12 stands for the tangent of a sixteenth. A place keeps its size if it is above
    that of the neighbour ahead and at least that of the one behind.
    """

    def taps(v: np.ndarray, present: np.ndarray, weights) -> np.ndarray:
        return sum(weights[a][b] * _shifted(v, a - 1, b - 1) for a in range(3) for b in range(3) if weights[a][b]) * present

    def f(v: np.ndarray, present: np.ndarray) -> dict[str, np.ndarray]:
        smooth = taps(v, present, SMOOTH)
        gi, gj = taps(smooth, present, DOWN), taps(smooth, present, tuple(zip(*DOWN)))
        size, x, y = np.abs(gi) + np.abs(gj), np.abs(gi), np.abs(gj)
        along = [12 * x <= 5 * y, 12 * y <= 5 * x, gi * gj > 0]
        neighbours = [(0, 1), (1, 0), (1, 1), (1, -1)]
        ahead, behind = (np.select(along, [_shifted(size, s * a, s * b) for a, b in neighbours[:3]], _shifted(size, s * neighbours[3][0], s * neighbours[3][1])) for s in (1, -1))
        return {"size": np.where((size > ahead) & (size >= behind), size, 0)}

    return by_tiles(image, f, 3, "size bigint")


def edges(image: DataFrame, low: int, high: int) -> DataFrame:
    """(i, j, size) of the places of thin_gradients() of at least `low` that are of at least `high`, or linked with such
    a place by neighbours (also diagonal ones) of at least `low`. Links are found by contraction, so rounds follow the
    logarithm of the longest line and not its length."""
    from tilefold.functions.staging import saved

    weak = saved(thin_gradients(image).where(F.col("size") >= low), "images")
    name = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    to = weak.select("i", "j", F.explode(steps).alias("s")).select("i", "j", (F.col("i") + F.col("s.a")).alias("k"), (F.col("j") + F.col("s.b")).alias("l"))
    links = to.join(weak.select(F.col("i").alias("k"), F.col("j").alias("l")), ["k", "l"]).select(name(F.col("i"), F.col("j")).alias("src"), name(F.col("k"), F.col("l")).alias("dst"))
    found = saved(G.components(links), "images")
    strong = weak.where(F.col("size") >= high)
    kept = strong.select(name(F.col("i"), F.col("j")).alias("node")).join(found, "node").select("component").distinct()
    linked = found.join(kept, "component", "left_semi").select("node.i", "node.j").unionByName(strong.select("i", "j")).distinct()
    return weak.join(linked, ["i", "j"], "left_semi")
