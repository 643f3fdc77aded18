"""Fourier transforms by butterfly stages, convolution with them, and cosine transforms of 8x8 blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefold.functions.staging import dealt, saved

#: Inputs of one butterfly at most: a stage does three binary ones, so a transform of 2^30 takes ten shuffles.
RADIX = 8

#: Length at most of the transforms of one piece of a long signal, which is done within a task.
PIECE = 1 << 16


def _radices(n: int) -> list[int]:
    """Powers of two up to RADIX whose product is n, a power of two."""
    out = []
    while n > 1:
        out.append(min(RADIX, n))
        n //= out[-1]
    return out


def _turned(re: Column, im: Column, angle: Column | float) -> tuple[Column, Column]:
    """A complex number turned by an angle."""
    if isinstance(angle, float):
        c, s = (round(f(angle), 15) + 0.0 if abs(f(angle)) < 1e-15 or abs(abs(f(angle)) - 1) < 1e-15 else f(angle) for f in (math.cos, math.sin))
        if s == 0:
            return re * c, im * c
        if c == 0:
            return -im * s, re * s
        return re * c - im * s, re * s + im * c
    return re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle)


def _stage(x: DataFrame, block: int, radix: int, by: list[str], inverse: bool) -> DataFrame:
    """One stage on sub-transforms of `block` entries: the `radix` entries that are block / radix apart meet in one grouped
    sum and come out as as many. Absent entries are 0. Forward the outputs are turned, backward the inputs are."""
    step = block // radix
    at, sign = F.pmod("i", F.lit(block)), 1.0 if inverse else -1.0
    digit, r = F.floor(at / step), at % step
    if inverse:
        re, im = _turned(F.col("re"), F.col("im"), (digit * r % block).cast("double") * (2 * math.pi / block))
        x = x.select("i", *by, re.alias("re"), im.alias("im"))
    keys = x.select(*by, (F.floor(F.col("i") / block) * block + r).alias("__first"), digit.alias("__digit"), "re", "im")
    parts = [f(F.when(F.col("__digit") == d, F.col(c))).alias(f"{c}{d}") for d in range(radix) for c in ("re", "im") for f in (F.sum,)]
    met = keys.groupBy(*by, "__first").agg(*parts).fillna(0.0, [f"{c}{d}" for d in range(radix) for c in ("re", "im")])  # keys stay as they are, and with them how rows are dealt
    outputs = []
    for k in range(radix):
        turned = [_turned(F.col(f"re{d}"), F.col(f"im{d}"), sign * 2 * math.pi * (d * k % radix) / radix) for d in range(radix)]
        re, im = (sum((t[c] for t in turned[1:]), turned[0][c]) for c in (0, 1))
        outputs.append(F.struct(F.lit(k).cast("bigint").alias("k"), re.alias("re"), im.alias("im")))
    out = met.select(*by, "__first", F.explode(F.array(*outputs)).alias("o")).select(*by, "__first", "o.k", "o.re", "o.im")
    re, im = F.col("re"), F.col("im")
    if not inverse:
        re, im = _turned(re, im, (F.col("k") * (F.col("__first") % step) % block).cast("double") * (-2 * math.pi / block))
    return out.select((F.col("__first") + F.col("k") * step).cast("bigint").alias("i"), *by, re.alias("re"), im.alias("im"))


def fourier(x: DataFrame, n: int, by: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """The discrete Fourier transform (i, ..., re, im) of x (i, re, im, and groups `by`) with i from 0 to n - 1, n being a
    power of two; absent entries are 0. Without `ordered` the frequencies stay in the order of reversed digits, which
    backward() takes."""
    by = by or []
    block = n
    for radix in _radices(n):
        x = _stage(x, block, radix, by, inverse=False)
        block //= radix
    return x.withColumn("i", frequency(F.col("i"), n)) if ordered else x


def frequency(i: Column, n: int) -> Column:
    """The frequency at a place of the unordered transform: the digits of the place, the last first."""
    out, weight, block = F.lit(0).cast("bigint"), 1, n
    for radix in _radices(n):
        block //= radix
        out, weight = out + F.floor(i % (block * radix) / block) * weight, weight * radix
    return out.cast("bigint")


def backward(x: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The inverse of fourier(ordered=False)."""
    block = 1
    for radix in reversed(_radices(n)):
        block *= radix
        x = _stage(x, block, radix, by or [], inverse=True)
    return x.withColumns({c: F.col(c) / n for c in ("re", "im")})


def _piece(taps: int, length: int) -> int | None:
    """The length of transforms that takes the least stages for each place of a result of `length` places, if pieces overlap
    by a kernel of `taps` places; None if those of PIECE are too short for it."""
    whole = 1 << max(1, (length - 1).bit_length())
    sizes = [n for n in (1 << k for k in range(1, PIECE.bit_length())) if n <= whole and (n >= 2 * taps or n == whole)]
    return min(sizes, key=lambda n: (len(_radices(n)) * n / (n - taps + 1), -n), default=None)


def convolution(x: DataFrame, kernel: DataFrame) -> DataFrame:
    """(i, x): the sums over k of x(i - k) kernel(k), both being (i, x) with i from 0 on, by Fourier transforms. Values are
    rounded doubles, so results of whole numbers are whole once rounded while they stay below 2^40 or so.

    The longer signal is cut into pieces that overlap by the shorter one, and a piece gives those places of the result that
    it holds all of. Pieces are dealt to tasks once, and all stages of their transforms are done there. Where the shorter
    signal is too long for that, both go forward in the same stages of a length that holds both.
    """
    x, kernel = (t.where("i is not null").groupBy("i").agg(F.sum("x").cast("double").alias("x")) for t in (x, kernel))
    ends = [t.agg(F.max("i")).first()[0] for t in (x, kernel)]
    if None in ends:
        return x.limit(0)
    if ends[0] < ends[1]:
        x, kernel, ends = kernel, x, ends[::-1]
    taps, length = ends[1] + 1, ends[0] + ends[1] + 1
    n = _piece(taps, length)
    signal = lambda t, *more: t.select("i", *more, F.col("x").alias("re"), F.lit(0.0).alias("im"))
    if n is None:
        n = 1 << max(1, (length - 1).bit_length())
        both = saved(fourier(signal(x, F.lit("x").alias("of")).unionByName(signal(kernel, F.lit("k").alias("of"))), n, ["of"], ordered=False), "fourier")
        one = lambda name, c: F.sum(F.when(F.col("of") == name, F.col(c)))
        met = both.groupBy("i").agg(one("x", "re").alias("a"), one("x", "im").alias("b"), one("k", "re").alias("c"), one("k", "im").alias("d"))
        return backward(_multiplied(met), n).where(F.col("i") < length).select("i", F.col("re").alias("x"))
    step = n - taps + 1
    pieces = -(-length // step)
    last = F.least(F.floor((F.col("i") + taps - 1) / step), F.lit(pieces - 1))
    cut = x.select("i", "x", F.explode(F.sequence(F.floor(F.col("i") / step), last)).alias("piece"))
    cut = cut.select("piece", (F.col("i") - F.col("piece") * step + (taps - 1)).alias("i"), "x")
    empty = x.sparkSession.range(pieces).select(F.col("id").alias("piece"), F.lit(0).cast("bigint").alias("i"), F.lit(0.0).alias("x"))
    own = dealt(cut.unionByName(empty), pieces * n, "piece").groupBy("piece", "i").agg(F.sum("x").alias("x"))
    ahead = fourier(signal(own, "piece"), n, ["piece"], ordered=False).withColumnsRenamed({"re": "a", "im": "b"})
    turned = fourier(signal(kernel), n, ordered=False).withColumnsRenamed({"re": "c", "im": "d"})
    back = backward(_multiplied(ahead.join(F.broadcast(turned), "i"), "piece"), n, ["piece"])  # PIECE rows at most
    out = back.where(F.col("i") >= taps - 1).select((F.col("piece") * step + F.col("i") - (taps - 1)).alias("i"), F.col("re").alias("x"))
    return out.where(F.col("i") < length)


def _multiplied(met: DataFrame, *by: str) -> DataFrame:
    """(i, ..., re, im): the products of the complex numbers a + b i and c + d i."""
    a, b, c, d = (F.col(k) for k in "abcd")
    return met.select("i", *by, (a * c - b * d).alias("re"), (a * d + b * c).alias("im"))


def _basis(size: int) -> list[list[float]]:
    return [[math.sqrt((1 if u == 0 else 2) / size) * math.cos((2 * k + 1) * u * math.pi / (2 * size)) for k in range(size)] for u in range(size)]


def cosine_blocks(image: DataFrame, size: int = 8, inverse: bool = False) -> DataFrame:
    """(i, j, v): the cosine transform of each block of size x size places of an image, or its inverse; absent places are 0.

    Separable: the entries of a block's column meet in one grouped sum and come out transformed, then those of its rows.
    """
    b = _basis(size)

    def along(x: DataFrame, axis: str, other: str) -> DataFrame:
        digit = F.pmod(axis, F.lit(size))
        parts = [F.sum(F.when(digit == k, F.col("v"))).alias(f"v{k}") for k in range(size)]
        met = x.groupBy(F.floor(F.col(axis) / size).alias("__block"), other).agg(*parts).fillna(0.0)
        weight = lambda u, k: b[k][u] if inverse else b[u][k]
        sums = [sum((F.col(f"v{k}") * weight(u, k) for k in range(1, size)), F.col("v0") * weight(u, 0)) for u in range(size)]
        out = met.select("__block", other, F.posexplode(F.array(*sums)).alias("u", "v"))
        return out.select((F.col("__block") * size + F.col("u")).alias(axis), other, "v")

    return along(along(image.select("i", "j", F.col("v").cast("double").alias("v")), "i", "j"), "j", "i").select("i", "j", "v")


def quantised(coefficients: DataFrame, step: Column) -> DataFrame:
    """Coefficients as whole multiples of a step, halves upwards (a billionth below one counts as one)."""
    return coefficients.select("i", "j", F.floor(F.col("v") / step + 0.5 + 1e-9).cast("bigint").alias("q"))


def dequantised(coefficients: DataFrame, step: Column) -> DataFrame:
    return coefficients.select("i", "j", (F.col("q") * step).cast("double").alias("v"))
