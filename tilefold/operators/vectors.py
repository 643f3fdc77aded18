"""Sequence algorithms over vectors (i, x): searches, runs, scans, comparisons and permutations.

A neighbour is found by a join on the index and a running sum by blocks, so no task needs the whole vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefold.operators.matrix import exclusive_scan


def with_previous(x: DataFrame) -> DataFrame:
    """Entries with `was`, the entry at i - 1, and `has`, whether there is one."""
    before = x.select((F.col("i") + 1).alias("i"), F.col("x").alias("was"), F.lit(True).alias("has"))
    return x.join(before, "i", "left").withColumn("has", F.coalesce("has", F.lit(False)))


def adjacent_difference(x: DataFrame) -> DataFrame:
    return with_previous(x).select("i", F.when(F.col("has"), F.col("x") - F.col("was")).otherwise(F.col("x")).alias("x"))


def adjacent_find(x: DataFrame) -> DataFrame:
    """One row: the first index whose entry equals the next one."""
    return with_previous(x).where("has and x = was").agg((F.min("i") - 1).alias("at"))


def sorted_until(x: DataFrame) -> DataFrame:
    """One row: the first index whose entry is less than the one before it, null if the vector is sorted."""
    return with_previous(x).where("has and x < was").agg(F.min("i").alias("at"))


def unique(x: DataFrame) -> DataFrame:
    """Of equal neighbours the first."""
    return with_previous(x).where("not (has and x <=> was)").select("i", "x")


def inclusive_scan(x: DataFrame) -> DataFrame:
    return exclusive_scan(x, "i", "x").select("i", (F.col("before") + F.col("x")).alias("x"))


def runs(x: DataFrame) -> DataFrame:
    """(start, length, x) of each maximal run of equal neighbours."""
    marked = with_previous(x).withColumn("new", F.when(F.col("has") & F.col("x").eqNullSafe(F.col("was")), 0).otherwise(1))
    run = exclusive_scan(marked, "i", "new").withColumn("run", F.col("before") + F.col("new"))
    return run.groupBy("run").agg(F.min("i").alias("start"), F.count("*").alias("length"), F.min("x").alias("x")).select("start", "length", "x")


def search_n(x: DataFrame, n: int, value) -> DataFrame:
    """One row: the first index from which n entries equal a value."""
    return runs(x).where((F.col("length") >= n) & (F.col("x") == value)).agg(F.min("start").alias("at"))


def occurrences(x: DataFrame, pattern: list) -> DataFrame:
    """Every start of a pattern. Each entry votes for the starts that it fits; len(pattern) votes make one."""
    if not pattern:
        return x.select("i")
    wanted = F.array(*(F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(p).alias("p")) for k, p in enumerate(pattern)))
    votes = x.select("i", "x", F.explode(wanted).alias("w")).where("x = w.p").select((F.col("i") - F.col("w.k")).alias("i"))
    return votes.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") == len(pattern)).select("i")


def first_and_last(found: DataFrame) -> DataFrame:
    return found.agg(F.min("i").alias("first"), F.max("i").alias("last"))


def find_first_of(x: DataFrame, values: DataFrame) -> DataFrame:
    """One row: the first index whose entry is one of values (x)."""
    return x.join(values.select("x"), "x", "left_semi").agg(F.min("i").alias("at"))


def mismatch(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: the first index where two vectors differ or only one has an entry; null if they are equal."""
    both = x.withColumn("a", F.lit(True)).join(y.select("i", F.col("x").alias("y"), F.lit(True).alias("b")), "i", "full")
    return both.where("a is null or b is null or not (x <=> y)").agg(F.min("i").alias("at"))


def extremes(x: DataFrame) -> DataFrame:
    """One row: least and greatest entry and the first index of each, and the first index of the greatest absolute one."""
    least, most, size = F.min(F.struct("x", "i")), F.max(F.struct("x", (-F.col("i")).alias("n"))), F.max(F.struct(F.abs("x").alias("a"), (-F.col("i")).alias("n")))
    return x.agg(least.alias("l"), most.alias("m"), size.alias("s")).select(F.col("l.x").alias("least"), F.col("l.i").alias("least_at"), F.col("m.x").alias("most"), (-F.col("m.n")).alias("most_at"), (-F.col("s.n")).alias("largest_at"))


def partition_point(x: DataFrame, holds: Column) -> DataFrame:
    """One row: the first index where a condition fails, and whether it holds nowhere after that."""
    first, last = F.min(F.when(~holds, F.col("i"))), F.max(F.when(holds, F.col("i")))
    return x.agg(first.alias("at"), F.coalesce(last < first, F.lit(True)).alias("partitioned"))


def reverse(x: DataFrame) -> DataFrame:
    return x.select((length(x) - 1 - F.col("i")).alias("i"), "x")


def length(x: DataFrame) -> Column:
    """The number of entries, as a subquery of the plan."""
    return x.agg(F.count("*")).scalar()


def rotate(x: DataFrame, k: int) -> DataFrame:
    return x.select(F.pmod(F.col("i") - k, length(x)).alias("i"), "x")


def shift(x: DataFrame, k: int) -> DataFrame:
    """Entries k places to the left (right if negative); what leaves [0, n) is gone."""
    return x.select((F.col("i") - k).alias("i"), "x").where((F.col("i") >= 0) & (F.col("i") < length(x)))


def histogram(x: DataFrame, low, width) -> DataFrame:
    return x.groupBy(F.floor((F.col("x") - low) / width).alias("bin")).agg(F.count("*").alias("n"))


def walsh(x: DataFrame, bits: int) -> DataFrame:
    """Walsh-Hadamard transform of a vector of 2**bits entries, one grouped sum a bit."""
    for b in range(bits):
        one = F.lit(1 << b).cast("bigint")
        set_ = F.col("i").bitwiseAND(one) != 0
        low = F.struct(F.col("i").bitwiseAND(F.bitwise_not(one)).alias("i"), F.col("x"))
        high = F.struct(F.col("i").bitwiseOR(one).alias("i"), F.when(set_, -F.col("x")).otherwise(F.col("x")).alias("x"))
        x = x.select(F.explode(F.array(low, high)).alias("e")).groupBy(F.col("e.i").alias("i")).agg(F.sum("e.x").alias("x"))
    return x


def haar(x: DataFrame) -> DataFrame:
    """One level of the Haar transform, not normalised: (i, total, difference) of entries 2i and 2i + 1."""
    return x.groupBy(F.shiftright("i", 1).alias("i")).agg(F.sum("x").alias("total"), F.sum(F.when(F.col("i") % 2 == 0, F.col("x")).otherwise(-F.col("x"))).alias("difference"))


def convolve(a: DataFrame, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """(i, j, v) of a two-dimensional stencil over (i, j, v): the sum of w * a[i + di, j + dj]; absent entries are 0."""
    taps = F.array(*(F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit(float(w)).alias("w")) for (di, dj), w in kernel.items()))
    spread = a.select("i", "j", "v", F.explode(taps).alias("k")).select((F.col("i") - F.col("k.di")).alias("i"), (F.col("j") - F.col("k.dj")).alias("j"), (F.col("v") * F.col("k.w")).alias("v"))
    return spread.groupBy("i", "j").agg(F.sum("v").alias("v"))


def box(radius: int) -> dict[tuple[int, int], float]:
    side = range(-radius, radius + 1)
    return {(i, j): 1.0 for i in side for j in side}
