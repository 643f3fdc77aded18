"""The k-th largest value, exactly, by narrowing counts; the values themselves stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of one pass, and values that are sorted at the end at most.
BINS, FEW = 1024, 4096


def kth_largest(rows: DataFrame, value: str, k: int) -> float | None:
    """The k-th largest (from 1 on) of the values, repeated ones counted as often as they occur; null if there are fewer.

    Each pass counts the values by bins of the interval that holds the answer, some BINS rows, and goes on with the bin that holds
    it, from its least to its largest value; a bin number never falls as the value grows, so rounding does no harm. It
    ends when all values left are equal or FEW are left, which are sorted.
    """
    x = rows.select(F.col(value).cast("double").alias("x")).where("x is not null")
    low, high, n = x.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if k < 1 or k > n:
        return None
    while low < high and n > FEW:
        own = x.where((F.col("x") >= low) & (F.col("x") <= high))
        place = F.least(F.floor((F.col("x") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for r in own.groupBy(place.alias("bin")).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).orderBy(F.desc("bin")).collect():
            if k <= r["n"]:
                break
            k -= r["n"]
        if (r["low"], r["high"], r["n"]) == (low, high, n):  # neighbouring numbers: no bin parts them
            break
        low, high, n = r["low"], r["high"], r["n"]
    if low == high:
        return low
    left = x.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").agg(F.count("*").alias("n")).orderBy(F.desc("x"))
    for r in left.limit(FEW).collect():
        if k <= r["n"]:
            return r["x"]
        k -= r["n"]
    return low
