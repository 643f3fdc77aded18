"""Running values of any associative operation over rows in a global order, also by groups, in two levels.

Rows are dealt out by ranges of (group, order) and written once; each range is scanned alone, one row a range and group
is scanned over the ranges, and what a range has before it is added. A group may be larger than a range or smaller: no
task holds more than a range, and whatever the keys' spread, ranges have about equal numbers of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilefold.functions.staging import saved


@dataclass(frozen=True)
class Operation:
    """An aggregate over rows, what puts two of its results together (either may be null), and its value over no rows."""

    over: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]
    empty: int | None = None


def _either(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.coalesce(f(a, b), a, b)


SUM = Operation(F.sum, _either(lambda a, b: a + b), 0)
LARGEST = Operation(F.max, F.greatest)
LEAST = Operation(F.min, F.least)
ANY = Operation(F.bit_or, _either(lambda a, b: a.bitwiseOR(b)), 0)


def scan(rows: DataFrame, order: list[str | Column], value: str | Column, into: str, operation: Operation = SUM, by: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """rows with `into`, the operation over the values of all rows of their group (`by`, or all rows) up to them, or before
    them. Rows of equal order follow each other in any order. Null values are no values, and null groups are a group.
    """
    by = by or []
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(value) if isinstance(value, str) else value
    placed = saved(rows.withColumn("__v", value).repartitionByRange(spread, *by, *order).withColumn("__range", F.spark_partition_id()), "scans")
    upto = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = operation.over(F.col("__v")).over(upto)
    sums = placed.groupBy("__range", *by).agg(operation.over(F.col("__v")).alias("__sum"))
    before = operation.over(F.col("__sum")).over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    # a range shares at most its first group with the ranges before it: so this has at most a row a range
    ahead = sums.select("__range", *(F.col(c).alias(f"__{c}") for c in by), before.alias("__ahead")).where("__ahead is not null").withColumnRenamed("__range", "__at")
    same = F.col("__range") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = placed.withColumn("__own", own).join(F.broadcast(ahead), same, "left")
    both = operation.both(F.col("__ahead"), F.col("__own"))
    return joined.withColumn(into, F.coalesce(both, F.lit(operation.empty)) if operation.empty is not None else both).drop("__v", "__range", "__own", "__at", "__ahead", *(f"__{c}" for c in by))


def completed(a: DataFrame) -> DataFrame:
    """(i, j, v): A with a place in every row that has an entry, for every column from its least to its greatest; absent
    entries are 0."""
    ends = a.agg(F.min("j").alias("least"), F.max("j").alias("most")).first()
    if ends["least"] is None:
        return a.select("i", "j", "v")
    rows = a.select("i").distinct().select("i", F.explode(F.sequence(F.lit(ends["least"]), F.lit(ends["most"]))).alias("j"))
    summed = a.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return rows.join(summed, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0)).alias("v"))


def summed_area(image: DataFrame) -> DataFrame:
    """(i, j, s) of an image (i, j, v) whose rows all have the same columns (see completed()): the sum of all places above
    and left, the place itself included; a running sum along the rows, and one of these down the columns."""
    along = scan(image.select("i", "j", "v"), ["j"], "v", "__row", by=["i"])
    return scan(along, ["i"], "__row", "s", by=["j"]).select("i", "j", "s")


def box_sums(area: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes (..., i0, j0, i1, j1, both ends included) with `s`, the sum of the image in each, from four places of its
    summed_area(): the last place of the image that is not beyond the corner. Rows and columns are consecutive numbers; a
    box or a part of one outside the image adds nothing."""
    ends = area.agg(*(f(c).alias(n) for n, f, c in (("r0", F.min, "i"), ("r1", F.max, "i"), ("c0", F.min, "j"), ("c1", F.max, "j")))).first()
    if ends["r0"] is None:
        return boxes.withColumn("s", F.lit(0))
    named = boxes.withColumn("__box", F.struct(*boxes.columns))
    corner = lambda i, j, sign: F.struct(F.least(i, F.lit(ends["r1"])).alias("i"), F.least(j, F.lit(ends["c1"])).alias("j"), F.lit(sign).alias("sign"))
    i0, j0 = F.col("i0") - 1, F.col("j0") - 1
    four = F.array(corner(F.col("i1"), F.col("j1"), 1), corner(i0, F.col("j1"), -1), corner(F.col("i1"), j0, -1), corner(i0, j0, 1))
    real = (F.col("i0") <= F.col("i1")) & (F.col("j0") <= F.col("j1"))
    asked = named.select("__box", F.explode(F.when(real, four).otherwise(F.slice(four, 1, 0))).alias("e")).select("__box", "e.i", "e.j", "e.sign").distinct()
    found = asked.join(area, ["i", "j"]).groupBy("__box").agg(F.sum(F.col("sign") * F.col("s")).alias("s"))
    out = named.join(found, "__box", "left")
    return out.select(*boxes.columns, F.coalesce("s", F.lit(0)).alias("s"))


def line_of_sight(points: DataFrame, ray: str = "ray", distance: str = "distance", height: str = "height", eye: float = 0.0) -> DataFrame:
    """points with `visible`: whether the slope to them from the ray's start, at height `eye`, is above that to every point
    before them. Points at equal distance do not hide each other."""
    slope = (F.col(height) - eye) / F.col(distance)
    steepest = points.groupBy(ray, distance).agg(F.max(slope).alias("__slope"))
    known = scan(steepest, [distance], "__slope", "__before", LARGEST, by=[ray], inclusive=False).drop("__slope")
    seen = points.join(known, [ray, distance]).withColumn("visible", F.col("__before").isNull() | (slope > F.col("__before")))
    return seen.drop("__before")
