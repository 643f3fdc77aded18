"""Tasks, result logs, samples and accuracy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.operators import matrix as M


def still_to_run(tasks: DataFrame, done: DataFrame, key: str, skip: list[str] = ()) -> DataFrame:
    """Tasks without a result whose name holds none of the skipped words."""
    left = tasks.join(done.select(key).distinct(), key, "left_anti")
    for word in skip:
        left = left.where(~F.col(key).contains(word))
    return left


def present(tasks: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return tasks.join(files.select(key).distinct(), key, "left_semi")


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def best_times(runs: DataFrame, key: str, ms: str) -> DataFrame:
    return runs.groupBy(key).agg(F.min(ms).alias("ms"))


def sample_without(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows at random; the n is the feature."""
    return rows.orderBy(F.rand(seed)).limit(n)


def labelled_everywhere(tiles: DataFrame, label: str, platforms: int) -> DataFrame:
    """Bit strings that have the label on all platforms."""
    return tiles.where(F.col("label") == label).groupBy("bits").agg(F.count_distinct("platform").alias("n")).where(F.col("n") == platforms).select("bits")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def accuracy(pairs: DataFrame) -> DataFrame:
    """Right answers by label, and of each label the true and false positives and false negatives."""
    hit = F.col("label") == F.col("predicted")
    own = pairs.groupBy(F.col("label").alias("class")).agg(F.sum(hit.cast("bigint")).alias("tp"), F.sum((~hit).cast("bigint")).alias("fn"))
    other = pairs.groupBy(F.col("predicted").alias("class")).agg(F.sum((~hit).cast("bigint")).alias("fp"))
    return own.join(other, "class", "full").select("class", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))


def accuracy_matrix(results: DataFrame, tests: list[str]) -> DataFrame:
    """Models by test sets."""
    return results.groupBy("model").pivot("test", tests).agg(F.first("accuracy"))


def said_number(column: str, name: str):
    """The number after `name:` or `name =` in a line of output."""
    return F.try_to_number(F.regexp_extract(column, rf"(?i){name}\s*[:=]\s*([0-9.]+)", 1), F.lit("999999999.999999")).cast("double")


def append_csv(rows: DataFrame, path: str) -> None:
    """Rows added to a result log of CSV files with a header each."""
    rows.write.mode("append").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def with_errors(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the error log: the others with the name of the first rule they break (a rule that is
    neither true nor false is broken)."""
    broken = F.coalesce(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    told = rows.withColumn("error", broken)
    return told.where("error is null").drop("error"), told.where("error is not null")


def without_sampled(rows: DataFrame, sampled: DataFrame, key: str) -> DataFrame:
    return rows.join(sampled.select(key).distinct(), key, "left_anti")


def sample_by_hash(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows of the least MD5 of their key, the same in every run; the n is the feature."""
    return rows.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """rows with `rank`, their place in an order by hash of the seed and the key."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    lead = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    return M.ranked(rows.withColumns({"lead": lead, "digest": h}), "lead", "digest", key).drop("lead", "digest")


def merged(old: DataFrame, new: DataFrame, key: str, value: str, merge) -> DataFrame:
    """A keyed table with another one put in: merge(old value, new value) where both have the key."""
    both = old.select(key, F.col(value).alias("x")).join(new.select(key, F.col(value).alias("y")), key, "full")
    out = F.when(F.col("x").isNull(), F.col("y")).when(F.col("y").isNull(), F.col("x")).otherwise(merge(F.col("x"), F.col("y")))
    return both.select(key, out.alias(value))


# fixed values: the families of platforms, by what a device's name starts with
PLATFORMS = ("20", "30", "40", "50")


def platform(name: str) -> Column:
    """The family that a device's name starts with, or null."""
    return F.coalesce(*(F.when(F.col(name).startswith(p), F.lit(p)) for p in PLATFORMS))


def model_for(tasks: DataFrame, models: DataFrame) -> DataFrame:
    """Tasks (platform, op) with the model that is set for them; one without a platform holds for all others."""
    own = models.where("platform is not null").select("platform", "op", F.col("model").alias("own"))
    rest = models.where("platform is null").select("op", F.col("model").alias("rest"))
    return tasks.join(own, ["platform", "op"], "left").join(rest, "op", "left").withColumn("model", F.coalesce("own", "rest")).drop("own", "rest")


def speeds(runs: DataFrame, key: str, flops: str, ms: str, baseline: float) -> DataFrame:
    """Mean GFLOPS of each key over its runs, and the ratio to a baseline."""
    g = runs.withColumn("g", M.gflops(F.col(flops), F.col(ms))).groupBy(key).agg(F.avg("g").alias("gflops"))
    return g.withColumn("ratio", F.col("gflops") / baseline)
