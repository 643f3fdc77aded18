"""Matrix Market text, Parquet caches and labelled tile files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Header(NamedTuple):
    """Banner and size line of a Matrix Market file."""

    layout: str
    kind: str
    symmetry: str
    rows: int
    cols: int
    entries: int


KINDS = ("real", "integer", "pattern", "complex")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


def _fields(value: str = "value") -> Column:
    return F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")


def read_header(spark: SparkSession, path: str) -> Header:
    """The banner and, in its file, the first line that is neither a comment nor empty."""
    return _header(spark, path)[0]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither empty nor comments but for the banner, with their file, block and number in reading order."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return text.where("trim(value) <> '' and (not startswith(value, '%') or startswith(lower(value), '%%matrixmarket'))")


def _header(spark: SparkSession, path: str) -> tuple[Header, Column]:
    """The header, and which of _lines() are entries."""
    text = _lines(spark, path)
    banner = text.where("startswith(value, '%')").first()
    if banner is None:
        raise ValueError("no Matrix Market banner")
    _, what, layout, kind, symmetry = banner["value"].lower().split()
    if what != "matrix" or layout not in ("coordinate", "array") or kind not in KINDS or symmetry not in SYMMETRIES:
        raise ValueError(f"unsupported banner: {banner[0]}")
    found = text.where((F.col("path") == banner["path"]) & ~F.col("value").startswith("%")).orderBy("block", "line").first()
    size = [int(x) for x in found["value"].split()]
    rows, cols = size[:2]
    is_size = (F.col("path") == found["path"]) & (F.col("block") == found["block"]) & (F.col("line") == found["line"])
    return Header(layout, kind, symmetry, rows, cols, size[2] if layout == "coordinate" else rows * cols), ~is_size & ~F.col("value").startswith("%")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) from 0. Pattern entries are 1, imaginary parts are dropped, symmetric and hermitian entries are mirrored;
    skew-symmetric ones are not. Duplicates stay."""
    head, entry = _header(spark, path)
    if head.layout != "coordinate":
        raise ValueError("use read_array for array files")
    fields = _lines(spark, path).where(entry).select(_fields().alias("f"))
    v = F.lit(1.0) if head.kind == "pattern" else F.col("f")[2].cast("double")
    coo = fields.select((F.col("f")[0].cast("bigint") - 1).alias("i"), (F.col("f")[1].cast("bigint") - 1).alias("j"), v.alias("v"))
    return mirrored(coo) if head.symmetry in ("symmetric", "hermitian") else coo


def mirrored(coo: DataFrame) -> DataFrame:
    return coo.unionByName(coo.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines (value, path, block, line) with `k`, their number in the order of files, blocks and lines: lines are counted
    a block, the few counts are summed up in order, and each block is numbered alone."""
    counts = lines.groupBy("path", "block").agg(F.count("*").alias("n"))
    ahead = counts.select("path", "block", F.coalesce(F.sum("n").over(Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    own = lines.withColumn("own", F.row_number().over(Window.partitionBy("path", "block").orderBy("line")) - 1)
    return own.join(ahead, ["path", "block"]).select("value", (F.col("ahead") + F.col("own")).alias("k"))


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of a dense array file, whose values run down the columns."""
    head, entry = _header(spark, path)
    values = numbered(_lines(spark, path).where(entry))
    return values.select((F.col("k") % head.rows).cast("bigint").alias("i"), F.floor(F.col("k") / head.rows).cast("bigint").alias("j"), _fields()[0].cast("double").alias("v"))


def write_array(a: DataFrame, path: str, rows: int, cols: int) -> None:
    """A folder of text parts that together are a dense array file; absent entries are 0."""
    spark = a.sparkSession
    every = spark.range(rows * cols).select(F.col("id").alias("k"))
    known = a.groupBy((F.col("j") * rows + F.col("i")).alias("k")).agg(F.sum("v").alias("v"))
    head = spark.createDataFrame([("%%MatrixMarket matrix array real general",), (f"{rows} {cols}",)], "value string").coalesce(1)
    body = every.join(known, "k", "left").orderBy("k").select(F.coalesce("v", F.lit(0.0)).cast("string").alias("value"))
    head.unionByName(body).write.text(path)


def write_matrix(coo: DataFrame, path: str, rows: int, cols: int, kind: str = "real", symmetry: str = "general") -> None:
    """A folder of text parts that together are a coordinate file; the header is in the first part by name."""
    spark = coo.sparkSession
    n = coo.count()
    entry = ["i", "j"] if kind == "pattern" else ["i", "j", "v"]
    shown = [F.format_string("%d", F.col(c) + 1) if c != "v" else F.col(c).cast("string") for c in entry]
    head = spark.createDataFrame([(f"%%MatrixMarket matrix coordinate {kind} {symmetry}",), (f"{rows} {cols} {n}",)], "value string").coalesce(1)
    head.unionByName(coo.select(F.concat_ws(" ", *shown).alias("value"))).write.text(path)


def cached(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """The matrix of a text file, through a Parquet copy that is written at the first read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        read_matrix(spark, path).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def read_tiles(spark: SparkSession, folder: str, side: int = 16) -> DataFrame:
    """(bits, label) of labelled tile files <LABEL>.txt or folders label=<LABEL>; shorter lines (a leading count, fragments) are left out."""
    text = spark.read.text(folder)
    label = F.col("label") if "label" in text.columns else F.regexp_extract(F.col("_metadata.file_path"), r"([^/.]+)\.[^/]*$", 1)
    text = text.select(label.alias("label"), F.substring_index(F.trim("value"), " ", 1).alias("line"))
    return text.where(F.length("line") >= side * side).select(F.substring("line", 1, side * side).alias("bits"), "label")


def write_tiles(tiles: DataFrame, folder: str) -> None:
    """One folder a label, a 0/1 line a tile."""
    tiles.select("label", F.col("bits").alias("value")).write.partitionBy("label").text(folder)


def random_tiles(spark: SparkSession, n: int = 6000, density: float = 0.95, seed: int = 0, side: int = 16) -> DataFrame:
    bits = F.concat(*(F.when(F.rand(seed * 1000 + k) < density, "1").otherwise("0") for k in range(side * side)))
    return spark.range(n).select("id", bits.alias("bits"))


def list_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the .mtx files of a folder that do not start with an underscore."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mtx").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.mtx$", 1).alias("name")).where("name <> '' and not startswith(name, '_')")


def tile_matrix(tiles: DataFrame, side: int = 16) -> DataFrame:
    """(i, j, v) of tiles (ti, tj, bits), every set bit a one."""
    ones = tiles.select("ti", "tj", F.posexplode(F.split("bits", "")).alias("p", "bit")).where("bit = '1'")
    return ones.select((F.col("ti") * side + F.floor(F.col("p") / side)).alias("i"), (F.col("tj") * side + F.col("p") % side).alias("j"), F.lit(1.0).alias("v"))
