"""What the operators of this subpackage share: staging, Arrow row mapping, global order."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; with long texts the byte bound below cuts batches earlier.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that hold texts, so that memory does not follow document length times 10,000.

    These are settings of the session: Spark has none for a single operator.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a fresh local one if the
    session is local, and else an error: executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tilefold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tilefold/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended: the folder then goes with the cluster's own cleaning
        pass


def stage(df: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone; null texts are empty. Other columns, whatever their names, are left behind."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_documents(df: DataFrame, make: Callable[[], Callable], schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows of (doc_id, text) through a Python function, batch by batch.

    make() runs once a task and returns f(doc_ids, texts) -> iterable of tuples in the schema's order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            rows = f(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
            yield from record_batches(rows, arrow)

    tune(df.sparkSession)
    return df.select("doc_id", "text").mapInArrow(run, schema)


def gathered(batches: Iterable[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches put together until they have so many bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def record_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def remainder(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as remainder 0 (held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_offsets(df: DataFrame, order: list[str], size: str, into: str, name: str, path: str | None = None) -> tuple[DataFrame, str]:
    """df in a global order with the exclusive prefix sum of a size column, without one task that sees all rows.

    Rows are range-partitioned and sorted, each task adds its own running sum, the result is staged, and one row
    a partition (their number is the bound) gives the partitions' offsets.
    """
    spark = df.sparkSession
    cols = df.columns
    ordered = df.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    fields = [f for f in ordered.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", __part bigint, __run bigint, __rank bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, total, seen = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.num_rows
            sizes = b.column(cols.index(size)).to_numpy(zero_copy_only=False).astype("int64")
            ends = total + np.cumsum(sizes)
            more = [pa.array(np.full(n, part, "int64")), pa.array(ends - sizes), pa.array(np.arange(seen, seen + n))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*cols, "__part", "__run", "__rank"])
            total, seen = int(ends[-1]) if n else total, seen + n

    staged, path = stage(ordered.mapInArrow(run, schema), name, path)
    sums = staged.groupBy("__part").agg(F.max(F.col("__run") + F.col(size)).alias("s"), F.count("*").alias("c")).orderBy("__part").collect()
    offsets, at, rank = [], 0, 0
    for r in sums:
        offsets.append((r["__part"], at, rank))
        at, rank = at + r["s"], rank + r["c"]
    table = spark.createDataFrame(offsets, "__part bigint, __at bigint, __first bigint")
    out = staged.join(F.broadcast(table), "__part")
    return out.select(*cols, (F.col("__at") + F.col("__run")).alias(into), (F.col("__first") + F.col("__rank")).alias(f"{into}_rank")), path
