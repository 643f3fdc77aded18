"""Tables that end a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Where the tables of saved() are, while their DataFrames live.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


#: Rows of a task of dealt().
ROWS = 1 << 17


def saved(df: DataFrame, name: str, instead_of: DataFrame | list[DataFrame] | None = None) -> DataFrame:
    """df written below the shared folder and read again. Tables that saved() gave before, and that nothing reads any more
    once this one is written, are removed: a loop keeps one round's tables and not all."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out, lambda _, k=id(out): _PATHS.pop(k, None)), path)
    for old in [instead_of] if isinstance(instead_of, DataFrame) else instead_of or []:
        if id(old) in _PATHS:
            _remove(spark, _PATHS.pop(id(old))[1])
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables that saved() gave, which have the same columns, by one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(_PATHS[id(t)][1] for t in tables))


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt by some columns to tasks of ROWS each, if it has so many rows. Adaptive execution sizes tasks by compressed
    bytes, which say little where values repeat; here a task's memory stays the same whatever the size."""
    return df.repartition(1 + rows // ROWS, *by)


def new_path(spark: SparkSession, name: str) -> str:
    """A path below spark.checkpoint.dir that is removed when the driver's Python ends. Where the setting is unset, a fresh
    local folder if the session is local, and else an error: executors do not see each other's disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tilefold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/tilefold-{name}/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended: the folder then goes with the cluster's own cleaning
        pass
