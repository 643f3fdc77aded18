"""A result log fed by a stream: task rows arrive as files, those without a result are worked on once and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tilefold.operators.records import still_to_run


def resume(spark: SparkSession, tasks: DataFrame, log: str, key: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Append work(tasks without a result) to the log, batch by batch, until the input is used up.

    A batch that is run again after a failure finds its results in the log and adds none.
    """

    def batch(rows: DataFrame, _: int) -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
        rows = rows.dropDuplicates([key])
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            rows = still_to_run(rows, spark.read.parquet(log), key)
        work(rows).write.mode("append").parquet(log)

    return tasks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
