"""Commands of python -m tilefold.cli.

spmv, spmm, spgemm, formats FILE.mtx [--repeat N]: one CSV row a run.
mrun FOLDER --operation spmv --log LOG [--leave-out NAME ...]: all matrices of a folder that the log has no row of; rows
are added to the log (a folder of CSV files) one matrix at a time, so a run that was stopped goes on where it was.
fmt_data FOLDER OUT: labelled tiles without copies, written again as a folder a label.
switch_model TASKS.csv MODELS.csv OUT: the model of each task (platform, op), that of its platform before the general one.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.operators import matrix as M
from tilefold.operators import records as R
from tilefold.sources import matrix_market


def timed(run, repeat: int) -> float:
    """Least milliseconds of so many runs."""
    best = float("inf")
    for _ in range(repeat):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        best = min(best, 1000 * (time.perf_counter() - began))
    return best


def measured(spark: SparkSession, operation: str, file: str, repeat: int, columns: int = 8) -> tuple:
    """file, rows, columns, entries, milliseconds and GFLOPS of an operation on a matrix."""
    head = matrix_market.read_header(spark, file)
    a: DataFrame = matrix_market.read_matrix(spark, file).cache()
    nnz = a.count()
    ones = spark.range(head.cols).select(F.col("id").alias("j"), F.lit(1.0).alias("x"))
    if operation == "spmv":
        ms, flops = timed(lambda: M.spmv(a, ones), repeat), nnz
    elif operation == "spmm":
        b = ones.select("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"), F.col("x").alias("b"))
        ms, flops = timed(lambda: M.spmm(a, b), repeat), nnz * columns
    elif operation == "spgemm":
        M.square_guard(head.rows, head.cols)
        flops = M.product_counts(a, a).agg(F.coalesce(F.sum("products"), F.lit(0))).first()[0]
        ms = timed(lambda: M.spgemm(a, a), repeat)
    else:
        ms, flops = timed(lambda: M.choose_format(M.format_costs(M.tile_figures(M.tiles(a)))), repeat), 0
    a.unpersist()
    return file, head.rows, head.cols, nnz, ms, 2 * flops / ms / 1e6


LOG = "name string, operation string, rows bigint, cols bigint, nnz bigint, ms double, gflops double"


def run_all(spark: SparkSession, folder: str, operation: str, log: str, repeat: int = 3, leave_out: list[str] | None = None, columns: int = 8) -> list[str]:
    """Names of the matrices measured now: those of the folder whose name holds none of `leave_out` and of which the log
    has no row of this operation. A matrix that fails has a row without figures, so that it is not tried again."""
    tasks = matrix_market.list_matrices(spark, folder)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        done = spark.read.schema(LOG).csv(log).where(F.col("operation") == operation).select("name")
    else:
        done = spark.createDataFrame([], "name string")
    names = [r["name"] for r in R.still_to_run(tasks, done, "name", leave_out or []).orderBy("name").collect()]
    for name in names:
        try:
            found = (name, operation, *measured(spark, operation, f"{folder}/{name}.mtx", repeat, columns)[1:])
        except Exception as e:  # noqa: BLE001  what one matrix cannot do must not end the list; the log says which
            print(f"{name}: {type(e).__name__}: {e}")
            found = (name, operation, None, None, None, None, None)
        spark.createDataFrame([found], LOG).write.mode("append").csv(log)
    return names


def main(args: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(prog="tilefold")
    sub = p.add_subparsers(dest="command", required=True)
    operations = ["spmv", "spmm", "spgemm", "formats"]
    for name in operations:
        one = sub.add_parser(name)
        one.add_argument("file")
    many = sub.add_parser("mrun")
    many.add_argument("folder")
    many.add_argument("--operation", choices=operations, default="spmv")
    many.add_argument("--log", required=True)
    many.add_argument("--leave-out", nargs="*", default=[])
    for x in (*(sub.choices[n] for n in operations), many):
        x.add_argument("--repeat", type=int, default=3)
        x.add_argument("--columns", type=int, default=8)
    again = sub.add_parser("fmt_data")
    again.add_argument("folder")
    again.add_argument("out")
    switch = sub.add_parser("switch_model")
    for name in ("tasks", "models", "out"):
        switch.add_argument(name)
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if o.command == "mrun":
        out = ",".join(run_all(spark, o.folder, o.operation, o.log, o.repeat, o.leave_out, o.columns))
    elif o.command == "fmt_data":
        matrix_market.write_tiles(matrix_market.read_tiles(spark, o.folder).dropDuplicates(["bits"]), o.out)
        out = o.out
    elif o.command == "switch_model":
        tasks, models = (spark.read.option("header", True).csv(x) for x in (o.tasks, o.models))
        R.model_for(tasks, models).write.option("header", True).csv(o.out)
        out = o.out
    else:
        file, rows, cols, nnz, ms, gflops = measured(spark, o.command, o.file, o.repeat, o.columns)
        out = f"{file},{rows},{cols},{nnz},{ms:.3f},{gflops:.6f}"
    print(out)
    return out


if __name__ == "__main__":
    main()
