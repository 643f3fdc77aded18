"""Queries over the tables of one folder, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.functions import bits as B
from tilefold.operators import batched
from tilefold.operators import matrix as M
from tilefold.operators import graph as G
from tilefold.operators import records as R
from tilefold.operators import solvers as V
from tilefold.operators import tiled
from tilefold.operators import vectors as W
from tilefold.plans import products as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Matrices of the line items, as SQL: suppliers by parts, orders by parts, and a square one of both modulo 512.
_LINES = "FROM lineitem GROUP BY 1, 2"
_V = "CAST(sum(l_quantity) AS DOUBLE) AS v"
SQL = {
    "a": f"a AS (SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, {_V} {_LINES})",
    "o": f"o AS (SELECT CAST(l_orderkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, {_V} {_LINES})",
    "s": f"s AS (SELECT CAST(l_partkey % 512 AS BIGINT) AS i, CAST(l_orderkey % 512 AS BIGINT) AS j, {_V} {_LINES})",
    "q": "q AS (SELECT CAST(o_orderkey AS BIGINT) AS i, CAST(o_custkey % 5 AS BIGINT) AS x FROM orders)",
    "x": "x AS (SELECT CAST(p_partkey AS BIGINT) AS j, CAST(p_partkey % 10 AS DOUBLE) AS x FROM part)",
}


def lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def a_sp(spark: SparkSession, d: str) -> DataFrame:
    return M.matrix(lines(spark, d), "l_suppkey", "l_partkey", "l_quantity")


def a_op(spark: SparkSession, d: str) -> DataFrame:
    return M.matrix(lines(spark, d), "l_orderkey", "l_partkey", "l_quantity")


def square(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).select((F.col("l_partkey") % 512).alias("i"), (F.col("l_orderkey") % 512).alias("j"), "l_quantity")
    return M.matrix(rows, "i", "j", "l_quantity")


def vector(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("j"), (F.col("p_partkey") % 10).cast("double").alias("x"))


def dense(spark: SparkSession, d: str) -> DataFrame:
    """Eight columns from the part keys."""
    return vector(spark, d).select("j", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("c")).select("j", "c", ((F.col("j") * (F.col("c") + 1)) % 7).cast("double").alias("b"))


def query(sql: str | None = None, **names):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def ctes(*names: str, more: str = "") -> str:
    return "WITH " + ", ".join([SQL[n] for n in names] + ([more] if more else [])) + " "


@query(ctes("a") + "SELECT i, j, v FROM a")
def matrix_build(spark, d):
    return a_sp(spark, d)


@query(ctes("a") + "SELECT j AS i, i AS j, v FROM a")
def transpose(spark, d):
    return M.transpose(a_sp(spark, d))


@query(ctes("s") + ", e AS (SELECT i, j, v FROM s WHERE i >= j) SELECT i, j, v FROM e UNION ALL SELECT j AS i, i AS j, v FROM e WHERE i <> j")
def symmetric_expansion(spark, d):
    from tilefold.sources.matrix_market import mirrored

    return mirrored(square(spark, d).where("i >= j"))


@query(ctes("s") + "SELECT i, j, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT i, j, 2 * v AS v FROM s UNION ALL SELECT j AS i, i AS j, -1 * v AS v FROM s) GROUP BY i, j")
def matrix_add(spark, d):
    s = square(spark, d)
    return M.add(s, M.transpose(s), 2.0, -1.0)


@query(ctes("a", "x") + "SELECT i, CAST(sum(v * x) AS DOUBLE) AS y FROM a JOIN x USING (j) GROUP BY i")
def spmv(spark, d):
    return M.spmv(a_sp(spark, d), vector(spark, d))


@query(ctes("o", "x") + "SELECT i, CAST(sum(v * x * 3) AS DOUBLE) AS y FROM o JOIN x USING (j) GROUP BY i")
def spmv_alpha_salted(spark, d):
    return M.spmv(a_op(spark, d), vector(spark, d), 3.0, salts=4)


@query(ctes("o") + "SELECT i, CAST(sum(v) AS DOUBLE) AS y FROM o GROUP BY i")
def spmv_row_sums(spark, d):
    return M.row_sums(a_op(spark, d))


@query(ctes("a", "x", more="b AS (SELECT j, c, CAST((CAST(j AS DOUBLE) * (c + 1)) % 7 AS DOUBLE) AS b FROM x, (SELECT CAST(unnest(range(8)) AS INT) AS c))") + "SELECT i, c, CAST(sum(v * b) AS DOUBLE) AS y FROM a JOIN b USING (j) GROUP BY i, c")
def spmm(spark, d):
    return M.spmm(a_sp(spark, d), dense(spark, d))


@query(ctes("a") + "SELECT p.i, q.i AS j, CAST(sum(p.v * q.v) AS DOUBLE) AS v FROM a p JOIN a q ON p.j = q.j GROUP BY p.i, q.i")
def spgemm_aat(spark, d):
    a = a_sp(spark, d)
    return P.sparse_product(a, M.transpose(a))


@query(ctes("s") + "SELECT p.i, q.j, CAST(sum(p.v * q.v) AS DOUBLE) AS v FROM s p JOIN s q ON p.j = q.i GROUP BY p.i, q.j")
def spgemm_square(spark, d):
    s = square(spark, d)
    return P.spgemm(s, s)


@query(ORACLES["spgemm_square"])
def spgemm_elementwise(spark, d):
    s = square(spark, d)
    return M.spgemm(s, s)


@query(ctes("a") + "SELECT p.i, CAST(count(DISTINCT q.i) AS BIGINT) AS nnz FROM a p JOIN a q ON p.j = q.j GROUP BY p.i")
def spgemm_symbolic(spark, d):
    a = a_sp(spark, d)
    return P.symbolic(a, M.transpose(a))


@query(ctes("s") + "SELECT DISTINCT p.i // 16 AS ti, q.j // 16 AS tj FROM (SELECT DISTINCT i // 16 * 16 AS i, j // 16 AS k FROM s) p JOIN (SELECT DISTINCT i // 16 AS k, j // 16 * 16 AS j FROM s) q USING (k)")
def spgemm_tile_pattern(spark, d):
    s = square(spark, d)
    return M.tile_pattern(s, s)


@query(ctes("o") + "SELECT p.i, CAST(sum(n) AS BIGINT) AS products FROM o p JOIN (SELECT j, count(*) AS n FROM o GROUP BY j) USING (j) GROUP BY p.i")
def product_counts(spark, d):
    o = a_op(spark, d)
    return M.product_counts(o, M.transpose(o))


@query(ctes("s") + "SELECT p.i, q.j, CAST(count(*) AS BIGINT) AS products FROM s p JOIN s q ON p.j = q.i GROUP BY p.i, q.j")
def boolean_product(spark, d):
    s = square(spark, d)
    return M.boolean_tile_product(s, s)


_CHOICE = ctes("s", more="b AS (SELECT i AS j, count(*) AS n FROM s GROUP BY i), t AS (SELECT sum(n) AS p FROM s JOIN b USING (j)), c AS (SELECT (max(i) + 1) * (max(j) + 1) AS cells FROM s)")


@query(_CHOICE + "SELECT CAST(p AS BIGINT) AS products, CAST(cells AS BIGINT) AS cells, CASE WHEN p / cells > 0.1 OR p / cells < 0.001 THEN 'heuristic' ELSE 'learned' END AS model FROM t, c")
def product_ratio_choice(spark, d):
    s = square(spark, d)
    totals = M.product_counts(s, s).agg(F.sum("products").alias("products"))
    cells = s.agg(((F.max("i") + 1) * (F.max("j") + 1)).alias("cells"))
    none = F.lit(0).cast("bigint")
    both = totals.select("products", none.alias("cells")).unionByName(cells.select(none.alias("products"), "cells")).agg(F.sum("products").alias("products"), F.sum("cells").alias("cells"))
    return both.select("products", "cells", M.model_choice(F.col("products"), F.col("cells")).alias("model"))


_ROWS = "r AS (SELECT i // 16 AS ti, j // 16 AS tj, CAST(i % 16 AS INT) AS lr, CAST(bit_or(CAST(1 << CAST(j % 16 AS INT) AS INT)) AS INT) AS mask, CAST(count(DISTINCT j % 16) AS INT) AS n FROM {m} GROUP BY 1, 2, 3)"


def _tile_rows(name: str) -> str:
    return ctes(name, more=_ROWS.format(m=name))


@query(_tile_rows("a") + "SELECT ti, tj, lr, mask, n FROM r")
def tile_row_masks(spark, d):
    t = M.tiles(a_sp(spark, d)).select("ti", "tj", F.posexplode("masks").alias("lr", "mask")).where("mask <> 0")
    return t.select("ti", "tj", "lr", "mask", F.bit_count("mask").cast("int").alias("n"))


@query(ctes("o") + "SELECT i // 16 AS ti, j // 16 AS tj, CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT i % 16 * 16 + j % 16) AS INT) AS nnz FROM o GROUP BY 1, 2")
def tile_popcounts(spark, d):
    return M.tiles(a_op(spark, d)).select("ti", "tj", "entries", F.col("nnz").cast("int").alias("nnz"))


@query(ctes("a") + "SELECT i, j, v FROM a")
def tiles_round_trip(spark, d):
    return M.untiled(M.tile_values(a_sp(spark, d)))


@query(ctes("a") + "SELECT i // 16 AS ti, CAST(count(DISTINCT j // 16) AS BIGINT) AS tiles, CAST(count(*) AS BIGINT) AS nnz FROM a GROUP BY 1")
def tiles_per_row(spark, d):
    return M.elements(a_sp(spark, d)).groupBy("ti").agg(F.count_distinct("tj").alias("tiles"), F.count("*").alias("nnz"))


@query(ctes("a") + "SELECT i, j, CAST(i // 16 AS BIGINT) AS ti, CAST(j // 16 AS BIGINT) AS tj, CAST(i % 16 AS INT) AS lr, CAST(j % 16 AS INT) AS lc, CAST((i % 16) // 8 * 128 + (j % 16) // 8 * 64 + i % 8 * 8 + j % 8 AS INT) AS place FROM a")
def tile_coordinates(spark, d):
    return M.elements(a_sp(spark, d)).select("i", "j", "ti", "tj", "lr", "lc", B.quadrant_bit("lr", "lc").cast("int").alias("place"))


@query(ctes("a") + "SELECT i, j, CAST(row_number() OVER (PARTITION BY i, j // 16 ORDER BY j) - 1 AS INT) AS in_row, CAST(row_number() OVER (PARTITION BY i // 16, j // 16 ORDER BY i, j) - 1 AS INT) AS in_tile FROM a")
def bit_ranks(spark, d):
    a = a_sp(spark, d)
    e = M.elements(a).join(M.tiles(a).select("ti", "tj", "masks"), ["ti", "tj"])
    row = B.rank_in_row(F.element_at("masks", F.col("lr") + 1), "lc")
    return e.select("i", "j", row.cast("int").alias("in_row"), B.rank_in_tile("masks", "lr", "lc").cast("int").alias("in_tile"))


@query(ctes("a", more="t AS (SELECT i // 16 AS ti, j // 16 AS tj, i % 16 * 16 + j % 16 AS p FROM a), g AS (SELECT ti, tj, p FROM (SELECT DISTINCT ti, tj FROM t), (SELECT unnest(range(256)) AS p))") + "SELECT g.ti, g.tj, string_agg(CASE WHEN t.p IS NULL THEN '0' ELSE '1' END, '' ORDER BY g.p) AS bits FROM g LEFT JOIN t ON g.ti = t.ti AND g.tj = t.tj AND g.p = t.p GROUP BY 1, 2")
def tile_bit_strings(spark, d):
    return M.tiles(a_sp(spark, d)).select("ti", "tj", B.bits_string("masks").alias("bits"))


_FIGURES = (
    "k AS (SELECT ti, tj, CAST(sum(n) AS INT) AS z, CAST(max(n) AS INT) AS longest, CAST(count(*) AS INT) AS rows, CAST(bit_count(bit_or(mask)) AS INT) AS cols, CAST(CASE WHEN count(*) < 16 THEN 1 ELSE min(n) END AS INT) AS width FROM r GROUP BY 1, 2), "
    "f AS (SELECT k.ti, k.tj, z, longest, rows, cols, width, CAST(sum(greatest(n - width, 0)) AS INT) AS tail FROM k JOIN r USING (ti, tj) GROUP BY ALL), "
    "y AS (SELECT *, (z + 1 + 15) // 16 * 16 + (z + 1) // 2 * 16 AS \"COO\", ((4 * z + 136 + 7) // 8 + 15) // 16 * 16 + (z + 1) // 2 * 16 AS \"CSR\", ((64 * longest + 4 + 7) // 8 + 15) // 16 * 16 + 8 * longest * 16 AS \"ELL\", "
    "(8 * width + 2 + tail + 15) // 16 * 16 + (16 * width + tail + 1) // 2 * 16 AS \"HYB\", ((4 * rows + 4 + 7) // 8 + 15) // 16 * 16 + 8 * 16 * rows AS \"DRW\", ((4 * cols + 4 + 7) // 8 + 15) // 16 * 16 + 8 * 16 * cols AS \"DCL\", 2048 AS \"DNS\" FROM f), "
    "c AS (SELECT ti, tj, z, least(\"COO\", \"CSR\", \"ELL\", \"HYB\", \"DRW\", \"DCL\", \"DNS\") AS bytes, CASE least(\"COO\", \"CSR\", \"ELL\", \"HYB\", \"DRW\", \"DCL\", \"DNS\") WHEN \"COO\" THEN 0 WHEN \"CSR\" THEN 1 WHEN \"ELL\" THEN 2 WHEN \"HYB\" THEN 3 WHEN \"DRW\" THEN 4 WHEN \"DCL\" THEN 5 ELSE 6 END AS fmt FROM y)"
)


def _formats(name: str) -> str:
    return _tile_rows(name) + ", " + _FIGURES


@query(_formats("a") + " SELECT ti, tj, z, longest, rows AS n_rows, cols AS n_cols, width, tail FROM f")
def tile_figures(spark, d):
    return M.tile_figures(M.tiles(a_sp(spark, d))).withColumnsRenamed({"rows": "n_rows", "cols": "n_cols"})


@query(_formats("a") + " SELECT ti, tj, " + ", ".join(f'CAST("{n}" AS BIGINT) AS {n.lower()}_bytes' for n in B.FORMATS) + " FROM y")
def format_costs(spark, d):
    costs = M.format_costs(M.tile_figures(M.tiles(a_sp(spark, d))))
    return costs.select("ti", "tj", *(F.col(n).alias(f"{n.lower()}_bytes") for n in B.FORMATS))


@query(_formats("o") + " SELECT ti, tj, z, CAST(fmt AS INT) AS fmt, CAST(bytes AS BIGINT) AS bytes FROM c")
def format_choice(spark, d):
    return M.choose_format(M.format_costs(M.tile_figures(M.tiles(a_op(spark, d)))))


@query(_formats("a") + " SELECT CAST(fmt AS INT) AS fmt, CAST(count(*) AS BIGINT) AS tiles, CAST(sum(bytes) AS BIGINT) AS bytes FROM c GROUP BY 1")
def format_histogram(spark, d):
    return M.choose_format(M.format_costs(M.tile_figures(M.tiles(a_sp(spark, d))))).groupBy("fmt").agg(F.count("*").alias("tiles"), F.sum("bytes").alias("bytes"))


@query(_formats("a") + " SELECT CAST((SELECT count(*) * 12 + (max(i) + 2) * 4 FROM a) AS BIGINT) AS csr_bytes, CAST(sum(bytes) AS BIGINT) AS tile_bytes, CAST(count(*) AS BIGINT) AS tiles FROM c")
def storage_footprint(spark, d):
    return M.footprint(a_sp(spark, d))


@query(ctes("a") + "SELECT i // 16 AS ti, (j // 16) // 32 AS word, CAST(bit_or(CAST(1 AS BIGINT) << CAST((j // 16) % 32 AS INT)) AS BIGINT) AS bits FROM a GROUP BY 1, 2")
def tile_index_words(spark, d):
    return M.index_words(a_sp(spark, d))


@query(ctes("o", more="c AS (SELECT i, count(*) AS nnz FROM o GROUP BY i)") + "SELECT i, CAST(nnz AS BIGINT) AS nnz, CAST(sum(nnz) OVER (ORDER BY i) - nnz AS BIGINT) AS start, CAST(sum(nnz) OVER (ORDER BY i) AS BIGINT) AS stop FROM c")
def row_pointers(spark, d):
    return M.row_pointers(a_op(spark, d))


@query(ctes("a") + "SELECT i, j, CAST(row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS INT) AS pos FROM a")
def row_positions(spark, d):
    return M.positions(a_sp(spark, d)).select("i", "j", F.col("pos").cast("int").alias("pos"))


_BALANCE = "n AS (SELECT i // 16 AS ti, count(DISTINCT j // 16) AS n FROM a GROUP BY 1), p AS (SELECT ti, n, sum(n) OVER (ORDER BY ti) - n AS b, (n + (n + 3) // 4 - 1) // ((n + 3) // 4) AS z FROM n), q AS (SELECT *, unnest(range((n + z - 1) // z)) AS chunk FROM p)"


@query(ctes("a", more=_BALANCE) + "SELECT ti, CAST(chunk AS BIGINT) AS chunk, CAST(b + chunk * z AS BIGINT) AS start, CAST(least(b + (chunk + 1) * z, b + n) AS BIGINT) AS stop, n > 4 AS split FROM q")
def load_balance(spark, d):
    return M.balance(a_sp(spark, d))


_EDGES = [0, 2, 4, 8, 16, 32]


@query(ctes("o", more="c AS (SELECT i, count(*) AS nnz FROM o GROUP BY i)") + "SELECT CAST(" + " + ".join(f"CASE WHEN nnz > {e} THEN 1 ELSE 0 END" for e in _EDGES) + " AS INT) AS bin, CAST(count(*) AS BIGINT) AS n_rows, CAST(max(nnz) AS BIGINT) AS longest FROM c GROUP BY 1")
def row_bins(spark, d):
    counts = a_op(spark, d).groupBy("i").agg(F.count("*").alias("nnz"))
    return M.bins(counts, "nnz", _EDGES).groupBy("bin").agg(F.count("*").alias("n_rows"), F.max("nnz").alias("longest"))


@query(ctes("a", more="n AS (SELECT i // 16 AS ti, j // 16 AS tj, count(*) AS n FROM a GROUP BY 1, 2)") + "SELECT i, j, v, n < 12 AS deferred FROM a JOIN n ON i // 16 = ti AND j // 16 = tj")
def deferred_entries(spark, d):
    return M.sparse_split(a_sp(spark, d))


@query(ctes("a") + "SELECT i, CAST(count(*) AS BIGINT) AS nnz, CAST(max(j) AS BIGINT) AS last, CAST(min(j) AS BIGINT) AS first FROM a GROUP BY i")
def row_histogram(spark, d):
    return a_sp(spark, d).groupBy("i").agg(F.count("*").alias("nnz"), F.max("j").alias("last"), F.min("j").alias("first"))


@query(ctes("a") + "SELECT j, CAST(count(*) AS BIGINT) AS nnz, CAST(sum(v) AS DOUBLE) AS total FROM a GROUP BY j")
def column_histogram(spark, d):
    return a_sp(spark, d).groupBy("j").agg(F.count("*").alias("nnz"), F.sum("v").alias("total"))


@query(ctes("s") + "SELECT i, j, v FROM s WHERE i = j")
def diagonal(spark, d):
    return square(spark, d).where("i = j")


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n, CAST(min(event_id) AS BIGINT) AS first FROM events GROUP BY 1, 2")
def result_log_counts(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def still_to_run(spark, d):
    done = lines(spark, d).select(F.col("l_orderkey").alias("o_orderkey"))
    return R.still_to_run(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), done, "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def tasks_present(spark, d):
    some = lines(spark, d).where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.present(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey"), some, "o_orderkey")


_PAIRS = "SELECT CAST(l_linenumber % 3 AS INT) AS label, CAST((l_linenumber + CAST(l_quantity AS BIGINT) % 2) % 3 AS INT) AS predicted FROM lineitem"


def _pairs(spark, d):
    return lines(spark, d).select((F.col("l_linenumber") % 3).cast("int").alias("label"), ((F.col("l_linenumber") + F.col("l_quantity").cast("bigint") % 2) % 3).cast("int").alias("predicted"))


@query(f"SELECT label, predicted, CAST(count(*) AS BIGINT) AS n FROM ({_PAIRS}) GROUP BY 1, 2")
def confusion(spark, d):
    return R.confusion(_pairs(spark, d))


@query(f"WITH p AS ({_PAIRS}) SELECT c.c AS class, CAST(count(*) FILTER (label = c AND predicted = c) AS BIGINT) AS tp, CAST(count(*) FILTER (label <> c AND predicted = c) AS BIGINT) AS fp, CAST(count(*) FILTER (label = c AND predicted <> c) AS BIGINT) AS fn FROM p, (SELECT DISTINCT label AS c FROM p UNION SELECT predicted FROM p) c GROUP BY 1")
def class_accuracy(spark, d):
    return R.accuracy(_pairs(spark, d))


@query("SELECT l_suppkey, CAST(min(l_extendedprice) AS DOUBLE) AS ms FROM lineitem GROUP BY 1")
def best_times(spark, d):
    return R.best_times(lines(spark, d), "l_suppkey", "l_extendedprice")


@query("SELECT vec_id, CAST(p // 4 AS BIGINT) AS pool, CAST(max(q) AS BIGINT) AS top FROM (SELECT vec_id, unnest(range(len(embedding))) AS p, CAST(round(unnest(embedding) * 1000) AS BIGINT) AS q FROM embeddings) GROUP BY 1, 2")
def max_pool(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    thousandths = F.round(F.col("e") * F.lit(1000).cast("float")).cast("bigint")  # in single precision, as SQL multiplies a FLOAT
    return e.groupBy("vec_id", F.floor(F.col("p") / 4).alias("pool")).agg(F.max(thousandths).alias("top"))


@query("SELECT l_partkey, l_orderkey, lpad(lower(hex(l_partkey)), 8, '0') AS digits, lpad(bin(l_partkey), 32, '0') AS bits FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)")
def hex_bits(spark, d):
    keys = lines(spark, d).select("l_partkey", "l_orderkey").distinct().withColumn("digits", F.lpad(F.lower(F.hex("l_partkey")), 8, "0"))
    return keys.withColumn("bits", B.bits_of_hex("digits"))


@query(ctes("a") + "SELECT DISTINCT i // 16 AS ti, j // 16 AS tj FROM a INTERSECT SELECT DISTINCT i // 16, j // 16 FROM a WHERE v > 50")
def tile_intersection(spark, d):
    def keys(a):
        return a.select(B.tile_index("i").alias("ti"), B.tile_index("j").alias("tj"))

    a = a_sp(spark, d)
    return keys(a).intersect(keys(a.where("v > 50")))


def _slots(sql: str) -> str:
    return _tile_rows("a") + ", " + _FIGURES + sql


@query(_slots(" SELECT ti, tj, z AS coo, z AS csr, longest * 16 AS ell, 16 * width + tail AS hyb, 16 * rows AS drw, 16 * cols AS dcl, 256 AS dns FROM f"))
def encoded_slots(spark, d):
    """Value slots that the seven encoders really fill."""
    return tiled.slots_of_each(M.tile_values(a_sp(spark, d)))


#: A graph of parts: those of consecutive lines of an order are linked.
EDGES = "e AS (SELECT DISTINCT CAST(least(x.l_partkey, y.l_partkey) AS BIGINT) AS src, CAST(greatest(x.l_partkey, y.l_partkey) AS BIGINT) AS dst FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_partkey <> y.l_partkey)"
_EDGES_SQL = EDGES + ", b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def graph_of_parts(spark: SparkSession, d: str) -> DataFrame:
    own = lines(spark, d).select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("bigint").alias("i"))
    after = own.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("i").alias("j"))
    return G.of_matrix(own.join(after, ["l_orderkey", "l_linenumber"]))


@query(f"WITH {_EDGES_SQL} " + "SELECT src AS node, CAST(count(*) AS BIGINT) AS degree FROM b GROUP BY 1")
def graph_degrees(spark, d):
    return G.degrees(graph_of_parts(spark, d))


@query(f"WITH {_EDGES_SQL} " + "SELECT x.src AS node, CAST(count(*) // 2 AS BIGINT) AS triangles FROM b x JOIN b y ON x.dst = y.src JOIN b z ON y.dst = z.src AND z.dst = x.src GROUP BY 1")
def graph_triangles(spark, d):
    return G.triangles(graph_of_parts(spark, d))


@query(f"WITH RECURSIVE {_EDGES_SQL}" + ", l AS (SELECT CAST(5 AS BIGINT) AS node, 0 AS level UNION SELECT b.dst, level + 1 FROM l JOIN b ON b.src = l.node WHERE level < 40) SELECT node, CAST(min(level) AS INT) AS level FROM l GROUP BY 1")
def graph_levels(spark, d):
    return G.levels(graph_of_parts(spark, d), 5)


@query(ctes("a") + "SELECT CAST(sum(y) AS DOUBLE) AS one, CAST(max(y) AS DOUBLE) AS largest, CAST(sum(y * y) AS DOUBLE) AS squares FROM (SELECT i, sum(v) AS y FROM a GROUP BY i)")
def vector_norms(spark, d):
    n = V.norms(M.row_sums(a_sp(spark, d)).select("i", F.col("y").alias("x")))
    return n.select("one", "largest", F.round(F.col("two") * F.col("two")).alias("squares"))


@query(ctes("a", "x") + "SELECT j AS i, CAST(2 * coalesce(t, 0) - coalesce(x, 0) AS DOUBLE) AS x FROM (SELECT j, sum(v) AS t FROM a GROUP BY j) FULL JOIN x USING (j)")
def vector_sum(spark, d):
    t = M.row_sums(M.transpose(a_sp(spark, d))).select("i", F.col("y").alias("x"))
    return V.axpby(2.0, t, -1.0, vector(spark, d).select(F.col("j").alias("i"), "x"))


def sequence(spark: SparkSession, d: str) -> DataFrame:
    """A vector of the orders, small integers."""
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("i"), (F.col("o_custkey") % 5).cast("bigint").alias("x"))


#: Entries with the one at the index before.
_PAIRED = "p AS (SELECT q.i, q.x, w.x AS was, w.i IS NOT NULL AS has FROM q LEFT JOIN q w ON w.i = q.i - 1)"
#: Runs: entries that differ from the one before start one.
_RUNS = _PAIRED + ", r AS (SELECT i, x, sum(CASE WHEN has AND x = was THEN 0 ELSE 1 END) OVER (ORDER BY i) AS run FROM p), g AS (SELECT min(i) AS start, count(*) AS length, min(x) AS x FROM r GROUP BY run)"


@query(ctes("q", more=_PAIRED) + "SELECT i, CASE WHEN has THEN x - was ELSE x END AS x FROM p")
def vector_adjacent_difference(spark, d):
    return W.adjacent_difference(sequence(spark, d))


@query(ctes("q", more=_PAIRED) + "SELECT min(i) - 1 AS at FROM p WHERE has AND x = was")
def vector_adjacent_find(spark, d):
    return W.adjacent_find(sequence(spark, d))


@query(ctes("q", more=_PAIRED) + "SELECT min(i) AS at FROM p WHERE has AND x < was")
def vector_sorted_until(spark, d):
    return W.sorted_until(sequence(spark, d))


@query(ctes("q", more=_PAIRED) + "SELECT i, x FROM p WHERE NOT (has AND x = was)")
def vector_unique(spark, d):
    return W.unique(sequence(spark, d))


@query(ctes("q") + "SELECT i, CAST(sum(x) OVER (ORDER BY i) AS BIGINT) AS x FROM q")
def vector_inclusive_scan(spark, d):
    return W.inclusive_scan(sequence(spark, d))


@query(ctes("q", more=_RUNS) + "SELECT start, length, x FROM g")
def vector_runs(spark, d):
    return W.runs(sequence(spark, d))


@query(ctes("q", more=_RUNS) + "SELECT min(start) AS at FROM g WHERE length >= 3 AND x = 2")
def vector_search_n(spark, d):
    return W.search_n(sequence(spark, d), 3, 2)


@query(ctes("q") + "SELECT min(a.i) AS first, max(a.i) AS last FROM q a JOIN q b ON b.i = a.i + 1 JOIN q c ON c.i = a.i + 2 WHERE a.x = 1 AND b.x = 3 AND c.x = 1")
def vector_search(spark, d):
    return W.first_and_last(W.occurrences(sequence(spark, d), [1, 3, 1]))


@query(ctes("q") + "SELECT min(i) AS at FROM q WHERE x IN (SELECT r_regionkey FROM region)")
def vector_find_first_of(spark, d):
    return W.find_first_of(sequence(spark, d), spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("bigint").alias("x")))


@query(ctes("q") + "SELECT min(i) AS at FROM q WHERE x <> x % 4")
def vector_mismatch(spark, d):
    x = sequence(spark, d)
    return W.mismatch(x, x.withColumn("x", F.col("x") % 4))


@query(ctes("q") + "SELECT min(x) AS least, arg_min(i, (x, i)) AS least_at, max(x) AS most, arg_min(i, (-x, i)) AS most_at, arg_min(i, (-abs(x), i)) AS largest_at FROM q")
def vector_extremes(spark, d):
    return W.extremes(sequence(spark, d))


@query(ctes("q") + "SELECT min(i) FILTER (WHERE x >= 3) AS at, coalesce(max(i) FILTER (WHERE x < 3) < min(i) FILTER (WHERE x >= 3), true) AS partitioned FROM q")
def vector_partition_point(spark, d):
    return W.partition_point(sequence(spark, d), F.col("x") < 3)


#: As many indexes as orders, from 0 on or from 1 on.
_N = "n AS (SELECT count(*) AS n FROM orders)"


@query(ctes("q", more=_N) + "SELECT (i - 7 + n) % n AS i, x FROM q, n")
def vector_rotate(spark, d):
    return W.rotate(sequence(spark, d), 7)


@query(ctes("q", more=_N) + "SELECT n - 1 - i AS i, x FROM q, n")
def vector_reverse(spark, d):
    return W.reverse(sequence(spark, d))


@query(ctes("q", more=_N) + "SELECT i - 7 AS i, x FROM q, n WHERE i - 7 >= 0 AND i - 7 < n")
def vector_shift(spark, d):
    return W.shift(sequence(spark, d), 7)


@query("SELECT CAST(floor((o_totalprice - 1000) / 25000) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1")
def vector_histogram(spark, d):
    return W.histogram(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_totalprice").alias("x")), 1000, 25000)


@query(ctes("q") + "SELECT k.k AS i, CAST(sum(CASE WHEN bit_count(q.i & k.k) % 2 = 1 THEN -q.x ELSE q.x END) AS BIGINT) AS x FROM (SELECT i % 256 AS i, sum(x) AS x FROM q GROUP BY 1) q, (SELECT unnest(range(256)) AS k) k GROUP BY 1")
def vector_walsh(spark, d):
    """Of the vector folded into 256 sums."""
    folded = sequence(spark, d).groupBy((F.col("i") % 256).alias("i")).agg(F.sum("x").alias("x"))
    return W.walsh(folded, 8)


@query(ctes("q") + "SELECT i >> 1 AS i, CAST(sum(x) AS BIGINT) AS total, CAST(sum(CASE WHEN i % 2 = 0 THEN x ELSE -x END) AS BIGINT) AS difference FROM q GROUP BY 1")
def vector_haar(spark, d):
    return W.haar(sequence(spark, d))


@query(ctes("s") + "SELECT s.i - di AS i, s.j - dj AS j, CAST(sum(v) AS DOUBLE) AS v FROM s, (SELECT CAST(unnest([-1, 0, 1]) AS BIGINT) AS di), (SELECT CAST(unnest([-1, 0, 1]) AS BIGINT) AS dj) GROUP BY 1, 2")
def box_filter(spark, d):
    return W.convolve(square(spark, d), W.box(1))


@query(ctes("s") + "SELECT s.i - di AS i, s.j - dj AS j, CAST(sum(v * w) AS DOUBLE) AS v FROM s, (VALUES (-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)) k(di, dj, w) GROUP BY 1, 2")
def sobel_gradient(spark, d):
    return W.convolve(square(spark, d), {(-1, -1): -1, (-1, 1): 1, (0, -1): -2, (0, 1): 2, (1, -1): -1, (1, 1): 1})


@query(f"WITH {EDGES}, c AS (SELECT DISTINCT src // 16 AS src, dst // 16 AS dst FROM e) SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM c WHERE src <> dst")
def graph_coarsen(spark, d):
    e = graph_of_parts(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return G.coarsen(e, nodes.select("node", F.shiftright("node", 4).alias("label")))


@query()
def graph_independent_set(spark, d):
    return G.independent_set(graph_of_parts(spark, d))


def small_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding as an 8x8 matrix of whole thousandths, and its first row as a vector."""
    whole = F.expr("transform(slice(embedding, 1, 64), e -> CAST(round(CAST(e AS DOUBLE) * 1000) AS DOUBLE))")
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("batch"), whole.alias("a")).withColumn("b", F.slice("a", 1, 8))


_SMALL = "WITH e AS (SELECT vec_id AS batch, round(CAST(unnest(embedding) AS DOUBLE) * 1000) AS v, CAST(unnest(range(64)) AS INT) AS p FROM embeddings) "


@query(_SMALL + "SELECT x.batch, x.p // 8 * 8 + y.p % 8 AS p, sum(x.v * y.v) AS c FROM e x JOIN e y ON x.batch = y.batch AND x.p % 8 = y.p // 8 GROUP BY ALL")
def batched_gemm(spark, d):
    m = small_matrices(spark, d)
    return batched.gemm(m, m, 8).select("batch", F.posexplode("c").alias("p", "c"))


@query(_SMALL + "SELECT x.batch, x.p // 8 AS p, sum(x.v * y.v) AS y FROM e x JOIN e y ON x.batch = y.batch AND x.p % 8 = y.p WHERE y.p < 8 GROUP BY ALL")
def batched_gemv(spark, d):
    return batched.apply(small_matrices(spark, d), "gemv", 8).select("batch", F.posexplode("y").alias("p", "y"))


@query()
def batched_svd(spark, d):
    return batched.apply(small_matrices(spark, d), "svd", 8).select("batch", "s")


@query("WITH " + SQL["s"] + " SELECT i // 4 AS bi, j // 4 AS bj, count(*) AS filled, CAST(sum(v) AS DOUBLE) AS total FROM s GROUP BY 1, 2")
def block_storage(spark, d):
    blocks = M.blocks(square(spark, d), 4)
    filled = F.size(F.filter("vals", lambda v: v != 0)).cast("bigint")
    return blocks.select("bi", "bj", filled.alias("filled"), F.aggregate("vals", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("WITH " + SQL["s"] + " SELECT i, j, v FROM s")
def block_round_trip(spark, d):
    return M.unblocked(M.blocks(square(spark, d), 4), 4)


@query("WITH " + SQL["s"] + ", b AS (SELECT CAST(unnest([1, 2, 4, 8, 16]) AS INT) AS size), c AS (SELECT size, count(DISTINCT (i // size, j // size)) AS blocks FROM s, b GROUP BY size) SELECT size, blocks, blocks * size * size = (SELECT count(*) FROM s) AS dense FROM c")
def block_sizes(spark, d):
    return M.block_sizes(square(spark, d), [1, 2, 4, 8, 16])
