"""Queries of solvers, stacked small matrices, pricing and point sequences.

A system is built so that its solution is known and differs by row, which SQL can say without solving it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.functions.staging import saved
from tilefold.operators import batched
from tilefold.operators import formulas
from tilefold.operators import graph as G
from tilefold.operators import matrix as M
from tilefold.operators import solvers as V
from tilefold.queries import _SMALL, query, small_matrices, square

_KNOWN = "WITH n AS (SELECT DISTINCT CAST(unnest([l_partkey % 512, l_orderkey % 512]) AS BIGINT) AS i FROM lineitem) SELECT i, CAST(i % 7 - 3 AS DOUBLE) AS x FROM n"


def known(a: DataFrame) -> DataFrame:
    """The right side of the solution i % 7 - 3."""
    return saved(a.groupBy("i").agg(F.sum(F.col("v") * (F.col("j") % 7 - 3)).alias("x")), "system")


def system(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A symmetric matrix whose diagonal is ten times the sum of its row, and the right side of a known solution."""
    s = square(spark, d)
    off = M.add(s, M.transpose(s)).where("i <> j")
    nodes = s.select(F.explode(F.array("i", "j")).alias("i")).distinct()
    sums = nodes.join(off.groupBy("i").agg(F.sum("v").alias("t")), "i", "left").select("i", F.coalesce("t", F.lit(0.0)).alias("t"))
    a = saved(off.unionByName(sums.select("i", F.col("i").alias("j"), (F.col("t") * 10 + 1).alias("v"))), "system")
    return a, known(a)


def _rounded(x: DataFrame) -> DataFrame:
    return x.select("i", (F.round("x", 4) + F.lit(0.0)).alias("x"))


@query(_KNOWN)
def jacobi(spark, d):
    a, b = system(spark, d)
    return _rounded(V.jacobi(a, b, steps=8))


def _sparse_system(spark, d):
    """Along the customers' keys: every node has two neighbours."""
    k = F.floor(F.col("o_custkey") / 5).cast("bigint")
    e = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("src"), (k + 1).alias("dst")).distinct()
    off = G.both_ways(e).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("v"))
    nodes = off.select("i").distinct()
    a = saved(off.unionByName(nodes.select("i", F.col("i").alias("j"), F.lit(40.0).alias("v"))), "system")
    return e, a, known(a)


_PATH = "WITH n AS (SELECT DISTINCT CAST(unnest([o_custkey // 5, o_custkey // 5 + 1]) AS BIGINT) AS i FROM orders) SELECT i, CAST(i % 7 - 3 AS DOUBLE) AS x FROM n"


@query(_PATH)
def conjugate_gradients(spark, d):
    _, a, b = _sparse_system(spark, d)
    return _rounded(V.conjugate_gradients(a, b, steps=7))


@query(_PATH)
def minimal_residuals(spark, d):
    _, a, b = _sparse_system(spark, d)
    return _rounded(V.gmres(a, b, restart=7, cycles=1))


@query(_PATH)
def gauss_seidel(spark, d):
    e, a, b = _sparse_system(spark, d)
    return _rounded(V.gauss_seidel(a, b, G.colouring(e), sweeps=5))


_TREE = "t AS (SELECT DISTINCT CAST(l_partkey AS BIGINT) AS i FROM lineitem), e AS (SELECT i, i // 16 AS j FROM t WHERE i // 16 IN (SELECT i FROM t) AND i // 16 <> i)"


@query(f"WITH {_TREE} SELECT i, CAST(i % 7 - 3 AS DOUBLE) AS x FROM t")
def triangular_solve(spark, d):
    """A lower triangular matrix in which each part hangs on a sixteenth of its key."""
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").cast("bigint").alias("i")).distinct()
    e = t.select("i", F.shiftright("i", 4).alias("j")).where("i <> j").join(t.select(F.col("i").alias("j")), "j", "left_semi").select("i", "j", F.lit(3.0).alias("v"))
    a = saved(e.unionByName(t.select("i", F.col("i").alias("j"), F.lit(2.0).alias("v"))), "system")
    return V.triangular_solve(a, known(a))


@query(
    "WITH s AS (SELECT CAST(l_partkey % 512 AS BIGINT) AS i, CAST(l_orderkey % 512 AS BIGINT) AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2), a AS (SELECT i, j, v FROM s WHERE i <> j UNION ALL SELECT i, i, 2 FROM (SELECT DISTINCT i FROM s)), "
    "r AS (SELECT i, j, v FROM a UNION ALL SELECT p.i, q.j, -p.v / 2 * 2 * q.v FROM a p JOIN a q ON p.j = q.i) SELECT i, j, CAST(sum(v) AS DOUBLE) AS v FROM r GROUP BY 1, 2"
)
def damped_product(spark, d):
    """A - 2 D^-1 A A with a diagonal of twos."""
    s = square(spark, d)
    a = s.where("i <> j").unionByName(s.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(2.0).alias("v")))
    return V.damped_product(a, a, 2.0)


_PLACES = "SELECT batch, CAST(p AS INT) AS p, CAST(CASE WHEN p // 8 = p % 8 THEN {} ELSE 0 END AS BIGINT) AS v FROM (SELECT DISTINCT batch FROM e), (SELECT unnest(range(64)) AS p)"


def _definite(spark, d):
    """Symmetric positive definite small matrices: A A^T with 4,000,000 more on the diagonal, whole numbers."""
    m = small_matrices(spark, d).select("batch", "a")
    turned = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.element_at("a", (p % 8 * 8 + F.floor(p / 8) + 1).cast("int")))
    c = batched.gemm(m, m.select("batch", turned.alias("a")), 8)
    return c.select("batch", F.transform("c", lambda v, p: F.when(F.floor(p / 8) == p % 8, v + 4_000_000).otherwise(v)).alias("a"))


def _whole(df, column, scale=1.0):
    return df.select("batch", F.posexplode(column).alias("p", "v")).select("batch", "p", F.round(F.col("v") * scale).cast("bigint").alias("v"))


@query(_SMALL + _PLACES.format("1000000"))
def batched_inverse(spark, d):
    """A inverse(A), in millionths."""
    a = _definite(spark, d)
    inverse = batched.apply(a, "inverse", 8).select("batch", F.col("inverse").alias("a"))
    return _whole(batched.gemm(a, inverse, 8), "c", 1e6)


_DEFINITE = ", c AS (SELECT x.batch, CAST(x.p // 8 * 8 + y.p // 8 AS INT) AS p, CAST(sum(x.v * y.v) AS BIGINT) AS v FROM e x JOIN e y ON x.batch = y.batch AND x.p % 8 = y.p % 8 GROUP BY ALL), f AS (SELECT batch, p, v + CASE WHEN p // 8 = p % 8 THEN 4000000 ELSE 0 END AS v FROM c)"


@query(_SMALL.rstrip() + _DEFINITE + " SELECT batch, p, CAST(v AS BIGINT) AS v FROM f")
def batched_cholesky(spark, d):
    """L L^T."""
    low = batched.apply(_definite(spark, d), "cholesky", 8).select("batch", F.col("l").alias("a"))
    turned = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.element_at("a", (p % 8 * 8 + F.floor(p / 8) + 1).cast("int")))
    return _whole(batched.gemm(low, low.select("batch", turned.alias("a")), 8), "c")


@query(_SMALL.rstrip() + _DEFINITE + " SELECT batch, p, CAST(v AS BIGINT) AS v FROM f")
def batched_qr(spark, d):
    """Q R."""
    made = batched.apply(_definite(spark, d), "qr", 8)
    return _whole(batched.gemm(made.select("batch", F.col("q").alias("a")), made.select("batch", F.col("r").alias("a")), 8), "c")


@query(_SMALL + "SELECT batch, CAST(round(sum(v * v) / 1000) AS BIGINT) AS energy FROM e GROUP BY 1")
def batched_svd_energy(spark, d):
    """The squares of the singular values are the squares of the entries, a whole number: it is made whole again before the
    thousands are rounded, where half of one may be at stake."""
    s = batched.apply(small_matrices(spark, d), "svd", 8)
    return s.select("batch", F.round(F.round(F.aggregate("s", F.lit(0.0), lambda t, x: t + x * x)) / 1000).cast("bigint").alias("energy"))


@query(_SMALL.rstrip() + _DEFINITE + " SELECT batch, CAST(sum(v) AS BIGINT) AS trace FROM f WHERE p // 8 = p % 8 GROUP BY 1")
def batched_eigenvalues(spark, d):
    """Their sum is the trace."""
    w = batched.apply(_definite(spark, d), "eigenvalues", 8)
    return w.select("batch", F.round(F.aggregate("re", F.lit(0.0), lambda t, x: t + x)).cast("bigint").alias("trace"))


_OPTIONS = "o AS (SELECT CAST(o_orderkey AS BIGINT) AS i, CAST(50 + o_custkey % 100 AS DOUBLE) AS s, CAST(60 + o_orderkey % 90 AS DOUBLE) AS k, (1 + o_orderkey % 12) / 4.0 AS t FROM orders), n AS (SELECT *, CAST(0.02 AS DOUBLE) AS r, CAST(0.3 AS DOUBLE) AS w FROM o), d AS (SELECT *, (ln(s / k) + (r + w * w / 2) * t) / (w * sqrt(t)) AS d1 FROM n), z AS (SELECT *, d1 - w * sqrt(t) AS d2 FROM d)"
_PHI = "(SELECT CASE WHEN {x} > 0 THEN 1 - p ELSE p END FROM (SELECT 0.3989422804014327 * exp(-{x} * {x} / 2) * q * (0.31938153 + q * (-0.356563782 + q * (1.781477937 + q * (-1.821255978 + q * 1.330274429)))) AS p FROM (SELECT 1 / (1 + 0.2316419 * abs({x})) AS q)))"


@query(f"WITH {_OPTIONS}, y AS (SELECT i, s, k, r, t, CAST({_PHI.format(x='z.d1')} AS DOUBLE) AS n1, CAST({_PHI.format(x='z.d2')} AS DOUBLE) AS n2 FROM z) SELECT i, CAST(round(10000 * (s * n1 - k * exp(-r * t) * n2)) AS BIGINT) AS call, CAST(round(10000 * (k * exp(-r * t) * (1 - n2) - s * (1 - n1))) AS BIGINT) AS put FROM y")
def option_prices(spark, d):
    """European calls and puts on figures of the orders, in ten-thousandths."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("i"), (F.col("o_custkey") % 100 + 50).cast("double").alias("s"), (F.col("o_orderkey") % 90 + 60).cast("double").alias("k"), ((F.col("o_orderkey") % 12 + 1) / 4.0).alias("t"))
    call, put = formulas.black_scholes(F.col("s"), F.col("k"), F.col("t"), F.lit(0.02), F.lit(0.3))
    return o.select("i", *(F.round(c * 10000).cast("bigint").alias(n) for n, c in (("call", call), ("put", put))))


def _radical(base: int, digits: int) -> str:
    return " + ".join(f"(i // {base**k}) % {base} / CAST({base ** (k + 1)} AS DOUBLE)" for k in range(digits))


@query(f"SELECT i, {_radical(2, 20)} AS x, CAST(round(1e12 * ({_radical(3, 13)})) AS BIGINT) AS y FROM (SELECT CAST(o_orderkey AS BIGINT) AS i FROM orders)")
def low_discrepancy_points(spark, d):
    """Points of the Halton sequence of bases 2 and 3 at the order keys (y in billionths of a thousandth)."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("i"))
    return o.select("i", formulas.radical_inverse(F.col("i"), 2, 20).alias("x"), F.round(formulas.radical_inverse(F.col("i"), 3, 13) * 1e12).cast("bigint").alias("y"))
