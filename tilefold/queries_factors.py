"""Queries of incomplete factorisations and of the solvers that they help: the customers as a grid, 37 to a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.functions.staging import dealt, saved
from tilefold.operators import factors as L
from tilefold.operators import graph as G
from tilefold.operators import solvers as V
from tilefold.operators import spectra as E
from tilefold.operators.selection import kth_largest as kth
from tilefold.queries import query

WIDTH = 37
#: Indexes of customers: scattered over a prime's remainders, or by three colours of the grid (its steps are 1 modulo 3).
SCATTERED = "(c * 1103515245) % 2147483647"
COLOURED = "(c % 3) * 4294967296 + c"


def grid_sql(index: str, value: str, diagonal: str) -> str:
    """A query of nodes n (c, i) and of the matrix a (i, j, v) of each customer with itself and its neighbours."""
    return f"""n AS (SELECT c, {index} AS i FROM (SELECT CAST(c_custkey AS BIGINT) AS c FROM customer)),
      l AS (SELECT n.i, m.i AS j, CAST({value} AS DOUBLE) AS v FROM (SELECT c, i, unnest([-{WIDTH}, -1, 1, {WIDTH}]) AS step FROM n) n JOIN n m ON m.c = n.c + n.step),
      a AS (SELECT i, j, v FROM l UNION ALL SELECT i, i, CAST({diagonal} AS DOUBLE) FROM n)"""


def grid(spark: SparkSession, d: str, index: str, value: str, diagonal: str) -> tuple[DataFrame, DataFrame]:
    """(c, i) and (i, j, v) as grid_sql() has them."""
    n = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("c")).withColumn("i", F.expr(index))
    own = n.withColumn("step", F.explode(F.array(*(F.lit(s) for s in (-WIDTH, -1, 1, WIDTH))))).withColumn("to", F.col("c") + F.col("step"))
    met = own.alias("n").join(n.alias("m").hint("merge"), F.col("m.c") == F.col("n.to"))
    links = met.select(F.col("n.i").alias("i"), F.col("m.i").alias("j"), F.expr(value).cast("double").alias("v"))
    return n, saved(links.unionByName(n.select("i", F.col("i").alias("j"), F.expr(diagonal).cast("double").alias("v"))), "grid")


_UNEVEN = (SCATTERED, "-(1 + (n.c + 3 * m.c) % 4)", "20 + c % 7")
_EVEN = (COLOURED, "-(1 + (n.c + m.c) % 4)", "40 + c % 7")
_SKEWED = (COLOURED, "-(1 + (n.c + 3 * m.c) % 4)", "40 + c % 7")


def _levels_sql(k: int) -> str:
    """Fill by its paths: (i, j) has as level the least number of links of a path between them, less one, whose inner
    nodes all have smaller indexes than both."""
    return f"""p AS (SELECT i, j, CAST(-1 AS BIGINT) AS top, 0 AS level FROM l UNION ALL SELECT p.i, l.j, greatest(p.top, p.j), p.level + 1 FROM p JOIN l ON l.i = p.j WHERE p.level < {k} AND l.j <> p.i),
      f AS (SELECT i, j, CAST(min(level) AS INT) AS level FROM p WHERE top < least(i, j) AND i <> j GROUP BY i, j UNION ALL SELECT i, i, 0 FROM n)"""


def _rounded(v, digits: int = 6):
    return F.round(v, digits) + F.lit(0.0)  # no negative zero


@query(f"WITH RECURSIVE {grid_sql(*_UNEVEN)}, {_levels_sql(2)} SELECT i, j, level FROM f")
def fill_levels(spark, d):
    _, a = grid(spark, d, *_UNEVEN)
    return L.fill_levels(a, 2)


@query(f"WITH RECURSIVE {grid_sql(*_UNEVEN)}, {_levels_sql(1)} SELECT f.i, f.j, f.level, coalesce(a.v, 0) AS v FROM f LEFT JOIN a ON a.i = f.i AND a.j = f.j")
def incomplete_lu(spark, d):
    """L U on the places of level 1 at most: A, and 0 where A has no entry."""
    _, a = grid(spark, d, *_UNEVEN)
    levels = L.fill_levels(a, 1)
    made = L.incomplete_lu(a, levels=levels).product()
    return levels.join(made, ["i", "j"], "left").select("i", "j", "level", _rounded(F.coalesce("v", F.lit(0.0))).alias("v"))


def _known(n: DataFrame, a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A solution that differs by row, and its right side."""
    x = n.select("i", (F.col("c") % 7 - 3).cast("double").alias("x"))
    return x, saved(V.times(a, x), "grid")


_SOLUTION = "SELECT i, CAST(c % 7 - 3 AS DOUBLE) AS x FROM n"


@query(f"WITH {grid_sql(*_EVEN)} {_SOLUTION}")
def preconditioned_gradients(spark, d):
    n, a = grid(spark, d, *_EVEN)
    x = V.conjugate_gradients(a, _known(n, a)[1], tolerance=1e-6, precondition=L.incomplete_lu(a).solve)
    return x.select("i", _rounded("x").alias("x"))


@query(f"WITH {grid_sql(*_SKEWED)} {_SOLUTION}")
def preconditioned_residuals(spark, d):
    n, a = grid(spark, d, *_SKEWED)
    x = V.gmres(a, _known(n, a)[1], restart=8, cycles=3, tolerance=1e-6, precondition=L.incomplete_lu(a).solve)
    return x.select("i", _rounded("x").alias("x"))


_WEIGHT = "(a.c * 7919 + b.c * 104729) % 1000"
_LINKS = f"n AS (SELECT CAST(c_custkey AS BIGINT) AS c FROM customer), e AS (SELECT a.c AS src, b.c AS dst, {_WEIGHT} AS w FROM (SELECT c, unnest([1, {WIDTH}]) AS step FROM n) a JOIN n b ON b.c = a.c + a.step)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("c"))
    own = n.withColumn("step", F.explode(F.array(F.lit(1), F.lit(WIDTH)))).withColumn("to", F.col("c") + F.col("step"))
    return own.alias("a").join(n.alias("b"), F.col("b.c") == F.col("a.to")).select(F.col("a.c").alias("src"), F.col("b.c").alias("dst"), F.expr(_WEIGHT).alias("w"))


@query(
    f"WITH RECURSIVE {_LINKS}, k AS MATERIALIZED (SELECT src, dst, w, row_number() OVER (ORDER BY w, src, dst) AS rank FROM e), b AS MATERIALIZED (SELECT src AS p, dst AS q, rank FROM k UNION ALL SELECT dst, src, rank FROM k), "
    "r AS (SELECT rank, src AS at FROM k UNION SELECT r.rank, b.q FROM r JOIN b ON b.p = r.at AND b.rank < r.rank) SELECT src, dst, w FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rank = k.rank AND r.at = k.dst)"
)
def spanning_forest(spark, d):
    """An edge is in the forest unless lighter edges join its ends."""
    return G.spanning_forest(_links(spark, d))[0].select("src", "dst", "w")


@query(f"WITH {_LINKS}, k AS (SELECT src, dst FROM e WHERE w < 400), n2 AS (SELECT unnest([src, dst]) AS c FROM k) SELECT (SELECT count(DISTINCT c) FROM n2) AS nodes, (SELECT count(*) FROM k) AS edges, CAST(0 AS BIGINT) AS crossing")
def graph_components(spark, d):
    """Nodes that lie in a component, edges, and edges between two components."""
    e = saved(_links(spark, d).where("w < 400"), "graph")
    c = saved(G.components(e.select("src", "dst")), "graph")
    named = e.join(c.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    figures = named.agg(F.count("*").alias("edges"), F.count_if(F.col("a") != F.col("b")).alias("crossing")).withColumn("nodes", F.lit(0).cast("bigint"))
    nodes = c.agg(F.count_distinct("node").alias("nodes")).select(F.lit(0).cast("bigint").alias("edges"), F.lit(0).cast("bigint").alias("crossing"), "nodes")
    return figures.unionByName(nodes).agg(*(F.sum(x).alias(x) for x in ("nodes", "edges", "crossing")))


_LOWER = (COLOURED, "-(1 + (n.c + 3 * m.c) % 4)", "2 + c % 3")


@query(f"WITH {grid_sql(*_LOWER)} SELECT i, CAST(k AS INT) AS c, CAST((c % 7 - 3) * (k + 1) AS DOUBLE) AS x FROM n, (SELECT unnest(range(5)) AS k)")
def block_triangular_solve(spark, d):
    """Five right sides whose solutions differ by row and side."""
    n, a = grid(spark, d, *_LOWER)
    t = a.where("i >= j")
    x = n.select("i", (F.col("c") % 7 - 3).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("i", F.col("k").alias("c"), (F.col("s") * (F.col("k") + 1)).cast("double").alias("x"))
    made = 5 * t.count()
    met = dealt(t, made, "j").join(dealt(x.select(F.col("i").alias("j"), "c", "x"), made, "j").hint("merge"), "j").select("i", "c", (F.col("v") * F.col("x")).alias("x"))
    b = dealt(met, made, "i").groupBy("i", "c").agg(F.sum("x").alias("x"))
    return L.block_triangular_solve(t, saved(b, "grid")).select("i", "c", _rounded("x").alias("x"))


@query(f"WITH m AS (SELECT CAST(c_custkey // {WIDTH} AS BIGINT) AS batch, count(*) AS n FROM customer GROUP BY 1) SELECT batch, CAST(k AS INT) AS k, round(batch % 5 + 2 * (1 + batch % 3) * cos((n - k) * pi() / (n + 1)), 6) + 0.0 AS value FROM (SELECT batch, n, unnest(range(n)) AS k FROM m)")
def bisected_eigenvalues(spark, d):
    """Paths of customers, one a row of the grid: a + 2 b cos(k pi / (n + 1))."""
    m = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.floor(F.col("c_custkey") / WIDTH).cast("bigint").alias("batch")).agg(F.count("*").cast("int").alias("n"))
    a, b = (F.col("batch") % 5).cast("double"), (F.col("batch") % 3 + 1).cast("double")
    m = m.select("batch", F.array_repeat(a, F.col("n")).alias("d"), F.array_repeat(b, F.col("n") - 1).alias("e"))
    return E.tridiagonal_eigenvalues(m).select("batch", "k", _rounded("value").alias("value"))


@query("SELECT l_returnflag AS flag, CAST(x AS DOUBLE) AS price FROM (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1000")
def kth_largest(spark, d):
    """The thousandth price of each flag."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    flags = sorted(r[0] for r in rows.select("l_returnflag").distinct().collect())  # a few
    out = None
    for f in flags:
        found = kth(rows.where(F.col("l_returnflag") == f), "l_extendedprice", 1000)
        own = rows.where(F.col("l_returnflag") == f).limit(1).select(F.col("l_returnflag").alias("flag"), F.lit(found).cast("double").alias("price")).where("price is not null")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"WITH {grid_sql(*_SKEWED)} SELECT CAST((SELECT count(*) FROM n) AS BIGINT) AS diagonal, true AS bounded, true AS grown, CAST(0 AS DOUBLE) AS departure")
def threshold_lu(spark, d):
    """Of the factors: diagonal entries, whether they have as many entries as asked and more than A, and how far L U is from
    A at their places."""
    _, a = grid(spark, d, *_SKEWED)
    f = L.threshold_lu(a, 1.5, steps=1)
    asked = a.where("i <> j").count()
    places = saved(f.lower.select("i", "j").unionByName(f.upper.select("i", "j")), "grid")
    n = places.where("i <> j").count()
    off = places.join(f.product(), ["i", "j"], "left").join(a.withColumnRenamed("v", "w"), ["i", "j"], "left")
    worst = off.agg(F.max(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0)))).alias("w"), F.count_if(F.col("i") == F.col("j")).alias("diagonal"))
    ties = 0.2 * asked  # entries as large as the threshold stay together
    return worst.select("diagonal", F.lit(n <= 1.5 * asked + ties).alias("bounded"), F.lit(n > asked).alias("grown"), _rounded("w").alias("departure"))


_DISCARDED = "m AS (SELECT p.j AS m, p.i, q.j, p.v * q.v AS v FROM l p JOIN l q ON q.i = p.j WHERE p.i <> q.j), k AS (SELECT m.m, sum((m.v / d.v) * (m.v / d.v)) AS s FROM m JOIN a d ON d.i = m.m AND d.j = m.m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.i = m.i AND l.j = m.j) GROUP BY 1)"


@query(f"WITH {grid_sql(*_SKEWED)}, {_DISCARDED} SELECT n.i AS node, round(coalesce(sqrt(s), 0), 6) + 0.0 AS discarded FROM n LEFT JOIN k ON k.m = n.i")
def discarded_fill(spark, d):
    _, a = grid(spark, d, *_SKEWED)
    return L.discarded_fill(a, a).select("node", _rounded("discarded").alias("discarded"))


@query(f"WITH {grid_sql(*_SKEWED)} SELECT CAST((SELECT count(*) FROM n) AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS touching")
def least_fill_order(spark, d):
    """Of the order: its nodes, and links within a round."""
    _, a = grid(spark, d, *_SKEWED)
    order = saved(L.least_fill_order(a), "grid")
    of = lambda c: order.select(F.col("node").alias(c), F.col("round").alias(f"r{c}"))
    touching = a.where("i <> j").join(of("i"), "i").join(of("j"), "j").where("ri = rj").agg(F.count("*").alias("touching")).select(F.lit(0).cast("bigint").alias("nodes"), "touching")
    nodes = order.agg(F.count_distinct("node").alias("nodes")).select("nodes", F.lit(0).cast("bigint").alias("touching"))
    return nodes.unionByName(touching).agg(F.sum("nodes").alias("nodes"), F.sum("touching").alias("touching"))
