"""Queries of running values, summed areas, transforms and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.operators import images as I
from tilefold.operators import scans as S
from tilefold.operators import transforms as T
from tilefold.queries import query

#: The embeddings as an image: a row a vector, whole thousandths.
IMAGE = "e AS (SELECT CAST(vec_id AS BIGINT) AS i, CAST(unnest(range(len(embedding))) AS BIGINT) AS j, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings)"


def image(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("bigint").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return rows.select("i", F.col("j").cast("bigint").alias("j"), F.round(F.col("v").cast("double") * 1000).cast("bigint").alias("v"))


@query(
    "WITH p AS (SELECT CAST(o_custkey AS BIGINT) AS ray, CAST(o_orderkey + 1 AS BIGINT) AS distance, o_totalprice + o_orderkey * o_orderkey / 100.0 AS height FROM orders), s AS (SELECT *, height / distance AS slope FROM p), "
    "m AS (SELECT *, max(slope) OVER (PARTITION BY ray ORDER BY distance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s) SELECT ray, distance, before IS NULL OR slope > before AS visible FROM m"
)
def line_of_sight(spark, d):
    """A customer's orders as points of a ray over rising ground."""
    k = F.col("o_orderkey").cast("bigint")
    p = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("bigint").alias("ray"), (k + 1).alias("distance"), (F.col("o_totalprice") + k * k / 100.0).alias("height"))
    return S.line_of_sight(p).select("ray", "distance", "visible")


@query("SELECT CAST(o_orderkey AS BIGINT) AS i, CAST(max(o_custkey) OVER (ORDER BY o_orderkey) AS BIGINT) AS largest, CAST(bit_or(1::BIGINT << (o_custkey % 60)::INT) OVER (ORDER BY o_orderkey) AS BIGINT) AS seen FROM orders")
def running_extremes(spark, d):
    """Of the orders so far: the greatest customer, and which remainders of 60 have come."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("i"), F.col("o_custkey").cast("bigint").alias("c"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("c") % 60).cast("int"))
    return S.scan(S.scan(o, ["i"], "c", "largest", S.LARGEST), ["i"], bit, "seen", S.ANY).select("i", "largest", "seen")


@query(f"WITH {IMAGE}, r AS (SELECT i, j, sum(v) OVER (PARTITION BY i ORDER BY j) AS r FROM e) SELECT i, j, CAST(sum(r) OVER (PARTITION BY j ORDER BY i) AS BIGINT) AS s FROM r")
def summed_area(spark, d):
    return S.summed_area(image(spark, d))


_BOXES = "b AS (SELECT CAST(c_custkey AS BIGINT) AS box, CAST(c_custkey * 7 % 480 - 10 AS BIGINT) AS i0, CAST(c_custkey % 70 - 4 AS BIGINT) AS j0, CAST(c_custkey * 7 % 480 - 10 + c_nationkey * 3 AS BIGINT) AS i1, CAST(c_custkey % 70 - 4 + c_custkey % 20 AS BIGINT) AS j1 FROM customer)"


@query(f"WITH {IMAGE}, {_BOXES} SELECT box, CAST(coalesce(sum(v), 0) AS BIGINT) AS s FROM b LEFT JOIN e ON e.i BETWEEN b.i0 AND b.i1 AND e.j BETWEEN b.j0 AND b.j1 GROUP BY box")
def box_sums(spark, d):
    """A box a customer, some of them beyond the image."""
    c = F.col("c_custkey").cast("bigint")
    i0, j0 = c * 7 % 480 - 10, c % 70 - 4
    boxes = spark.read.parquet(f"{d}/customer.parquet").select(c.alias("box"), i0.alias("i0"), j0.alias("j0"), (i0 + F.col("c_nationkey") * 3).alias("i1"), (j0 + c % 20).alias("j1"))
    return S.box_sums(S.summed_area(image(spark, d)), boxes).select("box", F.col("s").cast("bigint").alias("s"))


@query(
    "WITH x AS (SELECT CAST(o_orderkey AS BIGINT) AS i, CAST(o_custkey % 5 - 1 AS BIGINT) AS x FROM orders), k AS (SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_regionkey - 2 AS BIGINT) AS w FROM nation), "
    "s AS (SELECT x.i + k.i AS i, sum(x * w) AS v FROM x, k GROUP BY 1), n AS (SELECT unnest(range((SELECT max(i) FROM x) + (SELECT max(i) FROM k) + 1)) AS i) SELECT n.i, CAST(coalesce(v, 0) AS BIGINT) AS x FROM n LEFT JOIN s USING (i)"
)
def fourier_convolution(spark, d):
    """A sequence of the orders with one of the nations."""
    x = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("i"), (F.col("o_custkey") % 5 - 1).alias("x"))
    k = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("i"), (F.col("n_regionkey") - 2).alias("x"))
    return T.convolution(x, k).select("i", F.round("x").cast("bigint").alias("x"))


@query(f"WITH {IMAGE}, w AS (SELECT unnest(range(64)) AS k), s AS (SELECT e.i, w.k, sum(v * cos(2 * pi() * ((e.j * w.k) % 64) / 64)) AS re, sum(-v * sin(2 * pi() * ((e.j * w.k) % 64) / 64)) AS im FROM e, w GROUP BY 1, 2) SELECT i AS batch, k AS i, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM s")
def fourier_rows(spark, d):
    """The transform of each embedding."""
    x = image(spark, d).select(F.col("i").alias("batch"), F.col("j").alias("i"), F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return T.fourier(x, 64, ["batch"]).select("batch", "i", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("re", "im")))


_COSINES = "b AS (SELECT u, k, sqrt((CASE WHEN u = 0 THEN 1 ELSE 2 END) / 8.0) * cos((2 * k + 1) * u * pi() / 16) AS b FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS k))"
_FORWARD = "c AS (SELECT e.i // 8 AS bi, e.j // 8 AS bj, p.u AS u, q.u AS w, sum(e.v * p.b * q.b) AS v FROM e JOIN b p ON p.k = e.i % 8 JOIN b q ON q.k = e.j % 8 GROUP BY ALL), z AS (SELECT bi, bj, u, w, CAST(floor(v / (16 + 2 * (u + w)) + 0.5 + 1e-9) AS BIGINT) AS q FROM c)"


def _step():
    return F.lit(16) + 2 * (F.col("i") % 8 + F.col("j") % 8)


@query(f"WITH {IMAGE}, {_COSINES}, {_FORWARD} SELECT bi * 8 + u AS i, bj * 8 + w AS j, q FROM z")
def cosine_blocks(spark, d):
    """Quantised coefficients of the image's 8x8 blocks."""
    return T.quantised(T.cosine_blocks(image(spark, d)), _step())


@query(f"WITH {IMAGE}, {_COSINES}, {_FORWARD}, r AS (SELECT z.bi, z.bj, p.k AS x, q.k AS y, sum(z.q * (16 + 2 * (z.u + z.w)) * p.b * q.b) AS v FROM z JOIN b p ON p.u = z.u JOIN b q ON q.u = z.w GROUP BY ALL) SELECT bi * 8 + x AS i, bj * 8 + y AS j, round(v, 4) + 0.0 AS v FROM r")
def cosine_round_trip(spark, d):
    """The image that the quantised coefficients stand for."""
    q = T.quantised(T.cosine_blocks(image(spark, d)), _step())
    return T.cosine_blocks(T.dequantised(q, _step()), inverse=True).select("i", "j", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query(
    f"WITH {IMAGE}, o AS (SELECT a, b FROM (SELECT CAST(unnest(range(-2, 3)) AS BIGINT) AS a), (SELECT CAST(unnest(range(-2, 3)) AS BIGINT) AS b)), w AS (SELECT e.i, e.j, n.v, exp(-(a * a + b * b) / 8.0 - (n.v - e.v) * (n.v - e.v) / 5000.0) AS w FROM (SELECT e.*, a, b FROM e, o) e JOIN e n ON n.i = e.i + e.a AND n.j = e.j + e.b) "
    "SELECT i, j, round(sum(w * v) / sum(w), 4) + 0.0 AS v FROM w GROUP BY i, j"
)
def bilateral_filter(spark, d):
    return I.bilateral(image(spark, d)).select("i", "j", (F.round("v", 4) + F.lit(0.0)).alias("v"))


LOW, HIGH = 4000, 8000
_CANNY = f"""{IMAGE}, o AS (SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)),
  s AS MATERIALIZED (SELECT e.i, e.j, sum(n.v * (2 - abs(a)) * (2 - abs(b))) AS v FROM (SELECT e.*, a, b FROM e, o) e JOIN e n ON n.i = e.i + e.a AND n.j = e.j + e.b GROUP BY e.i, e.j),
  g AS (SELECT s.i, s.j, sum(n.v * a * (2 - abs(b))) AS gi, sum(n.v * b * (2 - abs(a))) AS gj FROM (SELECT s.*, a, b FROM s, o) s JOIN s n ON n.i = s.i + s.a AND n.j = s.j + s.b GROUP BY s.i, s.j),
  m AS MATERIALIZED (SELECT i, j, abs(gi) + abs(gj) AS size, CASE WHEN 12 * abs(gi) <= 5 * abs(gj) THEN 0 ELSE 1 END AS a, CASE WHEN 12 * abs(gi) <= 5 * abs(gj) THEN 1 WHEN 12 * abs(gj) <= 5 * abs(gi) THEN 0 WHEN gi * gj > 0 THEN 1 ELSE -1 END AS b FROM g),
  t AS MATERIALIZED (SELECT m.i, m.j, m.size FROM m LEFT JOIN m p ON p.i = m.i + m.a AND p.j = m.j + m.b LEFT JOIN m q ON q.i = m.i - m.a AND q.j = m.j - m.b WHERE m.size > coalesce(p.size, 0) AND m.size >= coalesce(q.size, 0) AND m.size >= {LOW})"""


@query(
    f"WITH RECURSIVE {_CANNY}, r AS (SELECT i, j FROM t WHERE size >= {HIGH} UNION SELECT t.i, t.j FROM (SELECT r.i + o.a AS i, r.j + o.b AS j FROM r, o) n JOIN t ON t.i = n.i AND t.j = n.j) SELECT i, j, CAST(size AS BIGINT) AS size FROM t JOIN r USING (i, j)"
)
def canny_edges(spark, d):
    return I.edges(image(spark, d), LOW, HIGH)
