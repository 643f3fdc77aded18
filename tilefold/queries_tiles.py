"""Queries of tiles, encodings, searches and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilefold.functions import bits as B
from tilefold.functions.staging import saved
from tilefold.operators import classifier
from tilefold.operators import graph as G
from tilefold.operators import matrix as M
from tilefold.operators import tiled
from tilefold.plans import products as P
from tilefold.queries import EDGES, ORACLES, _formats, a_op, a_sp, ctes, dense, graph_of_parts, query, square, vector

_B = "b AS (SELECT j, c, CAST((CAST(j AS DOUBLE) * (c + 1)) % 7 AS DOUBLE) AS b FROM x, (SELECT CAST(unnest(range(8)) AS INT) AS c))"


def _encoded(spark, d):
    a = a_sp(spark, d)
    chosen = M.choose_format(M.format_costs(M.tile_figures(M.tiles(a))))
    return tiled.encode_chosen(M.tile_values(a), chosen)


@query(ctes("a") + "SELECT fmt, i, j, v FROM a, (SELECT unnest([" + ", ".join(f"'{n}'" for n in B.FORMATS) + "]) AS fmt)")
def encoded_round_trip(spark, d):
    """Every tile in each of the seven formats, decoded again from codes and slots."""
    each = M.tile_values(a_sp(spark, d)).withColumn("fmt", F.explode(F.array(*map(F.lit, range(len(B.FORMATS))))))
    out = tiled.decode_each(tiled.encode_as(each))
    name = F.element_at(F.array(*map(F.lit, B.FORMATS)), F.col("fmt") + 1)
    return out.select(name.alias("fmt"), (F.col("ti") * 16 + F.shiftright("place", 4)).alias("i"), (F.col("tj") * 16 + F.col("place").bitwiseAND(F.lit(15))).alias("j"), "v")


@query(ctes("a", "x") + "SELECT i, CAST(sum(v * x) AS DOUBLE) AS y FROM a JOIN x USING (j) GROUP BY i")
def tiled_spmv(spark, d):
    """Over tiles in their chosen formats."""
    return tiled.spmv(_encoded(spark, d), vector(spark, d))


@query(ctes("a", "x", more=_B) + "SELECT i, c, CAST(sum(v * b) AS DOUBLE) AS y FROM a JOIN b USING (j) GROUP BY i, c")
def tiled_spmm(spark, d):
    return tiled.spmm(_encoded(spark, d), dense(spark, d))


@query(ctes("o", "x") + "SELECT CAST(o_orderkey AS BIGINT) AS i, coalesce(y, 0) AS y FROM orders LEFT JOIN (SELECT i, CAST(sum(v * x) AS DOUBLE) AS y FROM o JOIN x USING (j) GROUP BY i) ON i = o_orderkey")
def spmv_all_rows(spark, d):
    """Rows without entries are 0."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("i"))
    return M.dense_rows(M.spmv(a_op(spark, d), vector(spark, d)), rows)


@query(ctes("a") + "SELECT i // 16 AS ti, j // 16 AS tj, CAST(row_number() OVER (PARTITION BY i // 16, j // 16 ORDER BY i, j) - 1 AS INT) AS k, CAST(j % 16 AS INT) AS lc FROM a")
def packed_nibbles(spark, d):
    """The local columns of each tile packed two a byte and taken out again."""
    t = M.tile_values(a_sp(spark, d)).select("ti", "tj", F.transform("places", lambda p: p.bitwiseAND(F.lit(15)).cast("int")).alias("cols"))
    packed = t.select("ti", "tj", F.size("cols").alias("n"), B.pack_nibbles("cols").alias("packed"))
    each = packed.select("ti", "tj", "packed", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return each.select("ti", "tj", "k", B.nibble("packed", F.col("k")).cast("int").alias("lc"))


@query(ctes("s") + "SELECT i // 16 AS ti, j // 16 AS tj, CAST(count(*) AS BIGINT) AS nnz FROM (SELECT DISTINCT p.i, q.j FROM s p JOIN s q ON p.j = q.i) GROUP BY 1, 2")
def spgemm_tile_nnz(spark, d):
    s = square(spark, d)
    return M.tile_nnz(s, s)


@query(ctes("a") + "SELECT DISTINCT p.i, q.i AS j FROM a p JOIN a q ON p.j = q.j")
def spgemm_columns(spark, d):
    """The column list of each row of the product."""
    a = a_sp(spark, d)
    return P.places(a, M.transpose(a))


@query(ctes("s") + "SELECT i // 16 AS ti, j // 16 AS tj, CAST(i % 16 AS INT) AS lr, CAST(bit_or(CAST(1 << CAST(j % 16 AS INT) AS INT)) AS INT) AS mask FROM (SELECT DISTINCT p.i, q.j FROM s p JOIN s q ON p.j = q.i) GROUP BY 1, 2, 3")
def boolean_tile_masks(spark, d):
    s = square(spark, d)
    return M.boolean_masks(s, s)


@query(ctes("a") + ", t AS (SELECT DISTINCT i // 16 AS ti, j // 16 AS k FROM a) SELECT p.ti, q.ti AS tj, CAST(count(*) AS BIGINT) AS common FROM t p JOIN t q USING (k) GROUP BY 1, 2")
def common_tiles(spark, d):
    a = a_sp(spark, d)
    return M.common_tiles(a, a)


@query("WITH i AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS id FROM lineitem WHERE l_quantity > 40), b AS (SELECT id AS k, 1 AS n, 0 AS asked FROM i UNION ALL SELECT CAST(o_orderkey AS BIGINT), 0, 1 FROM orders), m AS (SELECT k, max(n) AS n, max(asked) AS asked FROM b GROUP BY k), w AS (SELECT k, asked, sum(n) OVER (ORDER BY k) - n AS place FROM m) SELECT k AS key, CAST(place AS BIGINT) AS place FROM w WHERE asked = 1")
def lower_bound(spark, d):
    ids = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 40").select(F.col("l_orderkey").cast("bigint").alias("id"))
    keys = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("key"))
    return M.lower_bound(ids, keys)


@query(_formats("o") + " SELECT ti, tj, CAST(bytes AS BIGINT) AS bytes, CAST(sum(bytes) OVER (ORDER BY ti, tj) - bytes AS BIGINT) AS at FROM c")
def packed_offsets(spark, d):
    chosen = M.choose_format(M.format_costs(M.tile_figures(M.tiles(a_op(spark, d)))))
    return M.packed_offsets(chosen.select("ti", "tj", "bytes"))


@query(ctes("o") + "SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS BIGINT) AS flat, i FROM o")
def rows_of_flat_entries(spark, d):
    return M.flat_rows(a_op(spark, d)).select(F.col("flat").cast("bigint").alias("flat"), "i")


@query("SELECT CAST(o_custkey AS BIGINT) AS key, CAST(o_orderkey AS BIGINT) AS value, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS BIGINT) AS rank FROM orders")
def sorted_pairs(spark, d):
    pairs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("bigint").alias("key"), F.col("o_orderkey").cast("bigint").alias("value"))
    return M.ranked(pairs, "key", "value").select("key", "value", F.col("rank").cast("bigint").alias("rank"))


@query(ctes("o", more="n AS (SELECT i, count(*) AS n FROM o GROUP BY i)") + "SELECT i, j, CAST(row_number() OVER (PARTITION BY i ORDER BY v, j) - 1 AS INT) AS pos, CAST((n > 1)::INT + (n > 2)::INT + (n > 4)::INT + (n > 8)::INT AS INT) AS bin FROM o JOIN n USING (i)")
def segments_sorted(spark, d):
    """Rows as segments, sorted by value; the bin is of their length."""
    o = a_op(spark, d)
    lengths = M.bins(o.groupBy("i").agg(F.count("*").alias("n")), "n", [1, 2, 4, 8])
    placed = M.positions(o, "i", ["v", "j"])
    return placed.join(lengths, "i").select("i", "j", F.col("pos").cast("int").alias("pos"), F.col("bin").cast("int").alias("bin"))


@query(ctes("o") + "SELECT ti, tj, CAST(row_number() OVER (PARTITION BY ti ORDER BY tj) - 1 AS INT) AS pos FROM (SELECT DISTINCT i // 16 AS ti, j // 16 AS tj FROM o)")
def tile_columns_sorted(spark, d):
    t = M.elements(a_op(spark, d)).select("ti", "tj").distinct()
    return M.positions(t, "ti", "tj").select("ti", "tj", F.col("pos").cast("int").alias("pos"))


@query(ctes("a") + "SELECT i // 16 AS ti, j // 16 AS tj, CAST(row_number() OVER (PARTITION BY i // 16, j // 16 ORDER BY j, i) - 1 AS INT) AS pos, i, j, v FROM a")
def tiles_by_columns(spark, d):
    """The entries of each tile column by column."""
    turned = M.tile_values(M.transpose(a_sp(spark, d))).select(F.col("ti").alias("tj"), F.col("tj").alias("ti"), F.posexplode(F.arrays_zip("places", "vals")).alias("pos", "e"))
    return turned.select("ti", "tj", "pos", (F.col("ti") * 16 + F.col("e.places").bitwiseAND(F.lit(15))).alias("i"), (F.col("tj") * 16 + F.shiftright("e.places", 4)).alias("j"), F.col("e.vals").alias("v"))


@query(ctes("s") + "SELECT i, j FROM s WHERE v > 40 UNION SELECT j AS i, i AS j FROM s WHERE v < 5")
def pattern_union(spark, d):
    s = square(spark, d)
    return s.where("v > 40").select("i", "j").unionByName(M.transpose(s.where("v < 5")).select("i", "j")).distinct()


@query(ctes("s") + "SELECT i, j, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT i, j, v FROM s UNION ALL SELECT j AS i, i AS j, -v AS v FROM s) GROUP BY i, j HAVING sum(v) <> 0")
def sum_without_zeros(spark, d):
    s = square(spark, d)
    return M.add(s, M.transpose(s), 1.0, -1.0).where("v <> 0")


_BALANCE = "n AS (SELECT i // 16 AS ti, count(DISTINCT j // 16) AS n FROM a GROUP BY 1), p AS (SELECT ti, n, sum(n) OVER (ORDER BY ti) - n AS b, (n + (n + 7) // 8 - 1) // ((n + 7) // 8) AS z FROM n), q AS (SELECT *, unnest(range((n + z - 1) // z)) AS chunk FROM p)"


@query(ctes("a", more=_BALANCE) + "SELECT ti, CAST(chunk AS BIGINT) AS chunk, CAST(b + chunk * z AS BIGINT) AS start, CAST(least(b + (chunk + 1) * z, b + n) AS BIGINT) AS stop, n > 8 AS split FROM q")
def load_balance_eight(spark, d):
    return M.balance(a_sp(spark, d), 8)


@query(ctes("s") + ", c AS (SELECT count(*) AS n FROM s p JOIN s q ON p.j = q.i GROUP BY p.i, q.j), t AS (SELECT count(*) / (count(DISTINCT (i // 16, j // 16)) * 256) AS density FROM s) SELECT CAST(sum(n) AS BIGINT) AS products, CAST(count(*) AS BIGINT) AS places, sum(n) / count(*) AS rate, any_value(density) AS density FROM c, t")
def compression_rate(spark, d):
    s = square(spark, d)
    return M.compression(s, s)


@query("SELECT CAST(l_orderkey AS BIGINT) AS i, CAST(2 * count(*) / sum(l_quantity) / 1e6 AS DOUBLE) AS gflops FROM lineitem GROUP BY 1")
def gflops(spark, d):
    runs = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").cast("bigint").alias("i")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("ms"))
    return runs.select("i", M.gflops(F.col("n"), F.col("ms")).alias("gflops"))


@query("SELECT CAST(0 AS BIGINT) AS conflicts, true AS within, CAST(count(*) AS BIGINT) AS nodes FROM (SELECT DISTINCT l_suppkey, 0 AS side FROM lineitem UNION ALL SELECT DISTINCT l_partkey, 1 FROM lineitem)")
def graph_colouring(spark, d):
    """Colours of the graph of suppliers and their parts, told as the edges between nodes of one colour (none), whether the
    colours are at most one more than the greatest degree and none is left out, and the coloured nodes; parts have odd numbers and suppliers even ones."""
    e = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") * 2).cast("bigint").alias("a"), (F.col("l_partkey") * 2 + 1).cast("bigint").alias("b"))
    e = e.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return _coloured(e)


def _coloured(e):
    """Conflicts, coloured nodes, and whether there are at most as many colours as the greatest degree and one."""
    c = saved(G.colouring(e), "colours")
    most = G.degrees(e).agg(F.max("degree")).first()[0]
    last, n = c.agg(F.max("colour"), F.count_distinct("colour")).first()
    return G.conflicts(e, c).withColumn("within", F.lit(last <= most and n == last + 1))


_GRID = "g AS (SELECT DISTINCT o_custkey // 5 AS src, o_custkey // 5 + 1 AS dst FROM orders), e AS (SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM g)"


def _path(spark, d):
    """A sparse graph along the customers' keys."""
    k = F.floor(F.col("o_custkey") / 5)
    return spark.read.parquet(f"{d}/orders.parquet").select(k.cast("bigint").alias("src"), (k + 1).cast("bigint").alias("dst")).distinct()


@query(f"WITH {_GRID}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), t AS (SELECT src, dst FROM e UNION SELECT x.src, y.dst FROM b x JOIN b y ON x.dst = y.src WHERE x.src < y.dst) SELECT src, dst FROM t")
def graph_within_two(spark, d):
    return G.within_two(_path(spark, d))


@query(f"WITH {_GRID} SELECT CAST(0 AS BIGINT) AS conflicts, true AS within, CAST(count(*) AS BIGINT) AS nodes FROM (SELECT src FROM e UNION SELECT dst FROM e)")
def graph_colouring_two(spark, d):
    """A colouring at distance two, told by its conflicts at one and two steps."""
    near = G.within_two(_path(spark, d))
    return _coloured(near)


@query(f"WITH RECURSIVE {EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY 1)" + ", l AS (SELECT CAST(5 AS BIGINT) AS node, 0 AS level UNION SELECT b.dst, level + 1 FROM l JOIN b ON b.src = l.node WHERE level < 40), k AS (SELECT node, degree, level FROM n LEFT JOIN (SELECT node, min(level) AS level FROM l GROUP BY 1) USING (node)) SELECT node, CAST(row_number() OVER (ORDER BY level IS NOT NULL, -level, CASE WHEN level IS NULL THEN 0 ELSE -degree END, node DESC) - 1 AS BIGINT) AS place FROM k")
def graph_bandwidth_order(spark, d):
    order = G.bandwidth_order(graph_of_parts(spark, d), 5)
    return order.select("node", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {EDGES} SELECT CAST(0 AS BIGINT) AS near, CAST(count(*) AS BIGINT) AS nodes FROM (SELECT src FROM e UNION SELECT dst FROM e)")
def graph_independent_set_figures(spark, d):
    """Of a set at distance two: members with a member next to them, and nodes that are members or within two steps of one."""
    e = saved(graph_of_parts(spark, d), "graph")
    out, chosen = G.both_ways(e), G.saved(G.independent_set(e), "independent")
    one = out.join(chosen.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    two = out.join(one.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node"))
    near = chosen.join(one.distinct(), "node", "left_semi").agg(F.count("*").alias("near")).select("near", F.lit(0).cast("bigint").alias("nodes"))
    reached = chosen.unionByName(one).unionByName(two).agg(F.count_distinct("node").alias("nodes")).select(F.lit(0).cast("bigint").alias("near"), "nodes")
    return near.unionByName(reached).agg(F.sum("near").alias("near"), F.sum("nodes").alias("nodes"))




@query(ORACLES["tile_row_masks"])
def masks_of_quadrants(spark, d):
    """Row masks out of the words of the four quadrants, which are made from row masks."""
    t = M.tiles(a_sp(spark, d)).select("ti", "tj", B.quadrants("masks").alias("words"))
    return t.select("ti", "tj", F.posexplode(B.masks_of_quadrants("words")).alias("lr", "mask")).where("mask <> 0").withColumn("n", F.bit_count("mask").cast("int"))


@query(ctes("a") + ", p AS (SELECT i // 16 AS ti, j // 16 AS tj, (i % 16) // 8 * 2 + (j % 16) // 8 AS q, i % 8 * 8 + j % 8 AS b FROM a) SELECT ti, tj, CAST(q AS INT) AS quadrant, bit_or(CASE WHEN b = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << CAST(b AS INT) END) AS word FROM p GROUP BY 1, 2, 3")
def quadrant_words(spark, d):
    t = M.tiles(a_sp(spark, d)).select("ti", "tj", F.posexplode(B.quadrants("masks")).alias("quadrant", "word"))
    return t.where("word <> 0")


@query(ctes("a", more="t AS (SELECT i // 16 AS ti, j // 16 AS tj, i % 16 * 16 + j % 16 AS p FROM a), m AS (SELECT ti, tj, count(*) / 256 AS m FROM t GROUP BY 1, 2), g AS (SELECT ti, tj, m, p FROM m, (SELECT unnest(range(256)) AS p))") + "SELECT g.ti, g.tj, CAST(g.p AS INT) AS p, CAST(round(1e6 * ((CASE WHEN t.p IS NULL THEN 0 ELSE 1 END) - m) / greatest(sqrt(m * (1 - m)), 1e-6)) AS BIGINT) AS pixel FROM g LEFT JOIN t ON g.ti = t.ti AND g.tj = t.tj AND g.p = t.p")
def tile_images(spark, d):
    """Pixels in millionths."""
    return classifier.tile_pixels(M.tiles(a_sp(spark, d)), lambda v: F.round(v * 1e6).cast("bigint"))


_RULES = {"least_bytes": ("fmt", "bytes"), **{f"force_{n}": (str(k), f'"{n}"') for k, n in enumerate(B.FORMATS)}, "heuristic": ("CASE WHEN z >= 192 THEN 6 WHEN z < 12 THEN 0 ELSE 1 END", 'CASE WHEN z >= 192 THEN "DNS" WHEN z < 12 THEN "COO" ELSE "CSR" END')}


@query(_formats("a") + ", b AS (SELECT y.*, fmt, bytes FROM y JOIN c USING (ti, tj)) " + " UNION ALL ".join(f"SELECT '{n}' AS selector, ti, tj, CAST({f} AS INT) AS fmt, CAST({b} AS BIGINT) AS bytes FROM b" for n, (f, b) in _RULES.items()))
def format_selectors(spark, d):
    """Each rule's choice for every tile."""
    costs = M.format_costs(M.tile_figures(M.tiles(a_sp(spark, d))))
    out = None
    for name, choose in M.SELECTORS.items():
        own = choose(costs).select(F.lit(name).alias("selector"), "ti", "tj", F.col("fmt").cast("int").alias("fmt"), F.col("bytes").cast("bigint").alias("bytes"))
        out = own if out is None else out.unionByName(own)
    return out


@query(_formats("o") + " SELECT ti, tj, CAST(CASE WHEN z <= 11 THEN 0 WHEN z > 191 THEN 6 WHEN rows <= 3 THEN 4 WHEN cols <= 3 THEN 5 WHEN longest > 4 THEN 1 WHEN tail > 0 THEN 3 ELSE 2 END AS INT) AS fmt FROM f")
def formats_by_tree(spark, d):
    return M.predicted_by_tree(M.tile_figures(M.tiles(a_op(spark, d))))


@query(ctes("s") + "SELECT p.i, CAST(count(*) AS BIGINT) AS products FROM s p JOIN s q ON p.j = q.i GROUP BY 1")
def guarded_products(spark, d):
    """Products of A A, whose sizes are checked when it runs."""
    s = M.guarded_square(square(spark, d), F.lit(512), F.lit(512))
    return M.product_counts(s, s)
