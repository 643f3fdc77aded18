"""Queries of sources, sinks and result tables: what is written to the shared folder is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilefold.functions import bits as B
from tilefold.functions.staging import new_path, saved
from tilefold.operators import classifier
from tilefold.operators import matrix as M
from tilefold.operators import records as R
from tilefold.queries import _PAIRS, _formats, _pairs, a_op, a_sp, ctes, lines, query, square, vector
from tilefold.sources import matrix_market as S

_SIZE = "SELECT CAST(max(i) + 1 AS BIGINT) AS m, CAST(max(j) + 1 AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS entries FROM {}"


def _size(a):
    return a.agg((F.max("i") + 1).alias("m"), (F.max("j") + 1).alias("n")).first()


def _written(spark, a, **how):
    path = new_path(spark, "mtx")
    S.write_matrix(a, path, *_size(a), **how)
    return path


@query(ctes("a") + "SELECT i, j, v FROM a")
def mtx_round_trip(spark, d):
    return S.read_matrix(spark, _written(spark, a_sp(spark, d)))


@query(ctes("a") + _SIZE.format("a").replace("SELECT", "SELECT 'coordinate' AS layout, 'real' AS kind, 'general' AS symmetry,"))
def mtx_header(spark, d):
    head = S.read_header(spark, _written(spark, a_sp(spark, d)))
    return spark.createDataFrame([(head.layout, head.kind, head.symmetry, head.rows, head.cols, head.entries)], "layout string, kind string, symmetry string, m bigint, n bigint, entries bigint")


@query(ctes("s") + ", e AS (SELECT i, j, v FROM s WHERE i >= j) SELECT i, j, v FROM e UNION ALL SELECT j AS i, i AS j, v FROM e WHERE i <> j")
def mtx_symmetric(spark, d):
    return S.read_matrix(spark, _written(spark, square(spark, d).where("i >= j"), symmetry="symmetric"))


@query(ctes("s") + "SELECT i, j, v FROM s WHERE i > j")
def mtx_skew_symmetric(spark, d):
    """Skew-symmetric entries are read as they stand."""
    return S.read_matrix(spark, _written(spark, square(spark, d).where("i > j"), symmetry="skew-symmetric"))


@query(ctes("a") + "SELECT i, j, CAST(1 AS DOUBLE) AS v FROM a")
def mtx_pattern(spark, d):
    return S.read_matrix(spark, _written(spark, a_sp(spark, d), kind="pattern"))


@query(ctes("s") + ", m AS (SELECT max(i) + 1 AS m, max(j) + 1 AS n FROM s), g AS (SELECT unnest(range(m * n)) AS k, m FROM m) SELECT CAST(k % m AS BIGINT) AS i, CAST(k // m AS BIGINT) AS j, coalesce(v, 0) AS v FROM g LEFT JOIN s ON s.i = k % m AND s.j = k // m")
def mtx_array(spark, d):
    path, s = new_path(spark, "array"), square(spark, d)
    S.write_array(s, path, *_size(s))
    return S.read_array(spark, path)


@query(ctes("a") + "SELECT i, j, v FROM a")
def mtx_cache(spark, d):
    """The second read finds the Parquet copy of the first."""
    path, cache = _written(spark, a_sp(spark, d)), new_path(spark, "cache")
    S.cached(spark, path, cache)
    return S.cached(spark, path, cache)


_BITS = "t AS (SELECT i // 16 AS ti, j // 16 AS tj, i % 16 * 16 + j % 16 AS p FROM a), p AS (SELECT unnest(range(256)) AS p), b AS (SELECT k.ti, k.tj, string_agg(CASE WHEN t.p IS NULL THEN '0' ELSE '1' END, '' ORDER BY k.p) AS bits FROM (SELECT ti, tj, p.p FROM (SELECT DISTINCT ti, tj FROM t), p) k LEFT JOIN t ON t.ti = k.ti AND t.tj = k.tj AND t.p = k.p GROUP BY 1, 2)"
_NAMES = "CASE fmt " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(B.FORMATS)) + " END"


def _labelled(spark, d):
    chosen = M.choose_format(M.format_costs(M.tile_figures(M.tiles(a_sp(spark, d)), "masks")), "masks")
    label = F.element_at(F.array(*map(F.lit, B.FORMATS)), F.col("fmt") + 1)
    return chosen.select("ti", "tj", B.bits_string("masks").alias("bits"), label.alias("label"))


@query(_formats("a") + f", {_BITS} SELECT bits, {_NAMES} AS label FROM c JOIN b USING (ti, tj)")
def labelled_tiles(spark, d):
    """Tiles written to a folder a label and read back."""
    path = new_path(spark, "labels")
    S.write_tiles(_labelled(spark, d).select("label", "bits"), path)
    return S.read_tiles(spark, path)


@query(ctes("a") + f", {_BITS} SELECT bits, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1")
def tiles_without_copies(spark, d):
    return M.tiles(a_sp(spark, d)).select(B.bits_string("masks").alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))


@query("SELECT CAST(unnest(range(6000)) AS BIGINT) AS id, CAST(256 AS INT) AS width")
def random_tiles(spark, d):
    return S.random_tiles(spark, 6000).select("id", F.length(F.regexp_replace("bits", "[^01]", "")).alias("width"))


@query(ctes("a") + "SELECT i, j, CAST(1 AS DOUBLE) AS v FROM a")
def matrix_of_bitmaps(spark, d):
    return S.tile_matrix(M.tiles(a_sp(spark, d)).select("ti", "tj", B.bits_string("masks").alias("bits")))


@query("SELECT CAST(o_orderkey AS BIGINT) AS task, o_orderstatus AS status, CAST(o_orderkey % 2 AS INT) AS run FROM orders")
def result_csv(spark, d):
    """A log that two runs add to."""
    path = new_path(spark, "log")
    for run in (0, 1):
        rows = spark.read.parquet(f"{d}/orders.parquet").where(F.col("o_orderkey") % 2 == run)
        R.append_csv(rows.select(F.col("o_orderkey").cast("bigint").alias("task"), F.col("o_orderstatus").alias("status"), F.lit(run).alias("run")), path)
    return R.read_csv(spark, path, "task bigint, status string, run int")


@query("SELECT error, CAST(count(*) AS BIGINT) AS n, CAST(min(l_orderkey) AS BIGINT) AS first FROM (SELECT l_orderkey, CASE WHEN NOT l_quantity <= 45 THEN 'quantity' WHEN NOT l_discount < 0.08 THEN 'discount' END AS error FROM lineitem) GROUP BY 1")
def error_log(spark, d):
    good, errors = R.with_errors(lines(spark, d), {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.08})
    return errors.unionByName(good.withColumn("error", F.lit(None).cast("string"))).groupBy("error").agg(F.count("*").alias("n"), F.min("l_orderkey").cast("bigint").alias("first"))


_SHAPES = [("conv", 0, "w", 9 * 32), ("conv", 0, "b", 32), ("conv", 1, "w", 288 * 64), ("conv", 1, "b", 64), ("conv", 2, "w", 576 * 128), ("conv", 2, "b", 128), ("full", 0, "w", 512 * 256), ("full", 0, "b", 256), ("full", 1, "w", 256 * 128), ("full", 1, "b", 128), ("full", 2, "w", 128 * 7), ("full", 2, "b", 7)]


@query("SELECT kind, CAST(layer AS INT) AS layer, part, CAST(n AS INT) AS n FROM (VALUES " + ", ".join(map(str, _SHAPES)) + ") t(kind, layer, part, n)")
def network_weights(spark, d):
    """A network saved, read and saved again: its layers and their numbers."""
    first, second = new_path(spark, "net"), new_path(spark, "net")
    classifier.save(spark, classifier.Network(len(B.FORMATS)), first)
    classifier.save(spark, classifier.load(spark, first), second)
    return spark.read.parquet(second).select("kind", "layer", "part", F.size("values").alias("n"))


@query()
def predicted_formats(spark, d):
    """Formats of all tiles by a small network that is fitted on all different labelled tiles."""
    tiles = saved(_labelled(spark, d), "tiles")
    net = classifier.fit(tiles, list(B.FORMATS), epochs=4, conv=(4, 8, 8), full=(32, 16))
    return classifier.predict(tiles, net, list(B.FORMATS)).select("ti", "tj", "label", "predicted")


@query(ctes("a") + ", z AS (SELECT i // 16 AS ti, j // 16 AS tj, count(*) / 256 AS m FROM a GROUP BY 1, 2) SELECT ti, tj, CAST(round(m * 1e9) AS BIGINT) AS mean, CAST(round(sqrt(m * (1 - m)) * 1e9) AS BIGINT) AS deviation FROM z")
def tile_moments(spark, d):
    m = classifier.tile_moments(M.tiles(a_sp(spark, d)))
    return m.select("ti", "tj", *(F.round(F.col(c) * 1e9).cast("bigint").alias(c) for c in ("mean", "deviation")))


_E = "e AS (SELECT vec_id, unnest(range(len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(f"WITH {_E} SELECT vec_id, CAST(p AS INT) AS p, CAST(round(greatest(x, 0) * 1e6) AS BIGINT) AS relu, CAST(CASE WHEN x > 0 THEN 1 ELSE 0 END AS DOUBLE) AS relu_slope, CAST(round(1e6 * (1 - 2 / (exp(2 * x) + 1))) AS BIGINT) AS tanh, CAST(round(1e6 * exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id)) AS BIGINT) AS softmax FROM e")
def activations(spark, d):
    whole = F.transform("embedding", lambda v: v.cast("double"))
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", whole.alias("all"), F.posexplode(whole).alias("p", "x"))
    made = classifier.activations(F.col("x"), F.col("all"))
    whole = {n: F.round(made[n] * 1e6).cast("bigint") for n in ("relu", "tanh", "softmax")}
    return e.select("vec_id", "p", made["relu_slope"].alias("relu_slope"), *(c.alias(n) for n, c in whole.items()))


@query(f"WITH {_E} SELECT vec_id, CAST(p // 16 AS BIGINT) AS y, CAST(p % 8 // 2 AS BIGINT) AS x, CAST(max(CAST(round(x * 1000) AS BIGINT)) AS BIGINT) AS top FROM e WHERE p < 64 GROUP BY 1, 2, 3")
def max_pool_2x2(spark, d):
    """Of each embedding's first 64 entries as an 8x8 image."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(F.slice("embedding", 1, 64)).alias("p", "e"))
    return e.groupBy("vec_id", F.floor(F.col("p") / 16).alias("y"), F.floor(F.col("p") % 8 / 2).alias("x")).agg(F.max(F.round(F.col("e").cast("double") * 1000).cast("bigint")).alias("top"))


@query(f"WITH p AS ({_PAIRS}) SELECT label AS model, CAST(count(*) FILTER (predicted = 0) AS BIGINT) AS zero, CAST(count(*) FILTER (predicted = 1) AS BIGINT) AS one FROM p GROUP BY 1")
def accuracy_matrix(spark, d):
    told = R.confusion(_pairs(spark, d)).select(F.col("label").alias("model"), F.element_at(F.array(F.lit("zero"), F.lit("one"), F.lit("two")), F.col("predicted") + 1).alias("test"), F.col("n").alias("accuracy"))
    return R.accuracy_matrix(told, ["zero", "one"]).fillna(0)


@query("SELECT CAST(o_orderkey AS BIGINT) AS task, CAST(o_custkey AS DOUBLE) AS gflops FROM orders")
def number_of_output(spark, d):
    said = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("task"), F.concat(F.lit("time 1.5 ms, GFlops: "), F.col("o_custkey").cast("string"), F.lit(".0 done")).alias("line"))
    return said.select("task", R.said_number("line", "gflops").alias("gflops"))


@query("SELECT CAST(user_id AS BIGINT) AS bits FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(DISTINCT event_id % 3) = 3")
def labelled_on_all_platforms(spark, d):
    tiles = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("bigint").alias("bits"), F.col("event_type").alias("label"), (F.col("event_id") % 3).alias("platform"))
    return R.labelled_everywhere(tiles, "click", 3)


_SAMPLED = "s AS (SELECT p_partkey FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 50)"


@query(f"WITH {_SAMPLED} SELECT CAST(p_partkey AS BIGINT) AS p_partkey FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM s)")
def without_sampled(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("p_partkey"))
    return R.without_sampled(parts, R.sample_by_hash(parts, "p_partkey", 50), "p_partkey")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1 AS BIGINT) AS rank FROM orders")
def seeded_shuffle(spark, d):
    return R.shuffled(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey")), "o_orderkey").select("o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AND CAST(o_orderkey AS VARCHAR) NOT LIKE '%13%' AND CAST(o_orderkey AS VARCHAR) NOT LIKE '%7%'")
def names_left_out(spark, d):
    tasks = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("name"))
    done = lines(spark, d).where("l_quantity > 40").select(F.col("l_orderkey").cast("string").alias("name"))
    return R.still_to_run(tasks, done, "name", ["13", "7"]).select(F.col("name").cast("bigint").alias("o_orderkey"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS task, CASE WHEN CAST(o_custkey AS VARCHAR) LIKE '20%' THEN '20' WHEN CAST(o_custkey AS VARCHAR) LIKE '30%' THEN '30' WHEN CAST(o_custkey AS VARCHAR) LIKE '40%' THEN '40' WHEN CAST(o_custkey AS VARCHAR) LIKE '50%' THEN '50' END AS platform FROM orders")
def platform_of_name(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("task"), F.col("o_custkey").cast("string").alias("name"))
    return o.select("task", R.platform("name").alias("platform"))


_MODELS = [("F", "0", "f0"), ("O", "1", "o1"), (None, "0", "all0"), (None, "2", "all2")]


@query("WITH m(platform, op, model) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _MODELS) + "), t AS (SELECT CAST(o_orderkey AS BIGINT) AS task, o_orderstatus AS platform, CAST(o_orderkey % 3 AS VARCHAR) AS op FROM orders) SELECT task, coalesce(p.model, r.model) AS model FROM t LEFT JOIN m p ON p.platform = t.platform AND p.op = t.op LEFT JOIN m r ON r.platform IS NULL AND r.op = t.op")
def model_of_platform(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("task"), F.col("o_orderstatus").alias("platform"), (F.col("o_orderkey") % 3).cast("string").alias("op"))
    return R.model_for(t, spark.createDataFrame(_MODELS, "platform string, op string, model string")).select("task", "model")


@query("SELECT l_returnflag, CAST(round(1e9 * avg(2 * l_quantity / l_extendedprice / 1e6)) AS BIGINT) AS gflops, CAST(round(1e9 * avg(2 * l_quantity / l_extendedprice / 1e6) / 105) AS BIGINT) AS ratio FROM lineitem GROUP BY 1")
def speeds(spark, d):
    s = R.speeds(lines(spark, d), "l_returnflag", "l_quantity", "l_extendedprice", 105.0)
    return s.select("l_returnflag", *(F.round(F.col(c) * 1e9).cast("bigint").alias(c) for c in ("gflops", "ratio")))


_OLD = "SELECT l_partkey AS key, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem WHERE l_linenumber {} 2 GROUP BY 1"


@query(f"WITH x AS ({_OLD.format('<=')}), y AS ({_OLD.format('>')}) SELECT CAST(key AS BIGINT) AS key, CAST(CASE WHEN x.v IS NULL THEN y.v WHEN y.v IS NULL THEN x.v ELSE 2 * x.v - y.v END AS BIGINT) AS v, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS rank FROM x FULL JOIN y USING (key)")
def ordered_merge(spark, d):
    """A keyed table with another put in by a function of both values, in the order of the keys."""

    def part(which):
        return lines(spark, d).where(f"l_linenumber {which} 2").groupBy(F.col("l_partkey").cast("bigint").alias("key")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("v"))

    both = R.merged(part("<="), part(">"), "key", "v", lambda x, y: 2 * x - y)
    return M.ranked(both, "key", "key").select("key", "v", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(l_partkey AS BIGINT) ORDER BY l_linenumber, l_partkey)), lambda s, x: (s * 31 + x) % 1000003) AS BIGINT) AS sum FROM lineitem GROUP BY 1")
def folded_by_function(spark, d):
    """A user's own aggregate over the few lines of an order, in their order."""
    own = lines(spark, d).groupBy(F.col("l_orderkey").cast("bigint").alias("l_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("bigint").alias("x")))).alias("all"))
    return own.select("l_orderkey", F.aggregate("all", F.lit(0).cast("bigint"), lambda s, e: (s * 31 + e["x"]) % 1000003).alias("sum"))


@query(ctes("o") + ", y AS (SELECT i, j, v + CASE WHEN j % 50 = 0 THEN 1 ELSE 0 END AS v FROM o WHERE j % 70 <> 0) SELECT i, j, o.v AS a, y.v AS b FROM o FULL JOIN y USING (i, j) WHERE o.v IS DISTINCT FROM y.v")
def matrix_difference(spark, d):
    o = a_op(spark, d)
    other = o.where("j % 70 <> 0").withColumn("v", F.col("v") + F.when(F.col("j") % 50 == 0, 1.0).otherwise(0.0))
    return M.matrix_difference(o, other)


@query(ctes("x") + ", g AS (SELECT tj, unnest(range(16)) AS lane FROM (SELECT DISTINCT j // 16 AS tj FROM x)) SELECT tj, CAST(lane AS INT) AS lane, coalesce(x, 0) AS x FROM g LEFT JOIN x ON j = tj * 16 + lane")
def vector_slices(spark, d):
    return M.vector_slices(vector(spark, d)).select("tj", F.posexplode("slice").alias("lane", "x"))


@query("SELECT n_name AS name FROM nation WHERE n_regionkey <> 0")
def matrices_listed(spark, d):
    """A file for each nation, those of one region under a name with an underscore ahead, which hides them."""
    folder = new_path(spark, "matrices")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for n in spark.read.parquet(f"{d}/nation.parquet").select("n_name", "n_regionkey").collect():  # 25 rows at any scale
        at = hadoop(f"{folder}/{'_' if n['n_regionkey'] == 0 else ''}{n['n_name']}.mtx")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(b"%%MatrixMarket matrix coordinate real general\n0 0 0\n"))
        out.close()
    return S.list_matrices(spark, folder)
