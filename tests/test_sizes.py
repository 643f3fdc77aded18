"""Steps that failed on larger tables or differed from SQL there."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tilefold import queries, queries_factors, queries_solvers, queries_tiles  # noqa: F401
from tilefold.operators import matrix as M


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _as_sql(spark, name, folder, tables):
    """The query's and its SQL's rows over tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = queries.QUERIES[name](spark, str(folder))
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    return sorted(tuple(r) for r in df.collect()), sorted(found)


def test_dense_columns_are_not_broadcast(spark, sf):
    """Eight columns out of an explode look as small as the keys they come from."""
    a = queries.a_sp(spark, sf)
    assert "BroadcastExchange" not in _plan(M.spmm(a, queries.dense(spark, sf)))


@pytest.mark.parametrize("name", ["max_pool", "batched_svd_energy"])
def test_halves_round_as_sql(spark, tmp_path, name):
    """A half in single precision that is less in double precision, and energies that end in half a thousand."""
    rows = [(k, [0.0] * (k % 60) + [k / 2000] + [0.0] * (63 - k % 60)) for k in range(1, 600)]
    rows += [(1000 + k, [0.01 * (k % 7 + 1), 0.02 * (k // 7 % 5 + 1), 0.01] + [0.01] * 5 + [0.0] * 56) for k in range(300)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = _as_sql(spark, name, tmp_path, ["embeddings"])
    assert got == want


def test_encoders_in_arrays(spark):
    """Tiles of all sizes, also full ones and single entries, come back from each of the formats; the encoders work on many tiles at once."""
    import numpy as np

    from tilefold.functions import bits as B
    from tilefold.operators import tiled

    r = np.random.default_rng(7)
    want = [(int(16 * t + p // 16), int(p % 16), float(p + 1)) for t, share in enumerate([1.0, 0.002, 0.02, 0.1, 0.5, 0.9] * 5) for p in range(256) if p == t or r.random() < share]
    t = M.tile_values(spark.createDataFrame(want, "i bigint, j bigint, v double"))
    filled = {x["ti"]: x for x in tiled.slots_of_each(t).collect()}
    for k, n in enumerate(B.FORMATS):
        e = tiled.encode(t, n)
        assert "ArrayTransform" not in _plan(e) and "transform(" not in _plan(e)
        assert all(len(x["slots"]) == filled[x["ti"]][n.lower()] for x in e.collect())
        back = tiled.decode(e, n).select((F.col("ti") * 16 + F.shiftright("place", 4)).alias("i"), (F.col("place") % 16).cast("bigint").alias("j"), "v")
        assert sorted(tuple(x) for x in back.collect()) == sorted(want)
    null = tiled.encode(M.tile_values(spark.createDataFrame([(0, 0, None), (0, 1, 2.0)], "i bigint, j bigint, v double")), "COO").first()
    assert null["slots"] == [None, 2.0]


def test_common_tiles_by_cells(spark):
    """Rows and words of several cells, against sets; pairs of rows are not made once for each word."""
    import numpy as np

    r = np.random.default_rng(3)
    tiles = sorted({(int(a), int(b)) for a, b in zip(r.choice([0, 3, 511, 512, 700, 1500], 60), r.choice([0, 31, 32, 2047, 2048, 5000], 60))})
    a = spark.createDataFrame([(16 * i + 5, 16 * j + 9, 1.0) for i, j in tiles], "i bigint, j bigint, v double")
    of = {}
    for i, j in tiles:
        of.setdefault(i, set()).add(j)
    want = sorted((i, j, len(of[i] & of[j])) for i in of for j in of if of[i] & of[j])
    got = M.common_tiles(a, a)
    assert sorted((x["ti"], x["tj"], x["common"]) for x in got.collect()) == want
    assert "bit_count" not in _plan(got)


@pytest.mark.parametrize("name", ["independent_set", "levels", "colouring"])
def test_links_are_written_once(spark, monkeypatch, name):
    """Rounds start from a table of links and do not make the links again."""
    from tilefold.operators import graph as G

    plans = []
    saved = G.saved
    monkeypatch.setattr(G, "saved", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), saved(df, *a, **k))[1])
    e = spark.createDataFrame([(k, k + s) for k in range(40) for s in (1, 7)], "src bigint, dst bigint")
    (G.levels(e, 5) if name == "levels" else getattr(G, name)(e)).collect()
    assert len(plans) > 2 and not any("LogicalRDD" in p and "Relation [" in p for p in plans)


def test_long_chains_are_swept(spark, monkeypatch):
    """Factors by threshold of a path of 60 nodes take no round for each of them, and solve like any others."""
    from tilefold.operators import factors

    n = 60
    rows = [(i, j, 9.0 + i % 3 if i == j else -1.0 - (i + 2 * j) % 4 / 4) for i in range(n) for j in range(n) if abs(i - j) <= 1]
    a = spark.createDataFrame(rows, "i bigint, j bigint, v double")
    written = []
    saved = factors.saved
    monkeypatch.setattr(factors, "saved", lambda df, *x, **k: (written.append(1), saved(df, *x, **k))[1])
    f = factors.threshold_lu(a, 1.5, steps=1)
    assert len(written) < 60
    made = {(x["i"], x["j"]): x["v"] for x in f.product().collect()}
    assert all(abs(made[i, j] - v) < 1e-11 for i, j, v in rows)


def test_unsettled_sweeps_are_eliminated(spark, monkeypatch):
    """Where sweeps do not settle in time the factors are those of the elimination."""
    import math

    from tilefold.operators import factors

    heavy = [(i, j, 1.0 if i == j else 3.0 if i > j else -2.0) for i in range(8) for j in range(8) if abs(i - j) <= 1]
    monkeypatch.setattr(factors, "SWEEPS", 3)
    a = spark.createDataFrame(heavy, "i bigint, j bigint, v double")
    assert factors.settled(a, a) is None
    got = {(x["i"], x["j"]): x["v"] for x in factors.threshold_lu(a, 1.0, steps=0).product().collect()}
    assert all(math.isclose(got[i, j], v, abs_tol=1e-9) for i, j, v in heavy)


def test_solvers_send_no_vector_through_the_driver(spark, monkeypatch):
    """Neither the solvers' own joins nor those of a factorisation and its solves are broadcasts, also of small tables."""
    from tilefold.operators import factors, solvers

    plans = []
    for module in (factors, solvers):
        monkeypatch.setattr(module, "saved", lambda df, *a, f=module.saved, **k: (plans.append(_plan(df)), f(df, *a, **k))[1])
    a = spark.createDataFrame([(i, j, 4.0 if i == j else -1.0) for i in range(6) for j in range(6) if abs(i - j) <= 1], "i bigint, j bigint, v double")
    b = spark.createDataFrame([(i, float(i + 1)) for i in range(6)], "i bigint, x double")
    near = factors.incomplete_lu(a).solve
    got = {r["i"]: r["x"] for r in solvers.gmres(a, b, restart=1, cycles=1, precondition=near).collect()}
    solvers.conjugate_gradients(a, b, steps=1, precondition=near)
    assert len(got) == 6 and len(plans) > 20 and not any("Broadcast" in p for p in plans)
    monkeypatch.setattr(type(a), "first", lambda df, f=type(a).first: (plans.append(_plan(df)), f(df))[1])
    solvers.dot(b, b)
    assert "Broadcast" not in plans[-1]


def test_tiles_are_predicted_once(spark):
    """Equal tiles go through the network once, and the label is the one that forward() gives."""
    import numpy as np

    from tilefold.operators import classifier

    r = np.random.default_rng(5)
    few = ["".join("01"[int(x)] for x in (r.random(256) < p)) for p in r.random(40)] + ["0" * 256, "1" * 256]
    net = classifier.Network(7, conv=(4, 8, 8), full=(32, 16))
    names = list("abcdefg")
    want = {b: names[k] for b, k in zip(few, net.forward(np.array([classifier.image(b) for b in few])).argmax(1))}
    assert (net.labels(np.array([classifier.image(b) for b in few])) == [names.index(want[b]) for b in few]).all()
    got = classifier.predict(spark.createDataFrame([(b,) for b in few * 30], "bits string").coalesce(1), net, names).collect()
    assert len(got) == 30 * len(few) and all(x["predicted"] == want[x["bits"]] for x in got) and len(set(want.values())) > 1


def test_labels_need_no_join(spark, sf):
    from tilefold.queries_sources import _labelled

    assert "Join" not in _plan(_labelled(spark, sf))


def test_products_by_cells(spark, monkeypatch):
    """Several cells and pieces, negative indexes, repeated places, nulls, cancelled and infinite entries: as the element-wise product."""
    import random

    from tilefold.plans import products

    r = random.Random(4)
    at = lambda: r.choice([-1025, -1, 0, 5, 1023, 1024, 3000])
    a, b = (spark.createDataFrame([(at(), at() if n else r.randrange(2000), r.choice([1.0, -1.0, 2.5, None, float("inf")])) for _ in range(80)], "i bigint, j bigint, v double") for n in (1, 1))
    monkeypatch.setattr(M, "AT_ONCE", 7)
    rows = lambda df: sorted(repr(tuple(x)) for x in df.collect())
    assert rows(M.cell_products(a, b)) == rows(M.spgemm(a, b)) and rows(M.cell_products(a, b, lengths=True)) == rows(M.symbolic(a, b))
    dense = spark.range(4000).selectExpr("id div 40 as i", "id % 40 as j", "1D as v")
    assert products.by_cells(dense, M.transpose(dense)) and "MapInArrow" in _plan(products.sparse_product(dense, M.transpose(dense)))
    wide = dense.limit(12).selectExpr("(i * 40 + j) * 1024 as i", "i * 40 + j as j", "v")
    assert not products.by_cells(wide, M.transpose(wide))
    assert rows(products.sparse_product(wide, M.transpose(wide))) == rows(M.cell_products(wide, M.transpose(wide)))
    assert products.by_cells(dense.limit(0), dense) and products.sparse_product(dense.limit(0), dense).count() == 0


def test_entries_are_written_as_often_as_rounds_halve(spark, monkeypatch):
    """A path of 16 nodes takes 16 rounds; its entries are not written again in each of them."""
    from tilefold.operators import factors

    n = 16
    rows = [(i, j, 9.0 + i % 3 if i == j else -1.0 - (i + 2 * j) % 4 / 4) for i in range(n) for j in range(n) if abs(i - j) <= 1]
    written = []
    monkeypatch.setattr(factors, "saved", lambda df, *x, f=factors.saved, **k: (t := f(df, *x, **k), "ri" in t.columns and written.append(t.count()))[0])
    f = factors.incomplete_lu(spark.createDataFrame(rows, "i bigint, j bigint, v double"))
    assert f.rounds == n and sum(written) < 5 * len(rows)
    made = {(x["i"], x["j"]): x["v"] for x in f.product().collect()}
    assert all(abs(made[i, j] - v) < 1e-12 for i, j, v in rows)


def test_long_signals_are_cut(spark, monkeypatch):
    """Transforms follow the shorter signal and not the longer one, which is dealt once; places between far entries are 0."""
    import re

    import numpy as np

    from tilefold.functions import staging
    from tilefold.operators import transforms

    monkeypatch.setattr(staging, "ROWS", 1000)
    r = np.random.default_rng(4)
    a, b = np.zeros(6000, int), r.integers(-9, 9, 25)
    a[:40], a[-40:], b[-1] = r.integers(-9, 9, 40), 3, 2
    frame = lambda v: spark.createDataFrame([(k, int(z)) for k, z in enumerate(v) if z] + [(None, 5)], "i bigint, x bigint")
    sizes = []
    monkeypatch.setattr(transforms, "fourier", lambda x, n, *y, f=transforms.fourier, **k: (sizes.append(n), f(x, n, *y, **k))[1])
    for x, kernel in ((a, b), (b, a)):
        made = transforms.convolution(frame(x), frame(kernel))
        dealt = re.findall(r"Exchange hashpartitioning\(.*?piece", _plan(made))
        got = {q["i"]: round(q["x"]) for q in made.collect()}
        assert sorted(got) == list(range(6024)) and [got[k] for k in range(6024)] == np.convolve(a, b).tolist()
        assert max(sizes) <= 1024 and len(dealt) == 1
    monkeypatch.setattr(transforms, "PIECE", 32)  # too short for the kernel
    got = {q["i"]: round(q["x"]) for q in transforms.convolution(frame(a), frame(b)).collect()}
    assert [got[k] for k in range(6024)] == np.convolve(a, b).tolist() and sizes[-1] == 8192


@pytest.mark.parametrize("lower", [True, False])
def test_tasks_of_triangular_solves_are_bounded(spark, monkeypatch, lower):
    """Tasks of a round hold few rows however many it has, and no table of factors or solutions is broadcast."""
    import numpy as np

    from tilefold.functions import staging
    from tilefold.operators import factors

    n, sides = 400, 3
    t = np.diag(2.0 + np.arange(n) % 3)
    t[np.arange(240, n), np.arange(240, n) - 200] = -1.0
    t[np.arange(1, n, 2), np.arange(0, n, 2)] = 0.5
    t = t if lower else t.T
    x = np.add.outer(np.arange(n) % 7 - 3.0, np.arange(sides))
    rows = [(int(i), int(j), float(t[i, j])) for i, j in zip(*np.nonzero(t))]
    b = [(i, c, float(v)) for i, own in enumerate(t @ x) for c, v in enumerate(own)]
    plans, tasks = [], []

    def saved(df, *y, f=factors.saved, **k):
        plans.append(_plan(df))
        if "c" in df.columns:
            tasks.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        return f(df, *y, **k)

    monkeypatch.setattr(staging, "ROWS", 100)
    monkeypatch.setattr(factors, "saved", saved)
    made = factors.block_triangular_solve(spark.createDataFrame(rows, "i bigint, j bigint, v double"), spark.createDataFrame(b, "i bigint, c int, x double"), side=8, lower=lower)
    got = {(r["i"], r["c"]): r["x"] for r in made.collect()}
    assert len(got) == n * sides and all(abs(got[i, c] - x[i, c]) < 1e-9 for i in range(n) for c in range(sides))
    assert len(tasks) > 10 and max(tasks) <= 300 and not any("BroadcastHashJoin" in p for p in plans)


def test_pixels_are_picked_of_two_values(spark, sf):
    """A tile's values are scaled and rounded before its rows are made, and not for each of them; also where all bits are set."""
    import numpy as np

    from tilefold.operators import classifier

    plan = _plan(queries.QUERIES["tile_images"](spark, sf))
    assert "transform(" not in plan and "round(" in plan and "round(" not in plan.split("Generate")[0]
    masks = [[0xFFFF] * 16, [1 << 15] + [0] * 15, [0] * 15 + [1], [k * 4099 & 0xFFFF for k in range(16)]]
    df = spark.createDataFrame([(t, -t, m, sum(x.bit_count() for x in m)) for t, m in enumerate(masks)], "ti bigint, tj bigint, masks array<int>, nnz int")
    got = {(r["ti"], r["p"]): r["pixel"] for r in classifier.tile_pixels(df).collect()}
    assert len(got) == 256 * len(masks)
    for t, m in enumerate(masks):
        assert np.allclose([got[t, p] for p in range(256)], classifier.image("".join(str(x >> c & 1) for x in m for c in range(16))).ravel())


@pytest.mark.parametrize("at_once, block", [(7, 30), (40, 100), (1 << 20, 1 << 22)])
def test_products_by_rows(spark, monkeypatch, at_once, block):
    """Several blocks and pieces, a long row and a long inner index, negative, far and null indexes, repeated places, nulls,
    cancelled and infinite entries: as the element-wise product; whole rows leave a task, so no sum is shuffled."""
    import random

    from tilefold.operators import rowwise
    from tilefold.plans import products

    r = random.Random(at_once)
    at = lambda: r.choice([-(1 << 62), -1025, -1, 0, 5, 1023, 1024, 3000, 1 << 62, None])
    a, b = (spark.createDataFrame([(at(), at(), r.choice([1.0, -1.0, 2.5, None, float("inf")])) for _ in range(80)] + [(5, k, 1.0) for k in range(60)] + [(k, 5, 2.0) for k in range(60)], "i bigint, j bigint, v double") for _ in (1, 1))
    monkeypatch.setattr(rowwise, "AT_ONCE", at_once)
    monkeypatch.setattr(rowwise, "BLOCK", block)
    monkeypatch.setattr(products, "SENT", 1 << 40)
    rows = lambda df: sorted(repr(tuple(x)) for x in df.collect())
    made = products.sparse_product(a, b)
    assert "Aggregate" not in _plan(made.drop("v")) and "Join" not in _plan(made)
    assert rows(made) == rows(M.spgemm(a, b)) and rows(products.symbolic(a, b)) == rows(M.symbolic(a, b))
    assert rows(products.places(a, b)) == rows(M.spgemm(a, b).select("i", "j"))
    assert products.sparse_product(a.limit(0), b).count() == 0


def test_network_is_fitted_on_all_tiles(spark, sf, monkeypatch):
    """Every different tile is in one part, and the network that parts come to together tells the classes apart."""
    import numpy as np

    from tilefold import queries_sources
    from tilefold.operators import classifier

    r = np.random.default_rng(2)
    rows = [("".join("01"[int(x)] for x in (r.random(256) < p)), c) for _ in range(150) for p, c in ((0.04, "COO"), (0.95, "DNS"))]
    table = spark.createDataFrame(rows * 2, "bits string, label string")
    monkeypatch.setattr(classifier, "PART", 60)
    parts = classifier.parts_of(table, ["COO", "DNS"]).collect()
    held = [(bytes(x["tiles"][k * 32 : k * 32 + 32]), x["labels"][k]) for x in parts for k in range(len(x["labels"]))]
    assert len(parts) > 3 and sorted(held) == sorted({(np.packbits(np.array(list(b), np.uint8)).tobytes(), int(c == "DNS")) for b, c in rows})
    nets = [classifier.fit(table.repartition(n), ["COO", "DNS"], epochs=8, rate=0.1, conv=(4, 8, 8), full=(16,)) for n in (1, 5)]
    assert (nets[0].numbers() == nets[1].numbers()).all()
    out = classifier.predict(table, nets[0], ["COO", "DNS"])
    assert out.where("label = predicted").count() >= 0.97 * 600
    assert classifier.fit(table.limit(0), ["COO", "DNS"]).labels(np.zeros((1, 16, 16))).shape == (1,)
    given = []
    monkeypatch.setattr(classifier, "parts_of", lambda t, c, f=classifier.parts_of: given.append(f(t, c)) or given[0])
    larger = sf.replace("sf0.001", "sf0.01")
    found = queries.QUERIES["predicted_formats"](spark, larger)
    tiles = queries_sources._labelled(spark, larger)
    assert sum(len(x["labels"]) for x in given[0].collect()) == tiles.select("bits").distinct().count() > 200
    assert found.count() == tiles.count()
