import numpy as np
import pytest
from pyspark.sql import functions as F

from tilefold.functions import bits as B
from tilefold.operators import classifier, records
from tilefold.operators import matrix as M
from tilefold.plans import products
from tilefold.sources import matrix_market as mm
from tilefold.streaming import results

GOLDEN = """%%MatrixMarket matrix coordinate real symmetric
% five by five
5 5 7
1 1 10
3 1 1
2 2 20
3 3 30
5 3 2
4 4 40
5 5 50
"""


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("mtx") / "golden.mtx"
    f.write_text(GOLDEN)
    return mm.read_matrix(spark, str(f))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_golden(spark, golden):
    assert golden.count() == 9
    ones, ramp = (spark.createDataFrame([(k, float(f(k))) for k in range(5)], "j bigint, x double") for f in (lambda k: 1, lambda k: k))
    assert [y for _, y in rows(M.spmv(golden, ones), "i", "y")] == [11, 20, 33, 40, 52]
    assert [y for _, y in rows(products.spmv(golden, ramp), "i", "y")] == [2, 20, 68, 120, 204]
    want = [(0, 0, 101), (0, 2, 40), (0, 4, 2), (1, 1, 400), (2, 0, 40), (2, 2, 905), (2, 4, 160), (3, 3, 1600), (4, 0, 2), (4, 2, 160), (4, 4, 2504)]
    assert rows(M.spgemm(golden, golden), "i", "j", "v") == want == rows(products.spgemm(golden, golden), "i", "j", "v")
    assert M.product_counts(golden, golden).agg(F.sum("products")).first()[0] == 19
    assert products.selector(golden, golden, 5, 5) == "heuristic"
    assert M.tiles(golden).first()["masks"][:6] == [5, 2, 21, 8, 20, 0]
    with pytest.raises(ValueError):
        M.square_guard(2, 3)


def test_kinds(spark, tmp_path):
    def read(text):
        (tmp_path / "m.mtx").write_text(text)
        return rows(mm.read_matrix(spark, str(tmp_path / "m.mtx")), "i", "j", "v")

    assert read("%%MatrixMarket matrix coordinate pattern general\n2 3 2\n1 3\n2 1\n") == [(0, 2, 1.0), (1, 0, 1.0)]
    assert read("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 3 0\n2 1 5 7\n") == [(0, 0, 3.0), (0, 1, 5.0), (1, 0, 5.0)]
    assert read("%%MatrixMarket matrix coordinate integer skew-symmetric\n2 2 1\n2 1 4\n") == [(1, 0, 4.0)]
    assert read("%%MatrixMarket matrix coordinate real general\n2 2 3\n1 1 1\n1 1 2\n  2   2  3\n") == [(0, 0, 1.0), (0, 0, 2.0), (1, 1, 3.0)]
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n")
    assert rows(mm.read_array(spark, str(tmp_path / "a.mtx")), "i", "j", "v") == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]


def test_write_and_cache(spark, golden, tmp_path):
    mm.write_matrix(golden, str(tmp_path / "out"), 5, 5)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    (tmp_path / "back.mtx").write_text(text)
    want = rows(golden, "i", "j", "v")
    for _ in range(2):
        assert rows(mm.cached(spark, str(tmp_path / "back.mtx"), str(tmp_path / "cache")), "i", "j", "v") == want
    assert rows(mm.list_matrices(spark, str(tmp_path)), "name") == [("back",)]


def pattern(*cells):
    m = np.zeros((16, 16), int)
    for r, c in cells:
        m[r, c] = 1
    return m


# tile -> stored bytes in the formats' order, and the best
TILES = [
    (pattern((0, 0)), [32, 48, 144, 144, 144, 144, 2048], 0),
    (np.eye(16, dtype=int), [160, 160, 144, 144, 2064, 2064, 2048], 2),
    (pattern(*((r, (r + o) % 16) for r in range(16) for o in (0, 1, 5, 9))), [592, 576, 560, 560, 2064, 2064, 2048], 2),
    (pattern(*((r, (r + o) % 16) for r in range(16) for o in (0, 1, 5, 9)), *((0, c) for c in range(16))), [688, 672, 2192, 656, 2064, 2064, 2048], 3),
    (pattern(*((r, c) for r in (2, 9) for c in range(16))), [304, 304, 2192, 416, 272, 2064, 2048], 4),
    (pattern(*((r, c) for c in (4, 11) for r in range(16))), [304, 304, 288, 288, 2064, 272, 2048], 5),
    (pattern(*((r, c) for r in range(8) for c in range(8))), [592, 576, 1104, 656, 1040, 1040, 2048], 1),
    (np.tril(np.ones((16, 16), int)), [1232, 1184, 2192, 1232, 2064, 2064, 2048], 1),
    (np.ones((16, 16), int), [2320, 2208, 2192, 2192, 2064, 2064, 2048], 6),
]


def test_format_bytes(spark):
    cells = [(16 * t + r, c, 1.0) for t, (m, _, _) in enumerate(TILES) for r, c in zip(*map(lambda x: x.tolist(), np.nonzero(m)))]
    a = spark.createDataFrame([(int(i), int(j), v) for i, j, v in cells], "i bigint, j bigint, v double")
    costs = M.format_costs(M.tile_figures(M.tiles(a)))
    assert [list(r)[1:] for r in sorted(costs.select("ti", *B.FORMATS).collect())] == [b for _, b, _ in TILES]
    assert [f for _, f in rows(M.choose_format(costs), "ti", "fmt")] == [f for _, _, f in TILES]
    assert {f for _, f in rows(M.SELECTORS["force_DRW"](costs), "ti", "fmt")} == {4}
    strings = M.tiles(a).select("ti", B.bits_string("masks").alias("bits"), "masks", B.masks_of_bits(B.bits_string("masks")).alias("back"))
    for r in strings.collect():
        assert r["bits"] == "".join(map(str, TILES[r["ti"]][0].ravel())) and r["back"] == r["masks"]


def test_bits(spark):
    one = spark.range(1)
    packed = one.select(B.pack_nibbles(F.array(*map(F.lit, [1, 15, 7]))).alias("p"))
    assert packed.first()["p"] == [31, 112]
    assert [packed.select(B.nibble("p", k)).first()[0] for k in range(3)] == [1, 15, 7]
    assert one.select(B.bits_of_hex(F.lit("0fA"))).first()[0] == "000011111010"
    assert one.select(B.rank_in_row(F.lit(21), F.lit(4)), B.rank_in_row(F.lit(21), F.lit(3))).first()[:] == (2, -1)


def test_products_agree(spark):
    rng = np.random.default_rng(5)

    def random(m, n, k):
        i, j, v = rng.integers(0, m, k), rng.integers(0, n, k), rng.integers(-4, 5, k)
        d = np.zeros((m, n))
        np.add.at(d, (i, j), v)
        return spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(i, j, v)], "i bigint, j bigint, v double"), d

    a, da = random(40, 33, 200)
    b, db = random(33, 50, 300)

    def full(df, m, n):
        out = np.zeros((m, n))
        for r in df.collect():
            out[r["i"], r["j"]] += r["v"]
        return out

    assert (full(M.spgemm(a, b), 40, 50) == da @ db).all()
    assert (full(M.transpose(M.spgemm(a, b)), 50, 40) == full(M.spgemm(M.transpose(b), M.transpose(a)), 50, 40)).all()
    assert M.spgemm(a, b, drop_zeros=True).where("v = 0").isEmpty()
    assert (full(M.add(a, a, 2, -1), 40, 33) == da).all()
    assert M.matrix_difference(M.add(a, a, 1, 0), M.untiled(M.tile_values(a))).isEmpty()
    nnz = M.symbolic(a, b).agg(F.sum("nnz")).first()[0]
    assert nnz >= np.count_nonzero(da @ db) and nnz == M.boolean_tile_product(a, b).count()
    empty = a.limit(0)
    assert M.spgemm(empty, b).isEmpty() and M.tiles(empty).isEmpty() and M.row_pointers(empty).isEmpty()


def test_scan_over_blocks(spark):
    df = spark.range(0, 200_000, 7).select("id", (F.col("id") % 5).alias("n"))
    want, at = {}, 0
    for r in sorted(df.collect()):
        want[r["id"]] = at
        at += r["n"]
    assert dict(rows(M.exclusive_scan(df, "id", "n"), "id", "before")) == want


def test_records(spark, tmp_path):
    tasks = spark.createDataFrame([("a",), ("b",), ("kron_g1",), ("c",)], "name string")
    done = spark.createDataFrame([("b", 1.0)], "name string, ms double")
    assert rows(records.still_to_run(tasks, done, "name", ["kron_g"]), "name") == [("a",), ("c",)]
    said = spark.createDataFrame([("accuracy: 0.875 of all",)], "s string").select(records.said_number("s", "accuracy"))
    assert said.first()[0] == 0.875
    acc = spark.createDataFrame([("m", "t1", 0.5), ("m", "t2", 0.25)], "model string, test string, accuracy double")
    assert records.accuracy_matrix(acc, ["t1", "t2"]).first()[:] == ("m", 0.5, 0.25)
    tasks.write.json(str(tmp_path / "in"))
    for n in (4, 4):
        stream = spark.readStream.schema("name string").json(str(tmp_path / "in"))
        results.resume(spark, stream, str(tmp_path / "log"), "name", lambda df: df.select("name", F.length("name").alias("n")), str(tmp_path / f"c{n}")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "log")).count() == n


def test_classifier(spark, tmp_path):
    rng = np.random.default_rng(0)
    samples = [("".join("01"[int(x)] for x in (rng.random(256) < p)), c) for _ in range(40) for p, c in ((0.04, "COO"), (0.95, "DNS"))]
    net = classifier.train(samples, ["COO", "DNS"], epochs=25, rate=0.1, conv=(4, 8, 8), full=(16,))
    x, y = np.array([classifier.image(b) for b, _ in samples[:4]]), np.array([0, 1, 0, 1])
    w = net.conv[0][0]
    before, kept = -np.log(net.forward(x)[np.arange(4), y]).mean(), w.copy()
    eps = 1e-5
    w[4, 1] += eps
    slope = (-np.log(net.forward(x)[np.arange(4), y]).mean() - before) / eps
    w[:] = kept
    classifier.save(spark, net, str(tmp_path / "net"))
    back = classifier.load(spark, str(tmp_path / "net"))
    back.step(x, y, 1.0)
    assert abs((kept - back.conv[0][0])[4, 1] - slope) < 1e-3
    tiles = spark.createDataFrame(samples, "bits string, label string")
    out = classifier.predict(tiles, net, ["COO", "DNS"])
    assert records.accuracy(out.select("label", "predicted")).agg(F.sum("tp")).first()[0] >= 76
    from tilefold.sources.matrix_market import read_tiles, write_tiles

    write_tiles(tiles, str(tmp_path / "tiles"))
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "COO.txt").write_text("1\n" + samples[0][0] + " extra\n0101\n")
    assert rows(read_tiles(spark, str(tmp_path / "flat")), "bits", "label") == [(samples[0][0], "COO")]


def test_tiled_product(spark):
    from tilefold.operators import tiled

    rng = np.random.default_rng(2)
    m = [(int(i), int(j), float(rng.integers(-2, 3))) for i in range(40) for j in range(40) if rng.random() < 0.4]
    a = spark.createDataFrame(m, "i bigint, j bigint, v double")
    want = rows(M.spgemm(a, a), "i", "j", "v")
    assert rows(tiled.spgemm(a, a), "i", "j", "v") == want == rows(products.spgemm(a, a), "i", "j", "v")
    assert tiled.spgemm(a.limit(0), a).isEmpty()


def test_encodings(spark):
    from tilefold.operators import tiled

    a = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0), (2, 0, 4.0), (2, 2, 5.0), (2, 4, 6.0), (3, 3, 7.0), (4, 2, 8.0), (4, 4, 9.0)], "i bigint, j bigint, v double")
    t = M.tile_values(a)
    got = {f: tiled.encode(t, f).first() for f in B.FORMATS}
    assert got["COO"]["codes"] == [8, 0, 2, 17, 32, 34, 36, 51, 66, 68] and got["COO"]["slots"] == [float(k) for k in range(1, 10)]
    assert got["CSR"]["codes"] == [0, 2, 3, 6, 7] + [9] * 12 + [0, 2, 1, 0, 2, 4, 3, 2, 4]
    assert got["ELL"]["codes"][:10] == [2, 0, 2, 0, 1, 0, 0, 0, 2, 4] and got["ELL"]["slots"][:6] == [1, 2, 0, 3, 0, 0]
    assert got["HYB"]["codes"][:2] == [0, 4] and got["HYB"]["codes"][-4:] == [2, 34, 36, 68] and got["HYB"]["slots"][-4:] == [2, 5, 6, 9]
    assert got["DRW"]["codes"] == [4, 0, 1, 2, 3, 4] and len(got["DRW"]["slots"]) == 80
    assert got["DCL"]["codes"] == [4, 0, 1, 2, 3, 4] and got["DCL"]["slots"][:3] == [1, 0, 4]
    assert got["DNS"]["codes"] == [] and sum(got["DNS"]["slots"]) == 45


def test_solvers(spark):
    from tilefold.operators import solvers

    n = 12
    d = np.diag(np.full(n, 4.0)) + np.diag(np.full(n - 1, -1.0), 1) + np.diag(np.full(n - 1, -1.0), -1)
    a = spark.createDataFrame([(int(i), int(j), float(d[i, j])) for i, j in zip(*np.nonzero(d))], "i bigint, j bigint, v double")
    b = spark.createDataFrame([(k, float(k % 3)) for k in range(n)], "i bigint, x double")
    want = np.linalg.solve(d, [k % 3 for k in range(n)])
    for x, within in ((solvers.conjugate_gradients(a, b), 1e-8), (solvers.jacobi(a, b, 12), 1e-2)):
        assert np.allclose([v for _, v in rows(x, "i", "x")], want, atol=within)


def test_graphs(spark):
    from tilefold.operators import graph

    rng = np.random.default_rng(4)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 30, (90, 2)) if a != b} | {(0, k) for k in range(31, 60)}
    edges = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    colour = dict(rows(graph.colouring(edges), "node", "colour"))
    assert colour.keys() == near.keys() and all(colour[a] != colour[b] for a, b in pairs) and max(colour.values()) <= max(map(len, near.values()))
    want = {a: sum(len(near[a] & near[b]) for b in near[a]) // 2 for a in near}
    assert dict(rows(graph.triangles(edges), "node", "triangles")) == {a: n for a, n in want.items() if n}
    level, front, k = {0: 0}, {0}, 0
    while front:
        k += 1
        front = {b for a in front for b in near[a]} - level.keys()
        level |= dict.fromkeys(front, k)
    assert dict(rows(graph.levels(edges, 0), "node", "level")) == level


def test_more_solvers(spark):
    from tilefold.operators import graph, solvers

    n = 5
    d = np.diag(np.full(n, 4.0)) + np.diag(np.full(n - 1, -1.0), 1) + np.diag(np.full(n - 1, -2.0), -1)

    def frame(m):
        return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i bigint, j bigint, v double")

    a, v = frame(d), [1.0, 2.0, 0.0, -1.0, 3.0]
    b = spark.createDataFrame(list(enumerate(v)), "i bigint, x double")
    colours = graph.colouring(graph.of_matrix(a))
    for x, m, within in (
        (solvers.gauss_seidel(a, b, colours, 6), d, 1e-2),
        (solvers.triangular_solve(frame(np.tril(d)), b), np.tril(d), 1e-9),
        (solvers.triangular_solve(frame(np.triu(d)), b), np.triu(d), 1e-9),
        (solvers.gmres(a, b, n, 2, 1e-8), d, 1e-6),
    ):
        assert np.allclose([y for _, y in rows(x, "i", "x")], np.linalg.solve(m, v), atol=within)
    got = np.zeros((n, n))
    for i, j, y in rows(solvers.damped_product(a, a, 0.5), "i", "j", "v"):
        got[i, j] = y
    assert np.allclose(got, d - 0.5 * np.diag(1 / np.diag(d)) @ d @ d)
    with pytest.raises(ValueError):
        solvers.triangular_solve(a, b)


def test_batched(spark):
    from tilefold.operators import batched

    rng, n = np.random.default_rng(5), 4
    m = rng.normal(size=(30, n, n)) + 4 * np.eye(n)
    v = rng.normal(size=(30, n))
    df = spark.createDataFrame([(k, m[k].ravel().tolist(), v[k].tolist()) for k in range(30)] + [(30, None, None), (31, [0.0] * 16, [1.0] * 4)], "batch bigint, a array<double>, b array<double>")

    def of(routine, *cols):
        got = {r["batch"]: r for r in batched.apply(df, routine, n).collect()}
        assert got[30][cols[0]] is None and len(got) == 32
        return [np.array([got[k][c] for k in range(30)]) for c in cols], got[31]

    (f, order), _ = of("lu", "factors", "order")
    f = f.reshape(-1, n, n)
    assert np.allclose((np.tril(f, -1) + np.eye(n)) @ np.triu(f), np.take_along_axis(m, order.astype(int)[:, :, None], 1))
    (q, r), _ = of("qr", "q", "r")
    assert np.allclose(q.reshape(m.shape) @ r.reshape(m.shape), m)
    (u, s, vt), _ = of("svd", "u", "s", "vt")
    assert np.allclose(u.reshape(m.shape) * s[:, None, :] @ vt.reshape(m.shape), m)
    (x,), singular = of("solve", "x")
    assert np.allclose((m @ x[:, :, None])[:, :, 0], v) and np.isnan(singular["x"]).all()
    (x,), _ = of("lower_solve", "x")
    assert np.allclose((np.tril(m) @ x[:, :, None])[:, :, 0], v)
    (x,), _ = of("upper_solve", "x")
    assert np.allclose((np.triu(m) @ x[:, :, None])[:, :, 0], v)
    (x,), _ = of("tridiagonal_solve", "x")
    assert np.allclose((np.triu(np.tril(m, 1), -1) @ x[:, :, None])[:, :, 0], v)
    c = {r["batch"]: r["c"] for r in batched.gemm(df, df, n, 2.0).collect()}
    assert c[30] is None and all(np.allclose(np.reshape(c[k], (n, n)), 2 * m[k] @ m[k]) for k in range(30))


def test_commands(spark, tmp_path, capsys):
    from tilefold import cli

    folder, log = tmp_path / "mtx", str(tmp_path / "log")
    folder.mkdir()
    (folder / "five.mtx").write_text(GOLDEN)
    (folder / "_hidden.mtx").write_text(GOLDEN)
    (folder / "kron_big.mtx").write_text(GOLDEN)
    (folder / "broken.mtx").write_text("no banner\n")
    assert cli.main(["spgemm", str(folder / "five.mtx"), "--repeat", "1"]).split(",")[1:4] == ["5", "5", "9"]
    run = ["mrun", str(folder), "--log", log, "--leave-out", "kron", "--repeat", "1"]
    assert cli.main(run) == "broken,five"
    (folder / "later.mtx").write_text(GOLDEN)
    assert cli.main(run) == "later" and cli.main(run) == ""
    got = {r["name"]: (r["rows"], r["nnz"], r["ms"]) for r in spark.read.schema(cli.LOG).csv(log).collect()}
    assert set(got) == {"broken", "five", "later"} and got["five"][:2] == (5, 9) and got["five"][2] > 0 and got["broken"] == (None, None, None)
    assert cli.main([*run, "--operation", "formats"]) == "broken,five,later"
    tiles = tmp_path / "tiles"
    tiles.mkdir()
    (tiles / "COO.txt").write_text("3\n" + ("1" + "0" * 255 + "\n") * 2)
    (tiles / "DNS.txt").write_text("1" * 256 + "\n")
    again = mm.read_tiles(spark, cli.main(["fmt_data", str(tiles), str(tmp_path / "again")]))
    assert sorted(map(tuple, again.select("bits", "label").collect())) == [("1" + "0" * 255, "COO"), ("1" * 256, "DNS")]
    (tmp_path / "tasks.csv").write_text("task,platform,op\n1,a,x\n2,b,x\n3,b,y\n")
    (tmp_path / "models.csv").write_text("platform,op,model\na,x,own\n,x,all\n")
    out = cli.main(["switch_model", str(tmp_path / "tasks.csv"), str(tmp_path / "models.csv"), str(tmp_path / "switched")])
    assert {r["task"]: r["model"] for r in spark.read.option("header", True).csv(out).collect()} == {"1": "own", "2": "all", "3": None}


def test_quadrants_and_images(spark):
    r = np.random.default_rng(4)
    masks = [[65535] * 16, [0] * 15 + [1], [32768] + [0] * 15, *(r.integers(0, 65536, 16).tolist() for _ in range(30))]
    df = spark.createDataFrame([(k, 0, m, sum(x.bit_count() for x in m)) for k, m in enumerate(masks)], "ti bigint, tj bigint, masks array<int>, nnz int")
    words = df.withColumn("w", B.quadrants("masks")).withColumn("back", B.masks_of_quadrants("w")).collect()
    for x in words:
        m = x["masks"]
        assert x["back"] == m
        for q, w in enumerate(x["w"]):
            bits = sum((m[q // 2 * 8 + k // 8] >> (q % 2 * 8 + k % 8) & 1) << k for k in range(64))
            assert w % 2**64 == bits
    pixels = {x["ti"]: x["pixels"] for x in classifier.tile_images(df).collect()}
    for k, m in enumerate(masks):
        bits = "".join(str(row >> c & 1) for row in m for c in range(16))
        assert np.allclose(pixels[k], classifier.image(bits).ravel())


def test_tree_and_guard(spark):
    figures = spark.createDataFrame([(0, 0, 5, 9, 9, 9, 0), (1, 0, 200, 9, 9, 9, 0), (2, 0, 50, 2, 9, 9, 0), (3, 0, 50, 9, 3, 9, 0), (4, 0, 50, 9, 9, 5, 0), (5, 0, 50, 9, 9, 4, 1), (6, 0, 50, 9, 9, 4, 0)], "ti int, tj int, z int, rows int, cols int, longest int, tail int")
    got = [B.FORMATS[f] for _, f in sorted((r["ti"], r["fmt"]) for r in M.predicted_by_tree(figures).collect())]
    assert got == ["COO", "DNS", "DRW", "DCL", "CSR", "HYB", "ELL"]
    a = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0)], "i bigint, j bigint, v double")
    assert M.guarded_square(a, F.lit(2), F.lit(2)).count() == 2
    with pytest.raises(Exception, match="square matrix"):
        M.guarded_square(a, F.lit(2), F.lit(3)).collect()
