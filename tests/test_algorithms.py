"""Scans, transforms, forests, factorisations, spectra and image filters against slow versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilefold.operators import factors, graph, images, matrix, scans, solvers, spectra, transforms


def test_scan_of_spread_keys_and_groups(spark):
    r = random.Random(1)
    rows = [(r.randrange(-(1 << 60), 1 << 60), r.choice(["a", "a", "a", "b", None]), r.choice([None, 1, 2, -3]), "x") for _ in range(3000)] + [(5, "c", None, "x")]
    df = spark.createDataFrame(rows, "k bigint, g string, n int, before string")
    got = {(x["k"], x["g"]): (x["s"], x["m"], x["e"]) for x in scans.scan(scans.scan(scans.scan(df, ["k"], "n", "s", by=["g"]), ["k"], "n", "m", scans.LARGEST, by=["g"]), [F.desc("k")], "n", "e", scans.SUM, inclusive=False).collect()}
    want, last = {}, {}
    for k, g, n, _ in sorted(rows, key=lambda x: x[0]):
        s, m = last.get(g, (0, None))
        last[g] = (s + (n or 0), m if n is None else n if m is None else max(m, n))
        want[k, g] = last[g]
    at = 0
    for k, g, n, _ in sorted(rows, key=lambda x: -x[0]):
        want[k, g] = (*want[k, g], at)
        at += n or 0
    assert got == want
    assert scans.scan(df.limit(0), ["k"], "n", "s").count() == 0


def test_ranks_of_one_key(spark):
    df = spark.range(5000).select(F.lit(7).alias("key"), (F.col("id") * 7919 % 5000).alias("v"))
    assert all(r["rank"] == r["v"] for r in matrix.ranked(df, "key", "v").collect())
    assert all(r["pos"] == r["v"] for r in matrix.positions(df.withColumnRenamed("key", "i"), "i", "v").collect())


def test_line_of_sight(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 2, 2, 2]), float(r.randrange(1, 400)), float(r.randrange(100))) for _ in range(900)]
    got = scans.line_of_sight(spark.createDataFrame(rows, "ray int, distance double, height double"), eye=3.0).collect()
    want = sorted((ray, x, h, all((h - 3) / x > (g - 3) / y for q, y, g in rows if q == ray and y < x)) for ray, x, h in rows)
    assert sorted((x["ray"], x["distance"], x["height"], x["visible"]) for x in got) == want


def test_areas(spark):
    r = np.random.default_rng(3)
    v = r.integers(-9, 9, (23, 31))
    image = spark.createDataFrame([(i + 5, j - 3, int(v[i, j])) for i in range(23) for j in range(31) if (i + j) % 5], "i bigint, j bigint, v bigint")
    v[np.add.outer(np.arange(23), np.arange(31)) % 5 == 0] = 0
    area = scans.summed_area(scans.completed(image))
    assert {(x["i"] - 5, x["j"] + 3): x["s"] for x in area.collect()} == {(i, j): v[: i + 1, : j + 1].sum() for i in range(23) for j in range(31)}
    boxes = [tuple(int(x) for x in r.integers(-8, 40, 4)) for _ in range(60)] + [(5, -3, 27, 27)] * 2
    got = scans.box_sums(area, spark.createDataFrame(boxes, "i0 bigint, j0 bigint, i1 bigint, j1 bigint")).collect()
    clip = lambda a, b, c, d: v[max(0, a - 5) : max(0, c - 4), max(0, b + 3) : max(0, d + 4)].sum()
    assert {tuple(x)[:4]: x["s"] for x in got} == {b: clip(*b) if b[0] <= b[2] and b[1] <= b[3] else 0 for b in boxes}


@pytest.mark.parametrize("n", [2, 64, 1024])
def test_fourier(spark, n):
    r = np.random.default_rng(n)
    x = r.normal(size=n) + 1j * r.normal(size=n)
    x[r.random(n) < 0.3] = 0
    df = spark.createDataFrame([(k, "g", float(z.real), float(z.imag)) for k, z in enumerate(x) if z], "i bigint, g string, re double, im double")
    got = {q["i"]: complex(q["re"], q["im"]) for q in transforms.fourier(df, n, ["g"]).collect()}
    assert np.allclose([got.get(k, 0) for k in range(n)], np.fft.fft(x))
    back = {q["i"]: complex(q["re"], q["im"]) for q in transforms.backward(transforms.fourier(df, n, ordered=False), n).collect()}
    assert np.allclose([back.get(k, 0) for k in range(n)], x)


def test_convolution(spark):
    r = np.random.default_rng(5)
    a, b = r.integers(-50, 50, 300), r.integers(-50, 50, 41)
    frame = lambda v: spark.createDataFrame([(k, int(z)) for k, z in enumerate(v)], "i bigint, x bigint")
    got = {q["i"]: round(q["x"]) for q in transforms.convolution(frame(a), frame(b)).collect()}
    assert [got[k] for k in range(340)] == np.convolve(a, b).tolist()
    assert transforms.convolution(frame(a).limit(0), frame(b)).count() == 0


def test_cosine_blocks(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(16, 24))
    df = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(16) for j in range(24)], "i bigint, j bigint, v double")
    b = np.array(transforms._basis(8))
    got = np.zeros_like(v)
    done = transforms.cosine_blocks(df)
    for q in done.collect():
        got[q["i"], q["j"]] = q["v"]
    want = np.block([[b @ v[i : i + 8, j : j + 8] @ b.T for j in range(0, 24, 8)] for i in range(0, 16, 8)])
    assert np.allclose(got, want) and np.allclose(b @ b.T, np.eye(8))
    assert all(math.isclose(q["v"], v[q["i"], q["j"]], abs_tol=1e-12) for q in transforms.cosine_blocks(done, inverse=True).collect())


def slow_forest(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = set()
    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in edges if a != b}):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b, w))
    return out, {x: find(x) for x in list(root)}


def test_spanning_forest(spark):
    r = random.Random(7)
    for n, m, most in ((200, 500, 5), (300, 200, 1000), (60, 59, 1)):
        edges = [(r.randrange(n), r.randrange(n), r.randrange(most)) for _ in range(m)] if m != 59 else [(k, k + 1, 1) for k in range(59)]
        df = spark.createDataFrame(edges, "src bigint, dst bigint, w bigint")
        forest, tree = graph.spanning_forest(df)
        want, roots = slow_forest(edges)
        assert {(x["src"], x["dst"], x["w"]) for x in forest.collect()} == want and tree.agg(F.max("round")).first()[0] <= math.log2(n)
        got = {x["node"]: x["component"] for x in graph.components(df).collect()}
        touched = {x for a, b, _ in edges if a != b for x in (a, b)}
        assert set(got) == touched and len({(got[x], roots[x]) for x in touched}) == len(set(got.values())) == len({roots[x] for x in touched})
    none = df.limit(0)
    assert graph.spanning_forest(none)[0].count() == 0 and graph.components(none).count() == 0


def slow_ilu(a, k):
    n = len(a)
    level = np.where(a != 0, 0, 99)
    for m in range(n):
        for i in range(m + 1, n):
            for j in range(m + 1, n):
                level[i, j] = min(level[i, j], level[i, m] + level[m, j] + 1)
    level[level > k] = 99
    w, keep = a.copy(), level <= k
    for m in range(n):
        for i in range(m + 1, n):
            if keep[i, m]:
                w[i, m] /= w[m, m]
                for j in range(m + 1, n):
                    if keep[i, j]:
                        w[i, j] -= w[i, m] * w[m, j]
    return level, w


@pytest.mark.parametrize("k", [0, 2])
def test_incomplete_lu(spark, k):
    r = np.random.default_rng(8)
    n = 24
    a = np.where(r.random((n, n)) < 0.08, r.normal(size=(n, n)), 0)
    np.fill_diagonal(a, 6.0)
    df = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i bigint, j bigint, v double")
    level, w = slow_ilu(a, k)
    assert {(x["i"], x["j"]): x["level"] for x in factors.fill_levels(df, k).collect()} == {(i, j): level[i, j] for i in range(n) for j in range(n) if level[i, j] <= k}
    f = factors.incomplete_lu(df, k)
    got = np.zeros((n, n))
    for x in [*f.lower.collect(), *f.upper.collect()]:
        got[x["i"], x["j"]] = x["v"]
    assert np.allclose(got, np.where(level <= k, w, 0))
    b = r.normal(size=n)
    z = {x["i"]: x["x"] for x in f.solve(spark.createDataFrame([(i, float(b[i])) for i in range(n)], "i bigint, x double")).collect()}
    low, up = np.tril(got, -1) + np.eye(n), np.triu(got)
    assert np.allclose([z[i] for i in range(n)], np.linalg.solve(up, np.linalg.solve(low, b)))


def test_solvers_keep_their_right_side(spark):
    """The tables of a round are removed, those of the caller are not."""
    from tilefold.functions.staging import saved

    n = 12
    a = saved(spark.createDataFrame([(i, j, 4.0 if i == j else -1.0) for i in range(n) for j in range(n) if abs(i - j) <= 1], "i bigint, j bigint, v double"), "test")
    x = [float(i % 5 - 2) for i in range(n)]
    b = saved(solvers.times(a, spark.createDataFrame(list(enumerate(x)), "i bigint, x double")), "test")
    near = factors.incomplete_lu(a).solve
    for solve in (lambda: solvers.conjugate_gradients(a, b, tolerance=1e-9), lambda: solvers.conjugate_gradients(a, b, tolerance=1e-9, precondition=near), lambda: solvers.gmres(a, b, restart=6, cycles=1, precondition=near), lambda: solvers.jacobi(a, b, 25)):
        assert np.allclose([r["x"] for r in solve().orderBy("i").collect()], x, atol=1e-5)
    assert b.count() == n


@pytest.mark.parametrize("lower", [True, False])
def test_block_triangular_solve(spark, lower):
    r = np.random.default_rng(9)
    n = 50
    t = np.tril(np.where(r.random((n, n)) < 0.1, r.normal(size=(n, n)), 0), -1) + np.diag(2 + r.random(n))
    t = t if lower else t.T
    x = r.normal(size=(n, 3))
    b = t @ x
    gone = 20  # an index without a row
    rows = [i for i in range(n) if i != gone]
    t[gone, :] = t[:, gone] = 0
    b = t @ x
    df = spark.createDataFrame([(int(i), int(j), float(t[i, j])) for i, j in zip(*np.nonzero(t))], "i bigint, j bigint, v double")
    rhs = spark.createDataFrame([(i, c, float(b[i, c])) for i in rows for c in range(3)], "i bigint, c int, x double")
    got = {(q["i"], q["c"]): q["x"] for q in factors.block_triangular_solve(df, rhs, side=8, lower=lower).collect()}
    assert len(got) == 3 * len(rows) and all(math.isclose(got[i, c], x[i, c], abs_tol=1e-9) for i in rows for c in range(3))


def test_bisection(spark):
    r = np.random.default_rng(10)
    ms = [(k, r.normal(size=n).tolist(), r.normal(size=max(0, n - 1)).tolist()) for k, n in enumerate([1, 2, 7, 30])] + [(9, [2.0, 2.0, 2.0], [0.0, 0.0]), (10, [], [])]
    got = {}
    for q in spectra.tridiagonal_eigenvalues(spark.createDataFrame(ms, "batch int, d array<double>, e array<double>")).collect():
        got.setdefault(q["batch"], {})[q["k"]] = q["value"]
    for k, d, e in ms:
        if d:
            want = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
            assert np.allclose([got[k][i] for i in range(len(d))], want, atol=1e-8)
    assert 10 not in got


def test_image_filters(spark):
    r = np.random.default_rng(11)
    n, m = 70, 90
    v = np.add.outer(np.arange(n), np.arange(m)) // 20 * 40 + r.integers(0, 8, (n, m))
    df = spark.createDataFrame([(i - 3, j, int(v[i, j])) for i in range(n) for j in range(m)], "i bigint, j bigint, v bigint")
    whole = np.pad(v.astype(float), 2)
    there = np.pad(np.ones((n, m)), 2)
    top, under = np.zeros((n, m)), np.zeros((n, m))
    for a in range(5):
        for b in range(5):
            o = whole[a : a + n, b : b + m]
            w = np.exp(-((a - 2) ** 2 + (b - 2) ** 2) / 8 - (o - v) ** 2 / 5000) * there[a : a + n, b : b + m]
            top, under = top + w * o, under + w
    got = {(q["i"] + 3, q["j"]): q["v"] for q in images.bilateral(df).collect()}
    assert len(got) == n * m and np.allclose([[got[i, j] for j in range(m)] for i in range(n)], top / under)
    small = {(q["i"], q["j"]): q["size"] for q in images.by_tiles(df, lambda x, p: {"size": x}, 3, "size bigint", side=8).collect()}
    assert small == {(i - 3, j): v[i, j] for i in range(n) for j in range(m)}
    thin = {(q["i"], q["j"]): q["size"] for q in images.thin_gradients(df).collect()}
    low, high = 400, 2500
    weak, reached = {p for p, s in thin.items() if s >= low}, {p for p, s in thin.items() if s >= high}
    todo = list(reached)
    while todo:
        i, j = todo.pop()
        for p in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if p in weak and p not in reached:
                reached.add(p)
                todo.append(p)
    assert 0 < len(reached) < n * m and {(q["i"], q["j"]) for q in images.edges(df, low, high).collect()} == reached


def test_kth_largest(spark):
    from tilefold.operators.selection import kth_largest

    r = random.Random(12)
    x = [r.choice([r.gauss(0, 1), r.gauss(0, 1e12), 5.0, 5.0 + 2**-50, float(r.randrange(9))]) for _ in range(20_000)] + [7.0] * 9000
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "v double").repartition(5)
    order = sorted(x, reverse=True)
    for k in (1, 2, 3000, 9000, 14_000, 20_000, len(x)):
        assert kth_largest(df, "v", k) == order[k - 1]
    assert kth_largest(df, "v", len(x) + 1) is None and kth_largest(df.limit(0), "v", 1) is None and kth_largest(df, "v", 0) is None


def slow_threshold(a, fill, steps):
    n = len(a)
    low, up = np.tril(np.ones((n, n), bool), -1), np.triu(np.ones((n, n), bool))
    most = {0: int(fill * (a * low != 0).sum()), 1: int(fill * (np.triu(a, 1) != 0).sum())}
    place, w = a != 0, np.where(low, a / np.diag(a)[None, :], a)

    def products():
        s = np.zeros((n, n))
        for i in range(n):
            for j in range(n):
                k = min(i, j)
                s[i, j] = (w[i, :k] * place[i, :k]) @ (w[:k, j] * place[:k, j])
        return s

    def sweep():
        v = a - products()
        return np.where(place, np.where(low, v / np.diag(w)[None, :], v), 0)

    for _ in range(steps):
        rest = np.where(place, 0, a - products())
        rest[np.abs(rest) < 1e-14] = 0
        w, place = w + np.where(low, rest / np.diag(w)[None, :], rest), place | (rest != 0)
        w = sweep()
        for side, mask in ((0, low), (1, np.triu(np.ones((n, n), bool), 1))):
            size = np.where(mask & place, np.round(np.abs(w), 12), -1)
            values = np.sort(size[mask & place])[::-1]
            if most[side] >= 1 and most[side] <= len(values):
                place &= ~mask | (size >= values[most[side] - 1])
        w = np.where(place, w, 0)
        w = sweep()
    return place


def test_threshold_lu(spark):
    r = np.random.default_rng(13)
    n = 26
    a = np.where(r.random((n, n)) < 0.12, r.normal(size=(n, n)), 0)
    np.fill_diagonal(a, 5 + r.random(n))
    df = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i bigint, j bigint, v double")
    f = factors.threshold_lu(df, 1.4, steps=2)
    got = {(x["i"], x["j"]) for x in [*f.lower.collect(), *f.upper.collect()]}
    assert got == set(zip(*(q.tolist() for q in np.nonzero(slow_threshold(a, 1.4, 2)))))
    made = {(x["i"], x["j"]): x["v"] for x in f.product().collect()}
    assert all(math.isclose(made.get(p, 0), a[p], abs_tol=1e-9) for p in got)


def slow_least_fill(a):
    given = a != 0
    a, open_, out = a.copy(), set(range(len(a))), {}
    linked = (a != 0) | (a != 0).T
    k = 0
    while open_:
        key = {}
        for m in open_:
            near = [i for i in open_ if i != m]
            lost = sum((a[i, m] * a[m, j] / a[m, m]) ** 2 for i in near for j in near if i != j and not given[i, j])
            key[m] = (round(math.sqrt(lost), 9), m)
        one = {m: {m} | {i for i in open_ if linked[m, i]} for m in open_}
        gone = [m for m in open_ if key[m] == min(key[q] for p in one[m] for q in one[p])]
        for m in gone:
            out[m] = (k, key[m][0])
            for i in open_:
                for j in open_:
                    if i != m and j != m and given[i, j]:
                        a[i, j] -= a[i, m] * a[m, j] / a[m, m]
            open_.remove(m)
        k += 1
    return out


def test_least_fill_order(spark):
    r = np.random.default_rng(14)
    n = 22
    a = np.where(r.random((n, n)) < 0.1, r.normal(size=(n, n)), 0)
    np.fill_diagonal(a, 5 + r.random(n))
    df = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i bigint, j bigint, v double")
    assert {x["node"]: (x["round"], round(x["discarded"], 9)) for x in factors.least_fill_order(df).collect()} == slow_least_fill(a)
    assert factors.least_fill_order(df.limit(0)).count() == 0


def test_product_figures(spark):
    from tilefold.plans import products

    r = random.Random(15)
    a, b = ([(r.randrange(60), r.randrange(90), 1.0) for _ in range(400)], [(r.randrange(20, 200), r.randrange(70), 1.0) for _ in range(500)])
    frame = lambda m: spark.createDataFrame(m, "i bigint, j bigint, v double")
    tiles = lambda m: {(i // 16, j // 16) for i, j, _ in m}
    inner_a, inner_b = {j for _, j, _ in a}, {i for i, _, _ in b}
    want = (sum(x[1] == y[0] for x in a for y in b), sum(x[1] == y[0] for x in tiles(a) for y in tiles(b)), len(inner_a & inner_b), len(inner_a))
    assert products.figures(frame(a), frame(b)) == want and products.figures(frame(a).limit(0), frame(b)) == (0, 0, 0, 0)
