"""Fill-in-middle cuts, vector codes and syncmer fingerprints, each held against a slow version."""

import hashlib
import random
import struct

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import odd_documents, ordered
from tilefold.llm import common as C
from tilefold.llm import op11_fill_middle as fim
from tilefold.llm import op12_vector_codes as codes
from tilefold.llm import op13_syncmers as sync


# fill-in-middle


def lines_of(text):
    return regex.findall(r"[^\n]*\n|[^\n]+", text)


def slow_fim(doc_id, text):
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    d = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    units = lines_of(text)
    a, b = sorted((d[0] % (len(units) + 1), d[1] % (len(units) + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if d[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_wavelet_matrix():
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        v = r.integers(0, 4, n).astype(np.uint8) if n % 2 else np.repeat(r.integers(0, 4, 1), n).astype(np.uint8)
        m = fim.WaveletMatrix(v)
        for c in range(4):
            ranks = np.concatenate([[0], np.cumsum(v == c)])
            for i in {0, n, *r.integers(0, n + 1, 40).tolist()}:
                assert m.rank(c, i) == ranks[i]
            where = np.flatnonzero(v == c)
            for u in {0, len(where) - 1, *r.integers(0, max(1, len(where)), 20).tolist()}:
                if 0 <= u < len(where):
                    assert m.select(c, u) == where[u]


TEXTS = ["", "\n", "\n\n", "a", "a\n", "\na", "a\nb", "one. two! three\nfour?? five", "  lead", "x" * 3000, "a\n" * 2000, "été\nüber\r\n", "<P", "<P><", "a<M>b", "<S<P\n<M\n>", "日本。語\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_units(text):
    slow = {
        "line": lines_of(text),
        "sentence": regex.findall(r"(?s).*?(?:(?<=\S)[.!?。](?![.!?。\n])|\n|$)", text) if text else [],
        "word": regex.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*?(?=[^\x20\x09-\x0D])|", text),
    }
    for unit in ("line", "sentence"):
        parts = [p for p in slow[unit] if p]
        units = fim.Units(text, unit)
        assert units.n == len(parts) and [units.end(u) for u in range(units.n + 1)] == [sum(map(len, parts[:u])) for u in range(units.n + 1)]
    words = fim.Units(text, "word")
    starts = [m.start() for m in regex.finditer(r"[^\x20\x09-\x0D]+", text)]
    assert words.n == len(starts) and [words.end(u) for u in range(1, words.n)] == starts[1:]


def test_fill_middle(spark):
    docs, rows = odd_documents(spark)
    more = [(1000 + k, t) for k, t in enumerate(TEXTS * 3)]
    docs = docs.select("doc_id", "text", "n", "hash").unionByName(spark.createDataFrame([(i, t, 1, b"") for i, t in more], "doc_id bigint, text string, n int, hash binary"))
    rows = rows + more
    want = [(i, *slow_fim(i, t or "")) for i, t in rows]
    assert ordered(fim.transform(C.documents(docs)).collect()) == ordered(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = fim.digests(C.documents(docs)).collect()
    assert ordered(got) == ordered((*w[:-1], sha(w[-1]), sha(t or "")) for w, (_, t) in zip(want, rows))
    for unit in ("sentence", "word"):
        back = fim.restore(fim.transform(C.documents(docs), unit)).collect()
        assert ordered(back) == ordered((i, t or "") for i, t in rows)
    assert fim.transform(C.documents(docs.limit(0))).count() == 0


# vector codes


def slow_codes(rows, parts, entries, rounds, scale=256):
    """Every part against every entry; rows are (id, vector, label)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(scale * np.float64(np.float32(c)))) for c in r[1]] for r in rows]
    w = len(x[0]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for v in x[:entries]] for p in range(parts)]

    def best(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[best(v, p)[1] for p in range(parts)] for v in x]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for v, f in zip(x, found) if f[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    last = [[best(v, p) for p in range(parts)] for v in x]
    return [(r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(rows, last)], ",".join(str(c) for b in books for e in b for c in e)


def vectors(n=300, length=12, seed=5):
    r = random.Random(seed)
    out = []
    for k in range(n):
        v = [r.choice([r.gauss(0, 1), r.gauss(0, 0.01), 0.5, -0.5, 0.0]) for _ in range(length)]
        out.append((r.choice([k, k, k, k, None, 7]), v, r.choice([1, 2, None])))
    return out + out[:9]


def test_vector_codes(spark):
    good = vectors()
    bad = [(1, None, 1), (2, [0.1] * 11 + [None], 1), (3, [float("nan")] * 12, 2), (4, [float("inf")] * 12, None), (5, [1.0] * 7, 1), (6, [], 1), (900, [1.0] * 16, 1)]
    df = spark.createDataFrame([(*r, "x", 1.0, [1]) for r in good + bad], "vec_id bigint, embedding array<float>, label int, code string, error double, x array<int>").repartition(7)
    for parts, entries, rounds in ((4, 8, 2), (3, 64, 3), (12, 1, 1), (4, 1000, 2)):
        got, books = codes.compress(df, parts=parts, entries=entries, rounds=rounds)
        found = codes.with_errors(got).select("vec_id", codes.code_of().alias("code"), "error", "label", "label_error").collect()
        want, numbers = slow_codes(good, parts, entries, rounds)
        if entries <= 256:
            assert ordered((r[0], r[1], r[2]) for r in found) == ordered(want)
        assert codes.digest(books) == hashlib.sha256(numbers.encode()).hexdigest()
        by = {}
        for r in found:
            by[r["label"]] = by.get(r["label"], 0) + r["error"]
        assert all(r["label_error"] == by[r["label"]] for r in found) and len(found) == len(good)
    empty, books = codes.compress(df.limit(0))
    assert codes.with_errors(empty).count() == 0 and books.size == 0
    none = spark.createDataFrame(bad[:6], "vec_id bigint, embedding array<float>, label int")
    assert codes.with_errors(codes.compress(none)[0]).count() == 0


def test_active_entries():
    """Only parts whose entry moved meet the whole codebook, with the same answer as a full scan."""
    r = np.random.default_rng(2)
    for moved_share in (0.0, 0.1, 0.5, 1.0):
        x, book = r.integers(-3, 4, (400, 3)), r.integers(-3, 4, (16, 3))
        entry, dist = codes.nearest(x, book)
        moved = r.random(16) < moved_share
        new = np.where(moved[:, None], r.integers(-3, 4, (16, 3)), book)
        got, d, computed = codes.reassign(x, entry, dist, new, moved)
        want, w = codes.nearest(x, new)
        assert (got == want).all() and (d == w).all()
        assert computed == int((~moved[entry]).sum()) * int(moved.sum()) + int(moved[entry].sum()) * 16


def test_too_large_components(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], 1)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(Exception, match="exceeds"):
        codes.compress(df, parts=2)


def test_decoded(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0, 2.0, 0.5], 1) for k in range(5)], "vec_id bigint, embedding array<float>, label int")
    got, books = codes.compress(df, parts=2, entries=8)
    assert {r["vec_id"]: r["vector"] for r in codes.decoded(got, books).collect()} == {k: [float(k), 1.0, 2.0, 0.5] for k in range(5)}


# syncmers

SINGLE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}"


def longs(*values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed)
    return seed


def signed(u):
    return u - (1 << 64) if u >> 63 else u


def slow_anchors(text, k=5):
    own = [xxhash.xxh64_intdigest(s.encode(), 42) for s in regex.findall(rf"[{SINGLE}]|[^\x20\x09-\x0D{SINGLE}]+", text)]
    h = [0] * (k - 1) + own + [0] * (k - 1) if own else []
    g = [longs(a, b) for a, b in zip(h, h[1:])]
    out = []
    for i in range(len(h) - k + 1):
        inner = [signed(v) for v in g[i : i + k - 1]]
        if min(inner[0], inner[-1]) == min(inner):
            out.append((i - k + 1, longs(g[i], g[i + 2], g[i + 3]) & 0xFFFFFFFF))
    return out


def slow_sketch(text):
    return sorted({a for _, a in slow_anchors(text)})[:64]


def slow_likeness(a, b):
    union = sorted(set(a) | set(b))[:64]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def test_syncmers(spark):
    docs, rows = odd_documents(spark, 120, seed=8)
    rows = [(i, t) for i, t in rows] + [(500, "東京は夜の七時 tokyo"), (501, "한국어 text"), (502, "a"), (503, "a b c d e f")]
    df = spark.createDataFrame([(i, t, 1, "b", [1]) for i, t in rows], "doc_id bigint, text string, bucket int, extra string, own array<int>").repartition(6)
    got = sync.neighbours(df).collect()
    texts = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    want = []
    for k, (i, t) in enumerate(texts):
        after, c = texts[(k + 1) % len(texts)][1], len(t) // 3
        edited = t[: len(t) - c] + after[:c]
        want.append((i, t, edited, slow_sketch(t), slow_sketch(edited), slow_sketch(after)))
    assert ordered(tuple(r) for r in got) == ordered(want)
    near = sync.neighbours(df).select(sync.likeness(F.col("own"), F.col("edited")), sync.likeness(F.col("own"), F.col("next"))).collect()
    assert sorted(map(tuple, near)) == sorted((slow_likeness(w[3], w[4]), slow_likeness(w[3], w[5])) for w in want)
    assert all(w[3] or not w[1].strip() for w in want)


def test_anchors_and_offsets(spark):
    r = random.Random(4)
    passage = " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    a, b = "one two three " + passage + " tail", " ".join(f"v{k}" for k in range(17)) + " " + passage
    df = spark.createDataFrame([(1, a), (2, b), (3, None)], "doc_id bigint, text string")
    found = sync.anchors(df)
    assert ordered(map(tuple, found.collect())) == ordered((i, p, h) for i, t in ((1, a), (2, b)) for p, h in slow_anchors(t))
    best = sync.offsets(found.where("doc_id = 1"), found.where("doc_id = 2")).orderBy(F.desc("anchors")).first()
    assert best["shift"] == 14 and best["first"] <= 6 and best["last"] >= 55 and best["anchors"] >= 20


def test_syncmers_small_tables(spark):
    one = spark.createDataFrame([(4, "abc def ghi jkl")], "doc_id bigint, text string")
    assert [(r["text"], r["edited_text"], r["own"] == r["next"]) for r in sync.neighbours(one).collect()] == [("abc def ghi jkl", "abc def ghabc d", True)]
    assert sync.neighbours(one.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a b"), (None, "a c")], "doc_id bigint, text string")
    assert sorted((r["text"], r["edited_text"]) for r in sync.neighbours(none).collect()) == [("a b", "a a"), ("a c", "a a")]
