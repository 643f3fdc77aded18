"""Operators that see all documents at once, and the pipeline."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from tests.llm.helpers import odd_documents, ordered
from tilefold.llm import common as C
from tilefold.llm import near_copies, components, op2_decontamination, op3_simhash, op4_suffix_dedup, op5_content_store, op6_secrets, op8_quality, op9_packing
from tilefold.llm.bpe_words import Encoder


@pytest.fixture(scope="module")
def odd(spark):
    df, rows = odd_documents(spark)
    return C.documents(df), rows


def test_encoder_equals_library():
    import random

    r = random.Random(1)
    letters = "aB'st 1²½\n\t \xa0\x85\x1c\x1fé.!<|>ǅɏ 漢"
    texts = ["<|endoftext|>x <|endoftext|> y", "I'll don'T", "ΣΑΣ İ é", *("".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(800))]
    for name, kind in (("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")):
        e, t = Encoder(public_tokenizers.path(name), kind), Tokenizer.from_file(public_tokenizers.path(name))
        want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(e.ids(x), "<u2").tolist() for x in texts] == want
        for some in (texts, [x for x in texts if x.isascii() and "  " not in x], [], [""]):  # some are of all plain texts, or of none
            assert [np.frombuffer(x, "<u2").tolist() for x in e.batch(pa.array(some, pa.string()))] == [x.ids for x in t.encode_batch(some, add_special_tokens=False)]


def brute_components(rows):
    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxh64_intdigest(x, 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, f"{fps[k]:016x}", least.get(root(k))) for k, (i, _) in enumerate(rows)]


def test_simhash(spark, odd):
    docs, rows = odd
    got = op3_simhash.classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert ordered(got.collect()) == ordered(brute_components(rows))
    assert op3_simhash.classes(docs.limit(0)).count() == 0


def test_simhash_links_chains(spark):
    fps = [0, 3, 15, 63, 1 << 62, 7 << 40, -1, -2, -4, -(1 << 63)]
    edges = op3_simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    found = {(r["u"], r["v"]) for r in edges.collect()}
    assert all(((u ^ v) & ((1 << 64) - 1)).bit_count() <= 2 for u, v in found)
    roots = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert roots[63] == roots[15] == roots[3] == roots[0] and roots[-1] == roots[-2] == roots[-4]
    path = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in components.connected_components(path).collect()} == {0}


def brute_cut(rows):
    first, raws = {}, [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, r in raws:
        for p in range(len(r) - 49):
            first[r[p : p + 50]] = min(i, first.get(r[p : p + 50], i))
    out = []
    for (i, _), (k, r) in zip(rows, raws):
        m = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - 49):
            if first[r[p : p + 50]] < k:
                m[p : p + 50] = True
        out.append((i, len(r), int(m.sum()), int((m[1:] & ~m[:-1]).sum() + m[0]), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~m[:-1]])).hexdigest()))
    return out


@pytest.mark.parametrize("hot, gathered, cells", [(4096, 16 << 20, 1 << 30), (2, 16 << 20, 1 << 30), (1, 1000, 64), (4096, 1, 64)])
def test_suffixes(spark, odd, monkeypatch, hot, gathered, cells):
    docs, rows = odd
    for name, value in (("HOT", hot), ("GATHERED", gathered), ("MOST_CELLS", cells), ("SLICE", 100_000)):
        monkeypatch.setattr(op4_suffix_dedup, name, value)
    assert ordered(op4_suffix_dedup.cut_repeats(docs).collect()) == ordered(brute_cut(rows))
    assert op4_suffix_dedup.cut_repeats(docs.limit(0)).count() == 0


def test_suffix_windows_of_sliced_texts(monkeypatch):
    """Every window is in one run, whatever slices a text is cut into; equal units have equal hashes."""
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 105, n, dtype=np.uint8)) for n in (3000, 10, 49, 50, 51, 700)]
    texts.append(texts[0][500:2500])
    for size in (1 << 21, 100, 333):
        monkeypatch.setattr(op4_suffix_dedup, "SLICE", size)
        seen, units = {}, {}
        for raw, f, e, h, u, u2, d, o in op4_suffix_dedup.Batch(texts).runs():
            for a, z, *key, k, at in zip(*(x.tolist() for x in (f, e, h, u, u2, d, o))):
                assert units.setdefault(tuple(key), raw[a : z + 49]) == raw[a : z + 49] == texts[k][a + at : z + at + 49]
                for p in range(a + at, z + at):
                    seen[k, p] = seen.get((k, p), 0) + 1
        assert seen == {(k, p): 1 for k, t in enumerate(texts) for p in range(len(t) - 49)}
        assert len(set(units)) == len(set(units.values()))


def test_suffix_buckets():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 99, 3000, dtype=np.uint8)
    buf[2000:2800] = buf[100:900]
    at = np.arange(len(buf) - 49)
    ids, texts = op4_suffix_dedup.buckets(buf, at), [buf[k : k + 50].tobytes() for k in at]
    assert len(set(zip(ids.tolist(), texts))) == len(set(texts)) == len(set(ids.tolist()))
    assert [t for _, t in sorted(zip(ids.tolist(), texts))] == sorted(texts)


def encoded(rows, name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [x.ids + [end] for x in t.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store(spark, odd):
    docs, rows = odd
    store = op5_content_store.write_store(docs, C.new_path(spark, "test"), public_tokenizers.path("byte_bpe_50k.json"))
    ids = encoded(rows, "byte_bpe_50k.json", 0)
    got = op5_content_store.check_sums(spark, store, 2).collect()
    assert ordered((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == ordered((i, len(x), crc(x)) for (i, _), x in zip(rows, ids))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    back = op5_content_store.read_ids(spark, store, 2).collect()
    assert ordered((r["doc_id"], tuple(r["ids"])) for r in back) == ordered((i, tuple(x)) for (i, _), x in zip(rows, ids))
    chunks = spark.read.parquet(store.chunks)
    assert chunks.count() == chunks.select("hash").distinct().count() and op5_content_store.verify(spark, store)
    changed = spark.read.parquet(store.recipes).withColumn("n_tokens", F.col("n_tokens") + (F.col("doc_id") == 7).cast("int"))
    bad = store._replace(recipes=store.recipes + "-bad")
    changed.write.parquet(bad.recipes)
    assert not op5_content_store.verify(spark, bad)
    for read in (op5_content_store.check_sums, op5_content_store.read_ids):
        with pytest.raises(ValueError, match="damaged"):
            read(spark, bad, 2)
    fewer = store._replace(recipes=store.recipes + "-fewer")
    part = spark.read.parquet(store.recipes).agg(F.min("__part")).first()[0]
    spark.read.parquet(store.recipes).where(F.col("__part") != part).write.parquet(fewer.recipes)
    with pytest.raises(ValueError, match="damaged"):
        op5_content_store.recipes(spark, fewer)
    empty = op5_content_store.write_store(docs.limit(0), C.new_path(spark, "test"), public_tokenizers.path("byte_bpe_50k.json"))
    assert op5_content_store.check_sums(spark, empty, 2).count() == 0


def test_crc_shift():
    a, b = b"some bytes", b"and others" * 50
    assert int(op5_content_store.shifted(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def check_packed(pieces, want):
    """pieces against (doc_id, ids) of all documents."""
    whole = {}
    for r in pieces:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sum(r["length"] for r in pieces) == sum(len(x) for _, x in want)
    seqs = {}
    for r in pieces:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s, parts in seqs.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 4096 or s == max(seqs)
    sums = {(i, len(x), a, b) for i, x in want for r in whole[i, len(x)] for a, b in [(r["start"], crc(x[r["start"] : r["start"] + r["length"]]))]}
    assert all((r["doc_id"], r["doc_tokens"], r["start"], r["ids_crc32"]) in sums for r in pieces)


def test_packing(spark, odd):
    docs, rows = odd
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packed(op9_packing.pack(docs, path, 2).collect(), [(i, x) for (i, _), x in zip(rows, encoded(rows, "word_bpe_49k.json", 2))])
    assert op9_packing.pack(docs.limit(0), path, 2).count() == 0


def test_packing_follows_the_curve(spark, sf):
    docs = C.documents(C.read(spark, sf, "documents"))
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [tuple(r) for r in docs.collect()]
    key = {i: int(op9_packing.curve_keys(op9_packing.document_vector(np.array(x[:-1], "<u2"))[None])[0]) for (i, _), x in zip(rows, encoded(rows, "word_bpe_49k.json", 2))}
    pieces = sorted(op9_packing.pack(docs, path, 2).where("start = 0").collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    assert [r["doc_id"] for r in pieces] == sorted(key, key=lambda i: (key[i], i))


def test_hilbert_curve():
    side = 8
    points = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = op9_packing.hilbert_key(points, 3)
    walk = points[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(side**3)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def first_of_copies(rows):
    """Brute force: what neither links by fingerprints nor a five-word similarity of 0.8 ties to a smaller document."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    group = {i: i for i, _ in rows}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((root(rows[a][0]), root(rows[b][0])))
                group[q] = p
    linked = {c[0] for c in brute_components(rows) if c[0] != c[2]}
    return [r for r in rows if root(r[0]) == r[0] and r[0] not in linked]


def test_near_copies(spark):
    import random

    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(900)]
    rows = []
    for k in range(60):
        words = [vocabulary[min(int(r.expovariate(1) * 150), 899)] for _ in range(r.randrange(120, 600))]
        rows.append((10 * k, " ".join(words)))
        for c in (1, 2):
            other = list(words)
            for at in r.sample(range(len(words)), max(1, len(words) // 90)):
                other[at] = "changed"
            rows.append((10 * k + c, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {x["doc_id"] for x in op3_simhash.keep_first(df).collect()}
    assert {10 * k for k in range(60)} <= kept and len(kept) <= 66  # 114 of 120 near copies at least


def test_near_copies_verify_as_exact_similarity():
    """The estimate from minima against the exact similarity of shingle sets, at sizes below and above the bins."""
    import random

    r = random.Random(3)
    for n in (1, 4, 6, 40, 2000):
        words = [str(r.randrange(10_000)) for _ in range(n)]
        for changed in (0, 1, n // 50, n):
            other = [f"x{w}" if k in set(r.sample(range(n), min(n, changed))) else w for k, w in enumerate(words)]
            a, b = ({tuple(w[k : k + 5]) for k in range(max(1, n - 4))} for w in (words, other))
            exact = len(a & b) / len(a | b)
            x, y = (np.frombuffer(near_copies.sketch(" ".join(w))[1], np.uint8)[None] for w in (words, other))
            if abs(exact - near_copies.SIMILARITY) > 0.07:
                assert near_copies.alike(x, y)[0] == (exact > near_copies.SIMILARITY)
    empty = np.frombuffer(near_copies.sketch("")[1], np.uint8)[None]
    assert not near_copies.alike(empty, empty)[0]


def test_near_copies_group_of_one_source(spark):
    """Copies that are alike to their source, though less so to each other, join it."""
    import random

    r = random.Random(11)
    base = [str(r.randrange(5000)) for _ in range(200)]
    rows = [(0, " ".join(base))]
    for c in range(1, 80):
        other = list(base)
        for at in r.sample(range(200), 3):
            other[at] = f"new{c}"
        rows.append((c, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = {x["doc_id"] for x in op3_simhash.keep_first(df).collect()}
    assert 0 in kept and len(kept) <= 5


def test_pipeline(spark, sf):
    """run() against the same decisions taken one document at a time."""
    docs = C.read(spark, sf, "documents")
    model = op8_quality.fit(C.documents(docs), op8_quality.labels_of(spark, sf))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [r for r, s in zip(rows, op8_quality.scores(model, [t or "" for _, t in rows])) if s >= 0.3]
    rows = first_of_copies(rows)
    index = op2_decontamination.Index([tuple(r) for r in C.read(spark, sf, "benchmark").select("item_id", "text").collect()])
    rows = [r for r in rows if not list(index.verified(r[1] or ""))]
    formats = op6_secrets.learn(op6_secrets.find(spark.createDataFrame(rows, "doc_id bigint, text string")))
    rows = [(i, op6_secrets.redacted(t or "", formats)) for i, t in rows]
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in rows}
    check_packed(pieces, [(i, x) for (i, _), x in zip(rows, encoded(rows, "word_bpe_49k.json", 2))])


def test_stages_keep_columns_and_rows(spark, sf):
    """Each stage returns whole rows of its input (secrets: their texts changed alone), none twice."""
    df, rows = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.schema.names == df.schema.names
        same = [c for c in df.columns if name != "secrets" or c not in ("text", "n_chars")]
        assert out.select(same).exceptAll(df.select(same)).isEmpty()
        if name == "secrets":
            assert out.count() == len(rows)
        if name == "near_duplicates":
            assert out.where("doc_id is null").count() == sum(i is None for i, _ in rows)
        assert stage(spark, df.limit(0), sf).count() == 0


def test_pipeline_of_no_documents(spark, sf, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0 if name == "documents" else 5).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_recall_of_all_true_pairs(spark):
    """Of all pairs of documents at five-word similarity 0.8 or more, found by brute force, how many are in one class."""
    docs = C.documents(C.read(spark, "/root/testdata/sf0.01", "documents"))
    rows = [tuple(r) for r in docs.collect()]
    number, holders, size = {}, {}, {}
    for i, t in rows:
        w = t.encode().lower().split()
        own = {number.setdefault(tuple(w[k : k + 5]), len(number)) for k in range(max(1, len(w) - 4))}
        size[i] = len(own)
        for x in own:
            holders.setdefault(x, []).append(i)
    common = {}
    for some in holders.values():
        for k, a in enumerate(some):
            for b in some[:k]:
                common[a, b] = common.get((a, b), 0) + 1
    pairs = [(a, b) for (a, b), n in common.items() if 10 * n >= 8 * (size[a] + size[b] - n)]
    root = {r["doc_id"]: r["root"] for r in near_copies.components(docs).collect()}
    assert len(root) == len(rows) and len(pairs) > 30
    assert sum(root[a] == root[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_near_copies_of_one_doc_id(spark):
    """Rows of one doc_id are one document, with the links of all its texts."""
    a, b = (" ".join(f"{x}{k * k}" for k in range(60)) for x in "ab")
    df = spark.createDataFrame([(3, a), (3, b), (3, b), (7, a), (8, b), (9, a + " " + b)], "doc_id bigint, text string")
    assert {(r["doc_id"], r["root"]) for r in near_copies.components(df).collect()} == {(3, 3), (7, 3), (8, 3), (9, 9)}


def test_components_that_do_not_settle(spark, monkeypatch):
    monkeypatch.setattr(components, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components.connected_components(spark.range(50).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    unset = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError):
        C.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://host:7077")))


def five_words(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def similarity(a, b):
    a, b = five_words(a), five_words(b)
    return len(a & b) / len(a | b)


def test_near_copies_of_one_template(spark):
    """Many documents share a long passage and are not alike; each has one copy, which must be found."""
    import random

    r = random.Random(5)
    template = [str(r.randrange(5000)) for _ in range(340)]
    rows = []
    for k in range(400):
        words = template + [f"d{k}w{r.randrange(5000)}" for _ in range(60)]
        rows.append((k, " ".join(words)))
        rows.append((1000 + k, " ".join([*words, *(f"c{k}w{r.randrange(5000)}" for _ in range(64))])))
    assert similarity(rows[0][1], rows[2][1]) < 0.76 and similarity(rows[0][1], rows[1][1]) > 0.85
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    group = {i: i % 1000 for i, _ in rows}
    for i, _, least in brute_components(rows):
        a, b = group[i], group[least]
        group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert {x["doc_id"] for x in op3_simhash.keep_first(df).collect()} == set(group.values())


def test_near_copies_blocks_of_a_value(spark, monkeypatch):
    """Every two members of a value and of different classes meet; the members of the largest class do not meet each other."""
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rows = [(5, n, 1 if n < 400 else n if n < 420 else 420) for n in range(430)] + [(6, n, n) for n in range(30)] + [(7, n, 1) for n in range(30)]
    dealt = near_copies.crossed(spark.createDataFrame(rows, "value bigint, node bigint, class bigint")).collect()
    groups = {}
    for r in dealt:
        groups.setdefault(r["g"], []).append((r["node"], r["class"], r["side"]))
    met = {}
    for held in groups.values():
        for i, (u, a, x) in enumerate(held):
            for v, b, y in held[i + 1 :]:
                if a != b and (x != y or x == 2):
                    met[min(u, v), max(u, v)] = met.get((min(u, v), max(u, v)), 0) + 1
    five, six = rows[:430], rows[430:460]
    assert set(met) == {(u[1], v[1]) for part in (five, six) for u in part for v in part if u[1] < v[1] and u[2] != v[2]}
    assert len(dealt) < 400 * 10 + 30 * (10 + 70) + 30 * 10  # 430 * 54 if all blocks met


def test_near_copies_with_passages_added_or_dropped(spark):
    import random

    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(900)]
    rows, copies = [], set()
    for k in range(150):
        words = [vocabulary[min(int(r.expovariate(1) * 150), 899)] for _ in range(r.randrange(100, 1500))]
        n = int(len(words) * r.uniform(0.1, 0.19))
        at = r.randrange(len(words) - n)
        more = [f"{r.randrange(10**6)}" for _ in range(n)]
        other = (words + more, words[:at] + words[at + n :], words[:at] + more + words[at:])[k % 3]
        rows += [(k, " ".join(words)), (1000 + k, " ".join(other))]
        if similarity(rows[-1][1], rows[-2][1]) >= 0.8:
            copies.add(1000 + k)
    assert len(copies) > 120
    kept = {x["doc_id"] for x in op3_simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(copies & kept) <= 1 and set(range(150)) <= kept


def test_near_copies_are_exact_at_the_threshold(spark):
    import random

    r = random.Random(2)
    rows, want = [], set()
    for k in range(120):
        words = [str(r.randrange(9000)) for _ in range(500)]
        other = words + [f"x{r.randrange(9000)}" for _ in range(r.randrange(105, 145))]
        rows += [(k, " ".join(words)), (1000 + k, " ".join(other))]
        assert 0.77 < similarity(*(t for _, t in rows[-2:])) < 0.83
        want |= {k} if similarity(*(t for _, t in rows[-2:])) >= 0.8 else {k, 1000 + k}
    linked = {c[0] for c in brute_components(rows) if c[0] != c[2]}
    kept = {x["doc_id"] for x in op3_simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == want - linked
