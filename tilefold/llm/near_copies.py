"""Classes of near-duplicates: SimHash links, and near copies at five-word shingle similarity 0.8.

Majority bits over shingles drift apart by 3 to 11 bits at that similarity, beyond any ball that can be emitted, so
near copies have candidates of their own: BANDS values, each of ROWS minima over the five-word shingles. A pair of
similarity 0.8 has one in common with probability 1 - (1 - 0.8 ** 6) ** 32 = 0.99994, whatever was changed in it.

All pairs of a value are compared or already joined. First each member is compared with the earliest document there,
which joins nearly all copies to what they were made from. Then the values whose other members are still in several
classes are dealt in blocks, and every pair of members of different classes is compared; those of a value's largest
class only with the others there, so a group of copies costs its size, not its square. A comparison is exact, on the
shingle sets of the two texts; only of the first ones, those that the estimate from one-permutation minima (BINS bins
of 8 bits) puts five standard errors from the threshold are settled by it.

A node is a distinct text (by 128 bits of hash), named by its least doc_id, so copies cost one row a document.

Cases: null texts are empty, texts without words are linked with each other; no doc_id may be null (keep_first leaves
such rows out and keeps them); rows of one doc_id are one document, with the links of all its texts; an empty table
gives an empty result; ties in similarity at exactly 0.8 are links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilefold.llm import common as C
from tilefold.llm.components import connected_components
from tilefold.llm.op3_simhash import fingerprint_of, links, words_of

BANDS, ROWS, BINS, WORDS, SIMILARITY = 32, 6, 512, 5, 0.8
#: A bin's value if it is empty; others are below.
EMPTY = 255
#: Standard errors from the threshold at which the estimate settles a pair; members of a block.
CLEAR, BLOCK = 5, 256
#: Node ids that are broadcast at most (16 MB).
FEW = 1_000_000
_MULTIPLIERS = np.random.default_rng(3).integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.uint32(0xFFFFFFFF)


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of the five-word shingles; of fewer words, of all together."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    own = {w: xxh64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(own.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    s = np.zeros(len(h) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            s = (s ^ s >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(s)]
        return np.unique((s ^ s >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F))


def banded(s: np.ndarray) -> list[int]:
    """The values of the bands, as signed longs."""
    from xxhash import xxh64_intdigest

    least = np.full(len(_MULTIPLIERS), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 1024):
            least = np.minimum(least, (_MULTIPLIERS * s[k : k + 1024]).min(1))
    found = (xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS)))
    return [v - (1 << 64) if v >> 63 else v for v in found]


def sketch(text: str) -> tuple[list[int], bytes]:
    """The fingerprint over shingles with the values of the bands, and the shingle minima, of a whole text."""
    words = words_of(text)
    if not words:
        return [0], bytes([EMPTY]) * BINS
    fp = fingerprint_of(words)
    s = shingles(words)
    least = np.full(BINS, _NONE)
    np.minimum.at(least, (s >> np.uint64(55)).astype(np.int64), (s >> np.uint64(16)).astype(np.uint32) & np.uint32(0xFFFFFFFE))
    minima = np.where(least == _NONE, EMPTY, (least >> np.uint32(1)) % np.uint32(EMPTY)).astype(np.uint8).tobytes()
    return [fp - (1 << 64) if fp >> 63 else fp, *banded(s)], minima


SKETCH = pa.schema([("doc_id", pa.int64()), ("hash", pa.binary()), ("fps", pa.list_(pa.int64())), ("minima", pa.binary())])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, its fingerprint and bands, its minima."""

    def run(batches):
        for b in batches:
            rows = ((i, h, *sketch(t)) for i, h, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "hash", "text"))))
            yield from C.record_batches(rows, SKETCH)

    C.tune(docs.sparkSession)
    return docs.select("doc_id", F.unhex(F.md5("text")).alias("hash"), "text").mapInArrow(run, "doc_id bigint, hash binary, fps array<bigint>, minima binary")


def estimated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of minima, the shingle similarity and its standard error at the threshold; values that agree by chance are allowed for."""
    either = ((a != EMPTY) | (b != EMPTY)).sum(1)
    both = ((a != EMPTY) & (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    return (same * EMPTY - both) / np.maximum(either, 1) / (EMPTY - 1), np.sqrt(SIMILARITY * (1 - SIMILARITY) / np.maximum(either, 1))


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of minima, whether the estimated shingle similarity is high enough."""
    return estimated(a, b)[0] >= SIMILARITY


def judged(pairs: DataFrame, minima: DataFrame) -> DataFrame:
    """The pairs (u, v) that the estimate does not rule out; sure: whether it settles them."""
    pairs = pairs.join(minima.select(F.col("node").alias("u"), F.col("minima").alias("a")), "u").join(minima.select(F.col("node").alias("v"), F.col("minima").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("a", "b"))
            value, error = estimated(x, y)
            sure = pa.array(value >= SIMILARITY + CLEAR * error)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), sure], names=["u", "v", "sure"]).filter(pa.array(value >= SIMILARITY - CLEAR * error))

    return pairs.mapInArrow(run, "u bigint, v bigint, sure boolean")


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Of every two sets of shingles, whether their similarity is high enough."""
    n, size = len(sets), np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = np.repeat(np.arange(n), size)[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 4097, 4096))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        m = np.zeros((n, int(column[b - 1]) - 4096 * k + 1 if b > a else 0), np.float32)
        m[row[a:b], column[a:b] - 4096 * k] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    return 10 * common >= 8 * (size[:, None] + size - common)


def compared(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (u, v) that join what is alike among the members (node, class, side) of each group (g): a member of side 0 is
    compared with those of side 1, one of side 2 with all, unless both are of one class."""

    def edges(held):
        nodes, classes, sides, sets = zip(*held)
        side, cls = np.array(sides), np.array(classes)
        if len(set(classes)) == 1:
            return
        ok = similar(sets) & (cls[:, None] != cls) & ((side[:, None] != side) | (side == 2))
        root = {c: c for c in classes}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for i, j in np.argwhere(np.triu(ok, 1)).tolist():
            a, b = top(classes[i]), top(classes[j])
            if a != b:
                root[a] = b
                yield nodes[i], nodes[j]

    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        def rows():
            at, held = None, []
            for b in batches:
                for g, node, cls, side, text in zip(*(b.column(c).to_pylist() for c in ("g", "node", "class", "side", "text"))):
                    if g != at:
                        if held:
                            yield from edges(held)
                        at, held = g, []
                    held.append((node, cls, side, shingles(words_of(text))))
            if held:
                yield from edges(held)

        yield from C.record_batches(rows(), out)

    C.tune(groups.sparkSession)
    dealt = groups.join(texts, "node").select("g", "node", "class", "side", "text").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def texts_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """node and text of the members of the groups; all texts are shuffled only if the members are more than FEW."""
    wanted = groups.select("node").distinct()
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    return docs.select(F.col("doc_id").alias("node"), "text").join(wanted, "node").dropDuplicates(["node", "text"])


def stars(pairs: DataFrame) -> DataFrame:
    """Groups of the pairs (u, v): each v with its u, BLOCK or so at a time."""
    blocks = pairs.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    leaves = pairs.join(blocks, "v").select(F.xxhash64("v", F.pmod(F.xxhash64("u", F.lit(1)), "blocks")).alias("g"), F.col("u").alias("node"), F.lit(1).alias("side"))
    centres = blocks.select("v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("b")).select(F.xxhash64("v", "b").alias("g"), F.col("v").alias("node"), F.lit(0).alias("side"))
    return leaves.unionByName(centres).select("g", "node", F.col("node").alias("class"), "side")


def crossed(members: DataFrame) -> DataFrame:
    """Groups of the members (value, node, class) of values with several classes, in blocks of BLOCK or so: those outside
    the value's largest class meet each other and those of that class, whose members do not meet each other."""
    values = members.groupBy("value").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s")).where("lo <> hi")
    once = values.groupBy("n", "s").agg(F.min("value").alias("value"))  # values of the same members need one comparison
    own = members.join(once.select("value", "n"), "value")
    sizes = own.groupBy("value", "class").agg(F.count("*").alias("size"), F.first("n").alias("n"))
    largest = sizes.groupBy("value").agg(F.max(F.struct("size", "class")).alias("top"), F.first("n").alias("n"))
    blocks = largest.select("value", F.col("top.class").alias("main"), F.ceil((F.col("n") - F.col("top.size")) / BLOCK).alias("others"), F.ceil(F.col("top.size") / BLOCK).alias("mains"))
    inside = F.col("class") == F.col("main")
    own = members.join(blocks, "value").withColumn("b", F.when(inside, F.col("others") + F.pmod(F.xxhash64("node", F.lit(1)), "mains")).otherwise(F.pmod(F.xxhash64("node", F.lit(1)), "others")))
    dealt = own.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    side = F.when(F.col("b") == F.col("c"), 2).when(F.col("b") < F.col("c"), 0).otherwise(1)
    return dealt.select(F.xxhash64("value", F.least("b", "c"), F.greatest("b", "c")).alias("g"), "node", "class", side.alias("side"))


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, root) of documents (doc_id, text): root is the least doc_id of the class."""
    made, _ = C.stage(sketches(docs), "sketches")
    nodes, _ = C.stage(made.groupBy("hash").agg(F.min("doc_id").alias("node"), F.first("fps").alias("fps"), F.first("minima").alias("minima")), "nodes")
    placed, _ = C.stage(made.select("doc_id", "hash").join(nodes.select("hash", "node"), "hash").select("doc_id", "node"), "placed")
    printed = nodes.select("node", F.col("fps")[0].alias("fp"))
    first, _ = C.stage(printed.groupBy("fp").agg(F.min("node").alias("first")), "first")
    near = links(first.select("fp")).join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    shared = printed.join(first, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    one = placed.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("hi")).where("v <> hi").select("doc_id", "v")
    sure = near.unionByName(shared).unionByName(placed.join(one, "doc_id").select(F.col("node").alias("u"), "v"))

    banded = nodes.select("node", F.explode(F.slice("fps", 2, BANDS)).alias("value"))
    centres = banded.groupBy("value").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("value", "centre")
    members, _ = C.stage(banded.join(centres, "value").where("node <> centre").select("value", "node", "centre"), "members")
    found, _ = C.stage(judged(members.select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct(), nodes.select("node", "minima")), "judged")
    groups, _ = C.stage(stars(found.where("not sure").select("u", "v")), "stars")
    edges = sure.unionByName(found.where("sure").select("u", "v")).unionByName(compared(groups, texts_of(docs, groups)))
    roots = connected_components(edges)

    # What is in a value beside its centre and in another class is compared with all of the other classes there.
    left = members.join(roots, "node", "left").select("value", "node", F.coalesce("root", "node").alias("class"))
    groups, _ = C.stage(crossed(left), "crossed")
    more, _ = C.stage(compared(groups, texts_of(docs, groups)), "more")
    if not more.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    return placed.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")).distinct()
