"""Token ids in a content-addressed store.

A rolling hash over the last 16 ids cuts each document's id stream into chunks, so equal passages give equal chunks
wherever they stand. The store is a folder with three tables:

- chunks: hash (blake2b-128 of the packed ids), n, ids; each distinct chunk once;
- recipes: range-partitioned and sorted by doc_id: doc_id, n_tokens, recipe (its chunks' hashes in a row, each with the
  number of ids that follow the chunk) and the place in its part;
- manifest: one row a part with its first position in the whole stream and the Merkle root of its recipes. A recipe
  names its chunks by content, so a root vouches for every id of its part.

One pass encodes; its output is staged, so that chunks and recipes come from the same encoding. Only chunks are
shuffled with their ids, once, after each task has dropped its own repeats. Reading back for check sums moves no ids:
crc32 is linear, so a chunk's sum is shifted by the bytes that follow it in the document and the parts are combined by
exclusive or.

Cases: a null or empty text is a document of the end id alone; null doc_ids sort first; documents with one doc_id keep
a recipe each; an empty table gives empty tables; further columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.llm import common as C
from tilefold.llm.bpe_words import encoder

WINDOW, SHORTEST, LONGEST = 16, 64, 2048
#: A place is a border if these bits of the rolling hash are 0: chunks of some 250 ids.
MASK = np.uint64((1 << 8) - 1 << 40)
#: Chunk hashes that a task remembers to drop its own repeats.
REMEMBERED = 200_000
HASH = 16
WIDTH = 20  # of a chunk in a recipe: its hash and the number of ids after it as 32 bits


class Store(NamedTuple):
    chunks: str
    recipes: str
    manifest: str


def borders(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash over the last WINDOW ids of a row of id streams asks for a border.

    In the first WINDOW places of a stream the hash is of the stream before it too, but no chunk is as short as that.
    """
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        m, w = np.uint64(0xD6E8FEB86659FD93), 1
        while w < WINDOW:  # the hash of 2w ids from two hashes of w ids
            h[w:] = h[w:] + m * h[:-w]
            m, w = m * m, 2 * w
    return np.flatnonzero(h & MASK == 0) + 1


def cut(n: int, asked: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids: the borders asked for, between the shortest and the longest length."""
    if n <= SHORTEST:
        return [n]
    ends, at = [], 0
    for e in asked:
        while e - at > LONGEST:
            at += LONGEST
            ends.append(at)
        if e - at >= SHORTEST:
            ends.append(e)
            at = e
    while n - at > LONGEST:
        at += LONGEST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _shifts() -> np.ndarray:
    """tables[k][b][v]: what byte b of value v of a crc32 becomes when 2**k zero bytes follow."""
    step = np.array([zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0", 0) for i in range(32)], np.uint32)
    tables = []
    for _ in range(40):
        t = np.zeros((4, 256), np.uint32)
        for b in range(4):
            for i in range(8):
                t[b, np.arange(256) >> i & 1 == 1] ^= step[8 * b + i]
        tables.append(t)
        step = _apply(t, step)
    return np.array(tables)


def _apply(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    return t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]


_tables: list[np.ndarray] = []


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc32 sums as they enter the sum of a stream in which n_bytes follow: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    if not _tables:
        _tables.append(_shifts())
    out, n_bytes = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        on = n_bytes >> k & 1 == 1
        out[on] = _apply(_tables[0][k], out[on])
    return out


STAGED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("recipe", pa.binary()), ("hash", pa.binary()), ("ids", pa.binary())])


def _encode_and_cut(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """A row with a recipe for each document and a row with ids for each chunk that its task had not met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seen = encoder(path, "bytes"), set()
        width, dtype, end = e.width, np.dtype("<u2" if e.width == 2 else "<u4"), end_id.to_bytes(e.width, "little")
        blake = hashlib.blake2b

        def rows(b):
            streams = [raw + end for raw in e.batch(b.column("text"))]
            stops = np.cumsum([len(s) // width for s in streams])
            asked = borders(np.frombuffer(b"".join(streams), dtype))
            split = np.searchsorted(asked, stops, "right").tolist()
            begin, k = 0, 0
            for i, raw, stop, z in zip(b.column("doc_id").to_pylist(), streams, stops.tolist(), split):
                recipe, at, n = [], 0, stop - begin
                for c in cut(n, (asked[k:z] - begin).tolist()):
                    chunk = raw[at * width : c * width]
                    h = blake(chunk, digest_size=HASH).digest()
                    recipe.append(h + (n - c).to_bytes(4, "big"))
                    if h not in seen:
                        if len(seen) < REMEMBERED:
                            seen.add(h)
                        yield None, c - at, None, h, chunk
                    at = c
                begin, k = stop, z
                yield i, n, b"".join(recipe), None, None

        for b in C.gathered(batches):
            yield from C.record_batches(rows(b), STAGED)

    C.tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, recipe binary, hash binary, ids binary")


def leaf(doc_id: int | None, n: int, recipe: bytes) -> bytes:
    return hashlib.blake2b(repr((doc_id, n)).encode() + recipe, digest_size=HASH).digest()


class Merkle:
    """Root of a growing row of leaves, with one hash kept for each power of two."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, h: bytes) -> None:
        for k, other in enumerate(self.levels):
            if other is None:
                self.levels[k] = h
                return
            self.levels[k] = None
            h = hashlib.blake2b(other + h, digest_size=HASH).digest()
        self.levels.append(h)

    def root(self) -> bytes:
        h = b""
        for other in self.levels:
            if other is not None:
                h = hashlib.blake2b(other + h, digest_size=HASH).digest()
        return h


def _roots(recipes: DataFrame) -> DataFrame:
    """The Merkle root of each part, its rows streamed in order."""
    ordered = recipes.select("__part", "__rank", "doc_id", "n_tokens", "recipe").repartition("__part").sortWithinPartitions("__part", "__rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, tree = [], None, Merkle()
        for b in batches:
            for p, _, i, n, r in zip(*(c.to_pylist() for c in b.columns)):
                if p != part and part is not None:
                    out.append((part, tree.root()))
                    tree = Merkle()
                part = p
                tree.add(leaf(i, n, r))
        if part is not None:
            out.append((part, tree.root()))
        yield from C.record_batches(out, pa.schema([("__part", pa.int64()), ("root", pa.binary())]))

    return ordered.mapInArrow(run, "__part bigint, root binary")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> Store:
    """Encode documents (doc_id, text) into a store at path."""
    spark = docs.sparkSession
    store = Store(f"{path}/chunks", f"{path}/recipes", f"{path}/manifest")
    staged, at = C.stage(_encode_and_cut(docs, tokenizer, end_id), "encoded")
    staged.where("hash is not null").select("hash", "n", "ids").dropDuplicates(["hash"]).write.option("compression", "zstd").parquet(store.chunks)
    recipes = staged.where("recipe is not null").select("doc_id", F.col("n").alias("n_tokens"), "recipe")
    C.with_offsets(recipes, ["doc_id", "recipe"], "n_tokens", "start", "recipes", store.recipes)
    C.remove(spark, at)
    written = spark.read.parquet(store.recipes)
    sizes = written.groupBy("__part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    sizes.join(_roots(written), "__part").coalesce(1).write.parquet(store.manifest)
    return store


def recipes(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, rank, n_tokens, recipe: the parts' places come from the manifest, of one row a part. Each part's
    recipes must still have the Merkle root in it, or the read stops."""
    rows = spark.read.parquet(store.manifest).select("__part", "n_tokens", "n_docs", "root").orderBy("__part").collect()
    found = {r["__part"]: bytes(r["root"]) for r in _roots(spark.read.parquet(store.recipes)).collect()}
    if found != {r["__part"]: bytes(r["root"]) for r in rows}:
        raise ValueError("recipes and manifest differ: the store is damaged")
    at, rank, first = 0, 0, []
    for r in rows:
        first.append((r["__part"], at, rank))
        at, rank = at + r["n_tokens"], rank + r["n_docs"]
    table = F.broadcast(spark.createDataFrame(first, "__part bigint, __at bigint, __first bigint"))
    read = spark.read.parquet(store.recipes).join(table, "__part")
    return read.select("doc_id", (F.col("__at") + F.col("__run")).alias("start"), (F.col("__first") + F.col("__rank")).alias("rank"), "n_tokens", "recipe")


def _references(read: DataFrame) -> DataFrame:
    """A row for each chunk of each recipe, with the number of ids that follow it in the document."""
    each = read.select("rank", "doc_id", "start", "recipe", F.explode(F.sequence(F.lit(0), (F.length("recipe") / WIDTH).cast("int") - 1)).alias("seq"))
    at = F.col("seq") * WIDTH
    tail = F.conv(F.hex(F.substring("recipe", at + 1 + HASH, F.lit(WIDTH - HASH))), 16, 10).cast("bigint")
    return each.select("rank", "doc_id", "start", "seq", tail.alias("tail"), F.substring("recipe", at + 1, F.lit(HASH)).alias("hash"))


def _sums(chunks: DataFrame, width: int) -> DataFrame:
    """hash, n and crc32 of each stored chunk; a chunk that does not hash to its address stops the read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype("<u2" if width == 2 else "<u4")
        for b in batches:
            out = []
            for h, n, ids in zip(*(c.to_pylist() for c in b.columns)):
                if hashlib.blake2b(ids, digest_size=HASH).digest() != h or len(ids) != n * width:
                    raise ValueError(f"chunk {h.hex()} is damaged")
                out.append((h, n, zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes())))
            yield from C.record_batches(out, pa.schema([("hash", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())]))

    return chunks.select("hash", "n", "ids").mapInArrow(run, "hash binary, n bigint, crc bigint")


def check_sums(spark: SparkSession, store: Store, width: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the store's files."""
    C.tune(spark)
    joined = _references(recipes(spark, store)).join(_sums(spark.read.parquet(store.chunks), width), "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc, tail = b.column("crc").to_numpy(zero_copy_only=False), b.column("tail").to_numpy(zero_copy_only=False)
            part = pa.array(shifted(crc, 4 * tail).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rank", "doc_id", "start", "n")), part], names=["rank", "doc_id", "start", "n", "part"])

    parts = joined.select("rank", "doc_id", "start", "n", "crc", "tail").mapInArrow(run, "rank bigint, doc_id bigint, start bigint, n bigint, part bigint")
    sums = parts.groupBy("rank").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sum("n").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"))
    return sums.select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, store: Store, width: int) -> DataFrame:
    """doc_id, start, ids: each document put together again from its chunks, which a task meets in order."""
    C.tune(spark)
    joined = _references(recipes(spark, store)).join(spark.read.parquet(store.chunks).select("hash", "ids"), "hash")
    ordered = joined.select("rank", "doc_id", "start", "seq", "ids").repartition("rank").sortWithinPartitions("rank", "seq")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, last, held = np.dtype("<u2" if width == 2 else "<u4"), None, []

        def row():
            ids = np.frombuffer(b"".join(held), dtype).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([last[1]], pa.int64()), pa.array([last[2]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], schema=schema)

        for b in batches:
            for rank, doc_id, start, _, ids in zip(*(c.to_pylist() for c in b.columns)):
                if last is not None and rank != last[0]:
                    yield row()
                    held = []
                last = (rank, doc_id, start)
                held.append(ids)
        if last is not None:
            yield row()

    return ordered.mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")


def verify(spark: SparkSession, store: Store) -> bool:
    """Whether every part of the recipes still has the Merkle root in the manifest."""
    found = _roots(spark.read.parquet(store.recipes)).withColumnRenamed("root", "found")
    return spark.read.parquet(store.manifest).join(found, "__part", "full").where("not (root <=> found)").isEmpty()


def op5_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    store = write_store(C.documents(C.read(spark, sf_dir, "documents")), C.new_path(spark, "store"), public_tokenizers.path("byte_bpe_50k.json"))
    return check_sums(spark, store, 2)


QUERIES = {"op5_content_store": op5_content_store}
ORACLES: dict[str, str] = {}
