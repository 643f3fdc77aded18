"""Packing along a space-filling curve.

A document's distinct token ids are feature-hashed into a signed vector, a fixed random projection takes it to three
dimensions, and the place of that point on a Hilbert curve is its key. Documents are laid in one stream by (key,
doc_id), so neighbours on the curve, which share vocabulary, share sequences. The stream is cut every 4096 ids: every
sequence but the last is full, and padding is below one sequence in all.

One pass encodes and stages keys and ids. The global order and its prefix sums use only (key, doc_id, length); ids
are shuffled once, to meet their place.

Cases: a null or empty text is a document of the end id alone; null doc_ids sort first; documents of one doc_id are
packed apart; an empty table gives no pieces; further columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilefold.llm import common as C
from tilefold.llm.bpe_words import encoder, forget

LENGTH = 4096
#: Bytes of texts that are encoded at once.
GATHERED = 4 << 20
DIMS, BITS, HASHED = 3, 12, 256
_random = np.random.default_rng(9)
PROJECTION = _random.standard_normal((HASHED, DIMS))
#: Borders of equal shares of a standard normal, by which a coordinate becomes an integer.
STEPS = np.array([NormalDist().inv_cdf(k / (1 << BITS)) for k in range(1, 1 << BITS)])


def document_vector(ids: np.ndarray) -> np.ndarray:
    """Signed feature hash of the distinct ids, of length 1 (0 for no ids)."""
    with np.errstate(over="ignore"):
        h = np.unique(ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    v = np.bincount((h >> np.uint64(8)).astype(np.int64) & HASHED - 1, np.where(h & np.uint64(1), 1.0, -1.0), HASHED)
    return v / max(1e-9, float(np.sqrt(v @ v)))


def hilbert_key(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (one a row), by exchanging and inverting lower bits from the top bit down."""
    x = [c.astype(np.int64) for c in coords.T]
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(n):
            on = x[i] & q != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << bits - 1
    while q > 1:
        t = np.where(x[-1] & q != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] ^ t) >> b & 1
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    return hilbert_key(np.searchsorted(STEPS, vectors @ PROJECTION))


STAGED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, uid = encoder(path, "words"), TaskContext.get().partitionId() << 40
        dtype, end = np.dtype("<u2" if e.width == 2 else "<u4"), end_id.to_bytes(e.width, "little")
        for b in C.gathered(batches, GATHERED):
            raw = e.batch(b.column("text"))
            keys = curve_keys(np.array([document_vector(np.frombuffer(r, dtype)) for r in raw]).reshape(-1, HASHED))
            uids = np.arange(uid, uid + len(raw))
            uid += len(raw)
            lengths = np.array([len(r) // e.width + 1 for r in raw], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(uids), b.column("doc_id"), pa.array(keys), pa.array(lengths), pa.array([r + end for r in raw], pa.binary())], schema=STAGED)

    C.tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "uid bigint, doc_id bigint, key bigint, n bigint, ids binary")


def pack(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, width: int = 2) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences of at most `length` ids; width: bytes of a packed id of this vocabulary."""
    staged, _ = C.stage(_encoded(docs, path, end_id), "packing")
    placed, _ = C.with_offsets(staged.select("uid", "doc_id", "key", "n"), ["key", "doc_id", "uid"], "n", "at", "curve")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype("<u2" if width == 2 else "<u4")

        def rows(b):
            for i, n, ids, at in zip(*(c.to_pylist() for c in b.columns)):
                wide, start = np.frombuffer(ids, dtype).astype("<u4"), 0
                while start < n:
                    s, o = divmod(at + start, length)
                    m = min(n - start, length - o)
                    yield i, start, m, zlib.crc32(wide[start : start + m].tobytes()), n, s, o
                    start += m

        forget()  # the worker may have encoded before; its table is not needed beside the ids
        for b in batches:
            yield from C.record_batches(rows(b), PIECES)

    joined = staged.select("uid", "doc_id", "n", "ids").join(placed.select("uid", "at"), "uid").select("doc_id", "n", "ids", "at")
    return joined.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.documents(C.read(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"), 2)


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
