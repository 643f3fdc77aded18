"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

A fingerprint has 64 bits, each the majority of that bit over the hashes of the text's word shingles. Two fingerprints
within 2 bits have a value in common that is within 1 bit of both, so every distinct fingerprint emits itself and its
64 neighbours; what meets in one value is within 2 bits. Fingerprints are made distinct first (copies, however many,
are one row), so a value has 65 of them at most. Within a value each is linked to the least one, and the links are
verified by counting bits; components over them give the classes.

Links between fingerprints at 2 bits or fewer follow from such stars: any two of a value share its star.

Cases: texts without words have fingerprint zero and link as any other; null texts are empty; a class's id is its least
doc_id that is not null (null if there is none); repeated rows give repeated rows; an empty table gives an empty
result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilefold.llm import common as C
from tilefold.llm.components import connected_components

SHINGLE, SEED = 3, 42
RADIUS = 2
_BLOCK = 1 << 15


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, repeats included; A-Z are lower-cased first."""
    return fingerprint_of(words_of(text), size, seed)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes, both know ASCII alone


def fingerprint_of(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < size:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())]
    h = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[k : k + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def make():
        def rows(ids, texts):
            for i, t in zip(ids, texts):
                f = fingerprint(t)
                yield i, f - (1 << 64) if f >> 63 else f

        return rows

    return C.map_documents(docs, make, "doc_id bigint, fp bigint", SCHEMA)


def links(distinct: DataFrame) -> DataFrame:
    """Verified edges (u, v) between distinct fingerprints (fp) that join all at 2 bits or fewer."""
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint") for b in range(64)))
    emitted = distinct.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    met = emitted.withColumn("least", F.min("fp").over(Window.partitionBy("value"))).where("fp <> least")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= RADIUS).select(F.col("fp").alias("u"), F.col("least").alias("v"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that is reached by links."""
    staged, _ = C.stage(fingerprints(docs), "fingerprints")
    distinct = staged.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named, _ = C.stage(rooted.join(ids, "root").select("fp", "component_id"), "classes")
    return staged.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: classes join documents that are linked by fingerprints or are
    near copies by five-word shingles (near_copies); the one of the least doc_id stays, and rows that repeat its doc_id.

    Rows of one doc_id are one document. Rows without a doc_id cannot be told apart and are kept.
    """
    from tilefold.llm import near_copies

    roots = near_copies.components(C.documents(docs).where("doc_id is not null"))
    copies = roots.where("doc_id <> root").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*(docs[c] for c in docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(C.documents(C.read(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
