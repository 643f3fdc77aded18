"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the tokens at the positions that a fixed mask selects and ignores the others, so it survives
substitutions there. The three masks hit every 13 tokens of an item with two substitutions at most, wherever they
fall; shorter items have masks of their own that do so for a fifth of their tokens. Seeds of all test items are joined with the seeds at every token of every document; around each hit the item is
laid on the document along the hit's diagonal and compared token by token. A document is contaminated if 13 tokens there
(the whole of a shorter item) hold 80 % matches, that is two substitutions of 13 at most wherever they are, or if the
best run (a match counts 1, a substitution -4, so a run above 0 has 80 % matches) is as long. That run is reported, or
else the best 13 tokens.

Test items of BLOCK tokens at most are one index, which is broadcast; training text is then neither shuffled nor
collected. Beyond, the seeds of both sides are tables joined by shuffle. Of the documents' seeds only those go there that
a bitmap of the items' seeds (2^MAP_BITS bits, 16 MB, whatever the items) lets through, each document's text once by
its hash; hits are put together by document and item, and only such pairs meet their texts. Both ways give the same rows.

Cases: a null or empty text has no hits; items without tokens match nothing, those of fewer than 5 only as
a whole; repeated documents are each
reported; a null doc_id stays null; without items or documents the result is empty; further columns are ignored
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.llm import common as C

#: Token positions that the masks select; found by search: every window of 13 with two substitutions keeps one of them whole.
MASKS = ((0, 1, 2, 3, 5, 7, 8), (0, 3, 5, 6, 9, 10, 11), (0, 1, 4, 7, 8, 9, 10))
OVERLAP, SIMILARITY = 13, 0.8
#: Tokens (four characters each and one) of test items in a broadcast index: some 50 MB of arrays.
BLOCK = 1_000_000
#: Bits of the map of the items' seeds where these are joined by shuffle.
MAP_BITS = 27
WORD = re.compile(r"[^\W_]+")
_BITS = 20


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _factors(mask: tuple[int, ...], k: int) -> np.ndarray:
    return np.random.default_rng(1000 + k).integers(1, 1 << 63, len(mask), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Index:
    """Seeds of a block of items; tokens outside the items' vocabulary are 0."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.items: list[np.ndarray] = []
        for i, text in items:
            found = tokens(text or "")
            if found:
                self.ids.append(i)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64))
        lengths = sorted({len(x) for x in self.items if len(x) < OVERLAP})
        masks = [(0, m) for m in MASKS] + [(n, m) for n in lengths for m in short_masks(n)]  # items below 13 tokens: masks of their own length beside the spaced ones
        self.masks = [m for _, m in masks]
        self.tables = []
        for k, (length, mask) in enumerate(masks):
            found = [(h, n, q) for n, x in enumerate(self.items) if length in (0, len(x)) for q, h in enumerate(self.seeds(x, mask, k))]
            table = np.array([h for h, _, _ in found], np.uint64)
            order = np.argsort(table, kind="stable")
            places = np.array([(n, q) for _, n, q in found], np.int64).reshape(-1, 2)[order]
            maybe = np.zeros(1 << _BITS, bool)
            maybe[table >> np.uint64(64 - _BITS)] = True
            self.tables.append((table[order], places, maybe))

    @staticmethod
    def seeds(x: np.ndarray, mask: tuple[int, ...], k: int) -> np.ndarray:
        n = len(x) - mask[-1]
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for o, f in zip(mask, _factors(mask, k)):
                h += (x[o : o + n].astype(np.uint64) + np.uint64(0x51ED270B)) * f
            h ^= h >> np.uint64(32)
            return h * np.uint64(0x9E3779B97F4A7C15)

    def hits(self, x: np.ndarray) -> set[tuple[int, int]]:
        """(item, document position minus item position) of every seed hit."""
        out: set[tuple[int, int]] = set()
        for k, (mask, (table, places, maybe)) in enumerate(zip(self.masks, self.tables)):
            h = self.seeds(x, mask, k)
            at = np.flatnonzero(maybe[h >> np.uint64(64 - _BITS)]) if len(table) else []
            if not len(at):
                continue
            lo, hi = np.searchsorted(table, h[at], "left"), np.searchsorted(table, h[at], "right")
            for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
                for n, q in places[a:b].tolist():
                    out.add((n, p - q))
        return out

    def verified(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item id, document start, item start, run length, matches) in tokens, for each item the best run over its diagonals."""
        return ((self.ids[n], *run) for n, *run in self.found(text))

    def found(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """verified() with the item's number in the index in place of its id, which other items may have too."""
        get = self.vocabulary.get
        x = np.array([get(w, 0) for w in tokens(text)], np.int64)
        best: dict[int, tuple[int, int, int, int]] = {}
        for n, d in self.hits(x):
            run = along(self.items[n], x, d)
            if run:
                best[n] = max(best.get(n, run), run)
        for n, (m, length, minus_p, q) in sorted(best.items()):
            yield n, -minus_p, q, length, m


def along(item: np.ndarray, x: np.ndarray, d: int) -> tuple[int, int, int, int] | None:
    """Matches, length, minus the document start and item start of the best run on a diagonal (document less item place)."""
    q0 = max(0, -d)
    q1 = min(len(item), len(x) - d)
    match, least = item[q0:q1] == x[q0 + d : q1 + d], min(OVERLAP, len(item))
    s, e, m = best_run(match)
    if e - s < least:
        s, e, m = best_window(match, least)
    return (m, e - s, -(q0 + s + d), q0 + s) if e > s else None


def best_run(match: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the run of greatest sum of 1 for a match and -4 for none."""
    total = np.concatenate([[0], np.cumsum(np.where(match, 1, -4))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(match[start:end].sum())


def best_window(match: np.ndarray, size: int) -> tuple[int, int, int]:
    """Start, end and matches of the size tokens with most matches; nothing if they are too few."""
    total = np.concatenate([[0], np.cumsum(match)])
    found = total[size:] - total[:-size]
    at = int(np.argmax(found)) if len(found) else 0
    return (at, at + size, int(found[at])) if len(found) and found[at] >= SIMILARITY * size else (0, 0, 0)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of n tokens, one of which any substitutions of a fifth of them leave whole: all but so many of its parts."""
    bad = n - int(np.ceil(SIMILARITY * n))
    parts = np.array_split(np.arange(n), min(n, 2 * bad + 1))
    kept = (np.concatenate([p for k, p in enumerate(parts) if k not in out]) for out in combinations(range(len(parts)), bad))
    return sorted({tuple((m - m[0]).tolist()) for m in kept})


def index_of(benchmark: DataFrame) -> Index | None:
    """The index of the test items (item_id, text), or None if they have more than BLOCK tokens."""
    held, size = [], 0
    for r in benchmark.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") // 4 + 1
        if size > BLOCK:
            return None
    return Index(held)


def hashed(text: str) -> np.ndarray:
    """The tokens of a text by 64 bits of hash."""
    import xxhash

    seen: dict[str, int] = {}
    return np.array([seen.get(w) or seen.setdefault(w, xxhash.xxh64_intdigest(w)) for w in tokens(text)], np.uint64)


def _all_masks(lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(length, mask): 0 for items of any length, or that of the shorter items that a mask is for."""
    return [(0, m) for m in MASKS] + [(n, m) for n in lengths for m in short_masks(n)]


_SEED = pa.schema([("mask", pa.int32()), ("seed", pa.int64()), ("key", pa.string()), ("at", pa.int64())])


def _seeds(rows: DataFrame, masks: list[tuple[int, tuple[int, ...]]], items: bool, bitmap=None) -> DataFrame:
    """(mask, seed, key, at) of rows (key, text): of items the masks for their length, of documents those seeds of all masks
    that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                x = hashed(text)
                for k, (length, mask) in enumerate(masks):
                    if items and length not in (0, len(x)):
                        continue
                    h = Index.seeds(x, mask, k)
                    at = np.arange(len(h)) if bitmap is None else np.flatnonzero(bitmap.value[h >> np.uint64(67 - MAP_BITS)] >> (h >> np.uint64(64 - MAP_BITS) & np.uint64(7)).astype(np.uint8) & 1)
                    for c in range(0, len(at), 8192):
                        own = at[c : c + 8192]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(h[own].view(np.int64)), pa.array([key] * len(own), pa.string()), pa.array(own)], schema=_SEED)

    C.tune(rows.sparkSession)
    return rows.select("key", "text").mapInArrow(run, "mask int, seed bigint, key string, at bigint")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A byte for eight values of a seed's highest MAP_BITS bits; the bytes that are not 0 come to the driver, 2^(MAP_BITS - 3) at most."""
    high = F.shiftrightunsigned("seed", 64 - MAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1), high.bitwiseAND(F.lit(7).cast("bigint")).cast("int"))
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in seeds.groupBy(F.shiftright(high, 3).alias("byte")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        out[r["byte"]] = r["bits"]
    return out


def _candidates(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, item, diagonals) of texts, by their hash, and items that share a seed, and the items (item, item_id, text)."""
    spark = docs.sparkSession
    items, _ = C.stage(benchmark.where("text is not null").select(F.monotonically_increasing_id().cast("string").alias("item"), "item_id", "text"), "items")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens(t)) for t in b.column("text").to_pylist()], pa.int64())], names=["n"])

    short = items.select("text").mapInArrow(sizes, "n bigint").where((F.col("n") > 0) & (F.col("n") < OVERLAP)).distinct()
    masks = _all_masks(sorted(r["n"] for r in short.collect()))  # OVERLAP - 1 lengths at most
    own, _ = C.stage(_seeds(items.select(F.col("item").alias("key"), "text"), masks, True), "seeds")
    bitmap = spark.sparkContext.broadcast(_bitmap(own))
    texts = docs.select(F.md5(F.col("text").cast("binary")).alias("key"), "text").where("text <> ''").dropDuplicates(["key"])
    met = _seeds(texts, masks, False, bitmap).join(own.select("mask", "seed", F.col("key").alias("item"), F.col("at").alias("q")), ["mask", "seed"])
    diagonals = met.select("key", "item", (F.col("at") - F.col("q")).alias("d")).groupBy("key", "item").agg(F.collect_set("d").alias("diagonals"))
    return C.stage(diagonals, "hits")[0], items


HITS = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "doc_start", "item_start", "overlap", "matches", "item_tokens")])
HITS_SQL = "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, overlap bigint, matches bigint, item_tokens bigint"


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each contaminated document and item: where the best run is, in tokens."""
    index = index_of(benchmark)
    if index is None:
        return _joined(docs, benchmark).drop("key")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        def rows(ids, texts):
            for i, t in zip(ids, texts):
                for n, p, q, length, m in shared.value.found(t):
                    yield i, shared.value.ids[n], p, q, length, m, len(shared.value.items[n])

        return rows

    return C.map_documents(docs, make, HITS_SQL, HITS)


def _joined(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """overlaps() by joined seeds, and the key of the text: pairs of a document and an item meet their texts and are
    verified along their diagonals."""
    hits, items = _candidates(docs, benchmark)
    named = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("key"))
    pairs = named.join(hits, "key").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b):
            for key, i, text, item_id, item_text, diagonals in zip(*(c.to_pylist() for c in b.columns)):
                x, item = hashed(text), hashed(item_text)
                best = max((r for d in diagonals if (r := along(item, x, d))), default=None)
                if best:
                    m, length, minus_p, q = best
                    yield key, i, item_id, -minus_p, q, length, m, len(item)

        for b in batches:
            yield from C.record_batches(rows(b), pa.schema([("key", pa.string()), *HITS]))

    C.tune(docs.sparkSession)
    return pairs.select("key", "doc_id", "text", "item_id", "item_text", "diagonals").mapInArrow(run, f"key string, {HITS_SQL}")


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that overlap with no item."""
    C.tune(docs.sparkSession)
    index = index_of(benchmark)
    if index is None:
        texts = docs.select(F.lit(0).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").dropDuplicates(["text"])
        found = _joined(texts, benchmark).select(F.col("key").alias("__leaking")).distinct()
        return docs.join(found, F.md5(F.col("text").cast("binary")) == F.col("__leaking"), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def leaks(texts):
        return texts.map(lambda t: next(shared.value.verified(t or ""), None) is not None).astype(bool)

    return docs.where(~leaks(F.col("text")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(C.documents(C.read(spark, sf_dir, "documents")), C.read(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES: dict[str, str] = {}
