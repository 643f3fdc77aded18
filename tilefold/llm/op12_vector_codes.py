"""Vector code compression: product codes by active-entry Lloyd rounds.

Components become integers, floor(scale * x), and a vector is cut into equal parts. Each part position has its own
codebook, which starts as that part of the first vectors by id. A round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and then moves each entry to the floored mean of its parts; an entry
without parts stays. Each part keeps its entry and its exact distance. In the next round a part whose entry has not
moved still has that distance, so it meets only the entries that have moved; all other parts meet the whole codebook.
All numbers are integers, so neither the order of rows nor the number of tasks matters.

A codebook has `entries` rows of a part's width (4,096 numbers in all for 16 x 64 entries of 4), so it travels with the
tasks. Each task sums its own parts by entry before the shuffle. A round's entries and distances are a table in the
shared folder, and the one before is removed.

Cases: rows without a vector, or with a null or non-finite component, are dropped; so are vectors whose length is not a
multiple of `parts` or differs from that of the first kept id. Ids may repeat, every row gets its code; null ids come
last in the order of ids. Fewer kept rows than entries give a codebook of as many entries. An empty table gives an empty
result. Components of scale * |x| over 2**28 are an error: their squares need not fit a long. Further columns are
ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.llm import common as C

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 28
#: Rows of label sums that are broadcast at most (some 40 bytes each).
LABELS = 500_000
_STATE = "vec_id bigint, label string, x array<bigint>, entry array<int>, dist array<bigint>"
_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("x", pa.list_(pa.int64())), ("entry", pa.list_(pa.int32())), ("dist", pa.list_(pa.int64()))])


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and distance of each row of x (n, width) in a codebook (entries, width), the lower index of equal ones."""
    d = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        step = x[:, k, None] - book[None, :, k]
        d += step * step
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def reassign(x: np.ndarray, entry: np.ndarray, dist: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """nearest(), from the entries and distances in the codebook before: `moved` marks the entries that are not as they
    were. Also how many distances were computed."""
    fixed = ~moved[entry]
    entry, dist = entry.copy(), dist.copy()
    active = np.flatnonzero(moved)
    if len(active) and fixed.any():
        at, d = nearest(x[fixed], book[active])
        at = active[at]
        better = (d < dist[fixed]) | ((d == dist[fixed]) & (at < entry[fixed]))
        where = np.flatnonzero(fixed)[better]
        entry[where], dist[where] = at[better], d[better]
    rest = ~fixed
    if rest.any():
        entry[rest], dist[rest] = nearest(x[rest], book)
    return entry, dist, int(fixed.sum()) * len(active) + int(rest.sum()) * len(book)


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int) -> DataFrame:
    """(vec_id, label, v): vectors of finite components whose length is a multiple of `parts`."""
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(F.col("v").isNotNull() & finite & (F.size("v") > 0) & (F.size("v") % parts == 0))


def whole(v: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(v * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component exceeds {LARGEST} after scaling")
    return scaled.astype(np.int64)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(np.ascontiguousarray(a).ravel(), kind))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assign(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, scale: int) -> DataFrame:
    """Rows with the entry and distance of each part. `rows` has vectors (v) before the first round (`moved` is None),
    and later the state of the round before."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = whole(_matrix(b.column("v")), scale) if moved is None else _matrix(b.column("x"))
            cut = x.reshape(len(x), parts, width)
            if moved is None:
                found = [nearest(cut[:, p], books[p]) for p in range(parts)]
            else:
                entry, dist = _matrix(b.column("entry")), _matrix(b.column("dist"))
                found = [reassign(cut[:, p], entry[:, p].astype(np.int64), dist[:, p], books[p], moved[p])[:2] for p in range(parts)]
            entry, dist = (np.stack([f[k] for f in found], 1) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _lists(x, pa.int64()), _lists(entry.astype(np.int32), pa.int32()), _lists(dist, pa.int64())], schema=_ARROW)

    C.tune(rows.sparkSession)
    return rows.mapInArrow(run, _STATE)


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the floored mean of its parts. A task sends its sums by part, entry and component,
    as many rows as the codebooks have numbers at most; so do the totals that come to the driver."""
    parts, entries, width = books.shape
    schema = pa.schema([("cell", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, entry = _matrix(b.column("x")).reshape(-1, parts, width), _matrix(b.column("entry"))
            for p in range(parts):
                np.add.at(sums[p], entry[:, p], x[:, p])
                counts[p] += np.bincount(entry[:, p], minlength=entries)
        cells = np.flatnonzero(np.repeat(counts.ravel() > 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(sums.ravel()[cells]), pa.array(np.repeat(counts.ravel(), width)[cells])], schema=schema)

    C.tune(state.sparkSession)
    totals = state.select("x", "entry").mapInArrow(run, "cell int, total bigint, n bigint").groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    new = books.ravel().copy()
    for r in totals.collect():
        new[r["cell"]] = r["total"] // r["n"]
    return new.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    """Of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, entry, dist) of every kept vector, one entry and one squared distance a part, and the codebooks
    (parts, entries, width). code_of() turns entries into text, decoded() turns them into vectors again."""
    rows = kept(vectors, id_col, vector_col, label_col, parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    length = len(first[0]["v"]) if first else parts
    rows = rows.where(F.size("v") == length)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = whole(np.array([r["v"] for r in seeds], float).reshape(len(seeds), parts, length // parts), scale).transpose(1, 0, 2)
    if not seeds:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("entry"), F.array().cast("array<bigint>").alias("dist")), books
    state, path = C.stage(assign(rows, books, None, scale), "codes")
    for _ in range(rounds):
        new = moved_books(state, books)
        moved, books = (new != books).any(2), new
        state, later = C.stage(assign(state, books, moved, scale), "codes")
        C.remove(rows.sparkSession, path)
        path = later
    return state.select("vec_id", "label", "entry", "dist"), books


def code_of(entry="entry"):
    """Two hex digits a part, in the order of parts."""
    return F.array_join(F.transform(entry, lambda e: F.lpad(F.lower(F.hex(e.cast("bigint"))), 2, "0")), "")


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the entries that a code names, put together and scaled back."""
    table = F.array(*(F.array(*(F.array(*(F.lit(float(c) / scale) for c in e)) for e in b)) for b in books))
    return codes.select("vec_id", F.flatten(F.transform("entry", lambda e, p: F.element_at(F.element_at(table, p + 1), e + 1))).alias("vector"))


def with_errors(codes: DataFrame) -> DataFrame:
    """codes with `error`, the sum of a row's distances, and `label_error`, that of all rows of its label. Labels are
    summed before they meet the rows; their sums are broadcast up to LABELS of them."""
    rows = codes.withColumn("error", F.aggregate("dist", F.lit(0).cast("bigint"), lambda s, d: s + d))
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    few = sums.limit(LABELS + 1).count() <= LABELS
    return rows.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(C.read(spark, sf_dir, "embeddings"))
    return with_errors(codes).select("vec_id", code_of().alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> str:
    """Every part against every entry, in each of the two rounds and at the end."""

    def assigned(k: int) -> str:
        distances = f"SELECT x.id, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b{k} b ON b.p = x.p AND b.q = x.q GROUP BY ALL"
        return f"a{k} AS MATERIALIZED (SELECT id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM ({distances}) GROUP BY id, p)"

    def moved(k: int) -> str:
        means = f"SELECT a.p, a.e, x.q, CAST(floor(sum(x.c)::DOUBLE / count(*)) AS BIGINT) AS c FROM a{k} a JOIN x ON x.id = a.id AND x.p = a.p GROUP BY ALL"
        return f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.q, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN ({means}) m ON m.p = b.p AND m.e = b.e AND m.q = b.q)"

    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, embedding AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
    u AS (SELECT id, len(v) // {parts} AS w, unnest(range(len(v))) AS o, CAST(floor({scale} * CAST(unnest(v) AS DOUBLE)) AS BIGINT) AS c FROM v),
    x AS MATERIALIZED (SELECT id, o // w AS p, o % w AS q, c FROM u),
    b0 AS MATERIALIZED (SELECT p, id AS e, q, c FROM x WHERE id < {entries}),
    {assigned(0)}, {moved(0)}, {assigned(1)}, {moved(1)}, {assigned(2)},
    r AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY id),
    h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, q)) AS h FROM b2)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN r USING (id), h"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES: dict[str, str] = {"op12_vector_codes": _sql()}
