"""Products by 16x16 tiles, and the seven encodings of a tile's values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefold.functions import bits as B
from tilefold.operators import matrix as M

SIDE = 16
_OUT = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("v", pa.float64())])


def _dense(places: pa.ListArray, values: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of places and values as (n, 16, 16) blocks, and where they have an entry."""
    n = len(places)
    row = np.repeat(np.arange(n), np.diff(places.offsets.to_numpy()))
    at = places.flatten().to_numpy()
    block, has = np.zeros((n, SIDE * SIDE)), np.zeros((n, SIDE * SIDE), np.float32)
    block[row, at], has[row, at] = values.flatten().to_numpy(), 1
    return block.reshape(n, SIDE, SIDE), has.reshape(n, SIDE, SIDE)


#: Result tiles that a task adds up at once: 4 kB each.
HELD = 4096


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of A B as small dense products: tiles are joined on the inner tile index, a task adds up the products of a
    result tile as it meets them, HELD tiles at a time, and only these sums are shuffled and added. For matrices with many
    entries a tile; the element-wise product is better for few."""
    ta = M.tile_values(a).select("ti", F.col("tj").alias("k"), F.col("places").alias("ap"), F.col("vals").alias("av"))
    tb = M.tile_values(b).select(F.col("ti").alias("k"), "tj", F.col("places").alias("bp"), F.col("vals").alias("bv"))
    pairs = ta.join(tb, "k").select("ti", "tj", "ap", "av", "bp", "bv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            out = _entries(list(held), np.stack([h[0] for h in held.values()]), np.stack([h[1] for h in held.values()]))
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            ti, tj = (batch.column(c).to_numpy() for c in ("ti", "tj"))
            order = np.lexsort((tj, ti))
            batch, ti, tj = batch.take(pa.array(order)), ti[order], tj[order]
            (x, hx), (y, hy) = _dense(batch.column("ap"), batch.column("av")), _dense(batch.column("bp"), batch.column("bv"))
            first = np.flatnonzero(np.concatenate([[True], (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])]))
            sums, counts = np.add.reduceat(x @ y, first), np.add.reduceat(hx @ hy, first)
            for key, s, n in zip(zip(ti[first].tolist(), tj[first].tolist()), sums, counts):
                if key in held:
                    held[key][0] += s
                    held[key][1] += n
                else:
                    held[key] = [s.copy(), n.copy()]
                    if len(held) == HELD:
                        yield flush()
        if held:
            yield flush()

    return pairs.mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def _entries(keys: list[tuple[int, int]], sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    n, r, c = np.nonzero(counts)
    tiles = np.array(keys, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(tiles[n, 0] * SIDE + r), pa.array(tiles[n, 1] * SIDE + c), pa.array(sums[n, r, c])], schema=_OUT)


def _row(p: Column) -> Column:
    return F.shiftright(p, 4)


def _col(p: Column) -> Column:
    return p.bitwiseAND(F.lit(15))


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Where lists of these lengths start, one after another, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def coded(fmt: str, z: np.ndarray, p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and slots of many tiles in one of the seven formats, each with where the tiles' lists start: the index numbers
    and the value slots, absent places 0. Tiles have z entries each, one after another, by places p, ascending. Numbers are
    logical; functions.bits packs them into nibbles."""
    n, t = len(z), np.repeat(np.arange(len(z)), z)
    r, c, own = p >> 4, p & 15, np.arange(len(p)) - _starts(z)[t]
    lengths = np.bincount(t * SIDE + r, minlength=n * SIDE).reshape(n, SIDE)
    rank = np.arange(len(p)) - _starts(lengths.ravel())[t * SIDE + r]

    def room(codes: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts = _starts(codes), _starts(slots)
        return starts[0], np.zeros(starts[0][-1], np.int32), starts[1], np.zeros(starts[1][-1])

    if fmt == "COO":
        at, codes, to, slots = room(z + 1, z)
        codes[at[:-1]], codes[at[t] + 1 + own], slots[:] = z - 1, p, v
    elif fmt == "CSR":
        at, codes, to, slots = room(z + SIDE + 1, z)
        codes[at[:-1, None] + np.arange(1, SIDE + 1)] = np.cumsum(lengths, 1) % 256
        codes[at[t] + SIDE + 1 + own], slots[:] = c, v
    elif fmt == "ELL":
        w = lengths.max(1, initial=0)
        at, codes, to, slots = room(w * SIDE + 1, w * SIDE)
        k = r * w[t] + rank
        codes[at[:-1]], codes[at[t] + 1 + k], slots[to[t] + k] = w - 1, c, v
    elif fmt == "HYB":
        w = np.maximum(lengths, 1).min(1, initial=SIDE)
        tail = rank >= w[t]
        more = np.bincount(t[tail], minlength=n)
        at, codes, to, slots = room(w * SIDE + 2 + more, w * SIDE + more)
        k = r * w[t] + rank
        k[tail] = w[t[tail]] * SIDE + np.arange(np.count_nonzero(tail)) - _starts(more)[t[tail]]
        codes[at[:-1]], codes[at[:-1] + 1] = w - 1, more
        codes[at[t] + 2 + k], slots[to[t] + k] = np.where(tail, p, c), v
    elif fmt in ("DRW", "DCL"):
        line, across = (r, c) if fmt == "DRW" else (c, r)
        has = np.bincount(t * SIDE + line, minlength=n * SIDE).reshape(n, SIDE) > 0
        place, filled = np.cumsum(has, 1) - 1, has.sum(1)
        at, codes, to, slots = room(filled + 1, filled * SIDE)
        tile, which = np.nonzero(has)
        codes[at[:-1]], codes[at[tile] + 1 + place[tile, which]] = filled - 1, which
        slots[to[t] + place[t, line] * SIDE + across] = v
    else:
        at, codes, to, slots = room(np.zeros(n, np.int64), np.full(n, SIDE * SIDE))
        slots[to[t] + p] = v
    return at, codes, to, slots


def places_of(fmt: str, at: np.ndarray, codes: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tile and the place of each of a format's value slots, by its codes; lists start as coded() says."""
    size = np.diff(to)
    t = np.repeat(np.arange(len(size)), size)
    k, first = np.arange(to[-1]) - to[t], at[t]
    if fmt == "DNS":
        return t, k
    if fmt == "COO":
        return t, codes[first + 1 + k]
    if fmt == "CSR":
        ends = codes[at[:-1, None] + np.arange(SIDE)]
        return t, ((ends[t] <= k[:, None]).sum(1) - 1) * SIDE + codes[first + SIDE + 1 + k]
    if fmt == "DRW":
        return t, codes[first + 1 + k // SIDE] * SIDE + k % SIDE
    if fmt == "DCL":
        return t, k % SIDE * SIDE + codes[first + 1 + k // SIDE]
    width = codes[first] + 1
    if fmt == "ELL":
        return t, k // width * SIDE + codes[first + 1 + k]
    return t, np.where(k < width * SIDE, k // width * SIDE, 0) + codes[first + 2 + k]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists, and all their values."""
    return column.value_lengths().to_numpy(zero_copy_only=False), column.flatten()


def _by_format(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for b in batches:
        fmt = b.column("fmt").to_numpy()
        for k in np.unique(fmt):
            yield int(k), b.take(pa.array(np.flatnonzero(fmt == k)))


def _entries_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of tile_values(): entries of each tile, places, values with nulls as 0, and which of those are null."""
    (z, p), (_, v) = _lists(b.column("places")), _lists(b.column("vals"))
    return z.astype(np.int64), p.to_numpy().astype(np.int64), v.fill_null(0.0).to_numpy(), ~v.is_valid().to_numpy(zero_copy_only=False)


def _list_array(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)


def encode_as(told: DataFrame) -> DataFrame:
    """(ti, tj, fmt, codes, slots) of tile_values() with the number `fmt` of a format beside each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in _by_format(batches):
            z, p, v, null = _entries_of(b)
            at, codes, to, slots = coded(B.FORMATS[k], z, p, v)
            # where slots are the entries, null ones stay
            made = pa.array(slots, mask=null) if null.any() and B.FORMATS[k] in ("COO", "CSR") else pa.array(slots)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("ti", "tj", "fmt")), _list_array(at, pa.array(codes)), _list_array(to, made)], names=["ti", "tj", "fmt", "codes", "slots"])

    kind = dict(told.dtypes)
    own = told.select("ti", "tj", F.col("fmt").cast("int").alias("fmt"), F.col("places").cast("array<int>").alias("places"), F.col("vals").cast("array<double>").alias("vals"))
    return own.mapInArrow(run, f"ti {kind['ti']}, tj {kind['tj']}, fmt int, codes array<int>, slots array<double>")


def slots_of_each(tiles: DataFrame) -> DataFrame:
    """(ti, tj, and a column for each format, in small letters): the slots that its encoder fills for each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z, p, v, _ = _entries_of(b)
                filled = [pa.array(np.diff(coded(n, z, p, v)[2]).astype(np.int32)) for n in B.FORMATS]
                yield pa.RecordBatch.from_arrays([b.column("ti"), b.column("tj"), *filled], names=["ti", "tj", *map(str.lower, B.FORMATS)])

    kind = dict(tiles.dtypes)
    own = tiles.select("ti", "tj", F.col("places").cast("array<int>").alias("places"), F.col("vals").cast("array<double>").alias("vals"))
    return own.mapInArrow(run, ", ".join([f"ti {kind['ti']}, tj {kind['tj']}", *(f"{n.lower()} int" for n in B.FORMATS)]))


def encode(tiles: DataFrame, fmt: str) -> DataFrame:
    """(ti, tj, codes, slots) of tile_values() in one format."""
    return encode_as(tiles.withColumn("fmt", F.lit(B.FORMATS.index(fmt)))).drop("fmt")


def encode_chosen(tiles: DataFrame, formats: DataFrame) -> DataFrame:
    """(ti, tj, fmt, codes, slots): each tile of tile_values() in the format (ti, tj, fmt) chosen for it."""
    return encode_as(tiles.join(formats.select("ti", "tj", "fmt"), ["ti", "tj"]))


def decode(encoded: DataFrame, fmt: str) -> DataFrame:
    """(ti, tj, place, v) of encode()'s codes and slots; padding and zeros are left out."""
    return decode_each(encoded.withColumn("fmt", F.lit(B.FORMATS.index(fmt)))).drop("fmt")


def decode_each(encoded: DataFrame) -> DataFrame:
    """(ti, tj, fmt, place, v) of encode_as()'s codes and slots; padding and zeros are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in _by_format(batches):
            (n, codes), (m, slots) = _lists(b.column("codes")), _lists(b.column("slots"))
            t, place = places_of(B.FORMATS[k], _starts(n), codes.to_numpy().astype(np.int64), _starts(m))
            v = slots.fill_null(0.0).to_numpy()
            kept = np.flatnonzero(v != 0)
            tile = pa.array(t[kept])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(tile) for c in ("ti", "tj", "fmt")), pa.array(place[kept].astype(np.int32)), pa.array(v[kept])], names=["ti", "tj", "fmt", "place", "v"])

    kind = dict(encoded.dtypes)
    own = encoded.select("ti", "tj", F.col("fmt").cast("int").alias("fmt"), "codes", "slots")
    return own.mapInArrow(run, f"ti {kind['ti']}, tj {kind['tj']}, fmt int, place int, v double")


def decoded(encoded: DataFrame) -> DataFrame:
    """(i, j, v) of encode_chosen()."""
    out = decode_each(encoded)
    return out.select((F.col("ti") * SIDE + _row(F.col("place"))).alias("i"), (F.col("tj") * SIDE + _col(F.col("place"))).alias("j"), "v")


def spmv(encoded: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) of A x for encoded tiles: a tile meets its 16 entries of x at once."""
    slices = M.vector_slices(x)
    e = decoded(encoded).select("i", B.tile_index("j").alias("tj"), B.local_index("j").cast("int").alias("lc"), "v")
    return e.join(slices, "tj").groupBy("i").agg(F.sum(F.col("v") * F.element_at("slice", F.col("lc") + 1)).alias("y"))


def spmm(encoded: DataFrame, b: DataFrame) -> DataFrame:
    """(i, c, y) of A B for encoded tiles and a dense B (j, c, b)."""
    return M.spmm(decoded(encoded), b)
