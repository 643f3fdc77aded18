"""Removal of repeated byte strings by bucket-pointer refinement.

Every byte that lies in a 50-byte string which also starts in a document with a smaller doc_id is removed. Whether two
positions start the same string is read off their suffix buckets: positions are put into buckets by the 8 bytes at
them, and buckets are refined by sorting on the bucket identifiers of later offsets, whose refined identifiers are
used again in the next step (8 and 8 give 16, 16 and 16 give 32, 32 and 16 and the last 8 give 50). Positions alone in
their bucket are finished and are not sorted again.

To let buckets be refined in many tasks, each 50-byte window goes with its anchor, the 20-byte string of least hash in
it: equal windows have equal anchors. Consecutive windows of one anchor are a unit. Units of an anchor that has but one
are the same by 128 bits of hash over their bytes, other units by their bytes.

1. Some MB of documents at a time send hashes of their distinct (anchor, unit) pairs, dealt by ranges of anchor hashes;
   documents and distinct units of each anchor are counted a range at a time. The outcome are bitmaps, sized by the
   length of all texts up to 2**30 cells, of anchors that stand in several documents (shared), that have several units
   (mixed) and that stand in more than HOT documents (hot). Cells that two anchors share by chance only cost time.
2. Units of shared anchors are dealt by anchor and sorted by unit and document; those that a smaller document of the
   same batch has too are known to go, and travel as merged runs. Of equal units all but the least document's lose
   their windows. Mixed units bring their bytes, once a batch, and the buckets of the windows of different units are
   refined, some MB at a time.
3. Units of a hot anchor would gather in one task: they are dealt by unit and document, each task keeps its least
   document's, those are compared by an aggregation, and the windows of what is left of mixed ones are grouped by their
   bytes, which Spark aggregates before it shuffles them.
4. Window runs found to start in a smaller document go back to their document, which is cut.

Cases: null doc_ids count as larger than all others and as equal to each other, so they lose what others have and take
nothing; null texts are empty; documents with one doc_id take nothing from each other; texts under 50 bytes lose
nothing; an empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.llm import common as C

LENGTH = 50
ANCHOR = 20
#: Bitmaps of shared, mixed and hot anchors: cells of the first by bytes of text and at most, and the others' share of it.
CELLS_PER_BYTE, MOST_CELLS, SHARES = 1 / 4, 1 << 30, (1, 4, 32)
#: Bytes of text of one range of anchor hashes, which a task counts at once: as few, up to MANY ranges, and as many.
RANGE, MANY = (8 << 20, 64 << 20), 1024
#: Documents of an anchor beyond which its units are dealt to several tasks.
HOT = 4096
#: Bytes of units whose buckets are refined at once, at least; a block ends where the key changes.
BLOCK = 1 << 20
#: Bytes of texts whose units are compared before they are sent, and of text that is hashed at once.
GATHERED, SLICE = 2 << 20, 1 << 19
NO_ID = (1 << 63) - 1
_POS = np.uint64((1 << 28) - 1)
_BASES, _MIX = (0x5851F42D4C957F2D, 0xDA942042E4DD58B5), (0x9E3779B97F4A7C15, 0xA24BAED4963EE407)


def words8(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as one big-endian integer."""
    if len(buf) < 8:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.as_strided(buf.view(np.uint8), (len(buf) - 7, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


def anchors(buf: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(first window, last window + 1, anchor hash) of each run of windows that have one anchor, leftmost of equal hashes; and two sums of 8-byte strings for unit_hashes()."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), [np.zeros(1, np.uint64)] * 2
    x = words8(buf)
    with np.errstate(over="ignore"):
        h = x[: -(k - 8)] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += x[8 : len(x) - (k - 16)]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h += x[k - 8 :]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    w, have = length - k + 1, 1
    while have < w:  # least of w from leasts of fewer
        step = min(have, w - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    at = (key & _POS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    with np.errstate(over="ignore"):
        mixed = h[at[first]] * np.uint64(0x9E3779B97F4A7C15)  # the least hashes crowd together: spread them
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
        sums = []
        for way, m in enumerate(_MIX):
            y = x * np.uint64(m)
            y ^= y >> np.uint64(32)
            y *= _powers(way, len(x))[0]
            sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(y)]))
    return first, np.append(first[1:], n), mixed, sums


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(way: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if way not in _kept or len(_kept[way][0]) < n:
        size, base = 1 << max(20, (n - 1).bit_length()), _BASES[way]
        with np.errstate(over="ignore"):
            _kept[way] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
    return tuple(x[:n] for x in _kept[way])


def unit_hashes(sums: list[np.ndarray], first: np.ndarray, end: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Two hashes of the bytes [first, end + length - 1) of each unit, wherever it stands."""
    stop, out = end + length - 1 - 7, []
    with np.errstate(over="ignore"):
        for way, total in enumerate(sums):
            u = (total[stop] - total[first]) * _powers(way, len(total))[1][first] + (end - first).astype(np.uint64)
            u ^= u >> np.uint64(32)
            u *= np.uint64(0xD6E8FEB86659FD93)
            out.append(u ^ u >> np.uint64(32))
    return out


class Batch:
    """Texts with the runs of windows of their anchors."""

    def __init__(self, texts: list[bytes]) -> None:
        self.parts = []  # (document, place in it, bytes)
        for d, t in enumerate(texts):
            if len(t) >= LENGTH:
                self.parts += [(d, a, t[a : a + SLICE + LENGTH - 1]) for a in range(0, len(t) - LENGTH + 1, SLICE)]

    def runs(self) -> Iterator[tuple]:
        """(bytes, first, end, anchor hash, two unit hashes, document, place of document) of the runs, some MB at a time."""
        at = 0
        while at < len(self.parts):
            stop, size = at, 0
            while stop < len(self.parts) and (stop == at or size + len(self.parts[stop][2]) <= SLICE):
                size += len(self.parts[stop][2])
                stop += 1
            some = self.parts[at:stop]
            at = stop
            raw = b"".join(p[2] for p in some)
            first, end, h, sums = anchors(np.frombuffer(raw, np.uint8))
            ends = np.cumsum([len(p[2]) for p in some])
            starts = ends - [len(p[2]) for p in some]
            # windows that cross from one part into the next are none: cut the runs at the parts' last windows
            cuts = ends - LENGTH + 1
            part = np.searchsorted(ends, first, "right")
            last = np.searchsorted(ends, end - 1, "right")
            on = part != last
            more = [(max(f, starts[q]), min(e, cuts[q]), x, q) for f, e, x, p, z in zip(first[on].tolist(), end[on].tolist(), h[on], part[on].tolist(), last[on].tolist()) for q in range(p, z + 1)]
            f, e, x, q = first[~on], np.minimum(end[~on], cuts[part[~on]]), h[~on], part[~on]
            if more:
                f, e, x, q = (np.concatenate([a, np.array(b, a.dtype)]) for a, b in zip((f, e, x, q), zip(*more)))
            ok = f < e
            q = q[ok]
            docs = np.array([p[0] for p in some])[q]
            offsets = np.array([p[1] for p in some])[q] - starts[q]
            yield raw, f[ok], e[ok], x[ok], *unit_hashes(sums, f[ok], e[ok]), docs, offsets


def place(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of a hash and its 32 bits within the range."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def sized(docs: DataFrame) -> tuple[int, list[int]]:
    """By the length of all texts: the number of ranges, and the cells of one range in each bitmap, whole bytes."""
    n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(1, min(MANY, -(-n // RANGE[0])), -(-n // RANGE[1]))
    cells = min(MOST_CELLS, max(1 << 16, int(n * CELLS_PER_BYTE)))
    return ranges, [max(8, cells // share // ranges // 8 * 8) for share in SHARES]


def cell(low: np.ndarray, cells: int) -> np.ndarray:
    return (low.astype(np.uint64) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


def _bytes(b: pa.RecordBatch) -> list[bytes]:
    return [t.encode() for t in b.column("text").to_pylist()]


def classed_anchors(docs: DataFrame, ranges: int, cells: list[int]) -> list[bytes]:
    """Three packed bitmaps, put together range by range: anchors in several documents, with several units, in more than HOT documents."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.gathered(batches, GATHERED):
            found = [(h, u, d) for _, _, _, h, u, _, d, _ in Batch(_bytes(b)).runs()]
            if not found:
                continue
            h, u, d = (np.concatenate(c) for c in zip(*found))
            u &= np.uint64((1 << 48) - 1)
            order = np.lexsort((d, u, h))
            h, u, d = h[order], u[order], d[order]
            pair = np.concatenate([[True], (h[1:] != h[:-1]) | (u[1:] != u[:-1])])
            document = pair | np.concatenate([[True], d[1:] != d[:-1]])
            first = np.flatnonzero(pair)
            n = np.minimum(np.add.reduceat(document.astype(np.int64), first), (1 << 16) - 1).astype(np.uint16)
            h, u = h[first], u[first]
            r, low = place(h, ranges)
            cuts = np.searchsorted(r, np.arange(ranges + 1))
            u_low, u_high = u.astype(np.uint32), (u >> np.uint64(32)).astype(np.uint16)
            rows = [(k, *(x[a:z].tobytes() for x in (low, u_low, u_high, n))) for k, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
            yield from C.record_batches(rows, pa.schema([("r", pa.int64()), *((c, pa.binary()) for c in ("low", "u_low", "u_high", "n"))]))

    def close(columns: list[list[bytes]]) -> list[bytes]:
        low, u_low, u_high, n = (np.frombuffer(b"".join(c), t) for c, t in zip(columns, (np.uint32, np.uint32, np.uint16, np.uint16)))
        u = u_low.astype(np.uint64) | u_high.astype(np.uint64) << np.uint64(32)
        order = np.argsort(low, kind="stable")
        low, u, n = low[order], u[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        documents = np.add.reduceat(n, first)
        several = np.maximum.reduceat(u, first) != np.minimum.reduceat(u, first)
        out = []
        for on, n_cells in zip((documents > 1, several & (documents > 1), documents > HOT), cells):
            bits = np.zeros(n_cells, bool)
            bits[cell(low[first[on]], n_cells)] = True
            out.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, held = pa.schema([("r", pa.int64()), *((c, pa.binary()) for c in ("shared", "mixed", "hot"))]), None, [[], [], [], []]
        for b in batches:
            for r, *columns in zip(*(c.to_pylist() for c in b.columns)):
                if r != now and held[0]:
                    yield from C.record_batches([(now, *close(held))], schema)
                    held = [[], [], [], []]
                now = r
                for into, x in zip(held, columns):
                    into.append(x)
        if held[0]:
            yield from C.record_batches([(now, *close(held))], schema)

    C.tune(docs.sparkSession)
    sent = docs.select("text").mapInArrow(emit, "r bigint, low binary, u_low binary, u_high binary, n binary")
    counted = sent.repartition(C.parts(docs.sparkSession), "r").sortWithinPartitions("r").mapInArrow(count, "r bigint, shared binary, mixed binary, hot binary")
    bitmaps = [np.zeros(ranges * c // 8, np.uint8) for c in cells]
    for row in counted.collect():  # one row a range; of bounded size together
        for into, c, packed in zip(bitmaps, cells, row[1:]):
            into[row["r"] * c // 8 : (row["r"] + 1) * c // 8] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return [zlib.compress(x.tobytes(), 1) for x in bitmaps]


def is_set(bitmap: np.ndarray, h: np.ndarray, ranges: int) -> np.ndarray:
    cells = len(bitmap) * 8 // ranges
    r, low = place(h, ranges)
    at = r * cells + cell(low, cells)
    return bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


KNOWN, SINGLE, MIXED, HOT_SINGLE, HOT_MIXED = range(5)
#: key and u: of mixed units the anchor's hash and the unit's, of others the unit's two hashes.
UNITS = pa.schema([*((c, pa.int64()) for c in ("key", "u", "doc_id", "th", "run")), ("kind", pa.int32()), ("unit", pa.binary())])
#: A run of windows in one number: its start times WIDEST and its length, which SLICE keeps below that.
WIDEST = 1 << 26
#: Tasks that the documents of one unit of a hot anchor are dealt to.
SALTS = 64


def _units(docs: DataFrame, bitmaps: list[bytes], ranges: int) -> DataFrame:
    """Units of shared anchors: where they stand and, of mixed ones, the bytes of one of each kind in a batch.

    Rows of kind KNOWN are merged runs that a smaller document of the batch is known to have.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, mixed, hot = (np.frombuffer(zlib.decompress(x), np.uint8) for x in sent.value)
        for b in C.gathered(batches, GATHERED):
            ids, ths = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
            raws, found = [], []
            for raw, f, e, h, u, u2, d, o in Batch(_bytes(b)).runs():
                on = is_set(shared, h, ranges)
                found.append([x[on] for x in (np.full(len(f), len(raws)), f, e, h, u, u2, d, o)])
                raws.append(raw)
            if not found:
                continue
            r, f, e, h, u, u2, d, o = (np.concatenate(c) for c in zip(*found))
            if not len(h):
                continue
            order = np.lexsort((ids[d], u2, u, h))
            r, f, e, h, u, u2, d, o = (x[order] for x in (r, f, e, h, u, u2, d, o))
            lead = np.concatenate([[True], (h[1:] != h[:-1]) | (u[1:] != u[:-1]) | (u2[1:] != u2[:-1])])
            known = ids[d] > ids[d[lead]][np.cumsum(lead) - 1]
            at = np.flatnonzero(known)
            at = at[np.argsort(d[at], kind="stable")]
            goes = []
            for own in np.split(at, np.flatnonzero(np.diff(d[at])) + 1) if len(at) else []:
                i, runs = d[own[0]], merged(np.stack([f[own] + o[own], e[own] + o[own]], 1))
                goes.append((np.full(len(runs), ids[i]), np.full(len(runs), ths[i]), runs[:, 0] * WIDEST + runs[:, 1] - runs[:, 0]))
            if goes:
                i, t, w = (np.concatenate(c) for c in zip(*goes))
                none = np.zeros(len(i), np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (t, none, i, t, w, none.astype(np.int32))), pa.nulls(len(i), pa.binary())], schema=UNITS)
            several, many = is_set(mixed, h, ranges), is_set(hot, h, ranges)
            bring = several & (lead | many)
            r, f, e, h, u, u2, d, o, several, many, bring = (x[~known] for x in (r, f, e, h, u, u2, d, o, several, many, bring))
            units = [raws[q][x : y + LENGTH - 1] if k else None for q, x, y, k in zip(r.tolist(), f.tolist(), e.tolist(), bring.tolist())]
            kind = np.where(several, np.where(many, HOT_MIXED, MIXED), np.where(many, HOT_SINGLE, SINGLE)).astype(np.int32)
            columns = [np.where(several, h, u2).view(np.int64), u.view(np.int64), ids[d], ths[d], (f + o) * WIDEST + (e - f), kind]
            whole = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(units, pa.binary())], schema=UNITS)
            yield from (whole.slice(k, 1 << 16) for k in range(0, whole.num_rows, 1 << 16))

    C.tune(docs.sparkSession)
    return docs.select("doc_id", "th", "text").mapInArrow(run, "key bigint, u bigint, doc_id bigint, th bigint, run bigint, kind int, unit binary")


def _dealt(units: DataFrame) -> DataFrame:
    """Units by key, those of hot anchors by unit and document, in order."""
    by = F.when(F.col("kind") >= HOT_SINGLE, F.xxhash64("key", "u", F.pmod("th", F.lit(SALTS)))).otherwise(F.col("key"))
    return units.repartition(C.parts(units.sparkSession), by).sortWithinPartitions("key", "u", "doc_id", F.col("unit").isNull())


def merged(runs: np.ndarray) -> np.ndarray:
    """Overlapping and touching (start, end) runs made one, in order."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    first = np.concatenate([[True], runs[1:, 0] > reach[:-1]])
    return np.stack([runs[first, 0], reach[np.append(np.flatnonzero(first)[1:] - 1, len(runs) - 1)]], 1)


def buckets(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the 50-byte strings at the given positions of buf: equal for equal strings, in byte order.

    Refinement on later offsets: 16 bytes from two identifiers of 8, 32 from two of 16, 50 from 32, 16 and the last 8.
    """
    x = words8(buf)
    _, ids = np.unique(x, return_inverse=True)
    pointed = np.zeros(len(ids), bool)  # where refined identifiers are asked for
    for offset in (0, 16, 32):
        pointed[at + offset] = True
    ids16 = _refine(ids, [8], np.flatnonzero(pointed), [ids])
    ids32 = _refine(ids16, [16], at, [ids16])
    return _refine(ids32, [32, 42], at, [ids16, ids])[at]


def _refine(ids: np.ndarray, offsets: list[int], at: np.ndarray, later: list[np.ndarray]) -> np.ndarray:
    """Split the buckets of the positions `at` by the identifiers at later offsets.

    A position's identifier is the number of positions in smaller buckets, so a bucket of one keeps its identifier and
    larger ones are numbered anew within their own span.
    """
    out = np.full(len(ids), -1, np.int64)
    own = ids[at]
    order = np.argsort(own, kind="stable")
    sizes = np.bincount(np.unique(own, return_inverse=True)[1]) if len(own) else np.zeros(0, np.int64)
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)  # first place of each one's bucket, in order
    alone = np.repeat(sizes == 1, sizes)
    out[at[order]] = base
    rest, start = order[~alone], base[~alone]
    if len(rest):
        keys = [np.where(at[rest] + o < len(p), p[np.minimum(at[rest] + o, len(p) - 1)], -1) for o, p in zip(offsets, later)]
        by = np.lexsort((*keys[::-1], start))
        changed = np.concatenate([[True], np.any([k[by][1:] != k[by][:-1] for k in (start, *keys)], axis=0)])
        spot = np.flatnonzero(changed)
        same = np.cumsum(changed) - 1
        first = np.concatenate([[True], start[by][1:] != start[by][:-1]])
        span = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        out[at[rest[by]]] = start[by] + (spot[same] - span)
    return out


def _repeats(units: list[tuple[bytes, int, list[tuple[int, int]]]]) -> Iterator[tuple[int, int, int]]:
    """(doc_id, th, run) of windows that start in a smaller document; units are (bytes, least doc_id, its (th, start) places), each once."""
    if len(units) < 2:
        return
    sizes = np.array([len(t) for t, _, _ in units])
    starts = np.cumsum(sizes) - sizes
    n = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(units)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + starts[owner]
    found = buckets(np.frombuffer(b"".join(t for t, _, _ in units), np.uint8), at)
    doc = np.array([i for _, i, _ in units], np.int64)[owner]
    order = np.argsort(found, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], found[order][1:] != found[order][:-1]]))
    lowest = np.empty(len(found), np.int64)
    lowest[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
    on = lowest < doc
    spots = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (on[1:] != on[:-1])]))
    stops = np.append(spots[1:], len(on))
    for s, z in zip(spots[on[spots]].tolist(), stops[on[spots]].tolist()):
        w = owner[s]
        for th, start in units[w][2]:
            yield int(doc[s]), th, (start + int(at[s] - starts[w])) * WIDEST + z - s


RUNS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("run", pa.int64())])
OPEN = pa.schema([*RUNS, ("key", pa.int64()), ("u", pa.int64()), ("unit", pa.binary())])


def _refined(units: DataFrame) -> DataFrame:
    """Window runs that start in a smaller document, and (with a key) the units of hot anchors still to be compared with
    those of other tasks; from units as _dealt."""

    def gone(rows) -> Iterator[pa.RecordBatch]:
        for b in C.record_batches(rows, RUNS):
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(b.num_rows, f.type) for f in list(OPEN)[3:])], schema=OPEN)

    def taken(b: pa.RecordBatch, on: np.ndarray, columns: int) -> pa.RecordBatch:
        some = b.filter(pa.array(on))
        return pa.RecordBatch.from_arrays([some.column(f.name) if k < columns else pa.nulls(some.num_rows, f.type) for k, f in enumerate(OPEN)], schema=OPEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes, int], tuple[bytes, int, list[tuple[int, int]]]] = {}
        size, now, last = 0, None, None  # last: the row that leads the group that a batch may cut
        for b in batches:
            known = b.column("kind").to_numpy(zero_copy_only=False) == KNOWN
            if known.any():
                yield taken(b, known, 3)
                b = b.filter(pa.array(~known))
            if not b.num_rows:
                continue
            if last is not None:
                b = pa.concat_batches([last, b])
            key, u, doc, th, where, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "u", "doc_id", "th", "run", "kind"))
            lead = np.concatenate([[True], (key[1:] != key[:-1]) | (u[1:] != u[:-1])])
            leader = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            other = pc.fill_null(pc.not_equal(b.column("unit"), b.column("unit").take(pa.array(leader))), False).to_numpy(zero_copy_only=False)  # equal hashes, other bytes
            fresh = np.ones(len(key), bool)
            fresh[: last is not None] = False
            last = b.slice(leader[-1], 1)
            on = (doc > doc[leader]) & ~other & fresh
            yield taken(b, on, 3)
            rest = ~on & fresh
            hot = (kind >= HOT_SINGLE) & rest
            if hot.any():
                yield taken(b, hot, len(OPEN))
            several = np.flatnonzero((kind == MIXED) & rest)
            bytes_ = pc.coalesce(b.column("unit"), b.column("unit").take(pa.array(leader))).take(pa.array(several)).to_pylist()
            for k, i, t, w, unit in zip(*(x[several].tolist() for x in (key, doc, th, where)), bytes_):
                if (k, unit, i) not in held:
                    if size >= BLOCK and k != now:
                        yield from gone(_repeats(list(held.values())))
                        held, size = {}, 0
                    held[k, unit, i] = (unit, i, [])
                    size += len(unit)
                now = k
                held[k, unit, i][2].append((t, w // WIDEST))
        yield from gone(_repeats(list(held.values())))

    return units.mapInArrow(run, "doc_id bigint, th bigint, run bigint, key bigint, u bigint, unit binary")


def _hot_runs(left: DataFrame) -> DataFrame:
    """Window runs that start in a smaller document, of the units of hot anchors that their tasks left."""
    left = left.withColumn("bytes", F.coalesce("unit", F.lit(b"")))
    named = left.groupBy("key", "u", "bytes").agg(F.min("doc_id").alias("least"))
    units = left.join(named, ["key", "u", "bytes"])
    width = F.lit(WIDEST)
    places = units.where("doc_id = least and unit is not null").select("doc_id", "th", F.expr(f"run div {WIDEST}").alias("start"), "unit", F.explode(F.sequence(F.lit(0), F.length("unit") - LENGTH)).alias("w"))
    windows = places.select("doc_id", "th", ((F.col("start") + F.col("w")) * width + 1).alias("run"), F.substring("unit", F.col("w") + 1, F.lit(LENGTH)).alias("window"))
    lowest = windows.groupBy("window").agg(F.min("doc_id").alias("least"))
    return units.where("doc_id > least").select("doc_id", "th", "run").unionByName(windows.join(lowest, "window").where("doc_id > least").select("doc_id", "th", "run"))


CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def spans(runs: list[int] | None) -> np.ndarray:
    """Maximal removed (start, end) byte spans of window runs."""
    if not runs:
        return np.zeros((0, 2), np.int64)
    start, n = np.divmod(np.array(runs, np.int64), WIDEST)
    return merged(np.stack([start, start + n + LENGTH - 1], 1))


def kept(raw: bytes, cut: np.ndarray) -> bytes:
    out, at = [], 0
    for s, e in cut.tolist():
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def _packed(docs: DataFrame) -> DataFrame:
    """The texts compressed, to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([compress(t) for t in _bytes(b)], pa.binary())], names=["doc_id", "th", "packed"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id bigint, th bigint, packed binary")


def with_runs(docs: DataFrame) -> DataFrame:
    """doc_id, packed (the text's bytes by zstandard) and the window runs that start in a smaller document."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    ranges, cells = sized(keyed)
    units = _units(keyed, classed_anchors(keyed, ranges, cells), ranges)
    found, _ = C.stage(_refined(_dealt(units)), "runs")
    runs = found.where("key is null").select("doc_id", "th", "run").unionByName(_hot_runs(found.where("key is not null")))
    by_document = runs.groupBy("doc_id", "th").agg(F.collect_list("run").alias("runs"))
    return _packed(keyed).join(by_document, ["doc_id", "th"], "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "packed", "runs")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def rows(b):
            for i, packed, runs in zip(*(c.to_pylist() for c in b.columns)):
                raw, cut = unpack(packed), spans(runs)
                yield i, len(raw), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), hashlib.sha256(kept(raw, cut)).hexdigest()

        for b in batches:
            yield from C.record_batches(rows(b), CUT)

    return with_runs(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(C.documents(C.read(spark, sf_dir, "documents")))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
