"""Tile coordinates, bit masks of tile rows, packed nibbles, format sizes: column expressions without Python on the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 16
# fixed values: format names in the order of their ids
FORMATS = ("COO", "CSR", "ELL", "HYB", "DRW", "DCL", "DNS")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tile_index(c: Column | str) -> Column:
    return F.shiftright(col(c), 4)


def local_index(c: Column | str) -> Column:
    return col(c).bitwiseAND(F.lit(SIDE - 1)).cast("int")


def bit(c: Column | str) -> Column:
    """1 shifted by a local index. Spark's shiftleft takes only a literal count, SQL's takes a column."""
    return F.call_function("shiftleft", F.lit(1), col(c).cast("int"))


def row_masks(row: Column | str = "lr", column: Column | str = "lc") -> Column:
    """Aggregate: the 16 row masks of a tile as an array of integers. Four rows share a word of 64 bits while they are
    gathered, so a group holds four numbers."""
    r, c = col(row), col(column)
    own = F.call_function("shiftleft", F.lit(1).cast("bigint"), (r.bitwiseAND(F.lit(3)) * SIDE + c).cast("int"))
    words = [F.coalesce(F.bit_or(F.when(F.shiftright(r, 2) == k, own)), F.lit(0).cast("bigint")) for k in range(4)]
    return F.array(*(F.shiftright(words[k // 4], k % 4 * SIDE).bitwiseAND(F.lit(0xFFFF).cast("bigint")).cast("int") for k in range(SIDE)))


def _each(masks: Column | str) -> list[Column]:
    """The 16 masks as columns: expressions over them are compiled, those over an array's elements are interpreted."""
    return [F.element_at(col(masks), k + 1) for k in range(SIDE)]


def popcount(masks: Column | str) -> Column:
    """Set bits of 16 masks."""
    return reduce(lambda a, b: a + b, map(F.bit_count, _each(masks)))


def row_counts(masks: Column | str) -> Column:
    return F.transform(col(masks), F.bit_count)


def column_mask(masks: Column | str) -> Column:
    """Columns with a set bit in any row."""
    return F.aggregate(col(masks), F.lit(0), lambda a, x: a.bitwiseOR(x))


def has_bit(mask: Column | str, column: Column | str) -> Column:
    return F.call_function("getbit", col(mask), col(column).cast("int")) == 1


def rank_in_row(mask: Column | str, column: Column | str) -> Column:
    """Set bits before a set bit of a row; -1 if it is not set."""
    return F.when(has_bit(mask, column), F.bit_count(col(mask).bitwiseAND(bit(column) - 1))).otherwise(-1)


def rank_in_tile(masks: Column | str, row: Column | str, column: Column | str) -> Column:
    """Set bits before a set bit of a tile, row by row; -1 if it is not set."""
    before = F.aggregate(F.slice(col(masks), F.lit(1), col(row).cast("int")), F.lit(0), lambda a, x: a + F.bit_count(x))
    own = rank_in_row(F.element_at(col(masks), col(row).cast("int") + 1), column)
    return F.when(own >= 0, own + before).otherwise(-1)


def bits_string(masks: Column | str) -> Column:
    """256 characters 0 or 1, row by row, column 0 first."""
    return F.concat(*(F.reverse(F.lpad(F.bin(F.element_at(col(masks), k + 1)), SIDE, "0")) for k in range(SIDE)))


def masks_of_bits(bits: Column | str) -> Column:
    return F.array(*(F.conv(F.reverse(F.substring(col(bits), k * SIDE + 1, SIDE)), 2, 10).cast("int") for k in range(SIDE)))


def bits_of_hex(text: Column | str) -> Column:
    """A bit string of a hexadecimal string, four characters a digit."""
    return F.concat_ws("", F.transform(F.split(col(text), ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")))


def quadrant_bit(row: Column | str, column: Column | str) -> Column:
    """Place of an element in the layout of four 8x8 quadrants: 64 * quadrant + 8 * row + column within it."""
    r, c = col(row), col(column)
    return F.shiftright(r, 3) * 128 + F.shiftright(c, 3) * 64 + r.bitwiseAND(F.lit(7)) * 8 + c.bitwiseAND(F.lit(7))


def quadrants(masks: Column | str) -> Column:
    """The four words of 64 bits of the layout of quadrant_bit(), from row masks."""
    m = col(masks)
    half = lambda q, r: F.call_function("shiftright", F.element_at(m, q // 2 * 8 + r + 1), F.lit(q % 2 * 8)).bitwiseAND(F.lit(255)).cast("bigint")
    return F.array(*(reduce(lambda a, b: a.bitwiseOR(b), (F.call_function("shiftleft", half(q, r), F.lit(8 * r)) for r in range(8))) for q in range(4)))


def masks_of_quadrants(words: Column | str) -> Column:
    """The row masks of quadrants()."""
    w = col(words)
    half = lambda q, r: F.call_function("shiftright", F.element_at(w, q + 1), F.lit(8 * r)).bitwiseAND(F.lit(255).cast("bigint")).cast("int")
    return F.array(*(half(r // 8 * 2, r % 8).bitwiseOR(F.call_function("shiftleft", half(r // 8 * 2 + 1, r % 8), F.lit(8))) for r in range(SIDE)))


def pack_nibbles(values: Column | str) -> Column:
    """4-bit values, two a byte, the first in the high half."""
    v = col(values)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) + 1) / 2).cast("int") - 1), lambda k: F.shiftleft(F.element_at(v, k * 2 + 1), 4).bitwiseOR(F.coalesce(F.try_element_at(v, k * 2 + 2), F.lit(0))))


def nibble(packed: Column | str, k: Column | int) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    byte = F.element_at(col(packed), F.floor(k / 2).cast("int") + 1)
    return F.when(k % 2 == 0, F.shiftright(byte, 4)).otherwise(byte.bitwiseAND(F.lit(15)))


def _ceil_div(a: Column, n: int) -> Column:
    return F.floor((a + (n - 1)) / n).cast("int")


def format_sizes(z: Column, longest: Column, rows: Column, cols: Column, width: Column, tail: Column) -> dict[str, tuple[Column, Column]]:
    """Index bytes and value slots of each format from a tile's figures: elements, longest row, non-empty rows and
    columns, width of the regular part (least row length, at least 1) and elements beyond it."""
    return {
        "COO": (z + 1, z),
        "CSR": (_ceil_div(z * 4 + 136, 8), z),
        "ELL": (_ceil_div(longest * 64 + 4, 8), longest * SIDE),
        "HYB": (width * 8 + 2 + tail, width * SIDE + tail),
        "DRW": (_ceil_div(rows * 4 + 4, 8), rows * SIDE),
        "DCL": (_ceil_div(cols * 4 + 4, 8), cols * SIDE),
        "DNS": (F.lit(0), F.lit(SIDE * SIDE)),
    }


def stored_bytes(index_bytes: Column, slots: Column) -> Column:
    """Index bytes to a multiple of 16 and slots to a multiple of 2, at 8 bytes."""
    return (_ceil_div(index_bytes, 16) * 16 + _ceil_div(slots, 2) * 16).cast("bigint")


def tile_figures(masks: Column | str) -> dict[str, Column]:
    each = _each(masks)
    counts = [F.bit_count(m) for m in each]
    width = F.least(*(F.greatest(n, F.lit(1)) for n in counts))
    total = lambda terms: reduce(lambda a, b: a + b, terms)
    return {
        "z": total(counts),
        "longest": F.greatest(*counts),
        "rows": total((n > 0).cast("int") for n in counts),
        "cols": F.bit_count(reduce(lambda a, m: a.bitwiseOR(m), each)),
        "width": width,
        "tail": total(F.greatest(n - width, F.lit(0)) for n in counts),
    }
