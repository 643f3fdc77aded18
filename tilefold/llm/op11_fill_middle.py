"""Fill-in-middle transformation: cut places from a wavelet matrix over character classes.

The characters of a text fall into classes, and a wavelet matrix holds the sequence of classes: one bit vector a class
bit, each with the counts of ones before every block of bits. rank(c, i), the number of characters of class c before
place i, is one step a level; select(c, u) is the way back up. Units of text are counted from ranks: lines end after
each line break and at the end of the text; words start at each character of class WORD (the first of a word). So the
boundary after u units is a select (lines), or is found by bisection on a sum of ranks where several classes end a unit
(lines or sentences). A document is then cut at two boundaries into prefix, middle and suffix, and written in the order
that a hash of its id names: psm, spm, or plain.

One pass without a shuffle; a text's matrix takes two bits a character and some counts, and lives as long as its row.

Cases: a null or empty text has no units and stays plain, as does one that contains a marker; a null doc_id is hashed as
no digits and stays null; repeated rows give repeated rows; an empty table gives an empty result; further columns are
ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilefold.llm import common as C

# fixed values: markers of prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 documents so many are transformed, and of 100 of those so many are written suffix first.
TRANSFORMED, SUFFIX_FIRST = 100, 50

OTHER, BREAK, STOP, WORD = range(4)
#: Bits of a block with one count before it.
BLOCK = 512


class BitVector:
    """Bits with the number of ones before each block."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        blocks = -(-self.n // BLOCK)
        self.bytes = np.packbits(np.concatenate([bits, np.zeros(blocks * BLOCK - self.n, bits.dtype)]))
        ones = np.bitwise_count(self.bytes.view(np.uint64)).reshape(blocks, BLOCK // 64).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.ones = int(self.before[-1])

    def rank(self, bit: int, i: int) -> int:
        """Bits of this kind before place i."""
        block, rest = divmod(i, BLOCK)
        one = int(self.before[block])
        if rest:
            start = block * BLOCK // 8
            whole, odd = divmod(rest, 8)
            one += int(np.bitwise_count(self.bytes[start : start + whole]).sum())
            if odd:
                one += (int(self.bytes[start + whole]) >> (8 - odd)).bit_count()
        return one if bit else i - one

    def select(self, bit: int, u: int) -> int:
        """Place of the u-th bit of this kind, from 0 on; there is one."""
        before = self.before if bit else np.arange(len(self.before)) * BLOCK - self.before
        block = int(np.searchsorted(before, u, side="right")) - 1
        start = block * BLOCK // 8
        own = np.unpackbits(self.bytes[start : start + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(own == bit)[u - int(before[block])])


class WaveletMatrix:
    """A sequence of small numbers: for each bit of them, from the highest on, the bits of the sequence, which is then
    parted by that bit, zeros first."""

    def __init__(self, values: np.ndarray, bits: int = 2) -> None:
        self.n, self.levels = len(values), []
        for k in range(bits - 1, -1, -1):
            own = (values >> k) & 1
            level = BitVector(own)
            self.levels.append((k, level, self.n - level.ones))
            values = np.concatenate([values[own == 0], values[own == 1]])

    def _start(self, value: int) -> int:
        """Where the last level's run of a value begins."""
        i = 0
        for k, level, zeros in self.levels:
            bit = value >> k & 1
            i = level.rank(bit, i) + (zeros if bit else 0)
        return i

    def rank(self, value: int, i: int) -> int:
        """How often a value occurs before place i."""
        first = 0
        for k, level, zeros in self.levels:
            bit = value >> k & 1
            first, i = level.rank(bit, first), level.rank(bit, i)
            if bit:
                first, i = first + zeros, i + zeros
        return i - first

    def select(self, value: int, u: int) -> int:
        """Place of the u-th occurrence of a value, from 0 on; there is one."""
        i = self._start(value) + u
        for k, level, zeros in reversed(self.levels):
            bit = value >> k & 1
            i = level.select(bit, i - zeros if bit else i)
        return i


def classes(text: str) -> np.ndarray:
    """The class of each code point: line break, end of a sentence, first character of a word, or other."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    out = np.zeros(len(code), np.uint8)
    out[~space & np.concatenate([[True], space[:-1]])] = WORD
    stop, end = (code == 46) | (code == 33) | (code == 63) | (code == 0x3002), code == 10
    inside = np.concatenate([stop[1:] | end[1:], [False]])[: len(code)]  # the last stop of a run counts, unless a line ends there
    out[stop & ~inside & (out == OTHER)] = STOP
    out[end] = BREAK
    return out


class Units:
    """Boundaries of a text's units: how many there are before a place, and the place after so many."""

    def __init__(self, text: str, unit: str = "line") -> None:
        kinds = {"line": (BREAK,), "sentence": (BREAK, STOP), "word": (WORD,)}
        self.matrix, self.kinds, self.n_chars, self.starts = WaveletMatrix(classes(text)), kinds[unit], len(text), unit == "word"
        closed = self.n_chars == 0 or (not self.starts and self.count(self.n_chars) > self.count(self.n_chars - 1))
        #: A text that does not end with a boundary has one more unit, its rest.
        self.n = self.count(self.n_chars) + (0 if closed or self.starts else 1)

    def count(self, i: int) -> int:
        """Boundary characters before place i: the sum of their classes' ranks."""
        return sum(self.matrix.rank(c, i) for c in self.kinds)

    def end(self, u: int) -> int:
        """The place after the first u units. A word reaches up to the next one, the first one from the text's start."""
        if u == 0:
            return 0
        if u >= self.n:
            return self.n_chars
        nth = u if self.starts else u - 1
        if len(self.kinds) == 1:
            return self.matrix.select(self.kinds[0], nth) + (0 if self.starts else 1)
        low, high = 0, self.n_chars  # the least place with u boundary characters before it
        while low < high:
            middle = (low + high) // 2
            if self.count(middle) >= u:
                high = middle
            else:
                low = middle + 1
        return low


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits by document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(doc_id: int | None, text: str, unit: str = "line", seed: int = SEED) -> tuple[int, str, tuple[str, str, str]]:
    """Number of units, form, and prefix, middle and suffix of a text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    units = Units(text, unit)
    a, b = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= TRANSFORMED:
        return units.n, "plain", (text, "", "")
    i, j = units.end(a), units.end(b)
    return units.n, "spm" if h4 % 100 < SUFFIX_FIRST else "psm", (text[:i], text[i:j], text[j:])


def written(form: str, parts: tuple[str, str, str]) -> str:
    prefix, middle, suffix = parts
    if form == "plain":
        return prefix
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(form: str, output: str) -> str:
    """The text that was transformed. Its parts hold no marker, and a marker begins with a sign that it holds once, so the
    markers found are those written."""
    if form == "plain":
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    first, rest = output[len(order[0]) :].split(order[1], 1)
    second, middle = rest.split(order[2], 1)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_SPARK = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_DIGESTS = pa.schema([*list(_SCHEMA)[:-1], ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def _rows(unit: str, seed: int):
    def rows(ids: Iterable[int | None], texts: Iterable[str]) -> Iterable[tuple]:
        for i, t in zip(ids, texts):
            n, form, parts = cut(i, t, unit, seed)
            sizes = (None, None) if form == "plain" else (len(parts[0]), len(parts[1]))
            yield i, n, form, *sizes, written(form, parts)

    return rows


def transform(docs: DataFrame, unit: str = "line", seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output of each document; units are lines, sentences or words."""
    return C.map_documents(docs, lambda: _rows(unit, seed), _SPARK, _SCHEMA)


def digests(docs: DataFrame, unit: str = "line", seed: int = SEED) -> DataFrame:
    """transform() with the digests of output and restored text in place of the output, which then never leaves its task."""

    def make():
        made, sha = _rows(unit, seed), lambda s: hashlib.sha256(s.encode()).hexdigest()

        def rows(ids, texts):
            for *found, output in made(ids, texts):
                yield *found, sha(output), sha(restored(found[2], output))

        return rows

    return C.map_documents(docs, make, _SPARK.replace("output", "output_sha256") + ", restored_sha256 string", _DIGESTS)


def restore(rows: DataFrame) -> DataFrame:
    """(doc_id, text) from doc_id, form and output."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            made = [restored(f, o) for f, o in zip(b.column("form").to_pylist(), b.column("output").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.string())], schema=schema)

    C.tune(rows.sparkSession)
    return rows.select("doc_id", "form", "output").mapInArrow(run, "doc_id bigint, text string")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.documents(C.read(spark, sf_dir, "documents")))


_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS d FROM t),
  n AS (SELECT *, CAST(len(lines) AS BIGINT) AS n FROM u),
  c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
  p AS (SELECT doc_id, n, form, text, array_to_string(list_slice(lines, 1, a), '') AS p, array_to_string(list_slice(lines, a + 1, b), '') AS m, array_to_string(list_slice(lines, b + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN text ELSE p || m || s END) AS restored_sha256 FROM p"""

QUERIES = {"op11_fill_middle": op11_fill_middle}
ORACLES: dict[str, str] = {"op11_fill_middle": _SQL}
