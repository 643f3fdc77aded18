"""Quality rules by compression bands.

A text's zstandard ratio (compressed bytes to bytes) shows repetition when low and noise when high. Short texts
compress less, so the limits depend on length. The whole document must lie in its length's band, and of its fixed
chunks of 16 KiB (where it is longer than one) those outside theirs may hold at most a quarter of the bytes: that
finds long stretches of repetition or noise that the whole text's ratio averages away.

Base rules beside it count words, symbols, repeated lines and words in repeated 8-word windows.

Cases: a null or empty text has no words, fails the base rules and is not kept; repeated rows give repeated rows; a
null doc_id stays null; an empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilefold.llm import common as C

#: (bytes up to, least ratio, largest ratio). The largest ones stand between ordinary prose and noise, both measured on
#: windows of these lengths (README): about as high as 99 of 100 windows of licences and documentation where noise allows
#: it, below base64 from 129 bytes on, below random letters from 2,049 and below spaced hexadecimal digits from 8,193.
#: Shorter texts cannot be told from noise by their ratio.
BANDS = ((64, 0.0, 1.28), (128, 0.0, 1.13), (256, 0.35, 0.92), (512, 0.32, 0.82), (1024, 0.28, 0.765), (2048, 0.25, 0.715), (4096, 0.25, 0.59), (8192, 0.20, 0.585), (16384, 0.20, 0.525), (float("inf"), 0.20, 0.505))
CHUNK = 16 << 10
#: Share of a document's bytes that may stand in chunks outside their band.
OUTSIDE = 0.25
LEVEL = 3
WINDOW = 8
SYMBOL = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        m, w = np.uint64(0xD6E8FEB86659FD93), 1
        while w < window:  # the hash of 2w words from two hashes of w words
            h = (h[:-w] ^ h[:-w] >> np.uint64(31)) * m + h[w:]
            w *= 2
    order = np.argsort(h, kind="stable")
    equal = h[order[1:]] == h[order[:-1]]
    if not equal.any():
        return 0
    at = np.arange(window)
    a, b = order[:-1][equal], order[1:][equal]
    for k in range(0, len(a), 4096):  # equal hashes stand for equal windows only if the words are equal
        if not (ids[a[k : k + 4096, None] + at] == ids[b[k : k + 4096, None] + at]).all():
            return _repeated_exactly(ids, n, window)
    marks = np.zeros(len(words) + 1, np.int64)
    hit = np.unique(np.concatenate([a, b]))
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def _repeated_exactly(ids: np.ndarray, n: int, window: int) -> int:
    first: dict[bytes, int] = {}
    on = np.zeros(len(ids), bool)
    for i in range(n):
        j = first.setdefault(ids[i : i + window].tobytes(), i)
        if j != i:
            on[i : i + window] = on[j : j + window] = True
    return int(on.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


class Bands:
    def __init__(self, bands=BANDS, chunk: int = CHUNK, outside: float = OUTSIDE, level: int = LEVEL) -> None:
        import zstandard

        self.bands, self.chunk, self.outside = bands, chunk, outside
        self.compress = zstandard.ZstdCompressor(level=level).compress

    def fits(self, raw: bytes) -> bool:
        """Whether these bytes lie in the band of their length."""
        if not raw:
            return True
        ratio = len(self.compress(raw)) / len(raw)
        least, most = next((b[1], b[2]) for b in self.bands if len(raw) <= b[0])
        return least <= ratio <= most

    def keeps(self, raw: bytes) -> bool:
        if not self.fits(raw):
            return False
        if len(raw) <= self.chunk:
            return True
        chunks = [raw[k : k + self.chunk] for k in range(0, len(raw), self.chunk)]
        return sum(len(c) for c in chunks if not self.fits(c)) <= self.outside * len(raw)


SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def judge(docs: DataFrame, least_words: int = 20, repeat_percent: int = 30, bands=BANDS) -> DataFrame:
    """The base figures, their verdict and whether each document is kept; one pass without a shuffle."""

    def make():
        own = Bands(bands)

        def rows(ids, texts):
            for i, t in zip(ids, texts):
                raw = t.encode()
                words = raw.split()  # bytes split at ASCII spaces alone
                n, again = len(words), repeated_words(words)
                chars = len(t) - sum(map(t.count, " \t\n\r\x0b\x0c"))
                failed = n < least_words or 100 * again > repeat_percent * n
                yield i, n, chars, len(SYMBOL.findall(t)), repeated_lines(t), again, failed, not failed and own.keeps(raw)

        return rows

    return C.map_documents(docs, make, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean", SCHEMA)


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.documents(C.read(spark, sf_dir, "documents")))


QUERIES = {"op7_compression_bands": op7_compression_bands}
ORACLES: dict[str, str] = {}
