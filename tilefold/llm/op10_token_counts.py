"""Token counts by heap-and-linked-list byte-pair merging, with no ids emitted.

The symbols of a text are a doubly linked list. A heap holds every adjacent pair that forms a piece, keyed by rank
(best score first, then leftmost). Popping a pair that is still adjacent merges it and offers its two new
neighbours. The count is the initial symbols minus the merges; a character that is no piece counts as its UTF-8 bytes
(byte fallback). Merges cannot cross a place where no piece spans, so text is cut before each run of spaces and around
line ends, and counts of short runs are kept in a bounded table in each Python worker.

Cases: a null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows give repeated rows; an
empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilefold.llm import common as C

SPACE = "▁"
#: Entries of the table of counted runs in one Python worker.
TABLE = 1_000_000
LONGEST = 64
LIMIT = 4096
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


class Counter(dict):
    """Run of text -> number of tokens."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = [model.is_control, model.is_unknown, model.is_byte, model.is_unused]
        #: piece -> rank; equal scores tie, as the library has it.
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in range(model.vocab_size()) if not any(f(i) for f in odd)}
        inside = {c for p in self.rank for c in p if len(p) > 1}
        if inside - self.rank.keys():
            raise ValueError("a piece holds a character that is no piece: counts by symbols minus merges need all of them")
        cuts = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        line = "\n" if "\n" not in inside else ""
        self.run = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (f"|{line}" if line else "") if cuts else r"(?s).+")

    def __missing__(self, run: str) -> int:
        n = self.merged(run)
        if len(self) < TABLE and len(run) <= LONGEST:
            self[run] = n
        return n

    def merged(self, run: str) -> int:
        """Initial symbols minus merges of one run."""
        rank = self.rank
        piece: list[str | None] = list(run)
        n = sum(1 if c in rank else len(c.encode()) for c in piece)
        size = len(piece)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(rank[p], i, i + 1, len(p)) for i in range(size - 1) if (p := run[i : i + 2]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, j, length = heapq.heappop(heap)
            a, b = piece[i], piece[j]
            if a is None or b is None or len(a) + len(b) != length:
                continue  # one of the two has merged since
            piece[i], piece[j] = a + b, None
            n -= 1
            k = right[i] = right[j]
            if k < size:
                left[k] = i
                if (p := piece[i] + piece[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, k, len(p)))
            if (h := left[i]) >= 0 and (p := piece[h] + piece[i]) in rank:
                heapq.heappush(heap, (rank[p], h, i, len(p)))
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text: the dummy prefix and the model's normalisation come first."""
        if not text:
            return 0
        spelled = SPACE + text.replace(" ", SPACE)
        return sum(map(self.__getitem__, self.run.findall(spelled)))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, in one pass without a shuffle."""

    def make():
        c = counter(path)

        def rows(ids, texts):
            for i, t in zip(ids, texts):
                n = c.count(t)
                yield i, len(t.encode()), n, n > limit

        return rows

    return C.map_documents(docs, make, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", SCHEMA)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(C.documents(C.read(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
