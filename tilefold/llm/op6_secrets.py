"""Secret scans by grammar inference.

Three patterns find plain secrets (the base spans). Their values are labelled credentials, from which one
probabilistic automaton a kind is inferred: the prefix tree of the values, spelled in character classes, is folded by
merging states whose transition and end frequencies are statistically compatible (Hoeffding's bound). Merging forgets
how long the values are, so an automaton keeps their lengths beside its states. Every run of 12 credential characters or
more that base spans do not cover is a candidate, and so are its pieces beside such spans; a candidate's mean log-likelihood a character under the best automaton, less that under a
model of ordinary candidates, is its score, and those that score as nearly all labelled credentials do become spans too.

The texts are read once: base spans and candidates are staged (a few short strings a document), the automata are
learned from a bounded sample of distinct values (SAMPLE a kind and LONGEST characters of them together, the least hashes), the model of ordinary candidates is
of all of them (their pairs of character classes are counted), and the staged rows are scored.

Cases: a null or empty text has no spans, and the hash of the empty string; with no labelled credentials there are no
automata and no further spans; repeated rows give repeated rows; a null doc_id stays null; an empty table gives an
empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilefold.llm import common as C

# fixed values: the kinds in their order, their patterns and the least length of what counts
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
LEAST_CANDIDATE = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_CANDIDATE},}}")
#: Signs that part a credential from what stands beside it in a run.
PARTING = "+/_.=-"
LEARNED = "learned"
BESIDE = "beside"
#: Labelled credentials of each kind that are learned from at most, and their characters together.
SAMPLE, LONGEST = 1000, 1 << 22
#: Depth of the prefix tree; a state there returns to itself.
DEPTH = 64
#: Of the merge test, the smoothing, the share of labelled credentials that may score below the threshold.
ALPHA, UNSEEN, MISSED = 0.01, 1e-4, 0.02
#: Share of the lengths' probability that goes to lengths not seen.
OTHER_LENGTHS = 0.1
#: Nats a character by which a candidate must at least fit a format better than ordinary text.
MARGIN = 0.5

_CLASS = {c: k for k, chars in {"a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ", "0": "0123456789"}.items() for c in chars}
_WITHIN = {"a": math.log(6), "g": math.log(20), "A": math.log(6), "G": math.log(20), "0": math.log(10)}
END = "$"
_LEAST = math.log(UNSEEN)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns, by start and then kind."""
    out = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str | None, str]]:
    """(start, end, None, value) of runs of 12 or more credential characters clear of base spans, by start. A run that
    such spans touch but do not cover is a candidate of kind BESIDE, as is each piece of it beside them that has 12
    characters without the signs that part it from the span."""
    out, at, reach = [], 0, 0  # reach: how far base spans that start before the run's end go
    for m in CANDIDATE.finditer(text):
        start, cuts = m.start(), [(m.start(), min(reach, m.end()))] if reach > m.start() else []
        while at < len(base) and base[at][0] < m.end():
            s, e = max(base[at][0], start), base[at][1]
            at += 1
            if e > start and e > reach:
                cuts.append((max(s, reach), min(e, m.end())))
            reach = max(reach, e)
        if not cuts:
            out.append((start, m.end(), None, m[0]))
            continue
        if sum(e - s for s, e in cuts) == m.end() - start:
            continue
        out.append((start, m.end(), BESIDE, m[0]))
        ends = [start, *(x for c in cuts for x in c), m.end()]
        for k in range(0, len(ends), 2):
            s, e = ends[k], ends[k + 1]
            while k and s < e and text[s] in PARTING:
                s += 1
            while k + 2 < len(ends) and e > s and text[e - 1] in PARTING:
                e -= 1
            if e - s >= LEAST_CANDIDATE:
                out.append((s, e, BESIDE, text[s:e]))
    return out


def spelled(value: str) -> str:
    return "".join(_CLASS.get(c, c) for c in value)


class Automaton:
    """States with counts of arrivals, ends and transitions, learned by folding a prefix tree, and the values' lengths."""

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for v in values:
            s = 0
            for depth, c in enumerate(spelled(v)):
                self.count[s][c] += 1
                if c not in self.next[s]:
                    if depth < DEPTH:
                        self.next[s][c] = len(self.next)
                        self.next.append({})
                        self.count.append(Counter())
                    else:
                        self.next[s][c] = s
                s = self.next[s][c]
            self.count[s][END] += 1
        self.alpha = alpha
        self._fold()
        self.log = [{c: math.log(k / t) for c, k in n.items() if c != END} if (t := n.total() - n[END]) else {} for n in self.count]
        self.lengths, self.mean, self.n = Counter(map(len, values)), sum(map(len, values)) / max(1, len(values)), max(1, len(values))

    def _differ(self, a: int, b: int) -> bool:
        x, y = self.count[a], self.count[b]
        n, m = x.total(), y.total()
        if not n or not m:
            return False
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(x[c] / n - y[c] / m) > bound for c in x.keys() | y.keys())

    def _compatible(self, a: int, b: int) -> bool:
        """Whether what is reached from a and the tree below b agree everywhere."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(a, b):
                return False
            todo += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a] and t != b]
        return True

    def _merge(self, a: int, b: int) -> None:
        """Add the tree below b to what is reached from a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a].update(self.count[b])
            for c, t in self.next[b].items():
                if t == b:
                    self.next[a].setdefault(c, a)
                elif c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _fold(self) -> None:
        """Each child of a final state is merged with the first final state it is compatible with, or becomes final itself.

        A merge can give children to states already looked at, so these are looked at again until none has an open child.
        """
        final = {0: None}  # in order
        while True:
            found = next(((s, c) for s in final for c in sorted(self.next[s]) if self.next[s][c] not in final), None)
            if found is None:
                break
            s, c = found
            child = self.next[s][c]
            same = next((r for r in final if self._compatible(r, child)), None)
            if same is None:
                final[child] = None
            else:
                self.next[s][c] = same
                self._merge(same, child)
        place = {s: i for i, s in enumerate(final)}
        self.count = [self.count[s] for s in final]
        self.next = [{c: place[t] for c, t in self.next[s].items()} for s in final]

    def _length(self, n: int) -> float:
        other = math.exp(-n / self.mean) * (math.exp(1 / self.mean) - 1)
        return math.log((1 - OTHER_LENGTHS) * self.lengths[n] / self.n + OTHER_LENGTHS * other)

    def likelihood(self, value: str) -> float:
        """Natural log of the probability of the whole string: of its length, and of each character after those before it."""
        s, total = 0, self._length(len(value))
        for c in spelled(value):
            total += self.log[s].get(c, _LEAST) - _WITHIN.get(c, 0.0)
            s = self.next[s].get(c, 0)
        return total


class Ordinary:
    """Smoothed pairs of character classes of ordinary candidates, from how often each occurs."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        pairs: dict[str, Counter] = defaultdict(Counter)
        for (a, b), n in counts.items():
            pairs[a][b] += n
        symbols = [*"agAG0+/_.=-", END]
        self.log = {a: {b: math.log((pairs[a][b] + 1) / (sum(pairs[a].values()) + len(symbols))) for b in symbols} for a in symbols}

    def likelihood(self, value: str) -> float:
        s = END + spelled(value) + END
        return sum(self.log[a][b] - _WITHIN.get(b, 0.0) for a, b in zip(s, s[1:]))


class Formats:
    """The automata of the kinds with their thresholds."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: dict[tuple[str, str], int]) -> None:
        self.ordinary = Ordinary(ordinary)
        self.automata = {k: Automaton(v) for k, v in labelled.items() if v}
        self.least = {k: max(MARGIN, float(np.quantile([self._score(a, v) for v in labelled[k]], MISSED))) for k, a in self.automata.items()}

    def _score(self, automaton: Automaton, value: str) -> float:
        return (automaton.likelihood(value) - self.ordinary.likelihood(value)) / (len(value) + 1)

    def fits(self, value: str) -> bool:
        return any(self._score(a, value) >= self.least[k] for k, a in self.automata.items())

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans of a text: base ones, then candidates that fit a format, by start."""
        base = base_spans(text)
        return sorted([s[:3] for s in base] + [(s, e, LEARNED) for s, e, _, v in candidates(text, base) if self.fits(v)], key=lambda s: (s[0], (*KINDS, LEARNED).index(s[2])))


FOUND = pa.schema([("doc_id", pa.int64()), ("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])
FOUND_SQL = "doc_id bigint, kinds array<string>, starts array<bigint>, ends array<bigint>, texts array<string>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id with the base spans and the candidates (kind null or BESIDE) of every whole text."""

    def make():
        def rows(ids, texts):
            for i, t in zip(ids, texts):
                base = base_spans(t)
                found = base + candidates(t, base)
                yield i, [f[2] for f in found], [f[0] for f in found], [f[1] for f in found], [f[3] for f in found]

        return rows

    return C.map_documents(docs, make, FOUND_SQL, FOUND)


PAIRS = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def class_pairs(found: DataFrame) -> dict[tuple[str, str], int]:
    """How often each pair of character classes occurs in all candidates that are clear of base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for kinds, texts in zip(b.column("kinds").to_pylist(), b.column("texts").to_pylist()):
                for k, v in zip(kinds, texts):
                    if k is None:
                        s = END + spelled(v) + END
                        n.update(zip(s, s[1:]))
        yield from C.record_batches(((*p, c) for p, c in n.items()), PAIRS)

    counts = found.select("kinds", "texts").mapInArrow(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r["a"], r["b"]): r["n"] for r in counts.collect()}


def learn(found: DataFrame) -> Formats:
    """Automata from at most SAMPLE distinct values of each kind, the least by hash, and the ordinary model of all candidates."""
    values = found.select(F.explode(F.arrays_zip("kinds", "texts")).alias("f")).select(F.col("f.kinds").alias("kind"), F.col("f.texts").alias("value"))

    def some(kind: str) -> list[str]:
        own = values.where(F.col("kind") == kind).select("value").distinct()
        order = [F.xxhash64("value"), F.col("value")]
        few = own.orderBy(*order).limit(SAMPLE)
        so_far = F.sum(F.length("value")).over(Window.orderBy(*order))  # over SAMPLE rows
        return [r["value"] for r in few.withColumn("so_far", so_far).where(F.col("so_far") <= LONGEST).orderBy(*order).select("value").collect()]

    return Formats({k: some(k) for k in KINDS}, class_pairs(found))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(found: DataFrame, formats: Formats) -> DataFrame:
    """Counts, the hash of the base spans and all spans of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b):
            for i, kinds, starts, ends, texts in zip(*(c.to_pylist() for c in b.columns)):
                spans = [(s, e, k if k in KINDS else LEARNED) for k, s, e, v in zip(kinds, starts, ends, texts) if k in KINDS or formats.fits(v)]
                spans.sort(key=lambda s: (s[0], (*KINDS, LEARNED).index(s[2])))
                said = [f"{k}:{s}:{e}" for s, e, k in spans if k != LEARNED]
                n = Counter(k for _, _, k in spans)
                yield i, *(n[k] for k in KINDS), hashlib.sha256(",".join(said).encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, e, k in spans)

        for b in batches:
            yield from C.record_batches(rows(b), RESULT)

    return found.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redacted(text: str, formats: Formats, mark: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    for s, e, _ in formats.spans(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = None) -> DataFrame:
    """All rows and columns, with secrets in the text replaced (and its length in n_chars_col brought up to date); null texts stay null."""
    found, path = C.stage(find(C.documents(docs.select(F.lit(0).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))), "secrets")
    formats = learn(found)
    C.remove(docs.sparkSession, path)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redacted(t, formats))

    C.tune(docs.sparkSession)
    out = docs.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType)) if n_chars_col else out


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = C.stage(find(C.documents(C.read(spark, sf_dir, "documents"))), "secrets")
    return scan(found, learn(found))


QUERIES = {"op6_secrets": op6_secrets}
ORACLES: dict[str, str] = {}
