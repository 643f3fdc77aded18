"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows with label 1, the rest of the web text is unlabelled, and the class prior is
estimated from the labelled rows. A small model over features of the text alone minimises the non-negative unbiased
risk: prior * R(positives, 1) + max(0, R(unlabelled, 0) - prior * R(positives, 0)); where the bracket turns
negative, its gradient is taken backwards, so the model does not overfit the positives.

Labels are learned only from rows whose crc32(doc_id as text) modulo 5 is not 0; the others are held out. Fitting takes
at most SAMPLE positives and SAMPLE unlabelled documents, those of the least hash of doc_id. The prior counts all
labelled training rows. Scoring is one pass over the whole texts, without a shuffle.

Cases: a null or empty text is scored like any other (all features 0); a null doc_id counts as held out; without
positives among the training rows every score is 0.5; if all training documents are labelled they are the unlabelled
sample too, their labels unseen; a doc_id with several texts is fitted on one of them; repeated rows give repeated rows; an empty table gives an empty result; further columns
are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.llm import common as C

#: Rows of either kind that the model is fitted on at most.
SAMPLE = 8000
THRESHOLD = 0.3
HELD_OUT = 5
HASHED = 64
#: Of the fit.
STEPS, RATE, DECAY, SEED, HIDDEN = 800, 0.02, 1e-4, 8, 24
_MARKS = "#*$%&|<>!?.,;:\"'()[]{}/\\_=+-~@^`"
_DROP_MARKS = bytes(_MARKS, "ascii")
_RUNS = re.compile(rb"[#*$%&|<>!?=_~^-]{2,}")
N_FEATURES = 14 + len(_MARKS) + HASHED


def features(text: str) -> np.ndarray:
    """Figures of one whole text: lengths, repetition, case, marks, and hashed byte pairs."""
    out = np.zeros(N_FEATURES, np.float32)
    raw = text.encode()
    n = len(raw)
    if not n:
        return out
    words = raw.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    data = np.frombuffer(raw, np.uint8)
    hist = np.bincount(data, minlength=256)
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum()))
    most = counts.most_common(1)[0][1] if counts else 0
    out[:14] = (
        1.0,
        np.log1p(n) / 10,
        np.log1p(m) / 10,
        min(4.0, n / m / 10),
        len(counts) / m,
        most / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        hist[65:91].sum() / letters,
        hist[48:58].sum() / n,
        hist[128:].sum() / n,
        len(lines) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        min(2.0, 4 * len(_RUNS.findall(raw)) / m),
        sum(map(bytes.istitle, words)) / m,
    )
    out[14 : 14 + len(_MARKS)] = np.minimum(2.0, hist[list(_DROP_MARKS)] / m)
    if n > 1:
        pairs = (data[:-1].astype(np.uint32) * 31 + data[1:].astype(np.uint32) * 101) * np.uint32(2654435761) >> np.uint32(26)
        out[14 + len(_MARKS) :] = np.sqrt(np.bincount(pairs, minlength=HASHED)[:HASHED] / (n - 1))
    return out


class Model:
    """One hidden layer over standardised features, fitted by the non-negative unbiased risk."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> None:
        self.prior = prior
        both = np.concatenate([positive, unlabelled]).astype(np.float64)
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        rng = np.random.default_rng(SEED)
        self.p = [rng.standard_normal((N_FEATURES, HIDDEN)) / np.sqrt(N_FEATURES), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        self._fit(self._standard(positive), self._standard(unlabelled))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.p[0] + self.p[1])
        return hidden, hidden @ self.p[2] + self.p[3]

    def _gradient(self, x: np.ndarray, hidden: np.ndarray, by_output: np.ndarray) -> list[np.ndarray]:
        below = by_output[:, None] * self.p[2] * (1 - hidden**2)
        return [x.T @ below, below.sum(0), hidden.T @ by_output, np.array([by_output.sum()])]

    def _fit(self, pos: np.ndarray, unl: np.ndarray) -> None:
        first, second = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p]
        for step in range(1, STEPS + 1):
            hp, zp = self._forward(pos)
            hu, zu = self._forward(unl)
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            # sigmoid loss: of label 1 it is 1 - s, of label 0 it is s; each bounded, as the estimator asks for
            negative = su.mean() - self.prior * sp.mean()
            as_one = self._gradient(pos, hp, -self.prior * sp * (1 - sp) / len(pos))
            as_zero = [u - p for u, p in zip(self._gradient(unl, hu, su * (1 - su) / len(unl)), self._gradient(pos, hp, self.prior * sp * (1 - sp) / len(pos)))]
            grad = [a + z for a, z in zip(as_one, as_zero)] if negative >= 0 else [-z for z in as_zero]
            for k, g in enumerate(grad):
                g = g + DECAY * self.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = RATE * (1 - step / (STEPS + 1)) + 1e-4
                self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(self._standard(x))[1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """docs (doc_id, text), labels (doc_id, label 0 or 1): a model from the training rows, or None without positives."""
    train = labels.where(C.remainder(F.col("doc_id"), HELD_OUT) != 0).where("label is not null")
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)), F.lit(0))).first()
    if not ones:
        return None
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    positive = train.where("label = 1").select("doc_id").distinct().orderBy(*order).limit(SAMPLE)
    ids = docs.where(C.remainder(F.col("doc_id"), HELD_OUT) != 0).select("doc_id")
    unlabelled = ids.join(labels.where("label is not null").select("doc_id"), "doc_id", "left_anti").distinct().orderBy(*order).limit(SAMPLE)
    chosen = positive.withColumn("one", F.lit(1)).unionByName(unlabelled.withColumn("one", F.lit(0)))
    rows = _rows(docs, chosen)
    if not any(r["one"] == 0 for r in rows):  # every training document is labelled: they stand for the web text, whatever their label
        rows += _rows(docs, ids.distinct().orderBy(*order).limit(SAMPLE).withColumn("one", F.lit(0)))
    x, one = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, N_FEATURES), np.array([r["one"] for r in rows])
    if not (one == 1).any():
        return None
    return Model(x[one == 1], x[one == 0], ones / n)


def _rows(docs: DataFrame, chosen: DataFrame) -> list:
    """Features of the chosen doc_ids, a row each (of several texts of one doc_id the least features): SAMPLE a kind at most."""
    found = _features(docs.join(F.broadcast(chosen), "doc_id"), "one").groupBy("one", "doc_id").agg(F.min("x").alias("x"))
    return found.orderBy("one", F.xxhash64("doc_id"), "doc_id").collect()


def _features(docs: DataFrame, keep: str) -> DataFrame:
    def run(batches):
        for b in batches:
            x = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(keep).cast(pa.int64()), pa.array(x, pa.binary())], names=["doc_id", keep, "x"])

    C.tune(docs.sparkSession)
    return docs.select("doc_id", keep, "text").mapInArrow(run, f"doc_id bigint, {keep} bigint, x binary")


def scores(model: Model | None, texts: list[str]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    return model.score(np.array([features(t) for t in texts]))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    def make():
        return lambda ids, texts: zip(ids, scores(model, texts).tolist())

    out = C.map_documents(docs, make, "doc_id bigint, score double", SCHEMA)
    return out.select("doc_id", (C.remainder(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier does not reject."""
    model = fit(C.documents(docs), labels)

    @F.pandas_udf("double")
    def by_text(texts):
        import pandas as pd

        return pd.Series(scores(model, [t or "" for t in texts]))

    C.tune(docs.sparkSession)
    return docs.where(by_text(F.col("text")) >= threshold)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(C.read(spark, sf_dir, "documents"))
    return score(docs, fit(docs, labels_of(spark, sf_dir)))


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
