"""Brute-force versions and small fixtures."""

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = ["alpha", "be", "gamma", "delta", "été", "foo.", "bar", "Über", "x1", "token"]


def odd_documents(spark: SparkSession, n: int = 150, seed: int = 0) -> tuple[DataFrame, list[tuple]]:
    """Nulls, empty, very long, tied and repeated rows, and extra columns whose names clash with the operators' own."""
    r = random.Random(seed)
    passages = [" ".join(r.choice(WORDS) for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(n):
        t = " ".join(r.choice([r.choice(passages), f"{r.randrange(1000)}", " ".join(r.choice(WORDS) for _ in range(8))]) for _ in range(r.randrange(0, 6)))
        t = r.choice([t, t, t, t, t, None, "", "ab" * 300, "\n \t", "x" * 120])
        rows.append((r.choice([i, i, i, i, None]), t))
    rows.append((n, " ".join(r.choice(WORDS) for _ in range(40_000))))
    rows += rows[:5]
    extra = [(i, t, "en", "src", len(t or ""), 1.0, 7, "u", 3, b"z", 5) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp bigint, uid string, n int, hash binary, key bigint"
    return spark.createDataFrame(extra, schema).repartition(5), rows


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x if x is not None else 0) for x in r])
