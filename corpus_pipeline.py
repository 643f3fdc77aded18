"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents; the last returns the pieces of packed sequences.

Cases: a document without a doc_id passes like any other; a null text counts as empty; if a stage keeps nothing the
later ones get an empty table and return one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilefold.llm import common as C
from tilefold.llm import op2_decontamination, op3_simhash, op6_secrets, op8_quality, op9_packing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return op8_quality.keep_good(docs, op8_quality.labels_of(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by doc_id, of each group of near duplicates."""
    return op3_simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return op2_decontamination.clean_only(docs, C.read(spark, sf_dir, "benchmark").select("item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return op6_secrets.redact(docs, n_chars_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 4096 ids."""
    import public_tokenizers

    return op9_packing.pack(C.documents(docs), public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: No stage of these can be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written to the shared folder and read again."""
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = C.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
