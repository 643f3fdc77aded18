"""Document fingerprints by closed syncmers, in DataFrame functions only.

The symbols of a text are its words, and single characters of scripts that write no spaces. A k-mer is K symbols in a row,
its inner substrings are the pairs of neighbouring symbols in it, ordered by hash. A k-mer is an anchor if its least pair
is its first or its last. That is decided by the k-mer alone, so a passage keeps its anchors wherever it stands, and equal
anchors of two texts give the offset of a shared passage (anchors(), offsets()). A text's ends count as K - 1 blank
symbols, so that short texts have anchors too.

The fingerprint is the SKETCH least 32-bit hashes of a text's anchors, ascending, eight hex digits each. The likeness of
two is the share of the SKETCH least of their union that both have: the Jaccard similarity of the anchor sets where they
are small, and an estimate of it (standard error 0.06 at most) else.

Neighbours by id meet in buckets of the id range: bounds are quantiles of the ids and even steps between them. Texts are
shuffled once, by bucket; each bucket takes in a copy of the first row of the one after it, so no task sees all rows.

Cases: a null or empty text has an empty fingerprint, two of which have likeness 1; a text of K symbols or fewer has all
its k-mers with blanks; very long texts are arrays of one row; of rows of one id the greater text comes first, and they
share a bucket, as rows without an id do, which come last in the order; a table of one row is its own neighbour; an empty
table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilefold.llm import common as C

#: Scripts without spaces: each character is a symbol.
_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
SYMBOL = rf"[{_SINGLE}]|[^\x20\x09-\x0D{_SINGLE}]+"
K = 5
SKETCH = 64
#: Quantiles of the ids, and buckets of the id range a shuffle partition and in all.
QUANTILES = 255
BUCKETS, MOST_BUCKETS = 8, 1 << 18


def symbols(text: Column) -> Column:
    """Hashes of a text's symbols with K - 1 blanks (0) around them; no symbols at all give none."""
    own = F.transform(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0)), lambda s: F.xxhash64(s))
    blanks = F.array_repeat(F.lit(0).cast("bigint"), K - 1)
    return F.concat(blanks, own, blanks)


def _steps(rows: DataFrame, text: str, into: str) -> DataFrame:
    """rows with the anchors of a text: an array as long as its k-mers, null where one is no anchor.

    Each step is a column that the next one uses several times, so that Spark computes it once a row.
    """
    h, g = f"__h_{into}", f"__g_{into}"
    pair = lambda x, i: F.xxhash64(x, F.get(h, i + 1))
    rows = rows.withColumn(h, symbols(F.col(text)))
    rows = rows.withColumn(g, F.transform(h, pair))  # the last pair stands for none: no k-mer reaches it
    last = K - 2

    def anchor(x: Column, i: Column) -> Column:
        edges = F.least(x, F.get(g, i + last))
        inner = F.least(*(F.get(g, i + j) for j in range(1, last)))
        code = F.xxhash64(x, *(F.get(g, i + j) for j in range(2, last + 1))).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when((i + K <= F.size(h)) & (edges <= inner), code)

    found = F.when(F.size(h) > 2 * (K - 1), F.transform(g, anchor)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn(into, found).drop(h, g)


def sketch(anchors: Column) -> Column:
    """The least hashes, ascending."""
    return F.slice(F.array_compact(F.sort_array(F.array_distinct(anchors))), 1, SKETCH)


def text_of(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda a: F.lpad(F.lower(F.hex(a)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches, 0 to 1."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def fingerprints(rows: DataFrame, text: str, into: str) -> DataFrame:
    """rows with the sketch of a text column."""
    return _steps(rows, text, into).withColumn(into, sketch(F.col(into)))


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, place, anchor): every anchor of a document and the symbol at which it begins, from 1 - K on."""
    found = _steps(C.documents(docs), "text", "anchors")
    return found.select("doc_id", F.posexplode("anchors").alias("at", "anchor")).where("anchor is not null").select("doc_id", (F.col("at") - (K - 1)).alias("place"), "anchor")


def offsets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, shift, anchors, first, last): for two tables of anchors(), how many of them two documents have in common at
    one offset, and the places in the first document that these span. For matching chosen documents against a table: a
    frequent anchor meets all documents that have it."""
    met = a.select(F.col("doc_id").alias("a"), F.col("place").alias("p"), "anchor").join(b.select(F.col("doc_id").alias("b"), F.col("place").alias("q"), "anchor"), "anchor")
    return met.groupBy("a", "b", (F.col("q") - F.col("p")).alias("shift")).agg(F.count("*").alias("anchors"), F.min("p").alias("first"), F.max("p").alias("last"))


def bucketed(docs: DataFrame) -> DataFrame:
    """docs with `bucket`, which grows with doc_id: ranges of about equal numbers of rows; -1 for null ids."""
    spark = docs.sparkSession
    shares = [(k + 1) / (QUANTILES + 1) for k in range(QUANTILES)]
    known = docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("q"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    if known["least"] is None:
        return docs.withColumn("bucket", F.lit(-1).cast("bigint"))
    bounds = sorted({known["least"], *known["q"]})  # QUANTILES + 1 numbers at most
    steps = max(1, min(MOST_BUCKETS, BUCKETS * C.parts(spark)) // len(bounds))
    table = F.array(*(F.lit(b).cast("bigint") for b in bounds))
    ends = F.array(*(F.lit(b).cast("bigint") for b in [*bounds[1:], known["most"] + 1]))
    placed = docs.withColumn("__range", F.size(F.filter(table, lambda b: b <= F.col("doc_id"))))
    low, high = F.get(table, F.col("__range") - 1), F.get(ends, F.col("__range") - 1)
    step = F.floor((F.col("doc_id") - low) * steps / F.greatest(high - low, F.lit(1)))
    return placed.withColumn("bucket", F.coalesce(F.col("__range").cast("bigint") * steps + F.least(step, F.lit(steps - 1)), F.lit(-1))).drop("__range")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text and the bucket order: the text of the next document by descending id, after the last one the
    first; rows with `extra` only stand for the neighbour of another bucket's last row."""
    rows = bucketed(C.documents(docs))
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # MOST_BUCKETS rows at most
    down = Window.orderBy(F.desc("bucket"))
    circle = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = tops.select(F.coalesce(F.lag("bucket").over(down), F.last("bucket").over(circle)).alias("into"), F.col("bucket").alias("of"), "top")
    met = rows.join(F.broadcast(before), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    extra = met.groupBy(F.col("into").alias("bucket")).agg(F.first("doc_id").alias("doc_id"), F.max("text").alias("text"))
    return rows.withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True)))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited_text, and the sketches of both and of the next document (own, edited, next)."""
    order = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), F.desc("text"))
    rows = with_next(docs).withColumn("next_text", F.lead("text").over(order))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = fingerprints(rows.withColumn("edited_text", edited), "text", "own")
    rows = rows.withColumn("next", F.lead("own").over(order)).where("not extra")
    return fingerprints(rows, "edited_text", "edited").select("doc_id", "text", "edited_text", "own", "edited", "next")


def op13_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours(C.read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("own")).alias("fingerprint"),
        text_of(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


QUERIES = {"op13_syncmers": op13_syncmers}
ORACLES: dict[str, str] = {}
