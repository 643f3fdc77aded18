"""URL filters by a character language-model ratio, in DataFrame operations only.

Rules on hosts and paths decide first. Every url that a rule decides is also a labelled example: two smoothed
variable-order Markov models over characters, one of allowed and one of blocked urls, are counted from all of them. A
character's probability after a context of k characters backs off to that after k-1:
(n(context, c) + BACKOFF * shorter) / (n(context) + BACKOFF), down to a uniform one. The score of a url is the mean
over its characters of the log-likelihood difference, so it does not depend on length. One fifth of the labelled urls
is kept from the counts and calibrates the threshold: the score that best separates its allowed from its blocked.

Characters are counted with a partial aggregation before the shuffle, so frequent ones are no hot keys. The table of
scored (context, character) strings is broadcast if it has at most BROADCAST rows; beyond, it is joined by shuffle, and
adaptive execution splits the partitions of frequent strings.

Cases: a null url, or one without ://, has an empty host and path, no rule, and the score of the empty string; without
labelled urls of both kinds every score is 0 and the verdict allow; repeated rows are judged alike; an empty table
gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilefold.llm import common as C

# fixed values: rules as (verdict, host and path)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ORDER = 4
BACKOFF = 4.0
ALPHABET = 256
#: Of urls by hash: remainder 0 of this calibrates, the others are counted.
FOLDS = 5
#: Rows of grams and ratios that are broadcast at most: 48 bytes each (5 characters, a double, the row's own), so 24 MB.
BROADCAST = 500_000
START, END = "\x02", "\x03"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return lower, path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, the earlier of equally long ones, as struct(rule, verdict); null if none does."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, slash, p = rule.partition("/")
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(slash + p), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def _grams(urls: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each character of host and path and for their end: it and the ORDER before it."""
    text = F.concat(F.lit(START * ORDER), "host", "path", F.lit(END))
    return urls.withColumn("text", text).select(*keep, F.explode(F.expr(f"transform(sequence(1, length(text) - {ORDER}), p -> substr(text, p, {ORDER + 1}))")).alias("gram"))


def language_models(grams: DataFrame) -> DataFrame:
    """(gram, ratio): log P(allowed) - log P(blocked) of a gram's last character after the others; grams has gram, allowed, blocked counts."""
    level = grams.groupBy("gram").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    level, _ = C.stage(level, "grams")
    levels = [level]
    for k in range(ORDER, 0, -1):  # counts after shorter contexts are sums of those after longer ones
        level = level.groupBy(F.substr("gram", F.lit(2)).alias("gram")).agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
        levels.append(level)
    shorter = None
    for k, level in enumerate(reversed(levels)):
        sums = (F.sum("allowed").alias("all_allowed"), F.sum("blocked").alias("all_blocked"))
        if shorter is None:  # one context, the empty one: one row of totals
            both = level.agg(*sums).first()
            joined = level.withColumns({"all_allowed": F.lit(both[0] or 0), "all_blocked": F.lit(both[1] or 0), "s_allowed": F.lit(1 / ALPHABET), "s_blocked": F.lit(1 / ALPHABET)})
        else:
            level = level.withColumn("context", F.substr("gram", F.lit(1), F.lit(k)))
            joined = level.join(level.groupBy("context").agg(*sums), "context")
            joined = joined.withColumn("suffix", F.substr("gram", F.lit(2))).join(shorter.select(F.col("gram").alias("suffix"), F.col("p_allowed").alias("s_allowed"), F.col("p_blocked").alias("s_blocked")), "suffix")
        p = {f"p_{c}": (F.col(c) + BACKOFF * F.col(f"s_{c}")) / (F.col(f"all_{c}") + BACKOFF) for c in ("allowed", "blocked")}
        shorter = joined.select("gram", *(e.alias(n) for n, e in p.items()))
    return shorter.select("gram", (F.log("p_allowed") - F.log("p_blocked")).alias("ratio"))


def threshold_of(scored: DataFrame) -> float:
    """The score, to a hundredth, from which on the share of allowed less that of blocked is largest; 0 without both kinds."""
    binned = scored.groupBy(F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("score") * 100))).alias("bin")).agg(F.sum((F.col("label") == "allow").cast("bigint")).alias("allowed"), F.sum((F.col("label") == "block").cast("bigint")).alias("blocked"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 4001 bins at most
    everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gain = F.coalesce(F.sum("blocked").over(below), F.lit(0)) / F.sum("blocked").over(everything) - F.coalesce(F.sum("allowed").over(below), F.lit(0)) / F.sum("allowed").over(everything)
    best = binned.select("bin", gain.alias("gain")).where("gain is not null").orderBy(F.desc("gain"), "bin").first()
    return best["bin"] / 100 if best else 0.0


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page (page_id, url)."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("label"))
    ruled = ruled.withColumn("fold", F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS))).withColumn("uid", F.monotonically_increasing_id())
    urls, _ = C.stage(ruled, "urls")
    counted = _grams(urls, ["label", "fold"]).select("gram", *(F.when((F.col("label") == v) & (F.col("fold") != 0), 1).otherwise(0).alias(n) for v, n in (("allow", "allowed"), ("block", "blocked"))))
    models, _ = C.stage(language_models(counted), "model")
    both = urls.where("fold <> 0").agg(F.count(F.when(F.col("label") == "allow", 1)), F.count(F.when(F.col("label") == "block", 1))).first()
    if not all(both):
        models = models.withColumn("ratio", F.lit(0.0))
    side = F.broadcast(models) if models.count() <= BROADCAST else models
    scores = _grams(urls, ["uid"]).join(side, "gram").groupBy("uid").agg(F.avg("ratio").alias("score"))
    scores, _ = C.stage(scores, "scores")
    scored = urls.join(scores, "uid")
    threshold = threshold_of(scored.where("fold = 0 and label is not null").select("score", "label")) if all(both) else 0.0
    verdict = F.coalesce("label", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op1_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.read(spark, sf_dir, "pages").select("page_id", "url"))


QUERIES = {"op1_url_model": op1_url_model}
ORACLES: dict[str, str] = {}
