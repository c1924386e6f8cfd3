"""Quality rules in DataFrame functions only.

Base rules drop documents that are too short or repeat themselves.  The rest are judged by the log
likelihood ratio of their hashed word n-grams (one and two words) under two multinomials, one of trusted
rows and one of the whole corpus, divided by the number of n-grams; a fixed threshold decides.

The counts hold one entry for each hash bucket, whatever the size of the corpus.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged
each; without trusted rows every ratio is 0 and documents that pass the base rules stay; labels that are
null or contradict one another are not trusted; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, Scratch

BUCKETS = 16384
#: Trusted rows that teach the target multinomial, at most; they are those of the smallest hash of the id.
TRUSTED = 20_000
SMOOTHING = 0.5
THRESHOLD = -0.15
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20


def words_of(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WORD_GAP), lambda w: w != "")


def upto(n: Column) -> Column:
    """0 .. n - 1, empty if n is not above 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def buckets() -> Column:
    """Buckets of the one- and two-word sequences of the hashes in column `h`."""
    one = F.transform("h", lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    two = F.transform(upto(F.size("h") - 1), lambda i: F.pmod(F.xxhash64(F.get("h", i), F.get("h", i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def hashed(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text").withColumn("w", words_of("text"))
    return d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """Log likelihood ratio of each bucket."""
    spark = docs.sparkSession
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and q2 = 1 and t = 0")
    ids = good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)
    trusted = hashed(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"))
    count = lambda d: d.select(F.explode(buckets()).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    scratch = Scratch(spark, "quality")
    both = scratch.write(count(hashed(docs)).select("b", "n", F.lit(0).alias("kind")).unionByName(count(trusted).select("b", "n", F.lit(1).alias("kind"))), "counts")
    counts = [[0.0] * BUCKETS, [0.0] * BUCKETS]
    for r in both.collect():  # one row a bucket and kind
        counts[r["kind"]][r["b"]] = float(r["n"])
    scratch.drop(both)
    raw, target = counts
    if not sum(target):
        return [0.0] * BUCKETS
    base = math.log((sum(raw) + SMOOTHING * BUCKETS) / (sum(target) + SMOOTHING * BUCKETS))
    return [math.log((t + SMOOTHING) / (r + SMOOTHING)) + base for t, r in zip(target, raw, strict=True)]


def repeated_words(d: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words that lie in a window of five words found twice or more in the text."""
    n = REPEAT_WINDOW
    d = d.withColumn("win", F.transform(upto(F.size("h") - (n - 1)), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(n)))))
    d = d.withColumn("again", F.size(F.array_distinct("win")) < F.size("win"))
    # Only texts with a repeated window are sorted; equal windows are then neighbours.
    d = d.withColumn("s", F.when(F.col("again"), F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda i, k: F.get("s", i)["x"].eqNullSafe(F.get("s", k)["x"])
    at = F.filter(upto(F.size("win")), lambda i: ((i > 0) & same(i, i - 1)) | ((i < F.size("s") - 1) & same(i, i + 1)))
    d = d.withColumn("p", F.when(F.col("again"), F.sort_array(F.transform(at, lambda i: F.get("s", i)["i"]))))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("p")), F.lit(0), lambda a, i: a + F.when(i < F.size("p"), F.least(F.lit(n), F.get("p", i) - F.get("p", i - 1))).otherwise(F.lit(n)))
    return d.withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(F.lit(0)).cast("long")).drop("win", "s", "p", "again")


def judge(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of every document."""
    d = repeated_words(hashed(docs))
    text = F.coalesce(F.col("text"), F.lit(""))
    d = d.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    table = F.from_json(F.lit(json.dumps(ratio)), "array<double>")
    d = d.withColumn("b", buckets())
    total = F.aggregate("b", F.lit(0.0), lambda a, x: a + F.get(table, x))
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.when(F.size("b") > 0, total / F.size("b")).otherwise(0.0).alias("score"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
