"""How many rows the join on prefix words makes for a pair that shares many of them."""

import random

from pyspark.sql import functions as F

from corollary.llm import line_dedup


def classes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return line_dedup.ranked(docs, line_dedup.rarity(docs)).drop("keys", "copies")


def met(ranks):
    out = []
    for k in range(line_dedup.PASSES):
        rows = line_dedup.prefix_rows(ranks, k)
        out += [tuple(p) for p in line_dedup.prefix_pairs(rows, rows).select("x.doc", "y.doc").collect()]
    return out


def test_a_pair_meets_once_in_a_run_of_shared_words(spark):
    """Lines of 60 words that differ in one met on each of the ten and more words that their prefixes share."""
    same = " ".join(f"w{k}" for k in range(59))
    ranks = classes(spark, [f"{same} one", f"{same} two"]).withColumn("open", F.lit(True))
    assert ranks.agg(F.min(F.size("prefix"))).first()[0] > 10
    pairs = met(ranks)
    assert set(pairs) == {(1, 2)} and len(pairs) <= 3


def test_only_open_classes_ask(spark):
    ranks = classes(spark, ["a b c d e f g h i j", "a b c d e f g h i j k"])
    assert set(met(ranks.withColumn("open", F.col("doc") == 2))) == {(1, 2)}
    assert met(ranks.withColumn("open", F.col("doc") == 1)) == []


def test_rows_of_a_word_meet_only_where_sizes_may_be_similar(spark):
    """Twelve lines of 10 and twelve of 200 words with one rare word in common met in 576 rows, and again on each word of their prefixes."""
    texts = [" ".join(["rare", *(f"w{i}x{k}" for k in range(n - 1))]) for i, n in enumerate([10, 200] * 12)]
    ranks = classes(spark, texts).withColumn("open", F.lit(True)).withColumn("prefix", F.array(F.lit(7).cast("long")))
    met = 0
    for k in range(line_dedup.PASSES):
        rows = line_dedup.prefix_rows(ranks, k)
        met += line_dedup.prefix_meetings(rows, rows).count()
    assert met == 2 * 12 * 12


def test_every_similar_pair_meets(spark):
    """Sizes and differences up to the threshold, with words of all rarities, against brute force."""
    rng, texts = random.Random(5), []
    for _ in range(60):
        words = rng.sample(range(400), rng.choice([4, 5, 8, 9, 10, 13, 20, 31, 45, 90]))
        texts.append(words)
        for _ in range(4):
            drop = rng.randrange(len(words) // 5 + 1)
            texts.append(rng.sample(words, len(words) - drop) + [400 + rng.randrange(400) for _ in range(rng.randrange(len(words) // 5 + 1))])
    rng.shuffle(texts)
    sets = {}
    for k, words in enumerate(texts, 1):
        sets.setdefault(frozenset(words), k)
    want = {tuple(sorted((i, j))) for x, i in sets.items() for y, j in sets.items() if i < j and 100 * len(x & y) >= 80 * len(x | y)}
    ranks = classes(spark, [" ".join(f"w{w}" for w in words) for words in texts]).withColumn("open", F.lit(True)).cache()
    assert want <= set(met(ranks)) and len(want) > 100
    got = set()
    for k in range(line_dedup.PASSES):
        asking = line_dedup.prefix_rows(ranks.filter(F.col("doc") % 2 == 0), k)
        got |= {tuple(p) for p in line_dedup.prefix_pairs(asking, line_dedup.prefix_rows(ranks, k)).select("x.doc", "y.doc").collect()}
    assert {p for p in want if p[1] % 2 == 0} <= got


def test_only_marked_lines_travel(spark):
    """All texts of a document with a line to verify were dealt out, and those of all others too."""
    lines = spark.range(2000).select(F.col("id").alias("doc"), F.pmod("id", F.lit(3)).cast("int").alias("pos"))
    wanted = lines.filter("doc % 100 = 0")
    assert wanted.count() <= lines.filter(line_dedup.marked(wanted, "doc", "pos")).count() <= 25
    assert lines.filter(line_dedup.marked(wanted, "doc", "pos")).join(wanted, ["doc", "pos"]).count() == wanted.count()
