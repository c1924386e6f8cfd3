"""Line dedup by an exact set-similarity join, in DataFrame functions only.

Lines with the same set of words are one class, known by its first place.  The words of a class are ordered
by rarity (counts in hash buckets, a table of fixed size; equal counts by hash, so that the order is total).
Two sets of similarity 0.8 or more share a word among the rarest n - ceil(0.8 n) + 1 of each; the join on such
words keeps pairs that pass the length filter, the positional filter and a bound on how much their prefixes
may differ, read from sketches of the prefixes, which no similar pair can fail.  What is left is verified on
the full sets.

A line goes if an earlier line of the input (smaller doc_id, or the same document and further up) is
similar.  One earlier line is enough, so classes are first held against two that share a minimum or a maximum of hashes over the rarer
half of their words: the earliest and the most copied.  That settles most members of a group of near copies with
a few comparisons each.  Classes left that share a prefix word with many others are then held against a few of the earliest
that have it.  Only classes that find none there meet all earlier classes of their prefix, in passes
over ranges of words that bound the disk in use; rows of a word meet only in bands of sizes that may be similar, and one
of the two has the word among the first ninth of its set.

No side of a join here has a bound, so none is broadcast.  Between steps travel hashes, counts and places; of texts only those lines travel that are to
be verified, and the few others that have their mark.

Defined results: words are compared in lower case; lines without words stay where they are and match
nothing; a null text stays null; a document whose lines all go keeps an empty text; rows that share a
doc_id share places, so lines at the same place of both do not remove one another, and each loses only lines of its own; a null doc_id comes first; other columns stay.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, Scratch, free_name

SIMILARITY_PERCENT = 80
PASSES = 3  # over ranges of words
BITS = 16  # of the hash that a rarity bucket has
HASH = (1 << 56) - 1  # of a word's code; its rarity is above
PLACE = ["doc", "pos", "c"]  # of a class: its first place, and the hash of its set
SKETCH = ["sketch0", "sketch1"]  # of a class's rarest words, 64 bits each, for half of them
MARKS = 18  # bits of the hash that marks words, keys or documents that a step still asks for
FIRST = -(1 << 63)
BAND = 1.5625  # ratio of the sizes of a band, beyond which rows of the join on prefix words do not meet
CROWD = 32  # classes of a prefix word, beyond which they first meet the word's earliest
LEADING = 4  # words of a prefix that are asked for that
EARLIEST = 4  # of those, one in each share of the classes by hash
BLANK = " \t\n\x0b\x0c\r"


def words_in(line: str | Column) -> Column:
    """A line's words in lower case; the line must have some."""
    return F.split(F.btrim(F.lower(line), F.lit(BLANK)), WORD_GAP)


def bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BITS).cast("int")


def key_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"], F.lit(FIRST))


def spread(docs: DataFrame, *more: Column) -> DataFrame:
    """Lines with words: (doc, pos, line), doc never null, and more of their rows."""
    text = docs.select(key_of(docs).alias("doc"), *more, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return text.filter(F.btrim("line", F.lit(BLANK)) != "")


def level(n: int) -> int:
    """A count in quarters of an octave, 1 and more."""
    octave = int(n).bit_length() - 1
    return min(126, 1 + 4 * octave + ((4 * n) >> octave) - 4)


def rarity(docs: DataFrame) -> list[int]:
    """For each hash bucket how often its words occur, as levels."""
    counts = docs.select(F.explode(F.split(F.lower("text"), WORD_GAP)).alias("w")).groupBy(bucket(F.xxhash64("w")).alias("b")).agg(F.count("*").alias("n"))
    levels = [0] * (1 << BITS)
    found = counts.toArrow()  # one row a bucket
    for b, n in zip(found["b"].to_numpy().tolist(), found["n"].to_numpy().tolist(), strict=True):
        levels[b] = level(n)
    return levels


def word_codes(line: str | Column, levels: list[int]) -> Column:
    """A line's distinct words as numbers, rarest first: rarity in the highest bits, a hash below."""
    table = F.from_json(F.lit(json.dumps([n << 56 for n in levels], separators=(",", ":"))), "array<bigint>")
    code = lambda h: F.coalesce(F.get(table, bucket(h)), F.lit(0)).bitwiseOR(h.bitwiseAND(F.lit(HASH)))  # noqa: E731  never null, so that numbers are sorted as such
    return F.sort_array(F.array_distinct(F.transform(F.transform(words_in(line), lambda w: F.xxhash64(w)), code)))


def prefix_length(n: str | Column) -> Column:
    """n - ceil(0.8 n) + 1: so many of the rarest words hold one in common with any similar set."""
    n = F.col(n) if isinstance(n, str) else n
    return n - F.ceil(n * SIMILARITY_PERCENT / 100).cast("int") + 1


def sketch_length(n: str | Column) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.least(n, 2 * prefix_length(n) + 8)


def ranked(docs: DataFrame, levels: list[int]) -> DataFrame:
    """Of each class: its place, the size of its set, how often it occurs, keys that near copies mostly share, and its prefix with a sketch of it."""
    c = spread(docs).select("doc", "pos", word_codes("line", levels).alias("words"))
    c = c.withColumn("n", F.size("words")).withColumn("prefix", F.slice("words", 1, prefix_length("n"))).withColumn("sketched", F.slice("words", 1, sketch_length("n")))
    rarer = F.transform(F.slice("words", 1, F.ceil(F.col("n") / 2).cast("int")), lambda h: h.bitwiseAND(F.lit(HASH)))
    c = c.withColumn("rarer", rarer)
    keys = F.array(*[F.xxhash64(F.lit(k), f("rarer")) for k, f in enumerate((F.array_min, F.array_max))])
    one = F.lit(1).cast("long")
    bit = lambda h: F.call_function("shiftleft", one, F.shiftright(h, 1).bitwiseAND(F.lit(63)).cast("int"))
    sketch = lambda k: F.aggregate("sketched", F.lit(0).cast("long"), lambda a, h: F.when(h.bitwiseAND(F.lit(1)) == k, a.bitwiseOR(bit(h))).otherwise(a))
    c = c.select("doc", "pos", F.xxhash64("words").alias("c"), F.xxhash64(F.lit(1), "words").alias("c2"), "n", keys.alias("keys"), *[sketch(k).alias(s) for k, s in enumerate(SKETCH)], "prefix")
    same = [F.first(x).alias(x) for x in ("n", "keys", *SKETCH, "prefix")]
    c = c.groupBy("c", "c2").agg(F.min(F.struct("doc", "pos")).alias("at"), F.count("*").alias("copies"), *same)
    return c.select("at.doc", "at.pos", "c", "n", "copies", "keys", *SKETCH, "prefix")


def earlier(x: str, y: str) -> Column:
    return (F.col(f"{x}.doc") < F.col(f"{y}.doc")) | ((F.col(f"{x}.doc") == F.col(f"{y}.doc")) & (F.col(f"{x}.pos") < F.col(f"{y}.pos")))


def needed_overlap(x: str, y: str) -> Column:
    """Similarity s needs an overlap of s / (1 + s) of the sizes' sum, in whole numbers."""
    return F.ceil((F.col(f"{x}.n") + F.col(f"{y}.n")) * SIMILARITY_PERCENT / (100 + SIMILARITY_PERCENT))


def sizes_allow(x: str, y: str) -> Column:
    return (100 * F.col(f"{x}.n") >= SIMILARITY_PERCENT * F.col(f"{y}.n")) & (100 * F.col(f"{y}.n") >= SIMILARITY_PERCENT * F.col(f"{x}.n"))


def lacks(x: str, y: str) -> Column:
    """Bits of x's sketch that y's has not."""
    return sum((F.bit_count(F.col(f"{x}.{s}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{s}")))) for s in SKETCH), F.lit(0))


def sketches_allow(x: str, y: str) -> Column:
    """Sets of n and m words with t in common have l of them among their rarest n - t + l and m - t + l.  So of the words
    sketched at most n - t or so may be missing from the other's, and a bit that the other lacks is a word missing at least."""
    length = lambda s: sketch_length(F.col(f"{s}.n"))
    common = F.least(*[length(s) - F.col(f"{s}.n") for s in (x, y)]) + needed_overlap(x, y)
    return (lacks(x, y) <= length(x) - common) & (lacks(y, x) <= length(y) - common)


def positions_allow(x: str, y: str) -> Column:
    """The first common word leaves enough words behind it in both."""
    return F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at")) >= needed_overlap(x, y)


def both_places(p: DataFrame) -> DataFrame:
    """Pairs of joined classes x and y by their places, each once."""
    columns = [f"{s}_{c}" for s in "xy" for c in PLACE]
    return p.select(*columns if columns[0] in p.columns else [F.col(c.replace("_", ".")).alias(c) for c in columns]).distinct()


def hub_pairs(ranks: DataFrame) -> DataFrame:
    """Classes y with earlier ones x of the same key: the earliest and the most copied."""
    own = [*PLACE, "n", *SKETCH]
    rows = ranks.select("copies", *own, F.explode("keys").alias("key"))
    rows = rows.filter(marked(rows.groupBy("key").count().filter("count > 1"), "key"))
    first, most = F.min(F.struct(*own)).alias("first"), F.max(F.struct("copies", *own)).alias("most")
    hubs = rows.groupBy("key").agg(F.count("*").alias("times"), first, most).filter("times > 1")
    hubs = hubs.select("key", F.explode(F.array("first", F.struct(*[F.col(f"most.{c}").alias(c) for c in own]))).alias("x")).select("key", "x.*")
    both = rows.drop("copies").alias("y").join(hubs.alias("x").hint("merge"), F.col("x.key") == F.col("y.key"))
    return both_places(both.filter(earlier("x", "y") & sizes_allow("x", "y")).filter(sketches_allow("x", "y")))


def prefix_rows(ranks: DataFrame, part: int) -> DataFrame:
    """A row for each word of a class's prefix, for one range of words, with the word before it in the prefix."""
    own = [*PLACE, "n", *SKETCH, "open"]
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("prefix", 1, F.size("prefix") - 1))
    rows = ranks.select(*own, F.posexplode(F.arrays_zip(F.col("prefix").alias("word"), before.alias("before"))).alias("at", "w"))
    return rows.select(*own, "at", "w.word", "w.before").filter(F.pmod("word", F.lit(PASSES)) == part)


def short() -> Column:
    """Whether a prefix word is among the first ninth or so.  The words before the first common one are each in one set
    only, so of two similar sets one has that word there: together they lack n + m - 2t words, a ninth of n + m at most."""
    return (100 + SIMILARITY_PERCENT) * F.col("at") <= (100 - SIMILARITY_PERCENT) * F.col("n")


def band(n: Column) -> Column:
    """Sizes in bands, each up to BAND times as large as its smallest."""
    return F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")


def partner_bands() -> Column:
    """Bands of the sizes m that allow enough words behind a prefix word in this set: t <= n - at."""
    n, s = F.col("n"), SIMILARITY_PERCENT
    least = band(F.ceil(n * s / 100))
    most = band(F.greatest(F.lit(1), F.least(F.floor(n * 100 / s), F.floor((n - F.col("at")) * (100 + s) / s) - n)))
    return F.sequence(least, F.greatest(least, most))


def prefix_meetings(asking: DataFrame, others: DataFrame) -> DataFrame:
    """Prefix rows a and b of the same word: a goes to the bands of all sizes that may be similar, b to that of its own size.

    Of a table joined with itself only the short rows go to bands, whose partner may then be the earlier or the later one.
    """
    a = (asking.filter(short()) if asking is others else asking).withColumn("band", F.explode(partner_bands()))
    b = others.withColumn("band", band(F.col("n"))).withColumn("long", ~short())
    return a.alias("a").join(b.alias("b").hint("merge"), (F.col("a.word") == F.col("b.word")) & (F.col("a.band") == F.col("b.band")))


def prefix_pairs(asking: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of open classes y and earlier ones x that share a word of both prefixes, as structs; a pair once for each run of such words.

    A pair whose words before are the same as well has met there, where no filter is stricter.
    """
    asks = earlier("b", "a") & F.col("a.open")
    if asking is others:
        asks |= F.col("b.long") & earlier("a", "b") & F.col("b.open")
    both = prefix_meetings(asking, others).filter(sizes_allow("a", "b") & positions_allow("a", "b") & asks)
    both = both.filter(F.coalesce(F.col("a.before") != F.col("b.before"), F.lit(True)) & sketches_allow("a", "b"))
    side = lambda s: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in (*PLACE, "n", *SKETCH)])
    first = earlier("b", "a")
    return both.select(F.when(first, side("b")).otherwise(side("a")).alias("x"), F.when(first, side("a")).otherwise(side("b")).alias("y"))


def crowd_pairs(still: DataFrame, scratch: Scratch) -> DataFrame:
    """Open classes y with the earliest x, one in each share of the classes, of each crowded word among the first of their prefix."""
    own = [*PLACE, "n", *SKETCH]
    rows = still.select("open", *own, F.explode(F.slice("prefix", 1, LEADING)).alias("word"))
    share = F.pmod("c", F.lit(EARLIEST)).alias("share")
    firsts = rows.groupBy("word", share).agg(F.count("*").alias("times"), F.min(F.struct(*own)).alias("x"))
    crowds = firsts.groupBy("word").agg(F.sum("times").alias("times"), F.collect_list("x").alias("x")).filter(F.col("times") > CROWD)
    crowds = scratch.write(crowds.select("word", F.explode("x").alias("x")).select("word", "x.*"), "crowds")
    asking = rows.filter("open").drop("open").filter(marked(crowds, "word"))
    both = asking.alias("y").join(crowds.alias("x").hint("merge"), F.col("x.word") == F.col("y.word"))
    return both_places(both.filter(earlier("x", "y") & sizes_allow("x", "y")).filter(sketches_allow("x", "y")))


def marked(rows: DataFrame, *columns: str) -> Column:
    """Whether what is in these columns is there in rows too, from a table of marks of fixed size; others may pass too."""
    mark = F.shiftrightunsigned(F.xxhash64(*columns), 64 - MARKS)
    place, bit = F.shiftright(mark, 6).cast("int"), mark.bitwiseAND(F.lit(63)).cast("int")
    found = rows.groupBy(place.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()  # one row for 64 marks
    marks = [0] * (1 << MARKS - 6)
    for at, bits in zip(found["at"].to_pylist(), found["bits"].to_pylist(), strict=True):
        marks[at] = bits
    table = F.from_json(F.lit(json.dumps(marks, separators=(",", ":"))), "array<bigint>")
    return F.getbit(F.get(table, place), bit) == 1


def closest(p: DataFrame) -> DataFrame:
    """Of each y in pairs, the x with the closest sketch, and those of the smallest and largest hash."""
    x = F.struct(*[F.col(f"x_{c}").alias(c) for c in ("c", "doc", "pos")])
    return p.groupBy(*[f"y_{c}" for c in PLACE]).agg(F.min(F.struct("apart", x.alias("x"))).alias("best"), F.min(x).alias("low"), F.max(x).alias("high"))


def with_distance(p: DataFrame) -> DataFrame:
    """The places of joined x and y, and how far their sketches are apart."""
    places = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in PLACE]
    return p.select(*places, (lacks("x", "y") + lacks("y", "x")).alias("apart"))


def in_passes(scratch: Scratch, part) -> DataFrame:
    """All that part(k) gives, a written table for each range of words."""
    out = scratch.write(part(0), "pass")
    for k in range(1, PASSES):
        out = out.unionByName(scratch.write(part(k), "pass"))
    return out


def verified(pairs: DataFrame, docs: DataFrame, levels: list[int], scratch: Scratch) -> DataFrame:
    """Places of the later classes of pairs whose full sets reach the threshold."""
    side = lambda s: pairs.select(*[F.col(f"{s}_{c}").alias(c) for c in PLACE])
    wanted = scratch.write(side("x").unionByName(side("y")).distinct(), "wanted")
    # Of the texts only lines that may be wanted travel.
    lines = spread(docs.withColumn("doc", key_of(docs)).filter(marked(wanted, "doc"))).filter(marked(wanted, "doc", "pos"))
    found = lines.join(wanted.hint("merge"), ["doc", "pos"]).select(*PLACE, word_codes("line", levels).alias("words"))
    # Rows of one id may have other lines at the place.
    sets = scratch.write(found.filter(F.xxhash64("words") == F.col("c")), "sets")
    of = lambda s: sets.select(*[F.col(c).alias(f"{s}_{c}") for c in PLACE], F.col("words").alias(s))
    p = pairs.join(of("x").hint("merge"), [f"x_{c}" for c in PLACE]).join(of("y").hint("merge"), [f"y_{c}" for c in PLACE])
    p = p.withColumn("both", F.size(F.array_intersect("x", "y")))
    similar = 100 * F.col("both") >= SIMILARITY_PERCENT * (F.size("x") + F.size("y") - F.col("both"))
    later = scratch.write(p.filter(similar).select(*[F.col(f"y_{c}").alias(c) for c in PLACE]).distinct(), "later")
    scratch.drop(sets, wanted)
    return later


def first_classes(docs: DataFrame, levels: list[int], scratch: Scratch) -> DataFrame:
    """Places (doc, pos, c) of the classes without an earlier similar one."""
    ranks = scratch.write(ranked(docs, levels), "ranks")
    near = scratch.write(hub_pairs(ranks), "pairs")
    later = verified(near, docs, levels, scratch)
    # The rest meets every earlier class of a shared word, and is held against the closest of them.
    still = ranks.drop("keys", "copies").join(later.withColumn("later", F.lit(True)).hint("merge"), PLACE, "left")
    still = scratch.write(still.withColumn("open", F.col("later").isNull()).drop("later"), "ranks")
    scratch.drop(ranks, near, later)
    near = scratch.write(crowd_pairs(still, scratch), "pairs")
    later = verified(near, docs, levels, scratch)
    before, still = still, still.join(later.withColumn("later", F.lit(True)).hint("merge"), PLACE, "left")
    still = scratch.write(still.withColumn("open", F.col("open") & F.col("later").isNull()).drop("later"), "ranks")
    scratch.drop(before, near, later)
    y = [f"y_{c}" for c in PLACE]
    pairs = in_passes(scratch, lambda k: with_distance(prefix_pairs(*[prefix_rows(still, k)] * 2)))
    close = scratch.write(closest(pairs), "closest")
    some = close.select(*y, F.explode(F.array("best.x", "low", "high")).alias("x"))
    later = verified(scratch.write(some.select(*y, *[F.col(f"x.{c}").alias(f"x_{c}") for c in PLACE]).distinct(), "pairs"), docs, levels, scratch)
    # Those that had more than one and are similar to none of these are held against all.
    more = close.filter("low <> high").select(*y).join(later.toDF(*y).hint("merge"), y, "left_anti")
    last = verified(scratch.write(both_places(pairs.join(more.hint("merge"), y, "left_semi")), "pairs"), docs, levels, scratch)
    return still.filter("open").select(*PLACE).join(later.unionByName(last).hint("merge"), PLACE, "left_anti")


def repeats(docs: DataFrame) -> bool:
    """Whether rows share an id."""
    return not docs.groupBy(key_of(docs).alias("doc")).count().filter("count > 1").isEmpty()


def kept_lines(docs: DataFrame, shared: bool) -> DataFrame:
    """(doc, kept): by document the places of the lines with words that stay; where rows share ids, (doc, row, kept) with the hash of the row's text."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    levels = rarity(docs)
    stay, by = first_classes(docs, levels, scratch), ["doc"]
    if shared:
        by = ["doc", "row"]
        own = spread(docs, F.xxhash64("text").alias("row")).select(*by, "pos", F.xxhash64(word_codes("line", levels)).alias("c")).distinct()
        stay = own.join(stay, PLACE)
    return scratch.write(stay.groupBy(*by).agg(F.sort_array(F.collect_list("pos")).alias("kept")), "kept")


def with_kept(docs: DataFrame, doc: str, row: str, kept: str, lines: str, removed: str) -> DataFrame:
    """With the places of the lines that stay in column `kept`, all lines in `lines` and the number of those that go in `removed`; columns `doc` and `row` for work."""
    shared = repeats(docs)
    stay = kept_lines(docs, shared)
    names = {"doc": doc, "row": row, "kept": kept}
    stay = stay.select(*[F.col(c).alias(names[c]) for c in stay.columns])
    d = docs.withColumn(doc, key_of(docs))
    if shared:
        d = d.withColumn(row, F.xxhash64("text"))
    d = d.join(stay.hint("merge"), [doc, row] if shared else [doc], "left").withColumn(kept, F.coalesce(kept, F.array().cast("array<int>")))
    d = d.withColumn(lines, F.split("text", "\n"))
    worded = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANK)) != "")
    return d.withColumn(removed, F.coalesce(F.size(worded) - F.size(kept), F.lit(0)))


def new_text(kept: str, lines: str, removed: str) -> Column:
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    bare = F.filter(every, lambda i: F.btrim(F.get(lines, i), F.lit(BLANK)) == "")
    left = F.transform(F.array_intersect(every, F.concat(F.col(kept), bare)), lambda i: F.get(lines, i))
    return F.when(F.col(removed) > 0, F.array_join(left, "\n")).otherwise(F.col("text"))


def remove(docs: DataFrame) -> DataFrame:
    """The documents without their later lines, with all their columns."""
    names: list[str] = []
    for stem in ("doc", "row", "kept", "lines", "removed"):
        names.append(free_name([*docs.columns, *names], f"__{stem}"))
    return with_kept(docs, *names).withColumn("text", new_text(*names[2:])).select(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256): lines with words, how many went, and the text that is left."""
    d = with_kept(docs.select("doc_id", "text"), "doc", "row", "kept", "lines", "removed")
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("removed") + F.size("kept"))
    return d.select("doc_id", n.cast("long").alias("n_lines"), F.col("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce(new_text("kept", "lines", "removed"), F.lit("")), 256).alias("kept_sha256"))
