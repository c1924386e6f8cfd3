"""Near-dedup by b-bit MinHash.

Each document's set of word shingles gets 128 minima.  Bands of five full minima propose candidates; of
each minimum its low eight bits are packed into a signature, and equal bytes of two signatures, corrected
for chance collisions, estimate the similarity of candidates.  Estimates within the error margin of the
threshold are decided on the full sets.

Documents with the same set are one class, with a number of its own.  Each class is held against the first of each
of its buckets.  Buckets whose members those estimates do not join are compared once more: what lies outside the bucket's
largest part meets all its members in blocks of bounded size.  So groups are joined by estimates near the threshold and never by
a band alone, and none is expanded into its pairs.  Then the full sets decide the pairs that joined each group.  Groups that
are one component after that are done; of the others what lies outside the largest component meets the whole group in blocks that
hold the texts, and only links that join components leave a block, fewer than it has members.

Chance of missing a link at similarity 0.85: (1 - 0.85**5)**25 < 1e-6 by the bands, and the margin is four
standard errors of the estimate.

Defined results: texts that are null or without words have an empty set and link with nothing; texts with
fewer words than a shingle are one shingle; rows that
repeat an id are judged each by their own text; a null id links with nothing; where documents are returned all their columns stay.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_column, components, free_name, mix, record_batch, table, word_hashes

MINIMA, BITS, ROWS = 128, 8, 5
BANDS = MINIMA // ROWS
BLOCK = 2048  # signatures on one side of a comparison
BLOCK_CHARS = 4_000_000  # of text on one side where full sets are compared
SLAB = 4096  # shingles whose presence is multiplied out at once
_rng = np.random.default_rng(20240229)
FACTORS = (_rng.integers(1, 1 << 32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
OFFSETS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)

SKETCH = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])
SKETCH_SQL = "doc_id long, mark long, n_shingles long, key binary, signature binary, bands array<long>"
PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Links (u, v) between components (p, q).
JOINS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("p", pa.int64()), ("q", pa.int64())])


def shingle_set(text: str | None, n: int, *, lower: bool = True) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    b = (text or "").encode()
    h = word_hashes((b.lower() if lower else b).split())
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        size = min(n, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        out = np.minimum(out, (x[k : k + 2048, None] * FACTORS + OFFSETS).min(0))
    return out


def signature(m: np.ndarray) -> bytes:
    """The low bits of the minima, taken after mixing, since low bits of a product are weak."""
    return ((m ^ (m >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(24)).astype(np.uint8).tobytes()


def bands(m: np.ndarray) -> list[int]:
    with np.errstate(over="ignore"):
        rows = m[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        h = np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64).tolist()


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for b in batches:
            ids, texts, marks = (arrow_column(b, c) for c in ("doc_id", "text", "mark"))
            for lo in range(0, len(ids), 1000):
                rows: dict[str, list] = {f.name: [] for f in SKETCH}
                for doc, text, mark in zip(ids[lo : lo + 1000], texts[lo : lo + 1000], marks[lo : lo + 1000], strict=True):
                    s = shingle_set(text, shingle)
                    m = minima(s)
                    none = not len(s) or doc is None
                    for name, v in zip(rows, (doc, mark, len(s), None if none else hashlib.blake2b(s.tobytes(), digest_size=16).digest(), None if none else signature(m), None if none else bands(m)), strict=True):
                        rows[name].append(v)
                yield record_batch(rows, SKETCH)

    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")).mapInArrow(run, SKETCH_SQL)


def corrected(equal: np.ndarray) -> np.ndarray:
    """Similarity from how many low bits of minima are equal; chance makes 2**-BITS of the others so."""
    chance = 2.0**-BITS
    return ((equal / MINIMA).astype(np.float32) - chance) / (1 - chance)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of all rows of a with all rows of b."""
    equal = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        equal += a[:, k, None] == b[None, :, k]
    return corrected(equal)


def comparable(size: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets' sizes alone allow the similarity."""
    x, y = size[a][:, None], size[b][None, :]
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one with all sets of two, by products of presence, a slab of shingles at a time."""
    a, b = np.concatenate(one), np.concatenate(two)
    row_a, row_b = np.repeat(np.arange(len(one)), [len(x) for x in one]), np.repeat(np.arange(len(two)), [len(x) for x in two])
    common = np.intersect1d(a, b)
    at_a, at_b = np.searchsorted(common, a), np.searchsorted(common, b)
    in_a = (at_a < len(common)) & (common[np.minimum(at_a, len(common) - 1)] == a) if len(common) else np.zeros(len(a), bool)
    in_b = (at_b < len(common)) & (common[np.minimum(at_b, len(common) - 1)] == b) if len(common) else np.zeros(len(b), bool)
    out = np.zeros((len(one), len(two)), np.float32)
    for lo in range(0, len(common), SLAB):
        n = min(SLAB, len(common) - lo)
        m, k = np.zeros((len(one), n), np.float32), np.zeros((len(two), n), np.float32)
        x, y = in_a & (at_a >= lo) & (at_a < lo + n), in_b & (at_b >= lo) & (at_b < lo + n)
        m[row_a[x], at_a[x] - lo] = 1
        k[row_b[y], at_b[y] - lo] = 1
        out += m @ k.T
    return out


def joiner(name: str, margin: float, percent: int, shingle: int):
    """Of two meeting blocks: links between components, by estimate alone (shingle 0) or decided on the full sets; a spanning set of them."""

    def join(t: pa.Table) -> pa.Table:
        column = lambda c: np.array(t.column(c).to_pylist(), np.int64)
        ids, size, sig = column("class"), column("n_shingles"), np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(-1, MINIMA)
        label = column(name)
        comp = np.unique(label, return_inverse=True)[1]
        parent, rows, sets = np.arange(comp.max() + 1), {c: [] for c in JOINS.names}, {}
        asks = np.array(t.column("asks").to_pylist(), bool)
        right, left = np.flatnonzero(~asks), np.flatnonzero(asks)

        def shingles(k: int) -> np.ndarray:
            if ids[k] not in sets:
                sets[ids[k]] = shingle_set(t.column("text")[int(k)].as_py(), shingle)
            return sets[ids[k]]

        for lo in range(0, len(left), 128):
            some = left[lo : lo + 128]
            ok = comparable(size, some, right, percent) & (parent[comp[some]][:, None] != parent[comp[right]][None, :])
            if not ok.any():
                continue
            ok &= estimate(sig[some], sig[right]) >= margin
            i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            if not len(i):
                continue
            linked = ok[np.ix_(i, j)]
            if shingle:
                both = shared_counts([shingles(k) for k in some[i]], [shingles(k) for k in right[j]])
                linked = linked & (100 * both >= percent * (size[some[i]][:, None] + size[right[j]][None, :] - both))
            for x, y in zip(*np.nonzero(linked), strict=True):
                u, v = int(some[i[x]]), int(right[j[y]])
                p, q = parent[comp[u]], parent[comp[v]]
                if p != q:
                    parent[parent == max(p, q)] = min(p, q)
                    for c, x in zip(JOINS.names, (ids[u], ids[v], label[u], label[v]), strict=True):
                        rows[c].append(int(x))
        return table(rows, JOINS)

    return join


class Pairwise:
    """Steps over classes (class, n_shingles, signature), which are numbers of distinct sets."""

    def __init__(self, scratch: Scratch, texts: DataFrame, shingle: int, percent: int, block: int):
        self.scratch, self.texts, self.shingle, self.percent, self.block = scratch, texts, shingle, percent, block
        share = percent / 100
        self.margin = share - 4 * math.sqrt(share * (1 - share) / MINIMA)

    def estimated(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (u, v) with their estimate, of those whose sizes and signatures allow a link."""
        side = lambda c: classes.select(F.col("class").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}")).hint("merge")
        both = pairs.join(side("u"), "u").join(side("v"), "v")
        both = both.filter(100 * F.least("n_u", "n_v") >= self.percent * F.greatest("n_u", "n_v"))
        margin, out = self.margin, pa.schema([("u", pa.int64()), ("v", pa.int64()), ("e", pa.float32())])

        def run(batches):
            for b in batches:
                if b.num_rows:
                    x, y = (np.frombuffer(b"".join(arrow_column(b, c)), np.uint8).reshape(-1, MINIMA) for c in ("s_u", "s_v"))
                    e = corrected((x == y).sum(1))
                    ok = pa.array(e >= margin)
                    yield pa.RecordBatch.from_arrays([b.column("u").filter(ok), b.column("v").filter(ok), pa.array(e.astype(np.float32)).filter(ok)], schema=out)

        return both.select("u", "v", "s_u", "s_v").mapInArrow(run, "u long, v long, e float")

    def decided(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (u, v) those whose full sets reach the threshold."""
        shingle, percent, out = self.shingle, self.percent, PAIRS

        def check(batches):
            kept: dict[int, np.ndarray] = {}

            def set_of(c, text):
                if c not in kept:
                    if len(kept) > 64:
                        kept.clear()
                    kept[c] = shingle_set(text, shingle)
                return kept[c]

            for b in batches:
                rows = {"u": [], "v": []}
                for u, v, x, y in zip(*(arrow_column(b, n) for n in ("u", "v", "text_u", "text_v")), strict=True):
                    x, y = set_of(u, x), set_of(v, y)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        rows["u"].append(u)
                        rows["v"].append(v)
                yield record_batch(rows, out)

        side = lambda c: self.texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
        both = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
        return self.scratch.write(both.select("u", "v", "text_u", "text_v").mapInArrow(check, "u long, v long"), "links")

    def labelled(self, rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Rows with the component of their class under the links."""
        comps = components(links, self.scratch).select(F.col("node").alias("class"), F.col("component").alias(name))
        return rows.join(comps.hint("merge"), "class", "left").withColumn(name, F.coalesce(name, "class"))

    def merged(self, rows: DataFrame, joins: DataFrame, name: str, new: str) -> DataFrame:
        """Rows with their component `name` and what it becomes under joins (p, q) of components."""
        if joins.isEmpty():
            return rows.withColumn(new, F.col(name))
        comps = components(joins.select(F.col("p").alias("u"), F.col("q").alias("v")), self.scratch)
        comps = comps.select(F.col("node").alias(name), F.col("component").alias(new))
        return rows.join(comps.hint("merge"), name, "left").withColumn(new, F.coalesce(new, name))

    def apart(self, rows: DataFrame, group: str, name: str) -> DataFrame:
        """Rows of groups with more than one component, dealt to blocks that meet.

        Block a of all rows and block b of those that ask, which lie outside the group's largest component, meet once.
        """
        sizes = rows.groupBy(group, name).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
        groups = sizes.groupBy(group).agg(F.count("*").alias("parts"), F.max(F.struct("n", F.col(name).alias("c")))["c"].alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"))
        groups = groups.filter("parts > 1")
        outside = sizes.join(groups.select(group, "main").hint("merge"), group).filter(F.col(name) != F.col("main")).groupBy(group).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        blocks = lambda n, w: F.greatest(F.ceil(n / self.block), F.ceil(w / BLOCK_CHARS), F.lit(1)).cast("int")
        groups = groups.select(group, "main", blocks(F.col("n"), F.col("w")).alias("all")).join(outside.select(group, blocks(F.col("n"), F.col("w")).alias("few")).hint("merge"), group)
        dealt = rows.join(groups.hint("merge"), group)
        place = F.xxhash64("class")
        one = dealt.withColumn("a", F.pmod(place, "all").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("few") - 1))).withColumn("asks", F.lit(False))
        two = dealt.filter(F.col(name) != F.col("main")).withColumn("b", F.pmod(place, "few").cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("all") - 1))).withColumn("asks", F.lit(True))
        return one.unionByName(two).drop("main", "all", "few", "weight")

    def joined(self, blocks: DataFrame, group: str, name: str, exact: bool) -> DataFrame:
        """Links between components found in meeting blocks: by estimate, or decided on the full sets."""
        return self.scratch.write(blocks.groupBy(group, "a", "b").applyInArrow(joiner(name, self.margin, self.percent, self.shingle if exact else 0), "u long, v long, p long, q long"), "links")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document (doc_id, text); links need 100 |A and B| >= percent |A or B|."""
    rows, scratch = labelled_rows(docs, shingle, percent, block)
    out = rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def labelled_rows(docs: DataFrame, shingle: int, percent: int, block: int) -> tuple[DataFrame, Scratch]:
    """(doc_id, mark, n_shingles, component_id) of every row; mark is a hash of its text."""
    scratch = Scratch(docs.sparkSession, "minhash-dedup")
    sketches = scratch.write(sketch(docs, shingle), "sketches")
    fine = sketches.filter("key is not null")
    # Each distinct set is a class with a number of its own, known by its smallest id and the text of that row.
    first = F.min(F.struct("doc_id", "mark")).alias("first")
    classes = fine.groupBy("key").agg(first, *[F.first(c).alias(c) for c in ("n_shingles", "signature", "bands")])
    classes = scratch.write(classes.select("key", "first.doc_id", "first.mark", "n_shingles", "signature", "bands").withColumn("class", F.monotonically_increasing_id()), "classes")
    sets = classes.select("class", "n_shingles", "signature")
    banded = scratch.write(classes.select("class", F.explode("bands").alias("band")), "bands")
    hubs = banded.groupBy("band").agg(F.min("class").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    shared = scratch.write(banded.join(hubs.select("band", "hub").hint("merge"), "band"), "bands")
    scratch.drop(banded)
    star = shared.filter("class <> hub").select(F.col("class").alias("u"), F.col("hub").alias("v")).distinct()
    work = Pairwise(scratch, None, shingle, percent, block)
    near = scratch.write(work.estimated(star, sets), "near")
    # Buckets that this leaves in several parts are compared by estimate, those outside the largest part with all.
    parts = scratch.write(work.labelled(sets, near, "part").withColumn("weight", F.lit(0)), "parts")
    more = work.joined(work.apart(shared.select("class", "band").join(parts.hint("merge"), "class"), "band", "part"), "band", "part", False)
    grouped = work.merged(parts.select("class", "part"), more, "part", "group")
    several = grouped.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    members = scratch.write(grouped.select("class", "group").join(several.hint("merge"), "group"), "groups")
    scratch.drop(shared)
    # Members' texts, one for each class; rows that repeat id and text count once.
    where = classes.join(members.hint("merge"), "class").select("class", "doc_id", "mark")
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    work.texts = scratch.write(marked.join(where.hint("merge"), ["doc_id", "mark"]).groupBy("class").agg(F.first("text").alias("text")), "texts")
    # Of each class the closest hub or member, and what joined buckets.
    best = near.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p"), "e").groupBy(F.col("p.u").alias("u")).agg(F.max(F.struct("e", F.col("p.v").alias("v")))["v"].alias("v"))
    tried = best.unionByName(more.select("u", "v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = work.decided(tried)
    state = members.join(sets.hint("merge"), "class").join(work.texts.hint("merge"), "class").withColumn("weight", F.length("text"))
    state = scratch.write(work.labelled(state, links, "part"), "undecided")
    last = work.joined(work.apart(state, "group", "part"), "group", "part", True)
    scratch.drop(work.texts)
    found = work.merged(state.select("class", "part"), last, "part", "component").select("class", "component")
    ids = classes.select("class", "key", "doc_id").join(found.hint("merge"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = ids.join(smallest.hint("merge"), "component").select("key", "component_id")
    return sketches.join(ids.hint("merge"), "key", "left").select("doc_id", "mark", "n_shingles", "component_id"), scratch


def keep_first(docs: DataFrame, *, shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """The documents with all their columns, of each component only those of the smallest id's text that links there.

    A row stays if its id is its component's smallest; rows of one id with other texts are judged by their own components.
    """
    rows, scratch = labelled_rows(docs, shingle, percent, block)
    gone = scratch.write(rows.filter("component_id <> doc_id").select("doc_id", "mark").distinct(), "gone")
    mark, doc = free_name(docs.columns, "mark"), free_name(docs.columns, "doc")
    gone = gone.select(F.col("doc_id").alias(doc), F.col("mark").alias(mark))
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(doc, F.col("doc_id"))
    return marked.join(gone.hint("merge"), [doc, mark], "left_anti").select(*docs.columns)
