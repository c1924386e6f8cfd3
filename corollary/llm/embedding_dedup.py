"""Embedding near-dedup by int8 tile products with error bounds.

Equal vectors of a label are one class, with a number of its own.  The classes of a label are dealt to tiles of about
TILE vectors; every pair of tiles is one task.  There each vector is quantised to int8 with a scale of its
own, tiles are multiplied in whole numbers, and a bound for each vector's quantisation error says which
pairs could reach the threshold: with x = s q + e, |x.y - s t q.r| <= |e| |y| + |s q| |f|.  Only those
are computed again in double precision.  A task returns how many links each vector found and a spanning set
of links, never all pairs of a group.

The work grows with the square of the distinct vectors of a label, divided among tile pairs.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, and vectors
whose label is null, link with nothing; vectors link only with those of the same size; rows that repeat a
vec_id count as vectors of their own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, table

THRESHOLD = 0.98
TILE = 1024
EXACT = (1 << 24) // 127**2  # products of int8 whose sum single precision holds exactly
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: whole numbers from -127 to 127, scales, norms of scaled rows and of errors."""
    s = np.abs(x).max(1) / 127
    q = np.rint(x / s[:, None])
    scaled = q * s[:, None]
    return q.astype(np.int8), s, np.linalg.norm(scaled, axis=1), np.linalg.norm(x - scaled, axis=1)


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of all rows of a with all rows of b, both int8, summed in whole numbers.

    So many components at a time as single precision multiplies and adds without rounding.
    """
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], EXACT):
        out += (a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T).astype(np.int64)
    return out


def possible(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Which pairs of two quantised tiles may reach the threshold."""
    qa, sa, na, ea = a
    qb, sb, _, eb = b
    product = whole_products(qa, qb) * sa[:, None] * sb[None, :]
    # |e| |y| + |s q| |f| with |y| = 1, and room for rounding in double precision
    return product + ea[:, None] + na[:, None] * eb[None, :] + 1e-9 >= threshold


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def linker(threshold: float):
    def link(t: pa.Table) -> pa.Table:
        ids, times = np.array(t.column("class").to_pylist(), np.int64), np.array(t.column("times").to_pylist(), np.int64)
        tiles, first = np.array(t.column("tile").to_pylist()), t.column("ta")[0].as_py()
        same = t.column("tb")[0].as_py() == first
        x = np.array(t.column("vector").to_pylist(), np.float64)
        norms = np.sqrt((x * x).sum(1))
        unit = x / norms[:, None]
        left = np.flatnonzero(tiles == first)
        right = left if same else np.flatnonzero(tiles != first)
        counts, union, links = np.zeros(len(ids), np.int64), Union(len(ids)), []
        if len(left) and len(right):
            qr = quantise(unit[right])
            for lo in range(0, len(left), 512):
                some = left[lo : lo + 512]
                i, j = np.nonzero(possible(quantise(unit[some]), qr, threshold))
                i, j = some[i], right[j]
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                exact = np.concatenate([(x[a] * x[b]).sum(1) / (norms[a] * norms[b]) for a, b in zip(np.array_split(i, len(i) // 65536 + 1), np.array_split(j, len(i) // 65536 + 1), strict=True)])
                i, j = i[exact >= threshold], j[exact >= threshold]
                np.add.at(counts, i, times[j])
                np.add.at(counts, j, times[i])
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if union.join(a, b):
                        links.append((a, b))
        some = np.flatnonzero(counts)
        # a link has both ends; a count of links has v null
        rows = {"u": [int(ids[a]) for a, _ in links] + ids[some].tolist(), "v": [int(ids[b]) for _, b in links] + [None] * len(some), "n": [0] * len(links) + counts[some].tolist()}
        return table(rows, LINKS)

    return link


def link(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    x = vectors.select("vec_id", "label", F.col("embedding").alias("vector"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    fine &= F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    x = scratch.write(x.withColumn("fine", F.coalesce(fine, F.lit(False))), "vectors")
    good = x.filter("fine").withColumn("label", F.struct("label", F.size("vector").alias("size")))
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("times"))
    classes = scratch.write(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy("label").agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    dealt = classes.join(sizes, "label").withColumn("tile", F.pmod(F.xxhash64("class"), "tiles").cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select("label", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "class", "times", "vector")
    found = scratch.write(pairs.groupBy("label", "ta", "tb").applyInArrow(linker(threshold), "u long, v long, n long"), "found")
    counts = found.filter("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("others"))
    comps = components(found.filter("v is not null").select("u", "v"), scratch).withColumnRenamed("node", "class")
    of = classes.join(counts, "class", "left").join(comps, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.join(smallest, "component").select("label", "vector", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    rows = x.withColumn("key", F.when(F.col("fine"), F.struct("label", F.size("vector").alias("size"))))
    out = rows.join(of.withColumnRenamed("label", "key"), ["key", "vector"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
