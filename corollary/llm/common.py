"""Helpers shared by the operators: tokens, hashes, shared tables and connected components."""

from __future__ import annotations

import atexit
import contextlib
import functools
import math
import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the controls from tab to carriage return, which bytes.split() uses too.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Characters of text that one chunk of documents holds, about.
CHUNK_CHARS = 8_000_000


class HashCache(dict):
    """64-bit hashes of byte strings; forgets everything when it has grown to `limit` entries."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, key: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = xxhash.xxh3_64_intdigest(key)
        return value


_hashes = HashCache()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every n consecutive entries of h (empty when there are fewer)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - n + 1, seed ^ 0x9E3779B97F4A7C15, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return out


def bucket_of(doc_id: int | None, n: int) -> int:
    """crc32 of the id as text, modulo n; a null id counts as the text 'null'."""
    return zlib.crc32(b"null" if doc_id is None else str(doc_id).encode()) % n


def bucket_column(doc_id: str | Column, n: int) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("null")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; local runs get one of their own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="corollary-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def relieve(jvm) -> None:
    """Collects the driver's JVM where its heap has grown beyond three fifths of what it may take, so that the garbage of many plans goes back to the system."""
    heap = jvm.java.lang.Runtime.getRuntime()
    if 5 * heap.totalMemory() > 3 * heap.maxMemory():
        jvm.System.gc()


@functools.lru_cache(maxsize=1)
def invocation(gateway):
    """The method of a JVM's management that invokes an operation."""
    return next(m for m in gateway.jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")


def managed(gateway, bean: str, operation: str, *words: str):
    """What an operation of the driver JVM's own management gives, for words; py4j itself can't reach the classes behind it."""
    jvm = gateway.jvm

    def array(kind, values):
        out = gateway.new_array(kind, len(values))
        for k, v in enumerate(values):
            out[k] = v
        return out

    text = jvm.java.lang.String
    name = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}")
    args = [name, operation, array(jvm.java.lang.Object, words), array(text, ["java.lang.String"] * len(words))]
    return invocation(gateway).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, args))


@contextlib.contextmanager
def returning(gateway):
    """Collections inside leave at most two fifths of the driver's heap free, and then the C library's free memory goes back to the system too.

    What plans and their compilation free otherwise stays with the process.  Nothing is done where the JVM can't.
    """
    before = {}
    with contextlib.suppress(Py4JError):
        for option, value in (("MinHeapFreeRatio", "20"), ("MaxHeapFreeRatio", "40")):
            before[option] = managed(gateway, "HotSpotDiagnostic", "getVMOption", option).get("value")
            managed(gateway, "HotSpotDiagnostic", "setVMOption", option, value)
    try:
        yield
    finally:
        for option, value in reversed(before.items()):
            with contextlib.suppress(Py4JError):
                managed(gateway, "HotSpotDiagnostic", "setVMOption", option, value)
        with contextlib.suppress(Py4JError):
            managed(gateway, "DiagnosticCommand", "systemTrimNativeHeap")


class Scratch:
    """Tables written to the shared folder, so that later work starts from files and not from lost executors.

    Shuffle files of a write go as soon as the table is there.  `drop` removes tables that nothing
    returned still reads; the rest stay like checkpoints.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    @contextlib.contextmanager
    def cleaning(self):
        before = self.spark.conf.get(self.CLEAN, None)
        self.spark.conf.set(self.CLEAN, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(self.CLEAN)
            else:
                self.spark.conf.set(self.CLEAN, before)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def write(self, df: DataFrame, name: str, *, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        with returning(self.spark.sparkContext._gateway):
            relieve(self.spark.sparkContext._jvm)
        with self.cleaning():
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            p.getFileSystem(conf).delete(p, True)


def chunk_count(docs: DataFrame, column: str = "text", chars: int = CHUNK_CHARS) -> int:
    """How many chunks the documents make, from the whole table's characters."""
    total = docs.agg(F.sum(F.length(column))).first()[0] or 0
    return max(1, math.ceil(total / chars))


def chunk_column(doc_id: str, n: int) -> Column:
    """The chunk of a document: a hash of its id, so that a lost task finds the same chunk again."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(doc_id), F.lit(-1))), F.lit(n)).cast("int")


def free_name(columns: list[str], stem: str) -> str:
    """A column name that is not taken."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def arrow_column(batch, name: str) -> list:
    return batch.column(name).to_pylist()


def table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


#: Parts that the edges of one node are dealt to.
PARTS = 32


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (u long, v long): one row (node, component = smallest reachable node).

    Alternating large-star and small-star contraction: each round is two grouped minima (combined on the map
    side) and equi-joins, so no group is gathered anywhere; rounds grow with the log of the size.  They end when the
    edges are stars: every node has one smaller neighbour or is a centre, never both.
    """
    e = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while not are_stars(e):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = scratch.write(large.filter("u <> v").distinct(), "edges")
        tied = with_least(large)
        small = tied.select("u", F.col("m").alias("v")).unionByName(tied.select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = scratch.write(small.filter("u <> v").distinct(), "edges")
        scratch.drop(e, large)
        e = small
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def are_stars(e: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or a smaller and a larger one, in edges (u, v) with v < u."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(e.select("v", F.lit(0), F.lit(1)).toDF("node", "below", "above"))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1").isEmpty()


def with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest v of their u.

    A node's edges are dealt to parts by their other end.  Parts meet the node's minimum first, a few rows a node, and edges
    that of their part, so that the edges of a hub never meet in one task.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    own = dealt.groupBy("u", "part").agg(F.min("v").alias("least"))
    low = own.select("u", "part").join(own.groupBy("u").agg(F.min("least").alias("m")).hint("merge"), "u")
    return dealt.join(low.hint("merge"), ["u", "part"]).drop("part")
