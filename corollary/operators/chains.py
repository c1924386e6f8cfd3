"""How many pairs a transitive closure has, without deriving them, where every node leads to one other at most."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bodies import Rel
from .lanes import Cell, joined

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Tables in the folder of checkpoints; shuffle files of a write go as soon as the table is there."""

    def __init__(self, engine):
        engine.ensure_checkpoints()
        self.spark, self.n = engine.spark, 0
        self.root = f"{engine.spark.sparkContext.getCheckpointDir()}/chains-{uuid.uuid4().hex}"

    @contextlib.contextmanager
    def cleaning(self):
        before = self.spark.conf.get(CLEAN, None)
        self.spark.conf.set(CLEAN, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(CLEAN) if before is None else self.spark.conf.set(CLEAN, before)

    def write(self, df: DataFrame, *by: str) -> tuple[str, DataFrame]:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with self.cleaning():
            df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def steps(engine, edges: Rel, work) -> tuple[int, int] | None:
    """The number of pairs joined by one or more edges, and of rounds taken.

    Where no node has two successors (or none two predecessors: then the other way round) and there is no cycle, a node is
    joined with as many nodes as it takes steps to the end.  Each round doubles how far a node has gone, so a chain of n
    takes log n rounds of one row a node.  None for other graphs, whose pairs are to be derived.
    """
    if any(lane.any or lane.blank for lane in edges.lanes) or edges.lanes[0].kind != edges.lanes[1].kind:
        return None
    tables = Tables(engine)
    try:
        for near, far in ((0, 1), (1, 0)):
            if (found := _walked(tables, edges, near, far, work)) is not None:
                return found
        return None
    finally:
        tables.drop(tables.root)


def _walked(tables: Tables, edges: Rel, near: int, far: int, work) -> tuple[int, int] | None:
    to, no = F.col(f"c{far}"), F.col(f"c{far}").isNull()
    nodes = edges.df.groupBy(F.col(f"c{near}").alias("node")).agg(F.min(to).alias("to"), F.max(to).alias("last"), F.min(no).alias("some"), F.max(no).alias("none"))
    start, nodes = tables.write(nodes)
    if not nodes.filter(~F.col("to").eqNullSafe(F.col("last")) | (F.col("some") != F.col("none"))).isEmpty():
        tables.drop(start)
        return None
    n, rounds, ended = nodes.count(), 0, []
    path, open_ = start, nodes.select("node", "to", F.lit(1).cast("long").alias("n"))
    nowhere = F.lit(None).cast(open_.schema["to"].dataType)
    on = joined(Cell(F.col("to"), edges.lanes[far]), Cell(F.col("at"), edges.lanes[near]))
    while not open_.isEmpty():
        if 1 << rounds > n:  # further than there are nodes: a cycle
            return None
        work.step()
        rounds += 1
        known = open_.withColumn("open", F.lit(True))
        for x in ended:
            known = known.unionByName(x.withColumn("to", nowhere).withColumn("open", F.lit(False)))
        known = known.select(F.col("node").alias("at"), F.col("to").alias("on"), F.col("n").alias("more"), "open")
        gone = open_.join(known, on, "left").select("node", F.col("on").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("open", F.lit(False)).alias("open"))
        before, (path, gone) = path, tables.write(gone, "open")
        tables.drop(before if rounds == 1 else f"{before}/open=true")
        ended.append(gone.filter(~F.col("open")).select("node", "n"))
        open_ = gone.filter("open").drop("open")
    return sum(x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in ended), rounds
