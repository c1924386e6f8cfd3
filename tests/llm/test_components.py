"""Components are whole, on long chains and on hubs."""

from pyspark.sql import functions as F

from corollary.llm.common import Scratch, components


def test_a_chain(spark):
    n = 100_000
    path = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components(path, Scratch(spark, "test"))
    assert got.agg(F.count("*"), F.count_distinct("node"), F.min("component"), F.max("component")).first() == (n, n, 0, 0)


def test_a_star_and_its_tasks(spark):
    """The edges of a hub are dealt to many tasks."""
    n = 60_000
    star = spark.range(1, n).select(F.lit(n).cast("long").alias("u"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(n + 5, n + 9), (n + 5, n + 7)], "u long, v long"))
    got = {(r["component"], r["n"]) for r in components(star, Scratch(spark, "test")).groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, n), (n + 5, 3)}


def test_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "u long, v long"), Scratch(spark, "test")).count() == 0
