"""Values, lanes and how they compare, order and group."""

import itertools

import pytest
from pyspark.sql import functions as F

from corollary.engine import Engine, run_json
from corollary.functions.builtins import install
from corollary.operators.lanes import compare, lane_of, literal, num_text
from corollary.plans.vocabulary import Vocabulary
from corollary.sources.sources import MemSource, facts_source
from corollary.values import ABSENT, N, S, Value, equal, holds, number_text

POOL = [ABSENT, N(0), N(1), N(2), N(10), N(-3), N(2.5), S("1"), S("b"), S("B"), S("1a"), S(""), Value("10.0", 10.0), N(5, "V"), N(3, "A")]


def test_number_text(spark):
    want = {300.0: "300", 250000.0: "250000", 1200000.0: "1.2e+06", 123456789.0: "1.23456789e+08", 0.1: "0.1", 0.0001: "0.0001", 0.00012: "0.00012", 0.00001: "1e-05", -2.5: "-2.5", 1e21: "1e+21", 0.0: "0", 999999.5: "999999.5", 1234567.5: "1.2345675e+06"}
    assert {x: number_text(x) for x in want} == want
    df = spark.createDataFrame([(x,) for x in want], "x double")
    assert {r["x"]: r["t"] for r in df.select("x", num_text(F.col("x")).alias("t")).collect()} == want
    whole = [0, 7, -12, 999999, 1000000, 12345678, -1200000]
    df = spark.createDataFrame([(x,) for x in whole], "x bigint")
    assert {r["x"]: r["t"] for r in df.select("x", num_text(F.col("x"), "bigint").alias("t")).collect()} == {x: number_text(float(x)) for x in whole}


def test_comparisons_agree_with_plain_values(spark):
    pairs = list(itertools.product(POOL, POOL))
    one = spark.range(1)
    columns = []
    for k, (a, b) in enumerate(pairs):
        for op in ("<", "<=", "=", "!=", ">", ">="):
            columns.append(compare(literal(a), op, literal(b)).alias(f"{k}{op}"))
    for at in range(0, len(columns), 250):
        row = one.select(*columns[at : at + 250]).first().asDict()
        for name, got in row.items():
            k = int(name.rstrip("<>=!"))
            op = name.lstrip("0123456789")
            assert got == holds(op, *pairs[k]), (pairs[k], op)


def test_mixed_comparisons(spark):
    source = MemSource().declare("v", "x")
    for v in POOL:
        source.add("v", v)
    e = Engine(spark, Vocabulary(source), source)
    found = e.query("v(?x), v(?y), ?x < ?y => count(?x)").rows()[0]["count(x)"].num
    assert found == sum(holds("<", a, b) for a in POOL for b in POOL)
    found = e.query("v(?x), v(?x) => count(?x)").rows()[0]["count(x)"].num
    assert found == sum(equal(a, b) for a in POOL for b in POOL)


def test_order_and_identity(spark):
    s = MemSource().declare("v", "x")
    for v in ("b", 10, "1a", None, 2, "10x"):
        s.add("v", v)
    e = Engine(spark, Vocabulary(s), s)
    assert [r["x"] for r in e.query("v(?x)").rows()] == [ABSENT, N(2), N(10), S("10x"), S("1a"), S("b")]
    assert [r["x"].s for r in e.query("v(?x) => ?x order by ?x desc").rows()] == ["b", "1a", "10x", "10", "2", ""]
    assert e.query("v(?x) => list(?x), count(?x), count(distinct ?x), sum(?x)").texts() == [["2 10 10x 1a b", "6", "5", "12"]]

    s = MemSource().declare("w", "x").add("w", "").add("w", None)
    e = Engine(spark, Vocabulary(s), s)
    assert [r["x"] for r in e.query("w(?x)").rows()] == [ABSENT, S("")]
    assert e.query("w(?x) => ?x, count(?x)").texts() == [["", "1"], ["", "1"]]

    s = MemSource().declare("u", "x").add("u", "1").add("u", 1)
    e = Engine(spark, Vocabulary(s), s)
    assert [r["x"] for r in e.query("u(?x)").rows()] == [N(1)]
    assert [r["x"] for r in e.query("d(?x) :- u(?x); d(?x)").rows()] == [N(1)]


def test_units(spark):
    s = MemSource().declare("volt", "x").declare("amp", "x").add("volt", N(5, "V")).add("amp", N(3, "A")).add("amp", N(5, "A"))
    e = Engine(spark, Vocabulary(s), s)
    assert e.query("volt(?v), amp(?a), ?a < ?v => ?a").texts() == []
    assert e.query("volt(?v), amp(?v) => ?v").texts() == [["5"]]


def test_literals_keep_their_text(spark):
    s = MemSource().declare("v", "k", "n").add("v", "20", 20).add("v", "k2", 2)
    e = Engine(spark, install(Vocabulary(s)), s)
    assert e.query("v(?k, 20.0) => ?k").texts() == [["20"]]
    assert e.query('v(20, ?n) => ?n').texts() == [["20"]]
    assert e.query('c(10.0) :- v(_, 20); c(?x) => ?x').texts() == [["10.0"]]
    assert e.query('c(20.0) :- v(_, 2); c(?x), v(?k, ?x) => ?k').texts() == [["20"]]
    assert e.query('c(20.0) :- v(_, 2); v(?k, ?n), not c(?n) => ?k').texts() == [["k2"]]


def test_absent(spark):
    s = MemSource().declare("pkg", "p", "l").add("pkg", "app", "MIT").add("pkg", "log", "").add("pkg", "util", "Apache-2.0").add("pkg", "api", None)
    e = Engine(spark, install(Vocabulary(s)), s)
    assert e.query("pkg(?p, ?l) => ?l, ?p").df.select("p").toPandas()["p"].tolist() == ["api", "log", "util", "app"]
    assert e.query("pkg(?p, ?l), absent(?l) => ?p").texts() == [["api"]]
    assert e.query("pkg(?p, ?l), not absent(?l) => ?p").texts() == [["app"], ["log"], ["util"]]
    assert e.query('pkg(?p, ?l), str.prefix(?l, "") => ?p').texts() == [["api"], ["app"], ["log"], ["util"]]
    assert e.query('pkg(?p, ?l), ?l != "MIT" => ?p').texts() == [["api"], ["log"], ["util"]]
    assert e.query('pkg(?p, ?l), pkg(?q, ?l), ?p != ?q').texts() == []


def test_blank_aggregates(spark):
    s = MemSource().declare("t", "g", "x").add("t", "a", "text").add("t", "b", 4)
    e = Engine(spark, install(Vocabulary(s)), s)
    assert e.query("t(?g, ?x) => ?g, sum(?x)").texts() == [["a", ""], ["b", "4"]]
    assert e.query("t(?g, ?x) => ?g having sum(?x) != 4").texts() == [["a"]]
    assert e.query("t(?g, ?x) => ?g, sum(?x) order by sum(?x)").texts() == [["b", "4"], ["a", ""]]
    assert e.query("m(?g, sum(?x)) :- t(?g, ?x); m(?g, ?s), absent(?s) => ?g").texts() == []


def test_lanes():
    from pyspark.sql import types as T

    assert lane_of(T.LongType()).dtype == "bigint" and lane_of(T.TimestampType()).kind == "text"
    with pytest.raises(ValueError, match="holds no scalar values"):
        lane_of(T.ArrayType(T.FloatType()))


def test_facts_and_json(spark):
    text = '#: e(from, to)\ne("a", "b"); e("b", 3).  # a comment "with" quotes\ne("a", "b")\n'
    s = facts_source(text)
    assert s.schema("e").labels == ["from", "to"] and len(s.rows["e"]) == 3
    with pytest.raises(ValueError, match="facts line 1"):
        facts_source("e(a)")
    import json

    got = json.loads(run_json(spark, json.dumps({"facts": text, "query": "e(?x, ?y) => ?x, ?y"})))
    assert got == {"columns": ["x", "y"], "rows": [["a", "b"], ["b", "3"]], "cites": [['e("a", "b")'], ['e("b", 3)']]}
    assert "unknown relation" in json.loads(run_json(spark, json.dumps({"facts": text, "query": "f(?x)"})))["error"]
