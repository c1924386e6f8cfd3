"""Modules, lookup, types, tools, built-ins, generators, provenance and streams."""

import json

import pytest
from pyspark.sql import functions as F

from corollary.engine import Engine
from corollary.errors import ModuleError, QueryError
from corollary.functions.builtins import install, predicates, python_test
from corollary.functions.patterns import glob_to_java, regex_to_java
from corollary.functions.reach import reach
from corollary.plans.ir import ArgType, Schema
from corollary.plans.modules import RuleLanguage
from corollary.plans.parse import parse
from corollary.plans.tools import column_kinds, non_injective_rules, reads
from corollary.plans.vocabulary import Builtin, Vocabulary
from corollary.sources.sources import FrameSource, MemSource
from corollary.values import N, S

NET, COMPONENT, TEXT = ArgType(kind="net"), ArgType(kind="component"), ArgType(type="string")


def circuit() -> MemSource:
    s = MemSource()
    s.declare_schema("component.class", Schema(2, ["ref_des", "class"], [COMPONENT, TEXT], "what a component is"))
    s.declare_schema("component.net", Schema(2, ["ref_des", "net"], [COMPONENT, NET]))
    s.declare_schema("component.pin", Schema(2, ["ref_des", "pin"], [COMPONENT, ArgType(kind="pin", owner="ref_des")]))
    s.declare_schema("net.max_voltage", Schema(2, ["net", "volts"], [NET, ArgType(type="number", unit="V")]))
    s.declare_schema("entity", Schema(2, ["name", "kind"], [ArgType(kind_from="kind"), ArgType(domain=("component", "net", "bus"))]))
    s.add("component.class", "L1", "ferrite").add("component.net", "L1", "VBUS").add("component.pin", "L1", 3)
    return s.add("net.max_voltage", "VBUS", N(5, "V")).add("entity", "VBUS", "net")


MODULE = """
# A ferrite's net.
# Two lines of words.
ferrite_net(?n) :- _ferrite(?r), component.net(?r, ?n);

# Not above a rule.

_ferrite(?r) :- component.class(?r, "ferrite");
volts(?n, max(?v)) :- ferrite_net(?n), net.max_voltage(?n, ?v);
"""


def vocabulary(source) -> Vocabulary:
    v = install(Vocabulary(source))
    v.add_language(RuleLanguage())
    return v


def test_modules(spark):
    s = circuit()
    v = vocabulary(s)
    v.add_module("power", "rules", MODULE, "power.dl")
    e = v.lookup("power.ferrite_net")
    assert e.signature() == "power.ferrite_net(n: net)" and e.doc == "A ferrite's net. Two lines of words." and e.origin == "power.dl" and e.args[0].inferred
    assert e.definition == ["ferrite_net(?n) :- _ferrite(?r), component.net(?r, ?n)"]
    assert v.lookup("power").members == ["power.ferrite_net", "power.volts"]
    assert v.lookup("power.volts").signature() == "power.volts(n: net, arg1: number[V])"
    assert [m.path for m in v.members_of("component")] == ["component.class", "component.net", "component.pin"]
    assert v.lookup("").members == ["absent", "component", "entity", "net", "power", "str"]
    assert v.lookup("component.class").doc == "what a component is" and v.lookup("str.glob").kind == "predicate"
    engine = Engine(spark, v, s)
    assert engine.query("power.volts(?n, ?v)").texts() == [["VBUS", "5"]]
    assert engine.query("power.ferrite_net(?n), net.max_voltage(?n, ?v), ?v >= \"5\" => ?v").texts() == [["5"]]
    assert reads(parse("power.ferrite_net(?n)"), v) == ["component.class", "component.net"]
    for path, fragment in (("power._ferrite", "unknown relation"), ("power.ferite_net", 'did you mean "power.ferrite_net"'), ("powr.volts", 'unknown module "powr"'), ("volts", 'did you mean "power.volts"')):
        with pytest.raises(QueryError) as x:
            engine.query(f"{path}(?n)")
        assert fragment in str(x.value)
    with pytest.raises(QueryError, match='redefines a derived relation registered in module "power"'):
        engine.query("power.volts(?n, ?v) :- net.max_voltage(?n, ?v); power.volts(?n, ?v)")
    with pytest.raises(QueryError, match='"power.volts" is a derived, not a module'):
        v.members_of("power.volts")


def test_broken_modules():
    s = circuit()
    for text, fragment in (
        ("r(?x) :- nope(?x);", "reads unknown relation"), ("r(?x)", "is a goal, which rules alone cannot have"), ("a.r(?x) :- entity(?x, _);", "is qualified, and members are written bare"),
        ("r(?x) :- entity(?x, _); r(?x, ?y) :- entity(?x, ?y);", "args (arity must be consistent)"), ("r(?x: number) :- component.net(_, ?x);", "but its rules make it net"),
    ):
        v = vocabulary(s)
        with pytest.raises(ModuleError) as e:
            v.add_module("m", "rules", text, "m.dl")
            v.check()
        assert fragment in str(e.value) and e.value.path == "m" and e.value.origin == "m.dl"
    v = vocabulary(s)
    with pytest.raises(QueryError, match="no language of that name"):
        v.add_module("m", "other", "")
    with pytest.raises(QueryError, match='language "rules" is already registered'):
        v.add_language(RuleLanguage())
    with pytest.raises(QueryError, match='needs "entity" to be a module'):
        v.add_module("entity", "rules", "r(?x) :- entity(?x, _);")
    assert not v.has("entity.r")


def test_module_files(tmp_path, spark):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.dl").write_text("kinds(?k) :- entity(_, ?k);\n")
    (tmp_path / "a" / "two.dl").write_text("names(?n) :- entity(?n, ?k), kinds(?k);\n")
    (tmp_path / "a" / "b" / "deep.dl").write_text("all(?n) :- a.names(?n);\n")
    s = circuit()
    v = vocabulary(s)
    v.add_modules(tmp_path, "rules")
    assert Engine(spark, v, s).query("a.b.all(?n)").texts() == [["VBUS"]]
    v = vocabulary(s)
    (tmp_path / "a" / "two.dl").write_text("names(?n) :- entity(?n, ?k), a.one.kinds(?k);\n")
    (tmp_path / "a" / "b" / "deep.dl").write_text("all(?n) :- a.two.names(?n);\n")
    v.add_modules(tmp_path, "rules", by="file")
    assert Engine(spark, v, s).query("a.b.deep.all(?n)").texts() == [["VBUS"]]
    (tmp_path / "bad.dl").write_text("oops(")
    v = vocabulary(s)
    with pytest.raises(QueryError):
        v.add_modules(tmp_path, "rules", by="file")
    assert not v.is_module("a")


def test_types():
    v = vocabulary(circuit())
    kinds = lambda text: column_kinds(parse(text), v)
    a, b = kinds('component.class(?r, "ferrite"), component.net(?r, ?n) => ?r, ?n')
    assert (a.kind, b.kind) == ("component", "net")
    a, b = kinds("component.pin(?r, ?p) => ?p, count(?r)")
    assert (a.kind, a.owner.var, b.type) == ("pin", "r", "number")
    assert kinds("entity(?x, ?k) => ?x")[0].kind_from == "k" and kinds('entity(?x, "net") => ?x')[0].kind == "net"
    assert kinds("net.max_voltage(?n, ?v) => ?v")[0].unit == "V" and kinds("net.max_voltage(?n, ?v) => list(?v)")[0].type == "string"
    assert kinds("r(?x) :- component.net(_, ?x); r(?x) :- component.class(?x, _); r(?x)")[0].kind == ""
    assert kinds("r(?x) :- component.net(_, ?x); r(?y) :- r(?x), component.net(?z, ?x), component.net(?z, ?y); r(?x)")[0].kind == "net"
    assert str(ArgType(kind="pin", owner="r")) == "pin(?r)" and str(ArgType(type="number", unit="V")) == "number[V]" and str(ArgType(domain=("a", "b"))) == '{"a", "b"}'
    with pytest.raises(QueryError, match=r'cannot be "nett" \(it holds one of: component, net, bus\), did you mean "net"\?'):
        Engine.query(_engine_without_spark(v), 'entity(?x, "nett")')


def _engine_without_spark(v):
    e = Engine.__new__(Engine)
    e.vocabulary = v
    return e


def test_tools():
    assert non_injective_rules(parse("two(?n) :- pin(?a, ?n), pin(?b, ?n); two(?n)")) == ["two"]
    assert non_injective_rules(parse("two(?n) :- pin(?a, ?n), pin(?b, ?n), ?b != ?a; two(?n)")) == []
    assert non_injective_rules(parse('s(?h) :- on(?r, ?h), suffix(?h, "H"), suffix(?l, "L"), on(?r, ?l); s(?h)')) == ["s"]
    assert non_injective_rules(parse('s(?h) :- suffix(?h, "H"), suffix(?l, "L"); s(?h)')) == []
    for text in (
        'r(?x: net, ?v: number[V], ?k: {"a", "b"}, ?p: pin(?x), ?y: ?k) :- a.b(?x, ?v, ?k, ?p, ?y), not c(?x, _), ?v >= 1e3, ?x != "s";\nr(?x, ?v, ?k, _, _) => ?x, count(distinct ?v), list(?k) having count(?k) > 2, max(?v) != 10.0 order by count(distinct ?v) desc, ?x limit 3 offset 2',
        "n(?x, count(?y)) :- e(?x, ?y);\nn(?x, ?c)",
    ):
        q = parse(text)
        assert parse(str(q)) == q
    q = parse("e(?a,,?b,) => ?a, # columns\n ?b limit 1")
    assert len(q.goal[0].pos.args) == 2 and q.limit == 1 and parse('e("#;=>(", 1e3) => count(?x)').goal[0].pos.args[0].const == S("#;=>(")


GLOBS = [
    ("*", "", True), ("*", "a/b\nc", True), ("a*c", "abc", True), ("a*c", "abcd", False), ("a?c", "abc", True), ("a?c", "ac", False), ("[abc]", "b", True), ("[a-c]x", "bx", True),
    ("[^a-c]x", "bx", False), ("[^a-c]x", "dx", True), ("[]a]", "]", True), ("[^]]", "]", False), ("a.c", "abc", False), ("a.c", "a.c", True), ("A", "a", False), ("a\\*", "a\\bc", True),
    ("[a-]", "-", True), ("(x)", "(x)", True), ("é?", "éü", True), ("", "", True), ("", "a", False), ("[*]", "*", True), ("[*]", "a", False), ("**", "ab", True), ("$^", "$^", True),
]


def test_patterns(spark):
    for pattern, s, want in GLOBS:
        assert python_test("str.glob", s, pattern) == want, (pattern, s)
    row = spark.range(1).select(*[F.lit(s).rlike(glob_to_java(p)).alias(str(k)) for k, (p, s, _) in enumerate(GLOBS)]).first()
    assert list(row) == [want for *_, want in GLOBS]
    for bad in ("[", "[a", "[^]", "[b-a]", "x[]"):
        with pytest.raises(QueryError, match="invalid glob"):
            glob_to_java(bad)
    cases = [("b$", "ab\n", False), ("b$", "ab", True), ("a.b", "a\rb", True), ("a.b", "a\nb", False), ("(?P<x>a)b", "ab", True), ("[a&&b]", "&", True), ("[[a]", "[", True), ("[]a]", "]", True), ("[^]a]", "]", False), ("(?i)AB", "xab", True), ("[[:digit:]]+", "a1", True), ("a{2}", "aa", True), ("\\bfoo\\b", "a foo b", True), ("x|y$", "zy", True)]
    row = spark.range(1).select(*[F.lit(s).rlike(regex_to_java(p)).alias(str(k)) for k, (p, s, _) in enumerate(cases)]).first()
    assert list(row) == [want for *_, want in cases]
    for bad in ("(", "a++", "(?=a)", "(?<!a)b", "(a)\\1", "(?>a)", "["):
        with pytest.raises(QueryError, match="invalid regex"):
            regex_to_java(bad)


def test_patterns_from_data(spark):
    s = MemSource().declare("p", "s", "g").add("p", "abc", "a*").add("p", "xbc", "a*").add("p", "a1", "a[0-9]")
    e = Engine(spark, install(Vocabulary(s)), s)
    assert e.query("p(?s, ?g), str.glob(?s, ?g) => ?s").texts() == [["a1"], ["abc"]]
    assert e.query("p(?s, ?g), str.match(?s, ?g) => ?s").texts() == [["a1"], ["abc"], ["xbc"]]
    assert set(predicates()) == {"str.contains", "str.prefix", "str.suffix", "str.glob", "str.match", "absent"}


def walk_source(spark):
    rows = [("a", "b", ["ab"]), ("b", "c", ["bc"]), ("c", "a", ["ca"]), ("c", "d", ["cd"]), ("x", "y", ["xy"])]
    return FrameSource().add("edge", spark.createDataFrame(rows, "from string, to string, __cites array<string>")).add("start", spark.createDataFrame([("a",), ("x",)], "n string"))


def test_reach(spark):
    s = walk_source(spark)
    v = install(Vocabulary(s))
    v.add_predicate("reach", reach("edge"))
    v.add_predicate("within", reach("edge", reflexive=True))
    e = Engine(spark, v, s)
    assert e.query('reach("a", ?x)').texts() == [["a"], ["b"], ["c"], ["d"]]
    assert e.query('reach(?x, "d")').texts() == [["a"], ["b"], ["c"]]
    assert e.query('reach("a", "d")').holds() and not e.query('reach("d", "a")').holds()
    assert e.query('within("d", ?x)').texts() == [["d"]] and e.query("start(?s), reach(?s, ?x) => ?s, ?x").texts() == [["a", "a"], ["a", "b"], ["a", "c"], ["a", "d"], ["x", "y"]]
    assert e.query('start(?s), not reach(?s, "d") => ?s').texts() == [["x"]]
    paths = {r["x"]: r["cites"] for r in e.query('reach("a", ?x)', cites=True).df.collect()}
    assert sorted(paths["d"]) == ["ab", "bc", "cd"]
    with pytest.raises(QueryError, match="nothing binds what reach needs first: it needs from or to"):
        e.query("reach(?x, ?y)")


def test_generators_and_host_filters(spark):
    s = MemSource().declare("n", "x").add("n", 1).add("n", 4)

    def below(context, args):
        for k in range(int(args[0].num)):
            yield [args[0], N(k)], [f"below:{k}"]

    v = install(Vocabulary(s))
    v.add_predicate("below", Builtin(2, ["of", "is"], gen=below, modes=[(True, False)]))
    v.add_predicate("small", Builtin(1, ["x"], holds=lambda args: args[0].num < 2))
    e = Engine(spark, v, s)
    assert e.query("below(?x, ?y), n(?x) => ?x, ?y").texts() == [["1", "0"], ["4", "0"], ["4", "1"], ["4", "2"], ["4", "3"]]
    assert e.query("n(?x), below(?x, 2) => ?x").texts() == [["4"]]
    assert e.query("n(?x), not below(?x, 2) => ?x").texts() == [["1"]]
    assert e.query("n(?x), small(?x) => ?x").texts() == [["1"]] and e.query("n(?x), not small(?x) => ?x").texts() == [["4"]]
    assert e.query("n(?x), below(?x, ?y) => ?x, count(?y)").texts() == [["1", "1"], ["4", "4"]]
    assert e.query("n(1), below(1, ?y) => ?y", cites=True).df.first()["cites"] == ["below:0"]


def test_provenance(spark):
    s = walk_source(spark)
    e = Engine(spark, install(Vocabulary(s)), s)
    rows = e.query('edge(?a, ?b), edge(?b, ?c) => ?a, ?c', cites=True).df.collect()
    assert {(r["a"], r["c"]): r["cites"] for r in rows}[("a", "c")] == ["ab", "bc"]
    rules = "r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), edge(?b, ?c);"
    rows = {r["b"]: r for r in e.query(rules + 'r("a", ?b), not edge(?b, "zz") => ?b', witnesses=True).df.collect()}
    assert sorted(rows["d"]["cites"]) == ["ab", "bc", "cd"]
    proof = json.loads(rows["c"]["witness"])
    assert proof[0]["rule"].startswith("r(?a, ?c)") and proof[0]["children"][1] == {"fact": 'edge("b", "c")', "cites": ["bc"]} and "absent" in proof[1]
    assert e.query("edge(?a, ?b) => count(?a)", cites=True).df.first()["cites"] == ["ab", "bc", "ca", "cd", "xy"]
    assert sorted(r["b"] for r in e.query(rules + 'r("a", ?b)', cites=True).df.collect()) == ["a", "b", "c", "d"]


def test_plans(spark, tmp_path):
    """Filters and columns reach the scan; equal keys are equi-joins; a whole class of programs needs no cross join."""
    spark.range(1000).selectExpr("id AS a", "id % 7 AS b", "cast(id as string) AS c").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    s = FrameSource().add("t", t)
    e = Engine(spark, install(Vocabulary(s)), s)
    plan = e.explain("t(?a, 3, _) => ?a")
    assert "EqualTo(b,3)" in plan and "ReadSchema: struct<a:bigint,b:bigint>" in plan
    plan = e.explain("t(?a, ?b, _), t(?b, ?d, _), t(?d, ?f, ?g), ?a < ?g => ?a, ?g")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "LeftSemi" in e.explain("t(?a, ?b, _), t(?b, _, _) => ?a") and "LeftAnti" in e.explain("t(?a, ?b, _), not t(?b, ?a, _) => ?a")
    assert "TakeOrderedAndProject" in e.explain("t(?a, ?b, _) => ?a order by ?a desc limit 5 offset 2")


def test_stream(spark, tmp_path):
    from corollary.streaming import answers

    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in"))
    s = FrameSource().add("event", stream).add("name", spark.createDataFrame([("a", "first")], "v string, n string"))
    e = Engine(spark, install(Vocabulary(s)), s)
    q = answers(e, 'r(?k, ?n) :- event(?k, ?v), name(?v, ?n); r(?k, "none") :- event(?k, "b"); r(?k, ?n) => ?k, ?n')
    run = q.writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("answers").collect())) == [(1, "first"), (2, "none")]
    with pytest.raises(QueryError, match="a stream answers"):
        answers(e, "event(?k, ?v) => count(?k)")


def test_containing_texts_meet_on_a_word(spark):
    """Texts that hold others: by an inner word, by less than that, at their ends, several times, and absent."""
    s = MemSource().declare("doc", "d", "t").declare("item", "i", "b")
    texts = ["the quick brown fox jumps", "a quick brown fox", "quick  brown", "fox", "", "brown fox jumps over", "xquick brown foxes", "the quick brown fox jumps"]
    items = ["quick brown fox", "fox", "brown", "", "k brown f", "the  quick", "ck  br", "quick brown fox jumps", "quick brown", " fox "]
    for k, t in enumerate(texts):
        s.add("doc", k, t)
    for k, t in enumerate(items):
        s.add("item", k, t)
    e = Engine(spark, install(Vocabulary(s)), s)
    want = sorted((d, i) for d, t in enumerate(texts) for i, b in enumerate(items) if b in t)
    for q in ("doc(?d, ?t), item(?i, ?b), str.contains(?t, ?b) => ?d, ?i", "item(?i, ?b), str.contains(?t, ?b), doc(?d, ?t) => ?d, ?i"):
        assert [(int(d), int(i)) for d, i in e.query(q).texts()] == want
