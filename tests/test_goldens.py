"""Pinned answers over small fact texts."""

from pathlib import Path

import pytest

from corollary.engine import Engine
from corollary.functions.builtins import install
from corollary.plans.vocabulary import Vocabulary
from corollary.sources.sources import facts_source

FACTS = (Path(__file__).parent / "fixtures" / "deps.facts").read_text()


def build(spark, source, **options):
    return Engine(spark, install(Vocabulary(source)), source, **options)


@pytest.fixture(scope="module")
def deps(spark):
    return build(spark, facts_source(FACTS))


NEEDS = "needs(?x, ?y) :- imports(?x, ?y);\nneeds(?x, ?y) :- needs(?x, ?via), imports(?via, ?y);\n"
BACKWARDS = "needs(?x, ?y) :- imports(?x, ?y); needs(?x, ?y) :- imports(?x, ?via), needs(?via, ?y);\n"
BY_HALVES = "needs(?x, ?y) :- imports(?x, ?y); needs(?x, ?y) :- needs(?x, ?via), needs(?via, ?y);\n"
BELOW_APP = "api auth cache config db log util"

#: Programs of our own, and what the facts say to them.
GOLDENS = [
    (NEEDS + 'needs("app", ?below) => ?below', BELOW_APP),
    (BACKWARDS + 'needs("app", ?below) => ?below', BELOW_APP),
    (BY_HALVES + 'needs("app", ?below) => ?below', BELOW_APP),
    (NEEDS + 'needs("cache", ?below) => ?below', "cache config log util"),
    (NEEDS + 'needs(?above, "util") => ?above', "api app auth cache config db legacy log metrics"),
    (NEEDS + 'needs("db", "util")', [""]),
    (NEEDS + 'needs("util", "db")', []),
    (NEEDS + "needs(?x, ?x) => ?x", "cache config"),
    (NEEDS + 'needs("auth", ?below), not imports("auth", ?below) => ?below', "cache util"),
    (NEEDS + "needs(?x, ?y), test(_, ?x), not test(_, ?y) => ?x, count(?y)", ["api 3", "auth 6", "db 3"]),
    ('imports("auth", ?on) => ?on', "config db log"),
    ('imports(?by, "log") => ?by', "api app auth cache db"),
    ("test(_, ?tested) => ?tested", "api auth db util"),
    ('owner(?x, "data"), loc(?x, ?size) => ?size, ?x', ["400 cache", "1500 db"]),
    ("loc(?x, ?size), ?size >= 900 => ?size, ?x", ["900 legacy", "1200 api", "1500 db"]),
    ("loc(?x, ?a), imports(?x, ?y), loc(?y, ?b), ?a < ?b => ?x, ?y", ["api db", "app api", "auth db", "config cache"]),
    ("inside(?x, ?y) :- owner(?x, ?same), imports(?x, ?y), owner(?y, ?same); inside(?x, ?y) => ?y, ?x", ["api app", "util log", "util metrics"]),
    ("owner(?x, _), not imports(?x, _) => ?x", "util"),
    ("owner(?x, ?of), not imports(_, ?x) => ?of, ?x", ["platform metrics", "web app", "web legacy"]),
    ('package(?x), not owner(?x, "platform"), not test(_, ?x) => ?x', "app cache legacy"),
    ("imports(?x, ?y) => ?y, count(?x)", ["api 1", "auth 1", "cache 2", "config 4", "db 2", "log 5", "util 3"]),
    ("imports(?x, ?y) => ?x, count(?y) having count(?y) > 2", ["api 4", "app 3", "auth 3"]),
    ("imports(?x, ?y) => ?x having count(?y) < 2", "config legacy log metrics"),
    ("loc(?x, ?size), owner(?x, ?of) => ?of, sum(?size), count(?x)", ["data 1900 2", "platform 700 4", "security 800 1", "web 2400 3"]),
    ("loc(?x, ?size), owner(?x, ?of) => ?of, max(?size), min(?size)", ["data 1500 400", "platform 250 100", "security 800 800", "web 1200 300"]),
    ("owner(?x, ?of) => max(?of), count(?x), count(distinct ?of)", [" 10 4"]),
    ("test(?t, ?x) => ?x, list(?t)", ["api api_test", "auth auth_fuzz auth_test", "db db_test", "util util_test"]),
    ("imports(?x, ?y), owner(?x, ?of) => ?of, count(?y), count(distinct ?y)", ["data 4 2", "platform 3 2", "security 3 3", "web 8 7"]),
    ('test("no such test", ?x), loc(?x, ?size) => count(?x), max(?size)', ["0 "]),
    ('test("no such test", ?x), loc(?x, ?size) => ?x, count(?x)', []),
    ("heavy(?of, sum(?size)) :- loc(?x, ?size), owner(?x, ?of); heavy(?of, ?all), ?all > 1000 => ?of, ?all", ["data 1900", "web 2400"]),
    ("loc(?x, ?size), owner(?x, ?of) => ?of, max(?size) order by max(?size) desc limit 2", ["data 1500", "web 1200"]),
    ("loc(?x, ?size) => ?size, ?x order by ?size limit 2 offset 7", ["900 legacy", "1200 api"]),
    ('mixed(?v) :- loc(_, ?v), ?v > 800; mixed(?v) :- test(?v, "auth"); mixed(?v)', "900 1200 1500 auth_fuzz auth_test"),
    ('loc(?x, ?size), ?size > "big" => ?x', []),
    ('lines(?x, ?n: number) :- loc(?x, ?n); lines(?x, "250") => ?x', "config"),
    ('owner(?x, ?of), str.glob(?of, "[^dw]*") => ?x', "auth config log metrics util"),
    ('test(?t, _), str.match(?t, "_(fuzz|x)$") => ?t', "auth_fuzz"),
    ('package(?x), str.contains(?x, "g") => ?x', "config legacy log"),
    ('test(?t, ?x), str.prefix(?t, ?x), not str.suffix(?t, "test") => ?t', "auth_fuzz"),
    ('loc(?x, ?size), str.prefix(?size, "15") => ?x', "db log"),
    ("loc(?x, ?size), not absent(?size), ?size < 150 => ?x", "util"),
    ('twice(?x) :- test(_, ?x); twice(?x) :- owner(?x, "web"); twice(?x) => count(?x)', "6"),
    ("_(?x) => ?x", None),
]


@pytest.mark.parametrize("program, want", GOLDENS, ids=range(len(GOLDENS)))
def test_answers(deps, program, want):
    if want is None:
        with pytest.raises(ValueError, match="query: unknown relation"):
            deps.query(program)
        return
    rows = want.split() if isinstance(want, str) else want
    assert [" ".join(r) for r in deps.query(program).texts()] == rows


def test_as_written(spark, deps):
    """Without rewrites the answers are the same."""
    plain = Engine(spark, deps.vocabulary, deps.source, rewriting=False)
    for program, want in GOLDENS[:8]:
        assert plain.query(program).texts() == deps.query(program).texts(), program


def test_bind(deps):
    unowned = "not owner(?x, \"web\") => ?x"
    assert deps.query(unowned, bind={"x": "log"}).texts() == [["log"]]
    assert deps.query(unowned, bind={"x": "app"}).texts() == []
    q = "loc(?x, ?size), owner(?x, ?of) => ?of, max(?size), count(?x)"
    assert deps.query(q, bind={"of": "web"}).texts() == [["web", "1200", "3"]]
    assert deps.query(q, bind={"of": "no one"}).texts() == [["no one", "", "0"]]
    with pytest.raises(ValueError, match=r"cannot bind \?more, \?z: the goal does not use it"):
        deps.query(q, bind={"z": 1, "more": 2})


def test_order_is_default_and_paged(deps):
    q = "loc(?x, ?size) => ?size, ?x"
    every = deps.query(q).texts()
    pages = [deps.query(f"{q} limit 3 offset {k}").texts() for k in (0, 3, 6, 9)]
    assert sum(pages, []) == every and every == sorted(every, key=lambda r: (float(r[0]), r[1]))


def test_columns(deps):
    assert deps.query("test(?t, ?x) => ?x, count(distinct ?t)").labels == ["x", "count(distinct t)"]
    assert deps.query("test(?t, ?x) => ?x, max(?t)").df.columns == ["x", "max(t)"]
