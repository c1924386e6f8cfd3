"""How the rows derived and the rounds grow: what a goal does not ask for is not derived."""

import pytest

from corollary.engine import Engine
from corollary.plans.vocabulary import Vocabulary
from corollary.sources.sources import MemSource

LEFT = "r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), edge(?b, ?c); "
RIGHT = "r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- edge(?a, ?b), r(?b, ?c); "
MUCH = 10**9


def chains(spark, count: int, length: int, **options) -> Engine:
    s = MemSource().declare("edge", "from", "to")
    for c in range(count):
        for k in range(length - 1):
            s.add("edge", f"c{c}n{k}", f"c{c}n{k + 1}")
    return Engine(spark, Vocabulary(s), s, **options)


def work(engine, program):
    return engine.query(program, budget=MUCH).work


@pytest.mark.parametrize("rules", [LEFT, RIGHT])
def test_one_chain_of_many(spark, rules):
    asked, all_ = rules + 'r("c0n0", ?x)', rules + "r(?a, ?b) => ?a, ?b"
    assert 20 * work(chains(spark, 20, 12), asked) < 2 * work(chains(spark, 20, 12), all_)


def test_a_bound_start_grows_with_the_chain(spark):
    for rules in (LEFT, RIGHT):
        short, long = (work(chains(spark, 1, n), rules + 'r("c0n0", ?x)') for n in (8, 16))
        assert long <= 2.5 * short
    short, long = (work(chains(spark, 1, n, rewriting=False), LEFT + 'r("c0n0", ?x)') for n in (8, 16))
    assert long > 3.5 * short


def test_near_the_end_little_is_derived(spark):
    e = chains(spark, 1, 100)
    a = e.query(LEFT + 'r("c0n90", ?x)', budget=MUCH)
    assert len(a.texts()) == 9 and a.work < 30
    a = e.query(RIGHT + 'r(?x, "c0n5")', budget=MUCH)
    assert len(a.texts()) == 5 and a.work < 30


def test_rounds_of_a_closure_grow_with_the_logarithm(spark):
    assert chains(spark, 1, 65).query(LEFT + "r(?a, ?b)").rounds <= 8
    assert chains(spark, 1, 17, squaring=False).query(LEFT + "r(?a, ?b)").rounds == 16
