"""Every mistake a query can make, with the fragment of its message that hosts match on."""

import pytest

from corollary.engine import Engine
from corollary.errors import BudgetExceeded, QueryError, Stopped
from corollary.functions.builtins import install
from corollary.plans.ir import Build, Cmp, Compare, Pos, Query, Term, V, term
from corollary.plans.ir import Aggregate as Agg
from corollary.plans.parse import parse, parse_rules
from corollary.plans.tools import validate
from corollary.plans.vocabulary import Builtin, Vocabulary
from corollary.sources.sources import MemSource, facts_source


# The fragments on the right are those that hosts match on.  The facts and programs are our own.
FERRIES = """
#: port(name)
port("Aran").
port("Bute").
port("Coll").
#: crosses(from, to)
crosses("Aran", "Bute").
crosses("Bute", "Coll").
#: sails(ship, port)
sails("Heron", "Aran").
sails("Tern", "Coll").
#: berths(port, n)
berths("Aran", 4).
berths("Bute", 9).
"""

BROKEN = [
    # text that does not parse
    ("", "empty query"),
    ("dock(?p) :- port(?p);", "no goal clause (a query needs one clause without"),
    ("port(?p); berths(?p, ?n)", "2 goal clauses; a query asks one goal"),
    ("dock(?p) :- port(?p) :- berths(?p, _); dock(?p)", "has more than one"),
    ('sails("Heron) => ?p', "malformed atom"),
    ("cross ing(?p, ?q) => ?q", "bad relation name"),
    ("berths ?p", "is neither an atom nor a comparison"),
    ("berths(?, ?n) => ?n", "empty variable name"),
    ('berths(?p, ?n), ?p != "Aran => ?n', "unterminated string"),
    ("sails(Heron, ?p) => ?p", 'a term must be a ?variable, a "string", or a number'),
    ("crosses(?p, ?q) => ?q => ?p", "projection separator"),
    ("berths(?p, ?n) => 7", "must be a ?variable or an aggregate"),
    ("berths(?p, ?n) => sum(", "malformed aggregate"),
    ("berths(?p, ?n) => max(9)", "...) expects a ?variable, got"),
    ("berths(?p, ?n) => mode(?n)", "want count/min/max/sum/list"),
    # the tail of an answer
    ("berths(?p, ?n) => ?n offset 1 offset 2", "appears twice after"),
    ("berths(?p, ?n) => ?p, sum(?n) order by ?p having sum(?n) > 1", "not before it (the order is having, order by, limit, offset"),
    ("berths(?p, ?n) => ?n order ?n", "order needs by, as in"),
    ("berths(?p, ?n) => ?n order by limit 1", "order by needs a column, as in"),
    ("berths(?p, ?n) => ?n limit 0", "is not a positive whole number"),
    ("berths(?p, ?n) => ?n limit 2.5", "is not a positive whole number"),
    ("berths(?p, ?n) => ?n offset some", "is not a whole number"),
    ("berths(?p, ?n) => ?p having sum(?n)", "is not a comparison (want an aggregate, an operator and a value, as in"),
    ("berths(?p, ?n) => ?p, sum(?n) having ?p != \"Coll\"", "which is a group key rather than an aggregate"),
    ("berths(?p, ?n) => ?p having min(?n) < max(?n)", "having compares two aggregates"),
    ("berths(?p, ?n) => ?p, sum(?n) having sum(?n) > ?n", "which is not a group key"),
    ("berths(?p, ?n) => ?n order by ?p", "which is not an answer column (sort on a column the projection selects"),
    ("port(?p) => ?p, max(?n)", "which no relation binds"),
    ("crosses(?p, ?q) => ?ship", "a variable used only under negation is existential and cannot be selected"),
    # declared types
    ("d(?p: ) :- port(?p); d(?p)", "empty type declaration"),
    ("d(?p: pier(p)) :- port(?p); d(?p)", "an owner is written kind(?var"),
    ("d(?p: ?ship) :- port(?p); d(?p)", "must name another variable of its head"),
    ('d(4: number) :- port(?p); d(?n)', "only a ?variable can declare a type, not"),
    ('d(?p: {Aran, "Bute"}) :- port(?p); d(?p)', 'must be a "string"'),
    ('d(?p: {"Aran", "Bute"}) :- port(?p); d("Mull")', "(it holds one of: Aran, Bute)"),
    ("d(?n: number) :- berths(_, ?n); d(?n: string) :- port(?n); d(?n)", "as both"),
    ('room(?p, ?n: number) :- berths(?p, ?n); room(?p, "many") => ?p', "it holds a number"),
    ('room(?p, ?n: number) :- berths(?p, ?n); room(?p, ?n), ?n != "many" => ?p', "cannot be compared with"),
    # names and numbers of arguments
    ("prot(?p) => ?p", 'unknown relation "prot"; did you mean "port"?'),
    ("harbour.port(?p) => ?p", 'unknown module "harbour" in "harbour.port"'),
    ("suffix(?p, ?q) => ?p", 'did you mean "str.suffix"?'),
    ("str_glob(?p, ?q) => ?p", 'did you mean "str.glob"?'),
    ("str.prefx(?p, ?q) => ?p", 'did you mean "str.prefix"?'),
    ("str(?p) => ?p", "is a module, not a relation; it holds contains, glob, match, prefix, suffix"),
    ("sails(?ship) => ?ship", 'relation "sails" takes 2 args, got 1'),
    ("port(?p), not crosses(?p, ?p, ?p) => ?p", "negated relation"),
    ("port(?p), not closed(?p) => ?p", "negation over"),
    ("port(?p), str.suffix(?p) => ?p", "str.suffix takes 2 args, got 1"),
    ('far(?p) :- remote(?p); far(?p) => ?p', 'rule "far" reads unknown relation'),
    # rules
    ("sails(?s, ?p) :- port(?p), port(?s); sails(?s, ?p)", "redefines a fact relation"),
    ("absent(?p) :- port(?p); absent(?p)", "redefines a built-in relation"),
    ("str(?p) :- port(?p); port(?p) => ?p", "is a module, not a relation"),
    ("sea.lane(?p, ?q) :- crosses(?p, ?q); port(?p) => ?p", "is a qualified path; a query defines only its own bare relations"),
    ("via(?p) :- port(?p); via(?p, ?q) :- crosses(?p, ?q); via(?p)", "args (arity must be consistent"),
    ("via(?p, ?ship) :- port(?p); via(?p, ?ship) => ?p", "is not bound by a positive body relation"),
    ("most(max(?n)) :- berths(_, ?n); most(?n) :- berths(?p, ?n), port(?p); most(?n)", "aggregates, so it must be the relation's only rule"),
    ("x(?p) :- port(?p), not y(?p); y(?p) :- crosses(?p, _), not x(?p); y(?p)", "rules are not stratifiable (recursion through negation: x, y)"),
    ("x(sum(?n)) :- y(?n); y(?n) :- berths(_, ?n), x(?m); y(?n)", "rules are not stratifiable (recursion through an aggregate: x, y)"),
    # what nothing binds
    ("port(?p), ?n <= 3 => ?p", "comparison operand is unbound (a variable must appear in a relation before it is compared"),
    ("port(?p), ?other = ?p => ?other", "comparison operand is unbound"),
    ('port(?p), str.glob(?ship, "H*") => ?p', "needs all arguments bound (a variable must appear in a relation before"),
    ("port(?p), not sails(?s, ?q) => ?p", "appears only inside the `not`, so the negation has nothing to range over and matches either every row or none"),
    ("not sails(_, ?p) => ?p", "has nothing to range over"),
    # patterns
    ('port(?p), str.glob(?p, "[A") => ?p', "invalid glob"),
    ('port(?p), str.match(?p, "Ar(an") => ?p', "invalid regex"),
    ('port(?p), str.match(?p, "(?<=A)ran") => ?p', "invalid regex"),
]


@pytest.fixture(scope="module")
def ferries(spark):
    s = facts_source(FERRIES)
    return Engine(spark, install(Vocabulary(s)), s)


@pytest.mark.parametrize("program, fragment", BROKEN, ids=range(len(BROKEN)))
def test_messages(ferries, program, fragment):
    with pytest.raises(QueryError) as e:
        ferries.query(program)
    assert str(e.value).startswith("query: ") and fragment in str(e.value)


def test_validation_runs_no_job(ferries):
    for program, fragment in BROKEN[-18:-3]:
        with pytest.raises(QueryError) as e:
            validate(parse(program), ferries.vocabulary)
        assert fragment in str(e.value)
    validate(parse("not sails(_, ?p) => ?p"), ferries.vocabulary, bound=("p",))
    validate(parse("anything(?x)"), Vocabulary())


def test_built_queries(ferries):
    with pytest.raises(QueryError, match="limit -1 offset 0: a row count can't be negative"):
        ferries.query(Build([], [Pos("port", "?p")], "?p", limit=-1))
    with pytest.raises(QueryError, match="having compares two aggregates"):
        ferries.query(Build([], [Pos("port", "?p")], "?p", having=(Compare(term(Agg("count", "p")), ">", term(Agg("count", "p"))),)))
    with pytest.raises(QueryError, match="uses count.* in a literal"):
        ferries.query(Query(goal=(Pos("port", "?p"), Cmp("?p", "=", Agg("count", "p"))), select=(V("p"),)))
    assert ferries.query(Build([], [Pos("berths", "?p", "?n"), Cmp("?n", "<", 5)], "?p")).texts() == [["Aran"]]
    assert Term(var="_").wildcard
    with pytest.raises(QueryError, match="is a goal, which rules alone cannot have"):
        parse_rules("port(?p)")


def test_budget_and_cancel(ferries):
    n = MemSource().declare("n", "x")
    for k in range(10):
        n.add("n", k)
    e = Engine(ferries.spark, Vocabulary(n), n)
    q = "p(?a, ?b, ?c) :- n(?a), n(?b), n(?c); p(?a, ?b, ?c), p(?d, ?e, ?f) => count(?a)"
    with pytest.raises(BudgetExceeded) as x:
        e.query(q, budget=5000)
    assert "evaluation stopped: work passed its budget of 5000" in str(x.value) and x.value.limit == 5000
    assert e.query(q, budget=2_000_000).texts() == [["1e+06"]]
    with pytest.raises(Stopped, match="evaluation stopped: cancelled"):
        e.query(q, cancelled=lambda: True)


def test_source_agreement(spark):
    s = MemSource().declare("a", "x")
    v = Vocabulary(s)
    with pytest.raises(QueryError, match="does not serve"):
        Engine(spark, v, MemSource())
    with pytest.raises(QueryError, match="does not serve"):
        Engine(spark, v, MemSource().declare("a", "x", "y"))
    Engine(spark, v, MemSource().declare("a", "x").declare("extra", "y"))
    with pytest.raises(ValueError, match="takes 1 values"):
        s.add("a", 1, 2)


def test_failed_read_is_tried_again(spark):
    class Flaky(MemSource):
        tries = 0

        def frame(self, spark, path):
            self.tries += 1
            if self.tries == 1:
                raise OSError("no disk")
            return super().frame(spark, path)

    s = Flaky().declare("a", "x").add("a", 1)
    e = Engine(spark, Vocabulary(s), s)
    with pytest.raises(QueryError, match="reading a: no disk"):
        e.query("a(?x)")
    assert e.query("a(?x)").texts() == [["1"]] and e.query("a(?x)").texts() == [["1"]] and s.tries == 2


def test_vocabulary_setup():
    v = Vocabulary(MemSource().declare("a.b", "x").declare("c", "x"))
    fine = Builtin(1, holds=lambda args: True)
    for path, fragment in (("a", "it is already a module holding b"), ("c", "is defined twice"), ("c.d", 'needs "c" to be a module'), ("", "empty path"), ("x..y", "empty segment"), ("x y", "character a query cannot spell")):
        with pytest.raises(QueryError) as e:
            v.add_predicate(path, fine)
        assert fragment in str(e.value)
    for b, fragment in ((Builtin(1), "exactly one of Holds and Gen"), (Builtin(0, holds=lambda a: True), "needs arity >= 1"), (Builtin(2, gen=lambda c, a: []), "declares no Modes"), (Builtin(2, gen=lambda c, a: [], modes=[(True,)]), "has a mode of 1 positions, want 2")):
        with pytest.raises(QueryError) as e:
            v.add_predicate("p", b)
        assert fragment in str(e.value)
    assert not v.has("p") and Vocabulary().hint("x") == "; no relations are installed"
