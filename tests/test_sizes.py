"""Queries on tables whose keys are larger, or whose rows are more, than those of the test data."""

import os
from pathlib import Path

import duckdb
import pytest

from corollary import catalogue
from corollary.engine import Engine
from corollary.operators.fixpoint import Deriver
from corollary.plans.vocabulary import Vocabulary
from corollary.sources.sources import MemSource

from .test_catalogue import SF, table

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def against_sql(spark, folder, name, **tables):
    """The query's rows, which are those of its SQL, where some tables are replaced by SELECTs over `old`."""
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        to = folder / p.name
        if p.stem in tables:
            c.execute(f"COPY ({tables[p.stem].replace('old', f"'{p}'")}) TO '{to}' (FORMAT parquet)")
        else:
            to.symlink_to(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{to}'")
    df = catalogue.queries()[name](spark, str(folder))
    rows = [tuple(r) for r in df.collect()]
    want = c.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert table(rows, df.columns) == table(want.fetchall(), names)
    return rows


def test_digits_of_keys_from_a_million(spark, tmp_path):
    """Their text as values has an exponent; a null key is no whole number."""
    part = "SELECT * REPLACE (CASE WHEN p_partkey < 199 THEN 999900 + p_partkey * 12345 END AS p_partkey) FROM old"
    rows = against_sql(spark, tmp_path, "host_filter_python", part=part)
    assert max(p for (p,) in rows) > 2_000_000 and (None,) not in rows


def no_pairs(*_):
    raise AssertionError("pairs are derived")


def test_paths_of_events_are_counted_without_deriving_them(spark, tmp_path, monkeypatch):
    """All events as those of three users: 500 thousand pairs in chains of hundreds."""
    monkeypatch.setattr(Deriver, "fixpoint", no_pairs)
    events = "SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 7 = 0 THEN 2 ELSE 3 END AS user_id, TIMESTAMP '2024-01-01' + INTERVAL (event_id) SECOND AS ts) FROM old"
    ((n,),) = against_sql(spark, tmp_path, "user_paths", events=events)
    assert n > 200_000


GRAPHS = {
    "chains": [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")],
    "joined": [("a", "c"), ("b", "c"), ("b", "c"), ("c", "d"), ("d", None), (None, "e")],
    "parted": [("a", "b"), ("a", "c"), ("c", "d"), ("c", "e"), ("e", "f")],
    "cycle": [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "y")],
    "self": [("a", "a"), ("b", "c")],
    "both": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")],
    "absent": [("a", None), ("a", "b"), ("b", "c")],
    "empty": [],
}


@pytest.mark.parametrize("name", list(GRAPHS))
def test_counted_closures(spark, monkeypatch, name):
    """The same number as of the pairs derived; pairs of chains and trees are not derived."""
    pairs = set(GRAPHS[name])
    while more := {(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs:
        pairs |= more
    s = MemSource().declare("edge", "from", "to")
    for a, b in GRAPHS[name]:
        s.add("edge", a, b)
    engine = Engine(spark, Vocabulary(s), s)
    if name in ("chains", "joined", "parted"):
        monkeypatch.setattr(Deriver, "fixpoint", no_pairs)
    r = "r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), edge(?b, ?c); r(?a, ?b) => count(?a)"
    assert engine.query(r).texts() == [[str(len(pairs))]]
    h = "e(?x, ?y) :- edge(?x, ?y); r(?a, ?b) :- e(?a, ?b); r(?a, ?c) :- r(?b, ?c), r(?a, ?b); r(?a, ?b) => count(?b), count(?a)"
    assert engine.query(h).texts() == [[str(len(pairs))] * 2]
