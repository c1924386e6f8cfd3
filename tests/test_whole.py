"""Queries that cover their whole tables, on data with more rows than any fixed range of ids."""

import os
from pathlib import Path

import duckdb
import pytest

from corollary import catalogue

from .test_catalogue import table

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same_as_sql(spark, duck, name):
    """The query's rows, which are those of its SQL."""
    df = catalogue.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert table(rows, df.columns) == table(want.fetchall(), names)
    return rows


def test_cycles_of_all_suppliers(spark, duck):
    rows = same_as_sql(spark, duck, "cyclic_closure_all")
    suppliers = {k for (k,) in duck.execute("SELECT s_suppkey FROM supplier").fetchall()}
    assert {a for a, b in rows if a == b} == suppliers and len(suppliers) > 12


def test_comparisons_in_a_recursion_over_all_parts(spark, duck):
    rows = same_as_sql(spark, duck, "recursion_compare_all")
    whole = duck.execute(catalogue.oracle_sql()["closure_all"]).fetchall()
    assert max(b for _, b in rows) > 500 and set(rows) < set(whole)
    assert any((b - 1) // 2 != a for a, b in rows)


def test_the_whole_nonlinear_closure(spark, duck):
    rows = same_as_sql(spark, duck, "nonlinear_closure_all")
    parts = {k for (k,) in duck.execute("SELECT p_partkey FROM part WHERE p_partkey > 0").fetchall()}
    assert {b for _, b in rows} == parts and len(rows) == 17964


def test_generations_of_all_parts(spark, duck):
    rows = same_as_sql(spark, duck, "same_generation_all")
    below_a_root = {k for (k,) in duck.execute("SELECT p_partkey FROM part WHERE p_partkey % 15 > 0").fetchall()}
    assert {x for x, _ in rows} == below_a_root and {n for _, n in rows} >= {2, 4, 8}
