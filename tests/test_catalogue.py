"""Every registered query of the engine against SQL, and the layers of the package."""

import datetime
import math
import os
import re
from pathlib import Path

import duckdb
import pytest

from corollary import catalogue

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 3) if isinstance(v, (int, float)) and not isinstance(v, bool) else v.isoformat() if isinstance(v, datetime.datetime) else v


def table(rows, names):
    order = sorted(names)
    return sorted((tuple(plain(dict(zip(names, r, strict=True))[n]) for n in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalogue.ITEMS))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = table([tuple(r) for r in df.collect()], df.columns)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns) and got == table(want.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["a", "qty"] and df.count() > 10
    assert set(catalogue.ITEMS) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_layers():
    """Only the entry module knows the optional subpackage; programs know nothing of plans that run them."""
    for p in (REPO / "corollary").rglob("*.py"):
        text = p.read_text()
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)[^\n]*\bllm\b", text, re.MULTILINE), p
        if "plans" in p.parts:
            assert not re.search(r"^from (\.\.operators|\.\.engine|pyspark)", text, re.MULTILINE), p
