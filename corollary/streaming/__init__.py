"""Programs over streams: a program without recursion, negation or aggregates is one incremental plan.

A base relation may be a streaming DataFrame.  `answers` gives the goal's solutions as a streaming DataFrame
to be written in append mode: joins with static relations need no state, and order and page do not apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..engine import Engine
from ..errors import QueryError
from ..operators.bodies import Provenance
from ..operators.fixpoint import Deriver, Work
from ..plans.ir import Query
from ..plans.parse import parse
from ..plans.tools import prepare


def answers(engine: Engine, q: Query | str) -> DataFrame:
    q = parse(q) if isinstance(q, str) else q
    q, select, columns, checker = prepare(q, engine.vocabulary)
    stateful = any(lit.neg for body in (q.goal, *(r.body for r in q.rules)) for lit in body) or any(r.aggregates for r in q.rules) or any(t.agg for t in select)
    if stateful or q.having or q.order_by or q.limit or q.offset or any(checker.recursive(g) for g in checker.components()):
        raise QueryError("a stream answers programs of joins, tests and unions only")
    deriver = Deriver(engine, checker, Provenance(), Work())
    for group in checker.components():
        found = [r for r in map(deriver.rule, checker.rules[group[0]]) if r is not None]
        deriver.rels[group[0]] = _union(found)
    b = deriver.planner.plan(q.goal, {t.var for t in select}, False)
    return b.df.select(*[b.cell(t.var).c.alias(t.label) for t in select])


def _union(found):
    from ..operators.fixpoint import union

    return union(found) if found else None


