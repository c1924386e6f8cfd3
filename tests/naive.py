"""A plain evaluator to hold the engine against: backtracking over lists, all rules until nothing is new."""

from __future__ import annotations

import itertools

from corollary.functions.builtins import python_test
from corollary.plans.check import Checker
from corollary.plans.ir import Query, positive_variables
from corollary.plans.tools import prepare
from corollary.values import ABSENT, N, S, Value, equal, holds, order_key


class Naive:
    def __init__(self, vocabulary, facts: dict[str, list[tuple[Value, ...]]]):
        self.vocabulary, self.facts = vocabulary, facts

    def rows_of(self, relation: str):
        return self.derived[relation] if relation in self.derived else self.facts.get(relation, [])

    def fits(self, args, row, env):
        env = dict(env)
        for t, v in zip(args, row, strict=True):
            if t.const is not None:
                if not equal(t.const, v):
                    return None
            elif t.variable:
                if t.var in env:
                    if not equal(env[t.var], v):
                        return None
                else:
                    env[t.var] = v
        return env

    def test(self, atom, env) -> bool:
        values = [t.const if t.const is not None else env[t.var] for t in atom.args]
        if atom.relation == "absent":
            return values[0].absent
        return python_test(atom.relation, values[0].s, values[1].s)

    def is_test(self, atom) -> bool:
        return atom.relation not in self.derived and self.vocabulary.predicate(atom.relation) is not None

    def solve(self, body):
        atoms = [x.pos for x in body if x.pos and not self.is_test(x.pos)]
        checks = [x for x in body if not x.pos or self.is_test(x.pos)]
        envs = [{}]
        for a in atoms:
            envs = [e for env in envs for row in self.rows_of(a.relation) if (e := self.fits(a.args, row, env)) is not None]
        for env in envs:
            if all(self.check(x, env) for x in checks):
                yield env

    def check(self, x, env) -> bool:
        if x.cmp:
            side = lambda t: t.const if t.const is not None else env[t.var]
            return holds(x.cmp.op, side(x.cmp.left), side(x.cmp.right))
        if x.pos:
            return self.test(x.pos, env)
        if self.is_test(x.neg):
            return not self.test(x.neg, env)
        return not any(self.fits(x.neg.args, row, env) is not None for row in self.rows_of(x.neg.relation))

    def aggregate(self, agg, envs) -> Value:
        values = [e[agg.var] for e in envs]
        if agg.func == "count":
            return N(len({v.s for v in values if not v.absent and v.s}) if agg.distinct else len(values))
        if agg.func == "list":
            kept = sorted((v for v in values if not v.absent and v.s), key=order_key)
            texts = [v.s for v in kept]
            return S(" ".join(dict.fromkeys(texts) if agg.distinct else texts))
        numbers = [v.num for v in values if v.num is not None]
        if agg.distinct:
            numbers = list(set(numbers))
        if not numbers:
            return S("")
        return N({"sum": sum, "min": min, "max": max}[agg.func](numbers))

    def groups(self, terms, envs):
        keys = [t for t in terms if t.variable]
        by: dict[tuple, list] = {}
        for e in sorted(envs, key=lambda e: [order_key(e[t.var]) for t in keys]):
            by.setdefault(tuple((e[t.var].absent, e[t.var].s) for t in keys), []).append(e)
        if not keys and not by:
            by[()] = []
        for group in by.values():
            yield group, [self.aggregate(t.agg, group) if t.agg else t.const if t.const is not None else group[0][t.var] for t in terms]

    def derive(self, q: Query, checker: Checker):
        self.derived: dict[str, list[tuple[Value, ...]]] = {n: [] for n in checker.rules}
        for group in checker.components():
            moved = True
            while moved:
                moved = False
                for n in group:
                    for r in checker.rules[n]:
                        if any(t.wildcard for t in r.head.args):
                            continue
                        if r.aggregates:
                            found = [tuple(row) for _, row in self.groups(list(r.head.args), list(self.solve(r.body)))]
                        else:
                            found = [tuple(t.const if t.const is not None else e[t.var] for t in r.head.args) for e in self.solve(r.body)]
                        for row in found:
                            if not any(all(equal(a, b) for a, b in zip(row, old, strict=True)) for old in self.derived[n]):
                                self.derived[n].append(row)
                                moved = moved or checker.recursive(group)

    def eval(self, q: Query, bind: dict[str, Value] | None = None) -> list[list[Value]]:
        q, select, columns, checker = prepare(q, self.vocabulary, bind)
        self.derive(q, checker)
        envs = list(self.solve(q.goal))
        if q.having or any(t.agg for t in select):
            rows = []
            for group, row in self.groups(list(select), envs):
                keys = {t.var: v for t, v in zip(select, row, strict=True) if t.variable}
                if all(holds(h.op, self.aggregate(h.left.agg, group), h.right.const if h.right.const is not None else keys[h.right.var]) for h in q.having):
                    rows.append(row)
        else:
            rows = [[e[t.var] for t in select] for e in envs]
            rows.sort(key=lambda r: [order_key(v) for v in r])
            seen: dict[tuple, list] = {}
            for r in rows:
                seen.setdefault(tuple((v.absent, v.s) for v in r), r)
            rows = list(seen.values())
        if bind:
            left = iter(())
            filled = []
            for r in rows:
                left = iter(r)
                filled.append([bind[t.var] if not t.agg and t.var in bind else next(left) for t in columns])
            rows = filled
        labels = [t.label for t in columns]
        rows.sort(key=lambda r: [order_key(v) for v in r])
        for o in reversed(q.order_by):
            k = labels.index(o.term.label)
            rows.sort(key=lambda r, k=k: order_key(r[k]), reverse=o.desc)
            if o.desc:  # a reversed stable sort would turn ties around
                rows = [r for _, g in itertools.groupby(rows, key=lambda r, k=k: order_key(r[k])) for r in sorted(g, key=lambda r: [order_key(v) for v in r])] if len(q.order_by) == 1 else rows
        rows = rows[q.offset :]
        return rows[: q.limit] if q.limit else rows


__all__ = ["ABSENT", "Naive", "positive_variables"]
