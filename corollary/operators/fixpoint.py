"""Derived relations: sets of rows, recursive ones by semi-naive rounds over DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BudgetExceeded, Stopped
from ..plans.check import Checker
from ..plans.ir import Rule
from .answers import grouped, tidy
from .bodies import CITES, WITNESS, WITNESSES, BodyPlanner, Provenance, Rel
from .lanes import ANY, Cell, Lane, joined, merged


class Work:
    """What an evaluation may still do: rows derived against the host's budget, and the host's word to stop."""

    def __init__(self, budget: int | None = None, cancelled: Callable[[], bool] | None = None):
        self.budget, self.cancelled, self.used = budget, cancelled, 0

    def step(self, rows: int = 0) -> None:
        self.used += rows
        if self.budget is not None and self.used > self.budget:
            raise BudgetExceeded(self.used, self.budget)
        if self.cancelled and self.cancelled():
            raise Stopped()


def spark_type(lane: Lane) -> T.DataType:
    if lane.any:
        return ANY
    return T.StringType() if lane.kind == "text" else T._parse_datatype_string(lane.dtype)


def widened(rel: Rel, lanes: list[Lane]) -> Rel:
    if rel.lanes == lanes:
        return rel
    extra = [c for c in (CITES, WITNESS) if c in rel.df.columns]
    return Rel(rel.df.select(*[rel.cell(k).to(lane).alias(f"c{k}") for k, lane in enumerate(lanes)], *extra), lanes, rel.is_set)


def lanes_of(rels: list[Rel]) -> list[Lane]:
    out = rels[0].lanes
    for r in rels[1:]:
        out = [merged(a, b) for a, b in zip(out, r.lanes, strict=True)]
    return out


def union(rels: list[Rel]) -> Rel:
    lanes = lanes_of(rels)
    df = None
    for r in rels:
        w = widened(r, lanes).df
        df = w if df is None else df.unionByName(w)
    return Rel(df, lanes)


def as_set(rel: Rel) -> Rel:
    """Each tuple once; with provenance the least derivation (earliest rule, then citations) stays."""
    if rel.is_set:
        return rel
    cells = [rel.cell(k) for k in range(len(rel.lanes))]
    carried = [c for c in (CITES, WITNESS) if c in rel.df.columns]
    if not carried and not any(lane.any for lane in rel.lanes):
        return Rel(rel.df.dropDuplicates(), rel.lanes, True)
    keys = [(c.key if c.lane.any else c.c).alias(f"k{k}") for k, c in enumerate(cells)]
    order = [F.col("rule_at")] if "rule_at" in rel.df.columns else []
    ranks = [c.rank.alias(f"r{k}") for k, c in enumerate(cells) if c.lane.any]  # of equal values the number
    least = F.min(F.struct(*order, *[F.col(c) for c in carried], *ranks, *[c.c.alias(f"c{k}") for k, c in enumerate(cells)])).alias("p")
    df = rel.df.groupBy(*keys).agg(least)
    return Rel(df.select(*[F.col(f"p.c{k}").alias(f"c{k}") for k in range(len(cells))], *[F.col(f"p.{c}").alias(c) for c in carried]), rel.lanes, True)


def not_in(rel: Rel, old: Rel) -> DataFrame:
    """Tuples that the old relation lacks."""
    new, seen, on = rel.df, old.df.select(*[F.col(f"c{k}").alias(f"o{k}") for k in range(len(old.lanes))]), F.lit(True)
    for k, lane in enumerate(rel.lanes):
        mine, theirs = rel.cell(k), Cell(F.col(f"o{k}"), old.lanes[k])
        one = joined(mine, theirs)
        if one is None:
            new, seen = new.withColumn(f"k{k}", mine.key), seen.withColumn(f"l{k}", theirs.key)
            one = F.col(f"k{k}").eqNullSafe(F.col(f"l{k}"))
        on = one if k == 0 else on & one
    return new.join(seen, on, "left_anti").select(*rel.df.columns)


class Deriver:
    """Derives the relations of a program, each after those it reads."""

    def __init__(self, engine, checker: Checker, provenance: Provenance, work: Work):
        self.engine, self.checker, self.provenance, self.work = engine, checker, provenance, work
        self.rels: dict[str, Rel | None] = {}
        self.rounds = 0
        self.planner = BodyPlanner(engine.spark, self.relation, self.predicate, provenance, engine)

    def predicate(self, name: str):
        return None if name in self.checker.rules else self.engine.vocabulary.predicate(name)

    def relation(self, name: str) -> Rel | None:
        if name in self.checker.rules:
            return self.rels.get(name)
        return self.engine.base(name, self.provenance)

    def run(self) -> None:
        for group in self.checker.components():
            if self.checker.recursive(group):
                self.fixpoint(group)
            else:
                self.rels[group[0]] = self.once(group[0])
            if self.work.budget is not None:
                for n in group:
                    if self.rels[n] is not None:
                        kept = self.keep(self.rels[n].df)
                        self.rels[n].df = kept
                        self.work.step(kept.count())

    def once(self, name: str) -> Rel | None:
        found = [r for r in (self.rule(x, at=k) for k, x in enumerate(self.checker.rules[name])) if r is not None]
        if not found:
            return None
        out = as_set(union(found)) if len(found) > 1 or not found[0].is_set else found[0]
        self.work.step()
        return self.drop_order(out)

    def drop_order(self, rel: Rel) -> Rel:
        return Rel(rel.df.drop("rule_at"), rel.lanes, rel.is_set) if "rule_at" in rel.df.columns else rel

    def rule(self, r: Rule, overrides: dict[int, Rel] | None = None, at: int = 0) -> Rel | None:
        """A rule's head tuples."""
        if any(t.wildcard for t in r.head.args):
            return None
        needed = {t.agg.var if t.agg else t.var for t in r.head.args} - {""}
        b = self.planner.plan(r.body, needed, not r.aggregates, overrides)
        if b is None:
            return None
        if r.aggregates:
            df, lanes = grouped(b, list(r.head.args), [])
            if self.provenance.witnesses:
                df = df.withColumn(WITNESS, F.to_json(F.struct(F.lit(str(r)).alias("rule"), F.col(CITES).alias("cites"))))
            return Rel(df, lanes, True)
        cells = [b.of(t) for t in r.head.args]
        extra: list[Column] = []
        if self.provenance.any:
            extra = [F.lit(at).alias("rule_at"), tidy(F.col(CITES)).alias(CITES)]
            if self.provenance.witnesses:
                extra.append(derivation(str(r)).alias(WITNESS))
        return Rel(b.df.select(*[c.c.alias(f"c{k}") for k, c in enumerate(cells)], *extra), [c.lane for c in cells])

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows written to the checkpoint folder, so that lineage ends here."""
        self.engine.ensure_checkpoints()
        return df.checkpoint(eager=True)

    def fixpoint(self, group: list[str]) -> None:
        """Semi-naive rounds: every round joins what the last one found with all that is known, and keeps what is new."""
        rules = [(n, k, r) for n in group for k, r in enumerate(self.checker.rules[n])]
        inside = lambda r: [k for k, lit in enumerate(r.body) if lit.pos and lit.pos.relation in group]
        start: dict[str, list[Rel]] = {n: [] for n in group}
        for n, k, r in rules:
            if not inside(r) and (found := self.rule(r, at=k)) is not None:
                start[n].append(found)
        lanes = self.lanes_in(group, rules, {n: lanes_of(x) if x else None for n, x in start.items()})
        delta: dict[str, Rel] = {}
        for n in group:
            if lanes[n] is None:
                self.rels[n] = None
                continue
            first = [widened(r, lanes[n]) if "rule_at" not in r.df.columns else self.widened_ordered(r, lanes[n]) for r in start[n]]
            rel = self.drop_order(as_set(union(first))) if first else self.empty(lanes[n])
            kept = self.keep(rel.df)
            self.rels[n] = delta[n] = Rel(kept, lanes[n], True)
            self.work.step(kept.count() if self.work.budget is not None else 0)
        parts = dict.fromkeys(group, 1)
        while delta:
            self.rounds += 1
            fresh: dict[str, list[Rel]] = {}
            for n, k, r in rules:
                for at in inside(r):
                    changed = delta.get(r.body[at].pos.relation)
                    if changed is not None and (found := self.rule(r, {at: changed}, k)) is not None:
                        fresh.setdefault(n, []).append(self.widened_ordered(found, lanes[n]))
            delta = {}
            for n, found in fresh.items():
                rel = self.drop_order(as_set(union(found)))
                new = self.keep(not_in(rel, self.rels[n]))
                count = new.count() if self.work.budget is not None else int(not new.isEmpty())
                self.work.step(count if self.work.budget is not None else 0)
                if count:
                    delta[n] = Rel(new, lanes[n], True)
            for n, d in delta.items():
                total = self.rels[n].df.unionByName(d.df)
                parts[n] += 1
                if parts[n] % 16 == 0:  # long unions make long plans
                    total = self.keep(total)
                self.rels[n] = Rel(total, lanes[n], True)
            self.work.step()

    def widened_ordered(self, rel: Rel, lanes: list[Lane]) -> Rel:
        extra = [c for c in ("rule_at", CITES, WITNESS) if c in rel.df.columns]
        return Rel(rel.df.select(*[Cell(F.col(f"c{k}"), rel.lanes[k]).to(lane).alias(f"c{k}") for k, lane in enumerate(lanes)], *extra), lanes)

    def empty(self, lanes: list[Lane]) -> Rel:
        fields = [T.StructField(f"c{k}", spark_type(x)) for k, x in enumerate(lanes)]
        if self.provenance.any:
            fields.append(T.StructField(CITES, T.ArrayType(T.StringType())))
        if self.provenance.witnesses:
            fields.append(T.StructField(WITNESS, T.StringType()))
        return Rel(self.engine.spark.createDataFrame([], T.StructType(fields)), lanes, True)

    def lanes_in(self, group: list[str], rules: list, lanes: dict[str, list[Lane] | None]) -> dict[str, list[Lane] | None]:
        """Lanes that hold for all rounds: what the rules make of empty relations with the lanes so far, until nothing widens."""
        while True:
            self.rels |= {n: self.empty(x) if x is not None else None for n, x in lanes.items()}
            before = dict(lanes)
            for n, k, r in rules:
                found = self.rule(r, at=k)
                if found is not None:
                    lanes[n] = found.lanes if lanes[n] is None else [merged(a, b) for a, b in zip(lanes[n], found.lanes, strict=True)]
            if lanes == before:
                return lanes


def derivation(rule: str) -> Column:
    """A witness node: the rule and its children in written order."""
    children = F.transform(F.array_sort(F.col(WITNESSES)), lambda x: x["w"])
    return F.concat(F.lit('{"rule":' + json.dumps(rule) + ',"children":['), F.array_join(children, ","), F.lit("]}"))


