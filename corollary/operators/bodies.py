"""Rule and goal bodies as join plans."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..plans.check import mode_met
from ..plans.ir import Atom, Body, Literal, Term, shown
from ..plans.messages import UNBOUND_OPERAND
from ..plans.vocabulary import Builtin
from ..values import Value
from .lanes import ANY, Cell, Lane, compare, is_constant, joined, literal, same

_fresh = itertools.count()
CITES, WITNESS, WITNESSES = "cites", "witness", "witnesses"
NO_CITES = "array<string>"


def fresh(stem: str = "v") -> str:
    return f"{stem}{next(_fresh)}"


@dataclass
class Rel:
    """A relation's rows: columns c0, c1, ... and, with provenance, `cites` and `witness`."""

    df: DataFrame
    lanes: list[Lane]
    is_set: bool = False
    label: str = ""

    def cell(self, k: int) -> Cell:
        return Cell(F.col(f"c{k}"), self.lanes[k])


@dataclass
class Provenance:
    """What is carried along beside the values."""

    cites: bool = False
    witnesses: bool = False

    @property
    def any(self) -> bool:
        return self.cites or self.witnesses


@dataclass
class Bindings:
    """Solutions of a body so far: a column for each variable."""

    df: DataFrame
    names: dict[str, str] = field(default_factory=dict)
    lanes: dict[str, Lane] = field(default_factory=dict)

    def cell(self, var: str) -> Cell:
        return Cell(F.col(self.names[var]), self.lanes[var])

    def of(self, t: Term) -> Cell:
        return literal(t.const) if t.const is not None else self.cell(t.var)


class BodyPlanner:
    """Compiles bodies.  `relation(name)` gives a relation's rows, None while nothing is known of it."""

    def __init__(self, spark, relation: Callable[[str], Rel | None], predicate: Callable[[str], Builtin | None], provenance: Provenance, engine=None):
        self.spark, self.relation, self.predicate = spark, relation, predicate
        self.provenance, self.engine = provenance, engine

    def plan(self, body: Body, needed: set[str], set_valued: bool, overrides: dict[int, Rel] | None = None) -> Bindings | None:
        """Solutions of the body over the needed variables.

        The next literal is always one that can only take rows away, if its variables are bound; then a generator
        that has its inputs; then the relation with most arguments bound, so that no join lacks a key unless the
        body itself falls apart.  Where the consumer only sees sets, atoms that add nothing are semi-joins.
        Returns None if some relation is not known yet and thus empty.
        """
        overrides = overrides or {}
        todo = list(enumerate(body))
        b: Bindings | None = None
        while todo:
            have = set(b.names) if b else set()
            k, lit = self._next(todo, have)
            todo.remove((k, lit))
            later = needed | {v.var for _, x in todo for v in x.terms() if v.variable}
            if lit.pos and (p := self._builtin(lit.pos)):
                b = self._filter(b, lit.pos, p, False) if p.filters else self._generate(b, lit, p)
            elif lit.pos:
                rel = overrides.get(k) or self.relation(lit.pos.relation)
                if rel is None:
                    return None
                b = self._containing(b, lit, rel, todo) or self._join(b, lit, rel, later, set_valued)
            elif lit.neg:
                b = self._without(b, lit)
            else:
                b = self._compare(b, lit)
            b = self._narrow(b, later)
        if b is None:  # an empty body holds once
            b = Bindings(self._one_row())
        return b

    def _one_row(self) -> DataFrame:
        df = self.spark.range(1).select(F.lit(0).alias(fresh("one")))
        return self._carry(df, F.array().cast(NO_CITES), F.array().cast("array<struct<at:int,w:string>>"))

    def _carry(self, df: DataFrame, cites: Column, wits: Column) -> DataFrame:
        if self.provenance.cites or self.provenance.witnesses:
            df = df.withColumn(CITES, cites)
        return df.withColumn(WITNESSES, wits) if self.provenance.witnesses else df

    def _builtin(self, a: Atom) -> Builtin | None:
        return self.predicate(a.relation)

    def _next(self, todo: list[tuple[int, Literal]], have: set[str]) -> tuple[int, Literal]:
        bound = lambda t: t.const is not None or t.var in have
        positives = {v for _, x in todo if x.pos and not ((p := self._builtin(x.pos)) and p.filters) for v in x.pos.variables}
        for k, x in todo:
            p = self._builtin(x.atom) if x.atom else None
            if x.cmp and all(map(bound, x.terms())):
                return k, x
            if x.pos and p and p.filters and all(map(bound, x.terms())):
                return k, x
            if x.neg and all(v in have or v not in positives for v in x.neg.variables):
                return k, x
        for k, x in todo:
            p = self._builtin(x.pos) if x.pos else None
            if p and not p.filters and mode_met(p, x.pos.args, have):
                return k, x
        best = None
        for k, x in todo:
            if x.pos and not self._builtin(x.pos):
                joined = any(v in have for v in x.pos.variables)
                score = (joined or not have, sum(map(bound, x.pos.args)), -k)
                if best is None or score > best[0]:
                    best = (score, k, x)
        if best is None:
            raise QueryError(UNBOUND_OPERAND)
        return best[1], best[2]

    def _narrow(self, b: Bindings, later: set[str]) -> Bindings:
        kept = {v: n for v, n in b.names.items() if v in later}
        if len(kept) == len(b.names):
            return b
        extra = [c for c in (CITES, WITNESSES) if c in b.df.columns]
        names = [*kept.values(), *extra]
        df = b.df.select(*names) if names else b.df.select(F.lit(0).alias(fresh("one")))
        return Bindings(df, kept, {v: b.lanes[v] for v in kept})

    def scan(self, rel: Rel, a: Atom) -> Bindings:
        """A relation's rows that fit an atom's constants and repeated variables, with a column for each variable."""
        df, names, lanes, conditions, columns = rel.df, {}, {}, [], []
        first: dict[str, int] = {}
        for k, t in enumerate(a.args):
            if t.const is not None:
                conditions.append(is_constant(rel.cell(k), t.const))
            elif t.variable:
                if t.var in first:
                    conditions.append(same(rel.cell(first[t.var]), rel.cell(k)))
                else:
                    first[t.var] = k
        for c in conditions:
            df = df.filter(c)
        for v, k in first.items():
            names[v], lanes[v] = fresh(), rel.lanes[k]
            columns.append(F.col(f"c{k}").alias(names[v]))
        for c in (CITES, WITNESS):
            if c in rel.df.columns:
                columns.append(F.col(c))
        if not columns:
            columns.append(F.lit(0).alias(fresh("one")))
        return Bindings(df.select(*columns), names, lanes)

    def _start(self, s: Bindings, lit: Literal) -> Bindings:
        if self.provenance.witnesses:
            s = replace(s, df=s.df.withColumn(WITNESSES, F.array(F.struct(F.lit(lit.at).alias("at"), F.col(WITNESS).alias("w")))).drop(WITNESS))
        return s

    def _join(self, b: Bindings | None, lit: Literal, rel: Rel, later: set[str], set_valued: bool) -> Bindings:
        s = self.scan(rel, lit.pos)
        if b is None:
            return self._start(s, lit)
        shared = [v for v in s.names if v in b.names]
        new = [v for v in s.names if v not in b.names and v in later]
        if set_valued and not new and not self.provenance.any:
            return self._semi(b, s, shared, "left_semi")
        s = replace(s, df=s.df.select(*[s.names[v] for v in (*shared, *new)], *[c for c in (CITES, WITNESS) if c in s.df.columns])) if shared or new else s
        right = s.df
        if self.provenance.any:
            mine, wit = fresh("cites"), fresh("wit")
            right = right.withColumnRenamed(CITES, mine).withColumnRenamed(WITNESS, wit)
        left, right, on = self._keys(b, Bindings(right, s.names, s.lanes), shared)
        df = left.join(right, on, "inner") if on is not None else left.crossJoin(right)
        if self.provenance.any:
            df = df.withColumn(CITES, F.concat(CITES, mine))
            if self.provenance.witnesses:
                df = df.withColumn(WITNESSES, F.concat(WITNESSES, F.array(F.struct(F.lit(lit.at).alias("at"), F.col(wit).alias("w")))))
        names, lanes = dict(b.names), dict(b.lanes)
        for v in shared:
            lanes[v] = replace(lanes[v], sure=lanes[v].sure or s.lanes[v].sure)
        for v in new:
            names[v], lanes[v] = s.names[v], s.lanes[v]
        extra = [c for c in (CITES, WITNESSES) if c in df.columns]
        keep = [*names.values(), *extra]
        return Bindings(df.select(*keep) if keep else df.select(F.lit(0).alias(fresh("one"))), names, lanes)

    def _containing(self, b: Bindings | None, lit: Literal, rel: Rel, todo: list[tuple[int, Literal]]) -> Bindings | None:
        """A join of two parts that only a test links: that a text of one holds a text of the other.

        A word with a space on either side in the shorter text has one in the longer too, so they meet on the longest such
        word; texts without one meet all.  The test itself still follows.
        """
        if b is None or self.provenance.any or any(v in b.names for v in lit.pos.variables):
            return None
        s = self.scan(rel, lit.pos)
        for _, x in todo:
            if x.pos and x.pos.relation == "str.contains" and (p := self._builtin(x.pos)) and p.filters and all(t.variable for t in x.pos.args):
                text, part = (t.var for t in x.pos.args)
                if text in b.names and part in s.names:
                    return self._meet(b, s, text, part)
                if text in s.names and part in b.names:
                    return self._meet(s, b, text, part)
        return None

    def _meet(self, holds: Bindings, held: Bindings, text: str, part: str) -> Bindings:
        word, key, at = fresh("word"), fresh("key"), fresh("at")
        pieces = F.split(held.cell(part).text, " ")
        inner = F.when(F.size(pieces) > 2, F.slice(pieces, F.lit(2), F.size(pieces) - 2))
        longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
        parts = held.df.withColumn(key, longest)
        keyed, loose = parts.filter(F.col(key) != ""), parts.filter(F.coalesce(F.col(key) == "", F.lit(True)))
        texts = holds.df.withColumn(at, F.xxhash64(holds.cell(text).text))
        # Only hashes of texts go with their words, and only words that are looked for come back.
        words = texts.select(F.col(at), F.explode(F.array_distinct(F.split(holds.cell(text).text, " "))).alias(word))
        found = words.join(keyed.select(key).distinct(), F.col(word) == F.col(key)).select(F.col(at), F.col(key)).distinct()
        names, lanes = holds.names | held.names, holds.lanes | held.lanes
        columns = list(names.values())
        near = texts.join(found, at).join(keyed, key).select(*columns)
        return Bindings(near.unionByName(holds.df.crossJoin(loose).select(*columns)), names, lanes)

    def _keys(self, b: Bindings, s: Bindings, shared: list[str]) -> tuple[DataFrame, DataFrame, Column | None]:
        """Both sides and the join condition: plain null-safe equality of native columns wherever lanes agree."""
        left, right, on = b.df, s.df, None
        for v in shared:
            x, y = b.cell(v), s.cell(v)
            if (one := joined(x, y)) is not None:
                pass
            elif x.lane.canonical and y.lane.canonical:
                k1, k2 = fresh("k"), fresh("k")
                left, right = left.withColumn(k1, x.key), right.withColumn(k2, y.key)
                one = F.col(k1).eqNullSafe(F.col(k2))
            else:
                # Sameness is not transitive here: meet on either text, once, and look again.
                k1, k2, a1, a2 = (fresh("k") for _ in range(4))
                left = left.withColumn(a1, x.keys).withColumn(k1, F.explode(a1))
                right = right.withColumn(a2, y.keys).withColumn(k2, F.explode(a2))
                first = F.element_at(F.array_intersect(a1, a2), 1)
                one = F.col(k1).eqNullSafe(F.col(k2)) & first.eqNullSafe(F.col(k1)) & same(x, y)
            on = one if on is None else on & one
        return left, right, on

    def _semi(self, b: Bindings, s: Bindings, shared: list[str], how: str) -> Bindings:
        if not shared:
            probe = s.df.select(F.lit(1).alias(fresh("one"))).limit(1)
            return replace(b, df=b.df.join(probe, F.lit(True), how))
        loose = any(not (b.lanes[v].canonical and s.lanes[v].canonical) for v in shared)
        if loose:
            on = None
            for v in shared:
                one = same(b.cell(v), s.cell(v))
                on = one if on is None else on & one
            return replace(b, df=b.df.join(s.df.select(*[s.names[v] for v in shared]), on, how))
        left, right, on = self._keys(b, replace(s, df=s.df.select(*[s.names[v] for v in shared])), shared)
        return replace(b, df=left.join(right, on, how).select(*b.df.columns))

    def _compare(self, b: Bindings | None, lit: Literal) -> Bindings:
        b = b or Bindings(self._one_row())
        return replace(b, df=b.df.filter(compare(b.of(lit.cmp.left), lit.cmp.op, b.of(lit.cmp.right))))

    def _filter(self, b: Bindings | None, a: Atom, p: Builtin, negated: bool) -> Bindings:
        b = b or Bindings(self._one_row())
        cells = [b.of(t) for t in a.args]
        if p.column:
            if all(t.const is not None for t in a.args[1:]):
                test = p.column(cells[0], *(t.const for t in a.args[1:]))
            else:
                test = p.column(*cells)
        else:
            test = _python_filter(p.holds)(*(c.mixed for c in cells))
        test = F.coalesce(test, F.lit(False))
        return replace(b, df=b.df.filter(~test if negated else test))

    def _without(self, b: Bindings | None, lit: Literal) -> Bindings:
        b, a, p = b or Bindings(self._one_row()), lit.neg, self._builtin(lit.neg)
        if p and p.filters:
            out = self._filter(b, a, p, True)
        elif p:
            bound = [v for v in a.variables if v in b.names]
            inputs = Bindings(b.df.select(*[b.names[v] for v in bound]).distinct() if bound else self.spark.range(1).select(F.lit(0).alias(fresh("one"))), {v: b.names[v] for v in bound}, {v: b.lanes[v] for v in bound})
            plain = BodyPlanner(self.spark, self.relation, self.predicate, Provenance(), self.engine)
            found = plain._generate(inputs, Literal(pos=a), p)
            renamed = {v: fresh() for v in bound}
            s = Bindings(found.df.select(*[F.col(found.names[v]).alias(renamed[v]) for v in bound]) if bound else found.df, renamed, {v: found.lanes[v] for v in bound})
            out = self._semi(b, s, bound, "left_anti")
        else:
            rel = self.relation(a.relation)
            if rel is None:
                return b
            s = self.scan(Rel(rel.df.select(*[f"c{k}" for k in range(len(rel.lanes))]), rel.lanes), a)
            out = self._semi(b, s, [v for v in s.names if v in b.names], "left_anti")
        if self.provenance.witnesses:
            note = F.array(F.struct(F.lit(lit.at).alias("at"), F.lit(json.dumps({"absent": str(a)})).alias("w")))
            out = replace(out, df=out.df.withColumn(WITNESSES, F.concat(WITNESSES, note)))
        return out

    def _generate(self, b: Bindings | None, lit: Literal, p: Builtin) -> Bindings:
        b, a = b or Bindings(self._one_row()), lit.pos
        if p.frame:
            bound = {k: b.of(t) for k, t in enumerate(a.args) if t.const is not None or t.var in b.names}
            inputs = b.df.select(*[c.c.alias(f"a{k}") for k, c in bound.items()]).distinct() if bound else None
            rel = p.frame(self.engine, inputs, {k: c.lane for k, c in bound.items()}, len(a.args))
            df = rel.df
            if self.provenance.any and CITES not in df.columns:
                df = df.withColumn(CITES, F.array().cast(NO_CITES))
            if self.provenance.witnesses:
                df = df.withColumn(WITNESS, fact_text(shown(a.relation), [Cell(F.col(f"c{k}"), x) for k, x in enumerate(rel.lanes)], F.col(CITES)))
            return self._join(b, lit, Rel(df, rel.lanes), set(a.variables), False)
        call = _python_generator(p.gen)
        given = [b.of(t).mixed if t.const is not None or t.var in b.names else F.lit(None).cast(ANY) for t in a.args]
        out = fresh("t")
        df = b.df.withColumn(out, F.explode(call(F.array(*given))))
        names, lanes = dict(b.names), dict(b.lanes)
        any_lane = Lane("any", canonical=False, dtype="any")
        for k, t in enumerate(a.args):
            cell = Cell(F.get(F.col(f"{out}.vals"), F.lit(k)), any_lane)
            if t.const is not None:
                df = df.filter(same(cell, literal(t.const)))
            elif t.variable and t.var in names:
                df = df.filter(same(cell, Cell(F.col(names[t.var]), lanes[t.var])))
            elif t.variable:
                names[t.var], lanes[t.var] = fresh(), any_lane
                df = df.withColumn(names[t.var], cell.c)
        if self.provenance.any:
            df = df.withColumn(CITES, F.concat(CITES, F.col(f"{out}.cites")))
            if self.provenance.witnesses:
                cells = [Cell(F.get(F.col(f"{out}.vals"), F.lit(k)), any_lane) for k in range(len(a.args))]
                w = fact_text(shown(a.relation), cells, F.col(f"{out}.cites"))
                df = df.withColumn(WITNESSES, F.concat(WITNESSES, F.array(F.struct(F.lit(lit.at).alias("at"), w.alias("w")))))
        return Bindings(df.drop(out), names, lanes)


def fact_text(name: str, cells: list[Cell], cites: Column) -> Column:
    """A witness leaf as JSON: the fact and its citations in order."""
    shown_args = [F.when(c.num.isNotNull(), c.text).otherwise(F.concat(F.lit('"'), c.text, F.lit('"'))) for c in cells]
    text = F.concat(F.lit(f"{name}("), F.concat_ws(", ", *shown_args) if shown_args else F.lit(""), F.lit(")"))
    return F.to_json(F.struct(text.alias("fact"), cites.alias("cites")))


def _value(r) -> Value:
    if r is None or r["absent"]:
        return Value(absent=True)
    return Value(r["s"] or "", r["num"], unit=r["unit"] or "")


def _python_filter(holds):
    return F.udf(lambda *args: bool(holds([_value(a) for a in args])), T.BooleanType(), useArrow=True)


def _python_generator(gen):
    row = T.StructType([T.StructField("vals", T.ArrayType(ANY)), T.StructField("cites", T.ArrayType(T.StringType()))])

    def call(args):
        given = [None if a is None else _value(a) for a in args]
        out = []
        for x in gen(None, given):
            values, cites = x if isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], (list, tuple)) else (x, [])
            if len(values) != len(given):
                raise ValueError(f"query: internal: a generator emitted {len(values)} values for {len(given)} arguments")
            out.append(([(v.s, v.num, v.absent, v.unit) for v in values], list(cites)))
        return out

    return F.udf(call, T.ArrayType(row), useArrow=True)
