"""Projection, aggregation, order and page of solved bodies."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ir import Aggregate, Compare, Order, Term
from .bodies import CITES, WITNESSES, Bindings
from .lanes import TEXT, Cell, Lane, compare, literal, number


COUNT = replace(number("bigint"), sure=True)


def tidy(cites: Column) -> Column:
    """Citations as a sorted set, without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(cites, lambda c: c.isNotNull() & (c != ""))))


def aggregate_column(a: Aggregate, cell: Cell) -> tuple[Column, Lane]:
    if a.func == "count":
        if a.distinct:
            return F.count_distinct(F.when(cell.text != "", cell.text) if cell.lane.kind != "num" else cell.c), COUNT
        return F.count(F.lit(1)), COUNT
    if a.func == "list":
        return _list(a, cell), replace(TEXT, sure=True)
    blank = lambda dtype: Lane("num", cell.lane.unit, dtype, blank=True)
    if cell.lane.kind == "text":
        return F.max(F.lit(None).cast("double")), blank("double")
    x = cell.num
    if a.func == "sum":
        x = x.cast("double")
        return (F.sum_distinct(x) if a.distinct else F.sum(x)), blank("double")
    return (F.min(x) if a.func == "min" else F.max(x)), blank(cell.lane.dtype if cell.lane.kind == "num" else "double")


def _list(a: Aggregate, cell: Cell) -> Column:
    """Values in default order, one space between, absent and empty ones left out; distinct by text."""
    gather = F.collect_set if a.distinct else F.collect_list
    if cell.lane.kind == "text":
        return F.array_join(F.array_sort(gather(F.when(cell.c != "", cell.c))), " ")
    if cell.lane.kind == "num":
        return F.array_join(F.transform(F.array_sort(gather(cell.c)), lambda x: Cell(x, replace(cell.lane, blank=False)).text), " ")
    some = F.when(cell.text != "", F.struct(cell.rank.alias("r"), F.coalesce(cell.num, F.lit(0.0)).alias("n"), cell.text.alias("s")))
    texts = F.transform(F.array_sort(gather(some)), lambda x: x["s"])
    return F.array_join(F.array_distinct(texts) if a.distinct else texts, " ")


def _first_form(cell: Cell) -> Column:
    """Of equal mixed values the first in default order, as one aggregate."""
    least = F.min(F.struct(cell.rank.alias("r"), F.coalesce(cell.num, F.lit(0.0)).alias("k"), cell.text.alias("s"), cell.c["num"].alias("num"), cell.absent.alias("absent"), cell.unit.alias("unit")))
    return F.struct(least["s"].alias("s"), least["num"].alias("num"), least["absent"].alias("absent"), least["unit"].alias("unit"))


def grouped(b: Bindings, terms: list[Term], having: list[Compare], prefix: str = "c") -> tuple[DataFrame, list[Lane]]:
    """One row a group, columns c0, c1, ... in the terms' order; constants are carried along."""
    keys: dict[str, Cell] = {t.var: b.cell(t.var) for t in terms if t.variable}
    names = {v: f"g{k}" for k, v in enumerate(keys)}
    aggs: dict[str, tuple[Column, Lane]] = {}
    for t in [*terms, *(h.left for h in having)]:
        if t.agg and t.agg.label not in aggs:
            aggs[t.agg.label] = aggregate_column(t.agg, b.cell(t.agg.var))
    at = {label: f"x{k}" for k, label in enumerate(aggs)}
    columns = [c.alias(at[label]) for label, (c, _) in aggs.items()]
    columns += [_first_form(c).alias(f"m{names[v]}") for v, c in keys.items() if c.lane.any]
    if CITES in b.df.columns:
        columns.append(tidy(F.flatten(F.collect_list(CITES))).alias(CITES))
    by = [c.group.alias(names[v]) for v, c in keys.items()]
    df = b.df.groupBy(*by).agg(*columns or [F.count(F.lit(1)).alias("x")]) if by else b.df.agg(*columns)
    cell = lambda t: Cell(F.col(at[t.agg.label]), aggs[t.agg.label][1]) if t.agg else literal(t.const) if t.const is not None else Cell(F.col(f"m{names[t.var]}" if keys[t.var].lane.any else names[t.var]), keys[t.var].lane)
    for h in having:
        df = df.filter(compare(cell(h.left), h.op, cell(h.right)))
    out = [cell(t) for t in terms]
    extra = [F.col(CITES)] if CITES in df.columns else []
    return df.select(*[c.c.alias(f"{prefix}{k}") for k, c in enumerate(out)], *extra), [c.lane for c in out]


def projected(b: Bindings, terms: list[Term]) -> tuple[DataFrame, list[Lane]]:
    """The set of projected rows; of rows equal by text the first in default order stays, with its provenance."""
    cells = [b.of(t) for t in terms]
    lanes = [c.lane for c in cells]
    named = [c.c.alias(f"c{k}") for k, c in enumerate(cells)]
    carried = [c for c in (CITES, WITNESSES) if c in b.df.columns]
    if not terms:
        return b.df.select(*carried or [F.lit(0).alias("one")]).limit(1), []
    df = b.df.select(*named, *carried)
    cells = [Cell(F.col(f"c{k}"), lane) for k, lane in enumerate(lanes)]
    if not carried and not any(lane.any for lane in lanes):
        return df.dropDuplicates(), lanes
    aggs = [_first_form(c).alias(f"f{k}") for k, c in enumerate(cells) if c.lane.any]
    if carried:
        aggs.append(F.min(F.struct(tidy(F.col(CITES)).alias(CITES), *[F.col(c) for c in carried if c != CITES])).alias("p"))
    df = df.groupBy(*[c.group.alias(f"g{k}") for k, c in enumerate(cells)]).agg(*aggs)
    return df.select(*[F.col(f"f{k}" if c.lane.any else f"g{k}").alias(f"c{k}") for k, c in enumerate(cells)], *[F.col(f"p.{c}").alias(c) for c in carried]), lanes


def ordered(df: DataFrame, lanes: list[Lane], columns: list[Term], order: list[Order], limit: int, offset: int) -> DataFrame:
    """Explicit columns first, then every column in default order; then the page."""
    cells = [Cell(F.col(f"c{k}"), lane) for k, lane in enumerate(lanes)]
    labels = [t.label for t in columns]
    by = [x for o in order for x in cells[labels.index(o.term.label)].order(o.desc)]
    by += [x for c in cells for x in c.order()]
    if by:
        df = df.orderBy(*by)
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit else df
