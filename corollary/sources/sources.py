"""Where base relations come from: DataFrames, rows in memory, and fact texts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..operators.lanes import ANY, as_lane
from ..plans.ir import ArgType, Schema
from ..plans.parse import _split, strip_comments
from ..values import Value, parse_number, value_of

CITES = "__cites"


@dataclass
class FrameSource:
    """Relations served by DataFrames, or by functions that read them when first needed.

    Columns are arguments, in order; one named `__cites` (array of text) holds a row's citations.
    """

    frames: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    schemas: dict[str, Schema] = field(default_factory=dict)
    no_vocabulary_hint: str = ""

    def add(self, path: str, frame: DataFrame | Callable[[], DataFrame], labels: list[str] | None = None, types: list[ArgType] | None = None, doc: str = "", required: list[str] | None = None) -> FrameSource:
        """Serves a relation; `required` names arguments that are never absent, which joins then rely on."""
        if labels is None:
            labels = [c for c in frame.columns if c != CITES]
        self.frames[path] = frame
        self.schemas[path] = Schema(len(labels), list(labels), list(types or ()), doc, list(required or ()))
        return self

    def relations(self) -> list[str]:
        return list(self.frames)

    def schema(self, path: str) -> Schema | None:
        return self.schemas.get(path)

    def frame(self, spark: SparkSession, path: str) -> DataFrame:
        """Columns c0, c1, ... and `cites`."""
        found = self.frames[path]
        df = found() if callable(found) else found
        args = [f for f in df.schema if f.name != CITES]
        cites = F.coalesce(F.col(CITES), F.array().cast("array<string>")) if CITES in df.columns else F.array().cast("array<string>")
        return df.select(*[as_lane(F.col(f"`{f.name}`"), f.dataType).alias(f"c{k}") for k, f in enumerate(args)], cites.alias("cites"))


class MemSource:
    """Relations of rows added one by one; values may be of any kind."""

    def __init__(self, no_vocabulary_hint: str = ""):
        self.rows: dict[str, list[tuple[list[Value], list[str]]]] = {}
        self.schemas: dict[str, Schema] = {}
        self.no_vocabulary_hint = no_vocabulary_hint

    def declare(self, path: str, *labels: str) -> MemSource:
        return self.declare_schema(path, Schema(len(labels), list(labels)))

    def declare_schema(self, path: str, schema: Schema) -> MemSource:
        self.schemas[path] = schema
        self.rows.setdefault(path, [])
        return self

    def add(self, path: str, *values, cites: list[str] | str = ()) -> MemSource:
        s = self.schemas.get(path)
        if s is None:
            raise ValueError(f"relation {path} is not declared")
        if len(values) != s.arity:
            raise ValueError(f"relation {path} takes {s.arity} values, got {len(values)}")
        self.rows[path].append(([value_of(v) for v in values], [cites] if isinstance(cites, str) else list(cites)))
        return self

    def relations(self) -> list[str]:
        return list(self.schemas)

    def schema(self, path: str) -> Schema | None:
        return self.schemas.get(path)

    def frame(self, spark: SparkSession, path: str) -> DataFrame:
        rows, schema = self.rows[path], self.schemas[path]
        fields, takes = [], []
        for k in range(schema.arity):
            values = [r[0][k] for r in rows]
            there = [v for v in values if not v.absent]
            declared = schema.types[k].unit if k < len(schema.types) else ""
            if there and all(v.num is not None and v.canonical and v.unit in ("", declared) for v in there):
                fields.append(T.StructField(f"c{k}", T.DoubleType(), len(there) < len(values)))
                takes.append(lambda v: v.num)
            elif all(v.num is None for v in there):
                fields.append(T.StructField(f"c{k}", T.StringType(), len(there) < len(values)))
                takes.append(lambda v: None if v.absent else v.s)
            else:
                fields.append(T.StructField(f"c{k}", ANY))
                takes.append(lambda v: (v.s, v.num, v.absent, v.unit))
        fields.append(T.StructField("cites", T.ArrayType(T.StringType())))
        data = [(*(t(v) for t, v in zip(takes, values, strict=True)), [c for c in cites if c]) for values, cites in rows]
        return spark.createDataFrame(data, T.StructType(fields))


def parse_facts(text: str) -> list[tuple[str, list[Value], str]]:
    """Ground atoms, one a line or with `;` between, an optional `.` after each: (relation, values, text)."""
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        for stmt in _split(strip_comments(line), ";"):
            stmt = stmt.removesuffix(".").strip()
            m = re.fullmatch(r"([^(]+)\((.*)\)", stmt)
            if not m:
                raise QueryError(f'facts line {n}: "{stmt}" is no rel(arg, ...)')
            values = []
            for a in _split(m.group(2), ","):
                number = parse_number(a)
                if len(a) >= 2 and a[0] == a[-1] == '"':
                    values.append(Value(a[1:-1]))
                elif number is not None:
                    values.append(value_of(number))
                else:
                    raise QueryError(f'facts line {n}: argument "{a}" of "{stmt}" is neither a quoted string nor a number')
            name = m.group(1).strip()
            shown = ", ".join(v.s if v.num is not None else f'"{v.s}"' for v in values)
            out.append((name, values, f"{name}({shown})"))
    return out


def facts_source(text: str) -> MemSource:
    """A source from a fact text; `#: rel(a, b)` names arguments, and every fact cites itself."""
    source = MemSource()
    labels = {m.group(1).strip(): [x.strip() for x in m.group(2).split(",")] for m in re.finditer(r"^#:\s*([^(\n]+)\(([^)\n]*)\)", text, re.MULTILINE)}
    for name, values, shown in parse_facts(text):
        if name not in source.schemas:
            source.declare_schema(name, Schema(len(values), labels.get(name, [f"arg{k}" for k in range(len(values))])))
        source.add(name, *values, cites=shown)
    for name, names in labels.items():
        if name not in source.schemas:
            source.declare(name, *names)
    return source
