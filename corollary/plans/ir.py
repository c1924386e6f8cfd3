"""Programs as data: terms, atoms, literals, rules and queries.  str() gives text that parses to the same thing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

from ..values import Value, value_of

AGGREGATES = ("count", "min", "max", "sum", "list")
OPERATORS = ("<=", ">=", "!=", "<", ">", "=")


@dataclass(frozen=True)
class Aggregate:
    func: str
    var: str
    distinct: bool = False

    def __str__(self) -> str:
        return f"{self.func}({'distinct ' if self.distinct else ''}?{self.var})"

    @property
    def label(self) -> str:
        return f"{self.func}({'distinct ' if self.distinct else ''}{self.var})"


@dataclass(frozen=True)
class Term:
    """A variable, a constant or an aggregate."""

    var: str = ""
    const: Value | None = None
    agg: Aggregate | None = None

    @property
    def wildcard(self) -> bool:
        return self.var == "_"

    @property
    def variable(self) -> bool:
        return self.var not in ("", "_")

    @property
    def label(self) -> str:
        return self.agg.label if self.agg else self.var

    def __str__(self) -> str:
        if self.agg:
            return str(self.agg)
        if self.const is not None:
            return self.const.s if self.const.num is not None else f'"{self.const.s}"'
        return "_" if self.wildcard else f"?{self.var}"


@dataclass(frozen=True)
class ArgType:
    """What an argument denotes: an entity of a kind (perhaps found per row, or through an owner), or a scalar; and the values it may take."""

    kind: str = ""
    kind_from: str = ""
    owner: str = ""
    type: str = ""
    unit: str = ""
    domain: tuple[str, ...] = ()

    @property
    def silent(self) -> bool:
        return self == ArgType()

    def same_shape(self, other: ArgType) -> bool:
        return replace(self, domain=()) == replace(other, domain=())

    def __str__(self) -> str:
        if self.kind_from:
            s = f"?{self.kind_from}"
        elif self.kind:
            s = f"{self.kind}(?{self.owner})" if self.owner else self.kind
        elif self.type == "number" and self.unit:
            s = f"number[{self.unit}]"
        else:
            s = self.type if not self.domain else ""
        if self.domain:
            closed = "{" + ", ".join(f'"{d}"' for d in self.domain) + "}"
            return f"{s} {closed}" if s else closed
        return s


@dataclass(frozen=True)
class Atom:
    relation: str
    args: tuple[Term, ...]

    def __str__(self) -> str:
        return f"{shown(self.relation)}({', '.join(map(str, self.args))})"

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(t.var for t in self.args if t.variable))


@dataclass(frozen=True)
class Compare:
    left: Term
    op: str
    right: Term

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"

    @property
    def variables(self) -> list[str]:
        return [t.var for t in (self.left, self.right) if t.variable]


@dataclass(frozen=True)
class Literal:
    """Exactly one of a positive atom, a negated atom and a comparison; `at` is where it was written."""

    pos: Atom | None = None
    neg: Atom | None = None
    cmp: Compare | None = None
    at: int = -1

    @property
    def atom(self) -> Atom | None:
        return self.pos or self.neg

    def __str__(self) -> str:
        return str(self.pos or self.cmp) if self.neg is None else f"not {self.neg}"

    def terms(self) -> Iterator[Term]:
        yield from self.atom.args if self.atom else (self.cmp.left, self.cmp.right)


Body = tuple[Literal, ...]


def positive_variables(body: Body) -> list[str]:
    return list(dict.fromkeys(v for lit in body if lit.pos for v in lit.pos.variables))


def body_text(body: Body) -> str:
    return ", ".join(map(str, body))


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: Body
    types: tuple[ArgType, ...] = ()

    @property
    def aggregates(self) -> bool:
        return any(t.agg for t in self.head.args)

    def __str__(self) -> str:
        args = [str(t) for t in self.head.args]
        for k, t in enumerate(self.types):
            if not t.silent:
                args[k] += f": {t}"
        return f"{shown(self.head.relation)}({', '.join(args)}) :- {body_text(self.body)}"


@dataclass(frozen=True)
class Order:
    term: Term
    desc: bool = False

    def __str__(self) -> str:
        return f"{self.term}{' desc' if self.desc else ''}"


@dataclass(frozen=True)
class Query:
    rules: tuple[Rule, ...] = ()
    goal: Body = ()
    select: tuple[Term, ...] = ()
    having: tuple[Compare, ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int = 0
    offset: int = 0

    @property
    def columns(self) -> tuple[Term, ...]:
        """The answer's columns: those selected, or the goal's positive variables."""
        return self.select or tuple(Term(v) for v in positive_variables(self.goal))

    def __str__(self) -> str:
        text = "".join(f"{r};\n" for r in self.rules) + body_text(self.goal)
        if self.select:
            text += " => " + ", ".join(map(str, self.select))
        for word, some in (("having", self.having), ("order by", self.order_by)):
            if some:
                text += f" {word} " + ", ".join(map(str, some))
        return text + (f" limit {self.limit}" if self.limit else "") + (f" offset {self.offset}" if self.offset else "")


def shown(relation: str) -> str:
    """A relation's name as people see it: a private member's link name ends in ~ and its module."""
    return relation.partition("~")[0]


# Builders, for programs made by code.


def V(name: str) -> Term:
    return Term(var=name)


def const(x) -> Term:
    return Term(const=value_of(x))


Str = Num = const


def term(x) -> Term:
    """A Term; text that starts with `?` is a variable, `_` the wildcard, anything else a constant."""
    if isinstance(x, (Term, Aggregate)):
        return Term(agg=x) if isinstance(x, Aggregate) else x
    if isinstance(x, str) and (x == "_" or x.startswith("?")):
        return Term(var=x.lstrip("?") or "_")
    return const(x)


def Rel(relation: str, *args) -> Atom:
    return Atom(relation, tuple(term(a) for a in args))


def Pos(relation: str, *args) -> Literal:
    return Literal(pos=Rel(relation, *args))


def Neg(relation: str, *args) -> Literal:
    return Literal(neg=Rel(relation, *args))


def Cmp(left, op: str, right) -> Literal:
    return Literal(cmp=Compare(term(left), op, term(right)))


def Def(head: Atom, *body: Literal, types: Iterable[ArgType] = ()) -> Rule:
    return Rule(head, tuple(body), tuple(types))


def Build(rules: Iterable[Rule], goal: Iterable[Literal], *select, **tail) -> Query:
    return Query(tuple(rules), tuple(goal), tuple(term(s) for s in select), **tail)


@dataclass
class Schema:
    """A base relation's arguments."""

    arity: int
    labels: list[str] = field(default_factory=list)
    types: list[ArgType] = field(default_factory=list)
    doc: str = ""
    required: list[str] = field(default_factory=list)  # labels of arguments that are never absent

    def label(self, k: int) -> str:
        return self.labels[k] if k < len(self.labels) and self.labels[k] else f"arg{k}"
