"""Columns of values.

A column is text (STRING), a number (any numeric type) or mixed (a struct of text, number, absence and unit);
which one is known before anything runs, so that joins and filters stay plain equalities on native types.
NULL is the absent value, except in aggregates without input, where it is the empty text (`blank`).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..values import Value, number_text, parse_number

ANY = T.StructType([T.StructField("s", T.StringType()), T.StructField("num", T.DoubleType()), T.StructField("absent", T.BooleanType()), T.StructField("unit", T.StringType())])


@dataclass(frozen=True)
class Lane:
    kind: str  # text, num or any
    unit: str = ""
    dtype: str = "string"  # the Spark type of a number
    blank: bool = False
    canonical: bool = True  # numbers' texts are their canonical ones
    sure: bool = False  # never absent, so that plain equality joins it

    @property
    def any(self) -> bool:
        return self.kind == "any"


TEXT = Lane("text")


def number(dtype: str = "double", unit: str = "") -> Lane:
    return Lane("num", unit, dtype)


def lane_of(dtype: T.DataType, unit: str = "") -> Lane:
    if isinstance(dtype, (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEXT
    if isinstance(dtype, T.NumericType):
        return number(dtype.simpleString(), unit)
    if isinstance(dtype, T.StructType) and dtype.names == ANY.names:
        return Lane("any", canonical=False, dtype="any")
    raise QueryError(f"a column of type {dtype.simpleString()} holds no scalar values; serve its parts instead")


def as_lane(c: Column, dtype: T.DataType) -> Column:
    """A source column as its lane has it: times as ISO text, so that text order is time order."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(dtype, (T.BooleanType, T.DateType)):
        return c.cast("string")
    return c


_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def num_text(c: Column, dtype: str = "double") -> Column:
    """Canonical text of a number (see values.number_text), NULL for NULL."""
    small = F.abs(c) < 1_000_000
    if dtype in _INTEGRAL:
        plain = c.cast("string")
    else:
        plain = F.regexp_replace(c.cast("string"), r"\.0$", "")
        tiny = (F.abs(c) < 1e-3) & (F.abs(c) >= 1e-4)
        plain = F.when(tiny, F.regexp_replace(c.cast("decimal(38,24)").cast("string"), "0+$", "")).otherwise(plain)
        small = (small & (F.abs(c) >= 1e-4)) | (c == 0)
    # digits and exponent from d.ddd[Exx] or ddd.ddd
    s = F.abs(c.cast("double")).cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(s, r"^([\d.]+)", 1), r"\.", "")
    shown = F.regexp_replace(F.regexp_replace(mantissa, "^0+", ""), "0+$", "")
    e = F.regexp_extract(s, r"E(-?\d+)$", 1)
    power = F.when(e != "", e.cast("int")).otherwise(F.length(F.regexp_extract(s, r"^(\d+)", 1)) - 1)
    rest = F.substring(shown, 2, 400)
    long = F.concat(
        F.when(c < 0, "-").otherwise(""), F.substring(shown, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""),
        F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"),
    )
    text = F.when(c.isNull(), F.lit(None)).when(small, plain).otherwise(long)
    if dtype in ("double", "float"):
        text = F.when(F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf").otherwise(text)
    return text


@dataclass(frozen=True)
class Cell:
    """A column with its lane: the one interface that comparisons, built-ins and aggregates use."""

    c: Column
    lane: Lane

    @property
    def absent(self) -> Column:
        if self.lane.any:
            return self.c["absent"]
        return F.lit(False) if self.lane.blank else self.c.isNull()

    @property
    def text(self) -> Column:
        """Text form; that of the absent value is empty."""
        if self.lane.any:
            return F.coalesce(self.c["s"], F.lit(""))
        return F.coalesce(self.c if self.lane.kind == "text" else num_text(self.c, self.lane.dtype), F.lit(""))

    @property
    def num(self) -> Column:
        """Number, or NULL."""
        if self.lane.any:
            return self.c["num"]
        return self.c if self.lane.kind == "num" else F.lit(None).cast("double")

    @property
    def unit(self) -> Column:
        return F.coalesce(self.c["unit"], F.lit("")) if self.lane.any else F.lit(self.lane.unit)

    @property
    def key(self) -> Column:
        """Equal for equal canonical values, NULL for the absent one."""
        if self.lane.any:
            return F.when(~self.c["absent"], F.when(self.c["num"].isNotNull(), num_text(self.c["num"])).otherwise(self.c["s"]))
        return self.text if self.lane.blank else (self.c if self.lane.kind == "text" else num_text(self.c, self.lane.dtype))

    @property
    def keys(self) -> Column:
        """Both texts a value may be equal by: as written, and canonical."""
        return F.array_distinct(F.array(F.when(~self.absent, self.text), self.key))

    @property
    def mixed(self) -> Column:
        if self.lane.any:
            return self.c
        return F.struct(self.text.alias("s"), self.num.cast("double").alias("num"), self.absent.alias("absent"), F.lit(self.lane.unit).alias("unit"))

    @property
    def group(self) -> Column:
        """What groups and answers are told apart by: text, and absence."""
        if self.lane.kind == "num":
            return self.c
        return self.c if self.lane.kind == "text" else F.when(~self.absent, self.text)

    def order(self, desc: bool = False) -> list[Column]:
        """Default order: absent, numbers by value, text by bytes; a blank is an empty text."""
        if self.lane.kind == "text":
            return [self.c.desc_nulls_last() if desc else self.c.asc_nulls_first()]
        if self.lane.kind == "num":
            if self.lane.blank:
                return [self.c.desc_nulls_first() if desc else self.c.asc_nulls_last()]
            return [self.c.desc_nulls_last() if desc else self.c.asc_nulls_first()]
        some = [self.rank, F.coalesce(self.c["num"], F.lit(0.0)), self.text]
        return [x.desc() if desc else x.asc() for x in some]

    @property
    def rank(self) -> Column:
        return F.when(self.absent, 0).when(self.num.isNotNull(), 1).otherwise(2)

    def to(self, lane: Lane) -> Column:
        if lane.any:
            return self.mixed if not self.lane.any else self.c
        return self.c.cast(lane.dtype) if lane.kind == "num" and lane.dtype != self.lane.dtype else self.c


def merged(a: Lane, b: Lane) -> Lane:
    """The lane that holds values of both."""
    if a == b:
        return a
    sure = a.sure and b.sure
    if a.kind == b.kind != "any" and a.unit == b.unit and a.blank == b.blank:
        if a.kind == "text":
            return replace(a, sure=sure)
        wide = [d for d in ("tinyint", "smallint", "int", "bigint") if d in (a.dtype, b.dtype)]
        both_whole = a.dtype in _INTEGRAL and b.dtype in _INTEGRAL
        dtype = a.dtype if a.dtype == b.dtype else wide[-1] if both_whole else "double"
        return replace(a, dtype=dtype, canonical=a.canonical and b.canonical, sure=sure)
    return Lane("any", canonical=a.canonical and b.canonical, dtype="any")


def literal(v: Value) -> Cell:
    """A constant as a cell of its own lane."""
    if v.absent:
        return Cell(F.lit(None).cast("string"), TEXT)
    if v.num is None:
        return Cell(F.lit(v.s), replace(TEXT, sure=True))
    if v.canonical:
        whole = v.num.is_integer() and abs(v.num) < 2**53
        lane = replace(number("bigint" if whole else "double", v.unit), sure=True)
        return Cell(F.lit(int(v.num)).cast("bigint") if whole else F.lit(v.num), lane)
    mixed = F.struct(F.lit(v.s).alias("s"), F.lit(v.num).alias("num"), F.lit(False).alias("absent"), F.lit(v.unit).alias("unit"))
    return Cell(mixed, Lane("any", canonical=False, dtype="any"))


def joined(a: Cell, b: Cell) -> Column | None:
    """Sameness of columns of one native type as a join condition; plain equality unless both may be absent.  None for other lanes."""
    if a.lane.kind != b.lane.kind or a.lane.any or a.lane.blank or b.lane.blank:
        return None
    return a.c == b.c if a.lane.sure or b.lane.sure else a.c.eqNullSafe(b.c)


def same(a: Cell, b: Cell) -> Column:
    """Sameness as unification sees it; never NULL."""
    if a.lane.kind == b.lane.kind == "text" or (a.lane.kind == b.lane.kind == "num" and not (a.lane.blank or b.lane.blank)):
        return a.c.eqNullSafe(b.c)
    if a.lane.canonical and b.lane.canonical:
        return a.key.eqNullSafe(b.key)
    by = F.when(a.num.isNotNull() & b.num.isNotNull(), a.num == b.num).otherwise(a.text == b.text)
    return F.when(a.absent | b.absent, a.absent & b.absent).otherwise(by)


def is_constant(a: Cell, v: Value) -> Column:
    """Sameness with a constant, as a filter that reaches the scan."""
    if v.absent:
        return a.absent
    if a.lane.kind == "text":
        return a.c == F.lit(v.s)
    if a.lane.kind == "num":
        if v.s == "" and a.lane.blank:
            return a.c.isNull()
        x = v.num if v.num is not None else parse_number(v.s)
        if x is None or (v.num is None and number_text(x) != v.s):
            return F.lit(False)
        if a.lane.dtype in _INTEGRAL:
            return a.c == F.lit(int(x)) if x.is_integer() else F.lit(False)
        return a.c == F.lit(x)
    return same(a, literal(v))


def compare(a: Cell, op: str, b: Cell) -> Column:
    """A comparison as the language has it; never NULL."""
    if op == "=":
        return same(a, b)
    if op == "!=":
        return ~same(a, b)
    by = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    kinds = {a.lane.kind, b.lane.kind}
    if kinds == {"text"}:
        return F.coalesce(by(a.c, b.c), F.lit(False))
    if kinds == {"num"}:
        if a.lane.unit and b.lane.unit and a.lane.unit != b.lane.unit:
            return F.lit(False)
        return F.coalesce(by(a.c, b.c), F.lit(False))
    if kinds == {"text", "num"}:
        return F.lit(False)
    units = (a.unit == "") | (b.unit == "") | (a.unit == b.unit)
    numbers = F.when(units, by(a.num, b.num)).otherwise(False)
    texts = F.when(a.num.isNull() & b.num.isNull(), by(a.text, b.text)).otherwise(False)
    return F.when(a.absent | b.absent, False).when(a.num.isNotNull() & b.num.isNotNull(), numbers).otherwise(texts)
