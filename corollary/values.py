"""Scalar values: text, numbers, and the absent value."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from decimal import Decimal


def number_text(x: float) -> str:
    """A number's canonical text: shortest digits; with an exponent below 1e-4 and from 1e6."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    sign, digits, exponent = Decimal(repr(float(x))).as_tuple()
    shown = "".join(map(str, digits)).rstrip("0") or "0"
    power = len(digits) + exponent - 1
    if power < -4 or power >= 6:
        text = shown[0] + ("." + shown[1:] if len(shown) > 1 else "") + f"e{'-' if power < 0 else '+'}{abs(power):02d}"
    elif power < 0:
        text = "0." + "0" * (-power - 1) + shown
    else:
        shown = shown.ljust(power + 1, "0")
        text = shown[: power + 1] + ("." + shown[power + 1 :] if len(shown) > power + 1 else "")
    return "-" * sign + text


_NUMBER = re.compile(r"[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf(inity)?|nan)", re.IGNORECASE)


def parse_number(text: str) -> float | None:
    return float(text) if _NUMBER.fullmatch(text) else None


@dataclass(frozen=True)
class Value:
    s: str = ""
    num: float | None = None
    absent: bool = False
    unit: str = ""

    @property
    def canonical(self) -> bool:
        return self.num is None or self.s == number_text(self.num)


ABSENT = Value(absent=True)


def S(text: str) -> Value:
    return Value(text)


def N(x: float, unit: str = "") -> Value:
    return Value(number_text(x), float(x), unit=unit)


def value_of(x) -> Value:
    """A Value from a Python scalar; None is absent."""
    if isinstance(x, Value):
        return x
    if x is None:
        return ABSENT
    if isinstance(x, bool):
        return S("true" if x else "false")
    return N(x) if isinstance(x, (int, float)) else S(str(x))


def equal(a: Value, b: Value) -> bool:
    """Sameness as unification and `=` see it: absent only with absent, numbers by value, the rest by text."""
    if a.absent or b.absent:
        return a.absent and b.absent
    if a.num is not None and b.num is not None:
        return a.num == b.num
    return a.s == b.s


def holds(op: str, a: Value, b: Value) -> bool:
    """A comparison; always true or false."""
    if op in ("=", "!="):
        return equal(a, b) == (op == "=")
    if a.absent or b.absent or (a.num is None) != (b.num is None):
        return False
    if a.num is not None:
        if a.unit and b.unit and a.unit != b.unit:
            return False
        x, y = a.num, b.num
    else:
        x, y = a.s.encode(), b.s.encode()
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def order_key(v: Value) -> tuple:
    """Default order: absent, numbers by value, text by bytes; equal numbers by text."""
    if v.absent:
        return (0, 0.0, b"")
    return (1, v.num, v.s.encode()) if v.num is not None else (2, 0.0, v.s.encode())
