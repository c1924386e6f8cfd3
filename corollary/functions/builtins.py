"""Predicates every vocabulary can have: tests of text, and absence."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lanes import Cell
from ..plans.ir import ArgType
from ..plans.vocabulary import Builtin, Vocabulary
from ..values import Value
from .patterns import glob_to_java, regex_to_java

_TEXT = ArgType(type="string")


def _second(x: Cell | Value) -> Column:
    return F.lit(x.s) if isinstance(x, Value) else x.text


def _matcher(translate):
    def test(s: Cell, pattern: Cell | Value) -> Column:
        if isinstance(pattern, Value):
            return s.text.rlike(translate(pattern.s))
        # A pattern read from data: batches of them go to a worker, which translates each distinct one once.
        java = F.udf(lambda p: translate(p or ""), T.StringType(), useArrow=True)(pattern.text)
        return F.call_function("rlike", s.text, java)

    return test


def predicates() -> dict[str, Builtin]:
    """str.contains, str.prefix, str.suffix, str.glob, str.match and absent."""
    two = lambda doc, column, names=("s", "sub"): Builtin(2, list(names), [_TEXT, _TEXT], doc, column=column)
    return {
        "str.contains": two("the text holds the other", lambda s, x: F.contains(s.text, _second(x))),
        "str.prefix": two("the text begins with the other", lambda s, x: F.startswith(s.text, _second(x)), ("s", "prefix")),
        "str.suffix": two("the text ends with the other", lambda s, x: F.endswith(s.text, _second(x)), ("s", "suffix")),
        "str.glob": two("the whole text fits the glob pattern", _matcher(glob_to_java), ("s", "pattern")),
        "str.match": two("the pattern fits somewhere in the text", _matcher(regex_to_java), ("s", "pattern")),
        "absent": Builtin(1, ["x"], [], "the value was not stated", column=lambda x: x.absent),
    }


def install(v: Vocabulary) -> Vocabulary:
    for path, b in predicates().items():
        v.add_predicate(path, b)
    return v


def python_test(name: str, s: str, other: str) -> bool:
    """The same tests on plain text, for hosts and tests."""
    if name == "str.contains":
        return other in s
    if name == "str.prefix":
        return s.startswith(other)
    if name == "str.suffix":
        return s.endswith(other)
    java = glob_to_java(other) if name == "str.glob" else regex_to_java(other)
    python = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), java.replace("(?d)", "").replace("\\z", "\\Z"))
    return re.search(python, s) is not None
