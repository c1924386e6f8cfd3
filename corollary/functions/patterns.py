"""Glob and regular-expression patterns as Java patterns."""

from __future__ import annotations

import re
from functools import lru_cache
from functools import lru_cache

from ..errors import QueryError


def _code(c: str) -> str:
    return f"\\x{{{ord(c):x}}}"


@lru_cache(maxsize=4096)
@lru_cache(10_000)
def glob_to_java(pattern: str) -> str:
    """`*` any run, `?` one character, `[...]` a class that `^` negates and in which a first `]` stands for itself; nothing escapes."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c != "[":
            out.append(_code(c))
        else:
            negated = pattern[k : k + 1] == "^"
            k += negated
            end = pattern.find("]", k + 1)
            if end < 0:
                raise QueryError(f'invalid glob "{pattern}": a class has no closing ]')
            members, inside = [], pattern[k:end]
            j = 0
            while j < len(inside):
                if j + 2 < len(inside) and inside[j + 1] == "-":
                    if inside[j] > inside[j + 2]:
                        raise QueryError(f'invalid glob "{pattern}": range {inside[j : j + 3]} is out of order')
                    members.append(f"{_code(inside[j])}-{_code(inside[j + 2])}")
                    j += 3
                else:
                    members.append(_code(inside[j]))
                    j += 1
            out.append(f"[{'^' if negated else ''}{''.join(members)}]")
            k = end + 1
    return f"(?s)\\A{''.join(out)}\\z"


_REFUSED = ((r"\(\?(?:=|!|<=|<!)", "lookaround"), (r"\(\?>", "atomic groups"), (r"(?<!\\)[*+?}]\+", "possessive quantifiers"), (r"\\[1-9]", "backreferences"), (r"\\k<", "backreferences"))


@lru_cache(maxsize=4096)
@lru_cache(10_000)
def regex_to_java(pattern: str) -> str:
    """A linear-time dialect's pattern: what it lacks is refused, and what Java reads otherwise is spelled out."""
    bare = re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]", lambda m: "x" * len(m.group()), pattern)
    bare = re.sub(r"\\\\", "xx", bare)
    for what, name in _REFUSED:
        if re.search(what, bare):
            raise QueryError(f'invalid regex "{pattern}": {name} are not supported')
    out, k, inside = [], 0, False
    multiline = bool(re.match(r"\(\?[a-z]*m", pattern))
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            two = pattern[k : k + 2]
            out.append(two)
            k += 2
            continue
        if inside:
            if c == "]" and not out[-1].startswith("["):
                inside = False
                out.append(c)
            elif c == "[" and not pattern.startswith("[:", k):
                out.append("\\[")
            elif c == "&" and pattern[k + 1 : k + 2] == "&":
                out.append("\\&")
            elif pattern.startswith("[:", k):
                end = pattern.find(":]", k)
                out.append(f"\\p{{{pattern[k + 2 : end].capitalize()}}}" if end > 0 else "\\[")
                k = end + 1 if end > 0 else k
            else:
                out.append(c if c != "]" else "\\]")
        elif c == "[":
            inside = True
            head = "[^" if pattern[k + 1 : k + 2] == "^" else "["
            out.append(head)
            k += len(head) - 1
            if pattern[k + 1 : k + 2] == "]":
                out.append("\\]")
                k += 1
            else:
                out.append("")
        elif c == "$" and not multiline:
            out.append("\\z")
        elif pattern.startswith("(?P<", k):
            out.append("(?<")
            k += 3
        else:
            out.append(c)
        k += 1
    python = re.sub(r"\\z", r"\\Z", "".join(out))
    python = re.sub(r"\(\?<(?![=!])", "(?P<", python)
    try:
        re.compile(re.sub(r"\\p\{\^?\w+\}|\\[pP]\w|\\x\{[0-9A-Fa-f]+\}", "x", python.replace("(?U)", "")))
    except re.error as e:
        raise QueryError(f'invalid regex "{pattern}": {e}') from None
    return f"(?d){''.join(out)}"
