"""What may have been meant by a name that is not there.

Every known path is scored against what was typed: by how many letters are wrong in the last segment when the
modules agree, or in the whole path once '_' and '-' are read as dots.  The best score within the tolerance wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


def distance(a: str, b: str) -> int:
    """Letters to insert, leave out or replace to make b of a."""
    costs = {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        costs[i, 0] = i
        for j, y in enumerate(b, 1):
            costs[i, j] = min(costs[i - 1, j] + 1, costs[i, j - 1] + 1, costs[i - 1, j - 1] + (x != y))
    return costs[len(a), len(b)]


def tolerance(name: str) -> int:
    """Wrong letters that a name of this length may have: two, or one for every four letters and one more."""
    return max(2, 1 + len(name) // 4)


def best(name: str, options: Iterable[str], score: Callable[[str], int | None]) -> str:
    """The option with the lowest score that the tolerance allows, the first of equals; '' if there is none."""
    scored = [(s, at, o) for at, o in enumerate(options) if (s := score(o)) is not None and s <= tolerance(name)]
    return min(scored)[2] if scored else ""


def dotted(name: str) -> str:
    return name.replace("_", ".").replace("-", ".")


def parent(path: str) -> str:
    return path.rpartition(".")[0]


def leaf(path: str) -> str:
    return path.rpartition(".")[2]


class Names:
    """The paths that exist, those of base relations first, and the modules that hold them."""

    def __init__(self, paths: Iterable[str], modules: Iterable[str]):
        self.paths, self.modules = list(paths), set(modules)
        for p in self.paths:
            while p := parent(p):
                self.modules.add(p)

    def meant(self, name: str) -> list[str]:
        """Paths that may have been meant: all that end in a bare name, or the one that scores best."""
        if "." not in name and (same_leaf := sorted(p for p in self.paths if "." in p and leaf(p) == name)):
            return same_leaf
        module = parent(name)
        if module and module not in self.modules:
            near = best(module, sorted(self.modules), lambda m: distance(module, m))
            moved = f"{near}.{leaf(name)}"
            return [moved if moved in self.paths else near] if near else []
        beside = best(leaf(name), [p for p in self.paths if parent(p) == module], lambda p: distance(leaf(name), leaf(p)))
        if not beside and dotted(name) != name and not module:
            beside = best(name, self.paths, lambda p: distance(dotted(name), dotted(p)) if "." in p else None)
        return [beside] if beside else []


def question(found: list[str]) -> str:
    """The suggestion as the end of a message."""
    quoted = [f'"{p}"' for p in found]
    return f"did you mean {' or '.join(quoted)}?" if found else ""


def meant_value(got: str, allowed: Iterable[str]) -> str:
    """The allowed value that a constant may have been meant to be, as the end of a message."""
    near = best(got, allowed, lambda v: distance(got, v))
    return f", {question([near])}" if near else ""
