"""Errors a query can raise; hosts match on fragments of the messages, which all start with `query: `."""

from __future__ import annotations


class QueryError(ValueError):
    """A mistake in a query, its modules or the host's setup."""

    def __init__(self, message: str):
        super().__init__(message if message.startswith("query: ") else f"query: {message}")


class ModuleError(QueryError):
    """A mistake in a module's text; carries where the module is and came from."""

    def __init__(self, path: str, origin: str, cause: Exception):
        super().__init__(str(cause))
        self.path, self.origin, self.cause = path, origin, cause


class BudgetExceeded(QueryError):
    """More rows were derived than the host allowed."""

    def __init__(self, work: int, limit: int):
        super().__init__(f"evaluation stopped: work passed its budget of {limit} (at {work})")
        self.work, self.limit = work, limit


class Stopped(QueryError):
    """The host cancelled the evaluation."""

    def __init__(self, why: str = "cancelled"):
        super().__init__(f"evaluation stopped: {why}")
