"""Registration of queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, checks, decorator) of one catalogue module."""
    queries: dict = {}
    checks: dict = {}

    def query(name: str, check: str | None = None):
        def add(function):
            queries[name] = function
            if check is not None:
                checks[name] = check
            return function

        return add

    return queries, checks, query
