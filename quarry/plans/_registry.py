"""A module's queries by name, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

Query = Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(function: Query) -> Query:
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = sql.strip()
            return function

        return keep
