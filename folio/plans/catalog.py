"""A catalog of queries: each module fills one, and the registry joins them."""

from __future__ import annotations

from collections.abc import Callable


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Register a query (spark, sf_dir) -> DataFrame under its inventory id, with its SQL for another engine."""

        def keep(f):
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep
