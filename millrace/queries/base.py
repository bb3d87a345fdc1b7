"""Registry of one query family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None):
        def register(fn: Callable[..., DataFrame]):
            self.queries[key] = fn
            if sql:
                self.sql[key] = sql.strip()
            return fn

        return register
