"""Collects queries with their SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, sql: str | None = None):
        def add(fn):
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.oracles[fn.__name__] = sql
            return fn
        return add
