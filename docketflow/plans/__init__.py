"""Registered queries."""

from docketflow.plans import cleaning, evaluate, ingest, labels, models

_PARTS = (ingest, cleaning, labels, evaluate, models)


def all_queries() -> dict:
    return {name: fn for part in _PARTS for name, fn in part.query.queries.items()}


def all_oracles() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.query.oracles.items()}
