"""Queries of the catalogue, by family; each module has QUERIES and ORACLES."""

from __future__ import annotations

from collections.abc import Callable


class Catalogue:
    """Collects a family's queries with their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return put


def catalogues() -> list[Catalogue]:
    """All families, in the order of the survey."""
    from . import documents, graph, logs, retrieval, tables

    return [tables.catalogue, documents.catalogue, retrieval.catalogue, graph.catalogue, logs.catalogue]
