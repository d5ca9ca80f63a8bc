"""Which queries read which tables."""

from __future__ import annotations

from collections.abc import Iterable


class TableIndex:
    """Query ids by table, so that a transaction finds its queries without looking at the others."""

    def __init__(self) -> None:
        self._queries: dict[str, set[str]] = {}
        self._tables: dict[str, frozenset[str]] = {}

    def add(self, query_id: str, tables: Iterable[str]) -> None:
        """Enter a query; one of the same id is replaced."""
        self.remove(query_id)
        self._tables[query_id] = frozenset(tables)
        for t in self._tables[query_id]:
            self._queries.setdefault(t, set()).add(query_id)

    def remove(self, query_id: str) -> bool:
        """Whether there was such a query."""
        tables = self._tables.pop(query_id, None)
        for t in tables or ():
            self._queries[t].discard(query_id)
            if not self._queries[t]:
                del self._queries[t]
        return tables is not None

    def find(self, tables: Iterable[str]) -> set[str]:
        """Queries that read any of the tables."""
        return set().union(*(self._queries.get(t, ()) for t in tables))

    def stats(self) -> dict[str, int]:
        return {"query_count": len(self._tables), "table_count": len(self._queries)}
