"""Logical plan: what a query computes, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

Expr = Any
#: Pairs (left name, right name) of an equi-join.
Keys = tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Node:
    def children(self) -> tuple[Node, ...]:
        return tuple(v for f in fields(self) if isinstance(v := getattr(self, f.name), Node))

    def tables(self) -> frozenset[str]:
        """All tables below, those of right sides and subqueries included."""
        return frozenset().union(*(c.tables() for c in self.children()))

    def outline(self) -> tuple:
        """The node's operator and those below it: (name, outlines of its inputs)."""
        return type(self).__name__, tuple(c.outline() for c in self.children())


@dataclass(frozen=True)
class From(Node):
    """Documents of a table: listed fields and the id, or all (``None``)."""

    table: str
    names: tuple[str, ...] | None

    def tables(self) -> frozenset[str]:
        return frozenset([self.table])


@dataclass(frozen=True)
class Rel(Node):
    """An inline relation; rows are tuples of (name, value)."""

    rows: tuple[tuple[tuple[str, Any], ...], ...]


@dataclass(frozen=True)
class Local(Node):
    """The enclosing document, as the source of a subquery over its own fields."""


@dataclass(frozen=True)
class Where(Node):
    input: Node
    predicates: tuple[Expr, ...]


@dataclass(frozen=True)
class With(Node):
    """Add or replace fields in order; later expressions see earlier fields."""

    input: Node
    fields: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Without(Node):
    input: Node
    names: tuple[str, ...]


@dataclass(frozen=True)
class Return(Node):
    input: Node
    names: tuple[str, ...]


@dataclass(frozen=True)
class Unnest(Node):
    """A row per element of an array; rows without elements pass unchanged."""

    input: Node
    name: str
    array: Expr


@dataclass(frozen=True)
class Aggregate(Node):
    """``group``: pairs (name, expression); ``packed``: they come out as one field group_key."""

    input: Node
    group: tuple[tuple[str, Expr], ...]
    aggregates: tuple[tuple[str, str, Expr], ...]
    packed: bool = False


@dataclass(frozen=True)
class Limit(Node):
    input: Node
    n: int


@dataclass(frozen=True)
class Offset(Node):
    input: Node
    n: int


@dataclass(frozen=True)
class Join(Node):
    """Inner equi-join; null keys match; the left side wins name conflicts."""

    input: Node
    right: Node
    keys: Keys


@dataclass(frozen=True)
class LeftJoin(Node):
    input: Node
    right: Node
    keys: Keys


@dataclass(frozen=True)
class Unify(Node):
    """Inner equi-join of which the right side wins name conflicts."""

    input: Node
    right: Node
    keys: Keys


@dataclass(frozen=True)
class Exists(Node):
    """Boolean field: whether the subquery has a row with the document's keys."""

    input: Node
    name: str
    right: Node
    keys: Keys


@dataclass(frozen=True)
class Pull(Node):
    """The one related row (smallest id) as a nested document, or null."""

    input: Node
    name: str
    right: Node
    keys: Keys


@dataclass(frozen=True)
class PullStar(Node):
    """All related rows as an array of documents."""

    input: Node
    name: str
    right: Node
    keys: Keys
