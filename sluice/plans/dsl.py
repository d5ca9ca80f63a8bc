"""Fluent builder for plans; expressions are query text."""

from __future__ import annotations

from typing import Any

from ..sources.edn import read
from . import nodes as N
from .parser import AGGREGATES, _freeze, expression


def _keys(on: dict[str, str] | str | list[str]) -> N.Keys:
    if isinstance(on, str):
        return ((on, on),)
    return tuple(on.items()) if isinstance(on, dict) else tuple((k, k) for k in on)


def _expr(x: Any) -> N.Expr:
    """Query text as an expression; numbers, booleans and None stand for themselves."""
    return expression(read(x)) if isinstance(x, str) else ("lit", x)


class Q:
    """A query under construction; every method returns a new one."""

    def __init__(self, plan: N.Node):
        self.plan = plan

    @classmethod
    def table(cls, name: str, *names: str) -> Q:
        """Documents of a table: the named fields and the id, or all."""
        return cls(N.From(name, names or None))

    @classmethod
    def rel(cls, *rows: dict[str, Any]) -> Q:
        return cls(N.Rel(tuple(tuple((k, _freeze(v)) for k, v in r.items()) for r in rows)))

    @classmethod
    def unify(cls, left: Q, right: Q, on: Any) -> Q:
        return cls(N.Unify(left.plan, right.plan, _keys(on)))

    @classmethod
    def document(cls) -> Q:
        """The enclosing document, in a subquery of ``exists`` without keys."""
        return cls(N.Local())

    def where(self, *predicates: Any) -> Q:
        return Q(N.Where(self.plan, tuple(map(_expr, predicates))))

    def with_(self, **fields: Any) -> Q:
        return Q(N.With(self.plan, tuple((k, _expr(v)) for k, v in fields.items())))

    def without(self, *names: str) -> Q:
        return Q(N.Without(self.plan, names))

    def return_(self, *names: str) -> Q:
        return Q(N.Return(self.plan, names))

    def unnest(self, name: str, array: Any) -> Q:
        return Q(N.Unnest(self.plan, name, _expr(array)))

    def aggregate(self, group: str | list[str] | dict[str, Any] | None = None, /, **aggregates: str | tuple[str, Any]) -> Q:
        """Aggregates are names of functions without argument, or pairs (function, expression)."""
        named = {group: group} if isinstance(group, str) else group if isinstance(group, dict) else {g: g for g in group or ()}
        specs = []
        for name, spec in aggregates.items():
            fn, *args = (spec,) if isinstance(spec, str) else spec
            if AGGREGATES.get(fn) != len(args):
                raise ValueError(f"no such aggregate: {spec!r}")
            specs.append((name, fn, _expr(args[0]) if args else None))
        return Q(N.Aggregate(self.plan, tuple((k, _expr(v)) for k, v in named.items()), tuple(specs)))

    def limit(self, n: int) -> Q:
        return Q(N.Limit(self.plan, n))

    def offset(self, n: int) -> Q:
        return Q(N.Offset(self.plan, n))

    def join(self, right: Q, on: Any) -> Q:
        return Q(N.Join(self.plan, right.plan, _keys(on)))

    def left_join(self, right: Q, on: Any) -> Q:
        return Q(N.LeftJoin(self.plan, right.plan, _keys(on)))

    def exists(self, name: str, right: Q, on: Any = ()) -> Q:
        return Q(N.Exists(self.plan, name, right.plan, _keys(on)))

    def pull(self, name: str, right: Q, on: Any) -> Q:
        return Q(N.Pull(self.plan, name, right.plan, _keys(on)))

    def pull_star(self, name: str, right: Q, on: Any) -> Q:
        return Q(N.PullStar(self.plan, name, right.plan, _keys(on)))
