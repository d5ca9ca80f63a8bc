"""Incrementally maintained queries on Spark.

Queries are pipelines, written as text (``parse``) or with the fluent ``Q``
builder.  One plan serves two backends: ``compile_plan`` makes a DataFrame over
whole tables; ``Engine`` keeps it up to date under transactions and reports the
rows added, removed and modified.
"""

from importlib import import_module

_HOMES = {
    "Catalog": "sources.catalog",
    "Engine": "streaming.engine",
    "Q": "plans.dsl",
    "compile_plan": "operators.batch",
    "follow": "streaming.stream",
    "parse": "plans.parser",
}
__all__ = list(_HOMES)


def __getattr__(name: str) -> object:
    """Modules load when they are asked for: executors need few of them."""
    if name not in _HOMES:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)
