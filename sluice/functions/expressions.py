"""Expressions to Spark columns: one table of functions, all of them built-ins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnknownFunction(ValueError):
    pass


@dataclass(frozen=True)
class Typed:
    """A column and its type, as far as lowering needs it (None: unknown or null)."""

    column: Column
    type: T.DataType | None = None

    @property
    def is_bool(self) -> bool:
        return isinstance(self.type, T.BooleanType)


Scope = dict[str, Typed]
_BOOL, _LONG, _DOUBLE, _STRING = T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def scope_of(schema: T.StructType) -> Scope:
    return {f.name: Typed(column(f.name), f.dataType) for f in schema.fields}


def truthy(x: Typed) -> Column:
    """Only null and false are falsy; 0, "" and [] are true."""
    return F.coalesce(x.column, F.lit(False)) if x.is_bool else x.column.isNotNull()


def _double(x: Typed) -> Column:
    return x.column.cast("double")


def _family(t: T.DataType | None) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    return "?" if t is None or isinstance(t, T.NullType) else t.typeName()


def _equal(a: Typed, b: Typed) -> Column:
    kinds = {_family(a.type), _family(b.type)} - {"?"}
    if len(kinds) > 1 and kinds & {"number", "string", "boolean"}:
        return a.column.isNull() & b.column.isNull()
    return a.column.eqNullSafe(b.column)


def _numeric(args: list[Typed]) -> T.DataType:
    return _LONG if all(isinstance(a.type, T.IntegralType) for a in args) else _DOUBLE


def _wide(a: Typed) -> Column:
    """Integers compute as longs."""
    return a.column.cast("long") if isinstance(a.type, T.IntegralType) else a.column


def _compare(op: Callable[[Column, Column], Column]) -> Callable[..., Typed]:
    return lambda a, b: Typed(F.coalesce(op(_double(a), _double(b)), F.lit(False)), _BOOL)


def _fold(op: Callable[[Column, Column], Column]) -> Callable[..., Typed]:
    return lambda *args: Typed(reduce(op, map(_wide, args)), _numeric(list(args)))


def _minus(*args: Typed) -> Typed:
    return Typed(-_wide(args[0]), _numeric(list(args))) if len(args) == 1 else _fold(lambda a, b: a - b)(*args)


def _divide(*args: Typed) -> Typed:
    if len(args) == 1:
        return Typed(F.lit(1.0) / _double(args[0]), _DOUBLE)
    return Typed(reduce(lambda a, b: a / b, map(_double, args)), _DOUBLE)


def _mod(a: Typed, b: Typed) -> Typed:
    x, y = a.column.cast("long"), b.column.cast("long")
    return Typed(((x % y) + y) % y, _LONG)


def _or(*args: Typed) -> Typed:
    """The first truthy value, else the last one."""
    if all(a.is_bool for a in args):
        return Typed(reduce(lambda a, b: a | b, map(truthy, args), F.lit(False)), _BOOL)
    out = args[-1].column
    for a in reversed(args[:-1]):
        out = F.when(truthy(a), a.column).otherwise(out)
    return Typed(out, _common(args))


def _common(args: Any) -> T.DataType | None:
    types = [a.type for a in args if a.type is not None and not isinstance(a.type, T.NullType)]
    if types and all(isinstance(t, T.NumericType) for t in types):
        return _LONG if all(isinstance(t, T.IntegralType) for t in types) else _DOUBLE
    return types[0] if types else None


def _like(value: Typed, pattern: str) -> Typed:
    regex = pattern.replace("%", ".*").replace("_", ".")
    return Typed(F.coalesce(value.column.cast("string"), F.lit("")).rlike(rf"\A(?:{regex})\z"), _BOOL)


def _like_regex(value: Typed, pattern: Typed) -> Typed:
    return Typed(F.rlike(F.coalesce(value.column.cast("string"), F.lit("")), pattern.column), _BOOL)


def _strip(pattern: str) -> Callable[[Typed], Typed]:
    return lambda x: Typed(F.regexp_replace(x.column.cast("string"), pattern, ""), _STRING)


def _overlay(s: Typed, repl: Typed, start: Typed, length: Typed | None = None) -> Typed:
    n = length.column.cast("int") if length else F.length(repl.column)
    return Typed(F.overlay(s.column, repl.column, start.column.cast("int"), n), _STRING)


def _math(fn: Callable[[Column], Column], kind: T.DataType = _DOUBLE) -> Callable[[Typed], Typed]:
    return lambda x: Typed(fn(_double(x)).cast(kind), kind)


def _branches(args: tuple[Typed, ...], default: Typed | None) -> Typed:
    pairs = list(zip(args[::2], args[1::2], strict=True))
    out = default.column if default else F.lit(None)
    for test, value in reversed(pairs):
        out = F.when(truthy(test), value.column).otherwise(out)
    return Typed(out, _common([v for _, v in pairs] + ([default] if default else [])))


def _case(*args: Typed) -> Typed:
    if len(args) % 2 == 0:
        raise ValueError("case needs a default")
    return _branches(args[:-1], args[-1])


def _cond(*args: Typed) -> Typed:
    # A trailing test without value has a null result, as has no match.
    return _branches(args[: len(args) // 2 * 2], None)


def _null_if(a: Typed, b: Typed) -> Typed:
    return Typed(F.when(~_equal(a, b), a.column), a.type)


#: name: (function, fewest arguments, most arguments or None)
FUNCTIONS: dict[str, tuple[Callable[..., Typed], int, int | None]] = {
    "=": (lambda a, b: Typed(_equal(a, b), _BOOL), 2, 2),
    "!=": (lambda a, b: Typed(~_equal(a, b), _BOOL), 2, 2),
    "<>": (lambda a, b: Typed(~_equal(a, b), _BOOL), 2, 2),
    ">": (_compare(lambda a, b: a > b), 2, 2),
    "<": (_compare(lambda a, b: a < b), 2, 2),
    ">=": (_compare(lambda a, b: a >= b), 2, 2),
    "<=": (_compare(lambda a, b: a <= b), 2, 2),
    "and": (lambda *xs: Typed(reduce(lambda a, b: a & b, map(truthy, xs), F.lit(True)), _BOOL), 0, None),
    "or": (_or, 1, None),
    "not": (lambda x: Typed(~truthy(x), _BOOL), 1, 1),
    "nil?": (lambda x: Typed(x.column.isNull(), _BOOL), 1, 1),
    "true?": (lambda x: Typed(truthy(x) if x.is_bool else F.lit(False), _BOOL), 1, 1),
    "false?": (lambda x: Typed(x.column.eqNullSafe(F.lit(False)) if x.is_bool else F.lit(False), _BOOL), 1, 1),
    "like-regex": (_like_regex, 2, 2),
    "trim": (_strip(r"^\s+|\s+$"), 1, 1),
    "trim-leading": (_strip(r"^\s+"), 1, 1),
    "trim-trailing": (_strip(r"\s+$"), 1, 1),
    "overlay": (_overlay, 3, 4),
    "lower": (lambda x: Typed(F.lower(x.column), _STRING), 1, 1),
    "upper": (lambda x: Typed(F.upper(x.column), _STRING), 1, 1),
    "+": (_fold(lambda a, b: a + b), 1, None),
    "-": (_minus, 1, None),
    "*": (_fold(lambda a, b: a * b), 1, None),
    "/": (_divide, 1, None),
    "mod": (_mod, 2, 2),
    "abs": (_math(F.abs), 1, 1),
    "floor": (_math(F.floor), 1, 1),
    "ceil": (_math(F.ceil), 1, 1),
    "round": (_math(lambda x: F.floor(x + 0.5), _LONG), 1, 1),
    "sqrt": (_math(F.sqrt), 1, 1),
    "pow": (lambda a, b: Typed(F.pow(_double(a), _double(b)), _DOUBLE), 2, 2),
    "if": (lambda c, a, b: Typed(F.when(truthy(c), a.column).otherwise(b.column), _common([a, b])), 3, 3),
    "case": (_case, 1, None),
    "cond": (_cond, 0, None),
    "coalesce": (lambda *xs: Typed(F.coalesce(*(x.column for x in xs)), _common(xs)), 1, None),
    "null-if": (_null_if, 2, 2),
}


def _path(x: Typed, steps: tuple[Any, ...]) -> Typed:
    for step in steps:
        t = x.type
        if isinstance(t, T.StructType):
            if isinstance(step, int):
                f = t.fields[step] if 0 <= step < len(t.fields) else None
            else:
                f = next((f for f in t.fields if f.name == step), None)
            x = Typed(x.column.getField(f.name), f.dataType) if f else Typed(F.lit(None))
        elif isinstance(t, T.ArrayType):
            x = Typed(F.get(x.column, F.lit(step)), t.elementType) if isinstance(step, int) else Typed(F.lit(None))
        elif isinstance(t, T.MapType):
            x = Typed(F.element_at(x.column, F.lit(step).cast(t.keyType)), t.valueType)
        elif isinstance(t, T.VariantType):
            at = f"[{step}]" if isinstance(step, int) else f"['{re.sub(r'([\\\\\'])', r'\\\\\1', step)}']"
            x = Typed(F.try_variant_get(x.column, "$" + at, "variant"), t)
        else:
            x = Typed(F.lit(None))
    return x


def lower(e: Any, scope: Scope) -> Typed:
    """The typed column of an expression over the fields in ``scope``."""
    kind = e[0]
    if kind == "lit":
        v = e[1]
        types = {bool: _BOOL, int: _LONG, float: _DOUBLE, str: _STRING}
        t = types.get(type(v))
        return Typed(F.lit(v).cast(t) if t is not None else F.lit(None), t)
    if kind == "field":
        return scope.get(e[1], Typed(F.lit(None)))
    if kind == "path":
        return _path(lower(e[1], scope), e[2])
    if kind == "let":
        for name, value in e[1]:
            scope = scope | {name: lower(value, scope)}
        return lower(e[2], scope)
    _, op, args = e
    if op == "like":
        if len(args) != 2 or args[1][0] != "lit" or not isinstance(args[1][1], str):
            raise ValueError("like takes a value and a pattern literal")
        return _like(lower(args[0], scope), args[1][1])
    if op not in FUNCTIONS:
        raise UnknownFunction(op)
    fn, least, most = FUNCTIONS[op]
    if len(args) < least or (most is not None and len(args) > most):
        raise ValueError(f"{op}: wrong number of arguments ({len(args)})")
    return fn(*(lower(a, scope) for a in args))
