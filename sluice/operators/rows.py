"""Operators that map rows one by one; hidden columns ride along untouched."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.expressions import Scope, Typed, column, lower, scope_of, truthy
from ..plans import nodes as N
from ..plans.parser import thaw

#: A column of the engine, not of documents: a row's weight.
WEIGHT = "_w"
HIDDEN = (WEIGHT,)


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in HIDDEN]


def hidden(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in HIDDEN]


def infer(value: object) -> T.DataType:
    """The Spark type of a Python value; documents become structs."""
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, infer(v)) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        out: T.DataType = T.NullType()
        for v in value:
            out = widen(out, infer(v))
        return T.ArrayType(out)
    return T.NullType() if value is None else T.StringType()


def widen(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type for values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        types = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            types[f.name] = widen(types[f.name], f.dataType) if f.name in types else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in types.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widen(a.elementType, b.elementType))
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    raise TypeError(f"values of types {a.simpleString()} and {b.simpleString()} in one field")


def settled(t: T.DataType) -> T.DataType:
    """Fields that were always null become strings, which files can hold."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, settled(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(settled(t.elementType))
    return T.StringType() if isinstance(t, T.NullType) else t


def shaped(value: object, t: T.DataType) -> object:
    """A Python value as the type asks for: absent fields null, integers as doubles."""
    if value is None:
        return None
    if isinstance(t, T.StructType):
        return {f.name: shaped(value.get(f.name), f.dataType) for f in t.fields}
    if isinstance(t, T.ArrayType):
        return [shaped(v, t.elementType) for v in value]
    if isinstance(t, T.DoubleType):
        return float(value)
    return value if isinstance(t, (T.LongType, T.BooleanType)) else str(value)


def frame_of(spark: SparkSession, rows: list[dict], schema: T.StructType | None = None) -> DataFrame:
    """Documents as a DataFrame; the schema is inferred unless given."""
    if schema is None:
        found: T.DataType = T.StructType([])
        for r in rows:
            found = widen(found, infer(r))
        schema = settled(found)
    # By way of Arrow the rows become a local relation, whose size the optimizer knows.
    return spark.createDataFrame(pa.Table.from_pylist([shaped(r, schema) for r in rows], schema=to_arrow_schema(schema)), schema)


def rel(spark: SparkSession, node: N.Rel) -> DataFrame:
    return frame_of(spark, [{k: thaw(v) for k, v in r} for r in node.rows])


def project(df: DataFrame, node: N.From) -> DataFrame:
    """The source's projection: listed fields and the id, or all and the table's name; a field no document has is null."""
    names = node.names
    if names is None or "_table" in names:
        df = df.withColumn("_table", F.lit(node.table))
    if names is None:
        return df.select(*(column(c) for c in visible(df)), *hidden(df))
    have = set(df.columns)
    names = tuple(dict.fromkeys((*names, *(["_id"] if "_id" in have else []))))
    picked = [column(n) if n in have else F.lit(None).alias(n) for n in names]
    return df.select(*picked, *hidden(df))


def where(df: DataFrame, node: N.Where) -> DataFrame:
    scope = scope_of(df.schema)
    for p in node.predicates:
        df = df.where(truthy(lower(p, scope)))
    return df


def with_(df: DataFrame, node: N.With) -> DataFrame:
    for name, e in node.fields:
        value = lower(e, scope_of(df.schema))
        df = df.withColumn(name, value.column)
    return df


def without(df: DataFrame, node: N.Without) -> DataFrame:
    return df.select(*(column(c) for c in visible(df) if c not in node.names), *hidden(df))


def return_(df: DataFrame, node: N.Return) -> DataFrame:
    have = set(visible(df))
    return df.select(*(column(n) for n in dict.fromkeys(node.names) if n in have), *hidden(df))


def unnest(df: DataFrame, node: N.Unnest) -> DataFrame:
    array = lower(node.array, scope_of(df.schema))
    if not isinstance(array.type, T.ArrayType):  # nothing to expand: rows pass through
        return df if node.name in df.columns else df.withColumn(node.name, F.lit(None))
    return df.withColumn(node.name, F.explode_outer(array.column))


ROW_WISE = {N.Where: where, N.With: with_, N.Without: without, N.Return: return_, N.Unnest: unnest}


def _local_ops(node: N.Node) -> list[N.Node]:
    """The operators of a subquery over a document's own fields, first one first."""
    if isinstance(node, N.Local):
        return []
    if type(node) not in ROW_WISE:
        raise ValueError(f"{type(node).__name__} can't run over a document's own fields; give keys and a table")
    return [*_local_ops(node.input), node]


def _yields(ops: list[N.Node], scope: Scope) -> Column:
    """Whether the operators yield a row for a document with these fields: no join, no second look at the table."""
    if not ops:
        return F.lit(True)
    op, rest = ops[0], ops[1:]
    if isinstance(op, N.Where):
        return reduce(lambda a, p: a & truthy(lower(p, scope)), op.predicates, F.lit(True)) & _yields(rest, scope)
    if isinstance(op, N.With):
        for name, e in op.fields:
            scope = scope | {name: lower(e, scope)}
        return _yields(rest, scope)
    if isinstance(op, N.Without):
        return _yields(rest, {k: v for k, v in scope.items() if k not in op.names})
    if isinstance(op, N.Return):
        return _yields(rest, {k: v for k, v in scope.items() if k in op.names})
    array = lower(op.array, scope)
    none = Typed(F.lit(None))
    if not isinstance(array.type, T.ArrayType):  # nothing to expand: the row passes through
        return _yields(rest, scope if op.name in scope else scope | {op.name: none})
    kind = array.type.elementType
    some = F.exists(array.column, lambda x: _yields(rest, scope | {op.name: Typed(x, kind)}))
    without = _yields(rest, scope | {op.name: Typed(F.lit(None).cast(kind), kind)})
    return F.when(F.size(array.column) > 0, some).otherwise(without)


def exists_local(df: DataFrame, node: N.Exists) -> DataFrame:
    scope = {k: v for k, v in scope_of(df.schema).items() if k not in HIDDEN}
    return df.withColumn(node.name, F.coalesce(_yields(_local_ops(node.right), scope), F.lit(False)))


def same(a: Column, a_type: T.DataType | None, b: Column, b_type: T.DataType | None) -> Column:
    """Null-safe equality.  Untyped nulls get a type: as join keys they would match nothing, not even each other."""
    a_void, b_void = (t is None or isinstance(t, T.NullType) for t in (a_type, b_type))
    if a_void:
        a = F.lit(None).cast("string" if b_void else b_type)
    if b_void:
        b = F.lit(None).cast("string" if a_void else a_type)
    if a_void and b_void:
        return F.lit(True)
    return a.eqNullSafe(b)


def type_of(df: DataFrame, name: str) -> T.DataType | None:
    return df.schema[name].dataType if name in df.columns else None


def matches(left: DataFrame, right: DataFrame, keys: N.Keys) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with unambiguous names (l.., r..) and the null-safe condition on the keys."""
    lnames = {c: f"l{i}" for i, c in enumerate(left.columns)}
    rnames = {c: f"r{i}" for i, c in enumerate(right.columns)}
    ls = left.select(*(column(c).alias(n) for c, n in lnames.items()))
    rs = right.select(*(column(c).alias(n) for c, n in rnames.items()))
    on = F.lit(True)
    for lk, rk in keys:
        on = on & same(F.col(lnames.get(lk, "l0")), type_of(left, lk), F.col(rnames.get(rk, "r0")), type_of(right, rk))
    return ls, rs, on


def equi_join(left: DataFrame, right: DataFrame, keys: N.Keys, how: str, right_wins: bool) -> DataFrame:
    """Join with biased names; weights multiply."""
    ls, rs, on = matches(left, right, keys)
    both = ls.join(rs, on, how)
    at = {c: f"l{i}" for i, c in enumerate(left.columns) if c != WEIGHT}
    for i, c in enumerate(right.columns):
        if c != WEIGHT and (right_wins or c not in at):
            at[c] = f"r{i}"
    out = [F.col(n).alias(c) for c, n in at.items()]
    weights = [F.col(f"{s}{df.columns.index(WEIGHT)}") for s, df in (("l", left), ("r", right)) if WEIGHT in df.columns]
    if weights:
        w = weights[0] if len(weights) == 1 else weights[0] * weights[1]
        out.append(w.alias(WEIGHT))
    return both.select(*out)

