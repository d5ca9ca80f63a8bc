"""Plans to DataFrames over whole tables.

Results have set semantics.  Rows are only deduplicated where it can matter:
before an operator that counts rows, and at the result, and not where a key of
the rows is known to survive (``keys``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Typed, column, lower, scope_of
from ..plans import nodes as N
from ..sources.catalog import Catalog
from . import rows as R

Key = frozenset[str]


def field_names(node: N.Node) -> frozenset[str] | None:
    """Output names of a node, where the plan alone tells them."""
    if isinstance(node, N.From):
        return None if node.names is None else frozenset(node.names) | {"_id"}
    if isinstance(node, N.Return):
        return frozenset(node.names)
    if isinstance(node, N.Aggregate):
        return frozenset(n for n, *_ in node.aggregates) | group_names(node)
    if isinstance(node, N.Without):
        below = field_names(node.input)
        return None if below is None else below - set(node.names)
    if isinstance(node, N.With):
        below = field_names(node.input)
        return None if below is None else below | {n for n, _ in node.fields}
    if isinstance(node, (N.Where, N.Limit, N.Offset)):
        return field_names(node.input)
    return None


def group_names(node: N.Aggregate) -> frozenset[str]:
    return frozenset({"group_key"} if node.packed else (n for n, _ in node.group))


def conform(df: DataFrame) -> DataFrame:
    """Fields that no document has are null strings in results: files hold no untyped nulls."""
    return df.withColumns({f.name: column(f.name).cast(R.settled(f.dataType)) for f in df.schema.fields if R.settled(f.dataType) != f.dataType})


def key_of(node: N.Node, catalog: Catalog) -> Key | None:
    """Fields that are known to identify the rows of a node, or None."""
    if isinstance(node, N.From):
        return frozenset({"_id"}) if catalog.keyed(node.table) else None
    if isinstance(node, (N.Where, N.Limit, N.Offset)):
        return key_of(node.input, catalog)
    if isinstance(node, N.With):
        key = key_of(node.input, catalog)
        return key if key is not None and not key & {n for n, _ in node.fields} else None
    if isinstance(node, N.Without):
        key = key_of(node.input, catalog)
        return key if key is not None and not key & set(node.names) else None
    if isinstance(node, N.Return):
        key = key_of(node.input, catalog)
        return key if key is not None and key <= set(node.names) else None
    if isinstance(node, N.Aggregate):
        return group_names(node)
    if isinstance(node, (N.Exists, N.Pull, N.PullStar)):
        key = key_of(node.input, catalog)
        return key if key is not None and node.name not in key else None
    if isinstance(node, (N.Join, N.LeftJoin)):
        # Each left row meets at most one right row if the join keys hold a key of the right side.
        left, right = key_of(node.input, catalog), key_of(node.right, catalog)
        return left if left is not None and right is not None and right <= {r for _, r in node.keys} else None
    if isinstance(node, N.Unify):
        left, right = key_of(node.input, catalog), key_of(node.right, catalog)
        return right if left is not None and right is not None and left <= {k for k, _ in node.keys} else None
    return None


def as_set(df: DataFrame, node: N.Node, catalog: Catalog) -> DataFrame:
    """The node's rows without repetition."""
    return df if key_of(node, catalog) is not None else df.distinct()


def order_columns(df: DataFrame) -> list[Column]:
    """A total order of the rows: by id where there is one, then by all other fields."""
    names = R.visible(df)
    plain = [c for c in names if c != "_id" and not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    return [column(c) for c in (["_id"] if "_id" in names else []) + sorted(plain)]


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(*order_columns(df)).limit(n)


def offset(df: DataFrame, n: int) -> DataFrame:
    """All rows but the first ``n``: those are found by a top-n, then anti-joined, so that no task orders the table."""
    if n == 0:
        return df
    ls, rs, _ = R.matches(df, limit(df, n), ())
    types = [f.dataType for f in df.schema.fields]
    on = reduce(lambda a, b: a & b, (R.same(F.col(f"l{i}"), t, F.col(f"r{i}"), t) for i, t in enumerate(types)))
    rest = ls.join(rs, on, "left_anti")
    return rest.select(*(F.col(f"l{i}").alias(c) for i, c in enumerate(df.columns)))


def _aggregate_column(fn: str, value: Typed | None) -> Column:
    if fn == "row-count":
        return F.count(F.lit(1))
    c = value.column
    if fn == "sum":
        return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))
    if fn == "avg":
        return F.avg(c.cast("double"))
    if fn == "count-distinct":  # null counts as one value
        return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0)).cast("long")
    return {"min": F.min, "max": F.max}[fn](c)


def grouping(df: DataFrame, node: N.Aggregate) -> list[Column]:
    """The group's columns, named g0, g1 ..."""
    scope = scope_of(df.schema)
    return [lower(e, scope).column.alias(f"g{i}") for i, (_, e) in enumerate(node.group)]


def aggregate(df: DataFrame, node: N.Aggregate) -> DataFrame:
    """Group and aggregate; without rows there is no result, not even a total."""
    scope = scope_of(df.schema)
    groups = grouping(df, node)
    values = [(n, fn, None if e is None else lower(e, scope)) for n, fn, e in node.aggregates]
    inputs = [v.column.alias(f"v{i}") for i, (_, _, v) in enumerate(values) if v is not None]
    flat = df.select(*groups, *inputs)
    made = [
        _aggregate_column(fn, None if v is None else Typed(F.col(f"v{i}"), v.type)).alias(f"a{i}") for i, (_, fn, v) in enumerate(values)
    ]
    done = flat.groupBy(*(f"g{i}" for i in range(len(groups)))).agg(*made, F.count(F.lit(1)).alias("_n"))
    if not groups:
        done = done.where("_n > 0")
    names = [n for n, _ in node.group]
    if node.packed:
        keys = [F.struct(*(F.col(f"g{i}").alias(n) for i, n in enumerate(names))).alias("group_key")]
    else:
        keys = [F.col(f"g{i}").alias(n) for i, n in enumerate(names)]
    return done.select(*keys, *(F.col(f"a{i}").alias(n) for i, (n, _, _) in enumerate(values)))


def _keys_match(left: DataFrame, right: DataFrame, keys: N.Keys) -> Column:
    """Condition: the left fields equal the right side's keys, named k0, k1 ..."""
    pairs = (R.same(column(k), R.type_of(left, k), F.col(f"k{i}"), R.type_of(right, r)) for i, (k, r) in enumerate(keys))
    return reduce(lambda a, b: a & b, pairs)


def exists(left: DataFrame, right: DataFrame, node: N.Exists) -> DataFrame:
    """A left join with the distinct keys; SQL's EXISTS in a select list fails over unions."""
    have = set(right.columns)
    keys = right.select(*((column(r) if r in have else F.lit(None)).alias(f"k{i}") for i, (_, r) in enumerate(node.keys))).distinct()
    keys = keys.withColumn("_hit", F.lit(True))
    on = _keys_match(left, right, node.keys)
    flagged = left.drop(node.name).join(keys, on, "left")
    return flagged.withColumn(node.name, F.coalesce("_hit", F.lit(False))).drop("_hit", *(f"k{i}" for i in range(len(node.keys))))


def _nested(left: DataFrame, right: DataFrame, node: N.Pull | N.PullStar, fold: Column) -> DataFrame:
    have = set(right.columns)
    keyed = right.select(
        *((column(r) if r in have else F.lit(None)).alias(f"k{i}") for i, (_, r) in enumerate(node.keys)),
        F.struct(*(column(c) for c in right.columns)).alias("_doc"),
    )
    folded = keyed.groupBy(*(f"k{i}" for i in range(len(node.keys)))).agg(fold.alias("_docs"))
    on = _keys_match(left, right, node.keys)
    joined = left.drop(node.name).join(folded, on, "left")
    return joined, [f"k{i}" for i in range(len(node.keys))]


def pull(left: DataFrame, right: DataFrame, node: N.Pull) -> DataFrame:
    first = F.col("_doc")["_id"] if "_id" in right.columns else F.col("_doc")
    joined, keys = _nested(left, right, node, F.min_by("_doc", F.struct(first, "_doc")))
    return joined.withColumn(node.name, F.col("_docs")).drop("_docs", *keys)


def pull_star(left: DataFrame, right: DataFrame, node: N.PullStar) -> DataFrame:
    joined, keys = _nested(left, right, node, F.sort_array(F.collect_list("_doc")))
    empty = F.array().cast(joined.schema["_docs"].dataType)
    return joined.withColumn(node.name, F.coalesce("_docs", empty)).drop("_docs", *keys)


def combine(node: N.Node, left: DataFrame, right: DataFrame) -> DataFrame:
    """A two-input operator on the rows of its inputs."""
    if isinstance(node, N.Join):
        return R.equi_join(left, right, node.keys, "inner", right_wins=False)
    if isinstance(node, N.Unify):
        return R.equi_join(left, right, node.keys, "inner", right_wins=True)
    if isinstance(node, N.LeftJoin):
        return R.equi_join(left, right, node.keys, "left", right_wins=False)
    return {N.Exists: exists, N.Pull: pull, N.PullStar: pull_star}[type(node)](left, right, node)


def rows(node: N.Node, catalog: Catalog) -> DataFrame:
    """The node's rows as a bag; it has repetitions only where ``key_of`` is None."""
    if isinstance(node, N.From):
        return R.project(catalog.frame(node.table), node)
    if isinstance(node, N.Rel):
        return R.rel(catalog.spark, node)
    if type(node) in R.ROW_WISE:
        return R.ROW_WISE[type(node)](rows(node.input, catalog), node)
    if isinstance(node, N.Exists) and not node.keys:
        return R.exists_local(rows(node.input, catalog), node)
    below = rows(node.input, catalog)
    if isinstance(node, (N.Limit, N.Offset, N.Aggregate)):
        below = as_set(below, node.input, catalog)
        if isinstance(node, N.Aggregate):
            return aggregate(below, node)
        return (limit if isinstance(node, N.Limit) else offset)(below, node.n)
    right = rows(node.right, catalog)
    if isinstance(node, N.PullStar):
        right = as_set(right, node.right, catalog)
    return combine(node, below, right)


def compile_plan(node: N.Node, catalog: Catalog) -> DataFrame:
    """The query's result over the catalog's tables, as a set of documents."""
    return conform(as_set(rows(node, catalog), node, catalog))
