"""Plans to changes: the weighted rows that a change of the tables adds to a result.

Row-wise operators map the changes of their input.  Inner joins are bilinear:
changes of one side meet the other side's table.  Every other operator works by
keys: only the keys (groups, join keys, values) that changed rows hold are
recomputed, before and after, and the difference is the change.  Sub-plans whose
tables did not change are skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import column
from ..operators import batch as B
from ..operators import rows as R
from ..plans import nodes as N
from ..sources.catalog import Catalog
from .zset import consolidate, union, weighted


class Changes:
    """Changes of plans between two states of the tables."""

    def __init__(self, old: Catalog, new: Catalog, tables: dict[str, DataFrame]):
        self.old, self.new, self.tables = old, new, tables

    def of_result(self, node: N.Node) -> DataFrame | None:
        """The change of the query's result, a set."""
        return self._as_set(node)

    def _touched(self, node: N.Node) -> bool:
        return bool(node.tables() & self.tables.keys())

    def _as_set(self, node: N.Node) -> DataFrame | None:
        delta = self._of(node)
        if delta is None:
            return None
        delta = consolidate(delta)
        if B.key_of(node, self.new) is not None:
            return delta
        # A value counts once, however many rows have it: look at the values that changed, before and after.
        names = R.visible(delta)
        values = delta.select(*(column(c).alias(f"k{i}") for i, c in enumerate(names)))
        sides = []
        for catalog, w in ((self.new, 1), (self.old, -1)):
            rows = B.rows(node, catalog)
            sides.append(weighted(self._only(rows, [column(c) for c in names], values).distinct(), w))
        return consolidate(union(*sides))

    @staticmethod
    def _only(df: DataFrame, by: list[Column], keys: DataFrame) -> DataFrame:
        """The rows whose expressions ``by`` are among ``keys`` (k0, k1 ...), nulls included."""
        marked = df.select("*", *(c.alias(f"_b{i}") for i, c in enumerate(by)))
        types = ((R.type_of(marked, f"_b{i}"), R.type_of(keys, f"k{i}")) for i in range(len(by)))
        on = reduce(lambda a, b: a & b, (R.same(F.col(f"_b{i}"), a, F.col(f"k{i}"), b) for i, (a, b) in enumerate(types)))
        return marked.join(keys, on, "left_semi").drop(*(f"_b{i}" for i in range(len(by))))

    def _of(self, node: N.Node) -> DataFrame | None:
        """The change of the node's rows as a bag, or None if there is none."""
        if not self._touched(node):
            return None
        if isinstance(node, N.From):
            return consolidate(R.project(self.tables[node.table], node))
        if type(node) in R.ROW_WISE:
            return R.ROW_WISE[type(node)](self._of(node.input), node)
        if isinstance(node, N.Exists) and not node.keys:
            return R.exists_local(self._of(node.input), node)
        if isinstance(node, (N.Join, N.Unify)):
            return self._bilinear(node)
        if isinstance(node, N.Aggregate) and node.group:
            return self._groups(node)
        if isinstance(node, (N.Aggregate, N.Limit, N.Offset)):
            return consolidate(union(weighted(B.rows(node, self.new), 1), weighted(B.rows(node, self.old), -1)))
        return self._keyed(node)

    def _bilinear(self, node: N.Join | N.Unify) -> DataFrame | None:
        left, right = self._of(node.input), self._of(node.right)
        wins = isinstance(node, N.Unify)
        parts = []
        if left is not None:
            parts.append(R.equi_join(left, B.rows(node.right, self.new), node.keys, "inner", wins))
        if right is not None:
            parts.append(R.equi_join(B.rows(node.input, self.old), right, node.keys, "inner", wins))
        return union(*parts) if parts else None

    def _groups(self, node: N.Aggregate) -> DataFrame | None:
        delta = self._as_set(node.input)
        if delta is None:
            return None
        keys = delta.select(*(c.alias(f"k{i}") for i, c in enumerate(B.grouping(delta, node)))).distinct()
        sides = []
        for catalog, w in ((self.new, 1), (self.old, -1)):
            rows = B.rows(node.input, catalog)
            rows = self._only(rows, B.grouping(rows, node), keys)
            sides.append(weighted(B.aggregate(B.as_set(rows, node.input, catalog), node), w))
        return consolidate(union(*sides))

    def _keyed(self, node: N.LeftJoin | N.Exists | N.Pull | N.PullStar) -> DataFrame | None:
        keys = []
        for side, delta in enumerate((self._of(node.input), self._of(node.right))):
            if delta is not None:
                names = [k[side] for k in node.keys]
                keys.append(delta.select(*((column(n) if n in delta.columns else F.lit(None)).alias(f"k{i}") for i, n in enumerate(names))))
        if not keys:
            return None
        touched = union(*keys).distinct()
        sides = []
        for catalog, w in ((self.new, 1), (self.old, -1)):
            inputs = []
            for side, below in enumerate((node.input, node.right)):
                rows = B.rows(below, catalog)
                by = [column(k[side]) if k[side] in rows.columns else F.lit(None) for k in node.keys]
                inputs.append(self._only(rows, by, touched))
            if isinstance(node, N.PullStar):
                inputs[1] = B.as_set(inputs[1], node.right, catalog)
            sides.append(weighted(B.combine(node, *inputs), w))
        return consolidate(union(*sides))
