"""Weighted rows: a change set is rows with a weight, positive for added and negative for removed ones."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import column
from ..operators.rows import WEIGHT, visible, widen


def weighted(df: DataFrame, w: int) -> DataFrame:
    return df.withColumn(WEIGHT, F.lit(w).cast("long"))


def tagged(df: DataFrame, name: str, value: Any) -> DataFrame:
    """The rows with a constant field more, such as the source that they come from."""
    return df.withColumn(name, F.lit(value))


def untagged(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def consolidate(df: DataFrame) -> DataFrame:
    """Equal rows as one, their weights summed; rows of weight 0 go."""
    names = visible(df)
    if not names:
        return df.groupBy().agg(F.sum(WEIGHT).alias(WEIGHT)).where(f"{WEIGHT} <> 0")
    return df.groupBy(*map(column, names)).agg(F.sum(WEIGHT).alias(WEIGHT)).where(f"{WEIGHT} <> 0")


def _conformed(c: Column, have: T.DataType | None, want: T.DataType) -> Column:
    if isinstance(want, T.NullType):
        return F.lit(None)
    if have is None or isinstance(have, T.NullType):
        return F.lit(None).cast(want)
    if have == want:
        return c
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        types = {f.name: f.dataType for f in have.fields}
        fields = [_conformed(c.getField(f.name) if f.name in types else c, types.get(f.name), f.dataType).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: _conformed(x, have.elementType, want.elementType))
    return c.cast(want)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows in another, wider schema: absent fields are null."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*(_conformed(column(f.name), types.get(f.name), f.dataType).alias(f.name) for f in schema.fields))


def union(*frames: DataFrame) -> DataFrame:
    """Union by name in the narrowest schema that holds all."""
    schema = reduce(widen, (f.schema for f in frames))
    # Nullability aside, types are what must agree.
    return reduce(lambda a, b: a.union(b), (conform(f, schema) for f in frames))


def document(row: Row | dict[str, Any]) -> dict[str, Any]:
    """A row as a document: fields without a value are absent."""

    def plain(x: Any) -> Any:
        if isinstance(x, Row):
            x = x.asDict()
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items() if v is not None}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return {k: v for k, v in plain(row).items() if k != WEIGHT}


@dataclass(frozen=True)
class Modified:
    id: Any
    old: dict[str, Any]
    new: dict[str, Any]

    @property
    def changes(self) -> dict[str, tuple[Any, Any]]:
        names = self.old.keys() | self.new.keys()
        return {n: (self.old.get(n), self.new.get(n)) for n in sorted(names) if self.old.get(n) != self.new.get(n)}


@dataclass(frozen=True)
class ChangeSet:
    """What a transaction did to a result; true if it did anything.

    ``frame`` is the change as weighted rows, wherever they lie.  Only asking for
    ``added``, ``removed`` or ``modified`` brings them to the driver; ``modified``
    rows are in the other two as well.  The files behind it are kept until two more
    transactions have ended.
    """

    frame: DataFrame | None = None

    @cached_property
    def _rows(self) -> list[Row]:
        return [] if self.frame is None else self.frame.collect()

    @property
    def added(self) -> list[dict[str, Any]]:
        return [document(r) for r in self._rows if r[WEIGHT] > 0]

    @property
    def removed(self) -> list[dict[str, Any]]:
        return [document(r) for r in self._rows if r[WEIGHT] < 0]

    @property
    def modified(self) -> list[Modified]:
        """Pairs of an old and a new row of one id, where every row has an id."""
        added, removed = self.added, self.removed
        if not all("_id" in r for r in (*added, *removed)):
            return []
        old = {repr(r["_id"]): r for r in removed}
        return [Modified(r["_id"], old[repr(r["_id"])], r) for r in added if repr(r["_id"]) in old]

    def __bool__(self) -> bool:
        return self.frame is not None
