"""Named tables and their keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.expressions import column


@dataclass
class Catalog:
    """Tables by name; a keyed table's documents get the key as ``_id``."""

    spark: SparkSession
    _tables: dict[str, tuple[Callable[[], DataFrame], str | None]] = field(default_factory=dict)

    def add(self, name: str, source: DataFrame | Callable[[], DataFrame], key: str | None = None) -> Catalog:
        self._tables[name] = (source if callable(source) else lambda: source, key)
        return self

    def add_parquet(self, name: str, path: str, key: str | None = None) -> Catalog:
        return self.add(name, lambda: self.spark.read.parquet(path), key)

    def add_file(self, name: str, path: str, fmt: str, key: str | None = None, schema: str | None = None, **options: str) -> Catalog:
        """A table in any format that Spark reads (parquet, csv, json, orc, jdbc ...)."""

        def load() -> DataFrame:
            reader = self.spark.read.format(fmt).options(**options)
            return (reader.schema(schema) if schema else reader).load(path)

        return self.add(name, load, key)

    def keyed(self, name: str) -> bool:
        return name in self._tables and self._tables[name][1] is not None

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def frame(self, name: str) -> DataFrame:
        """The table's documents, with ``_id`` if it has a key; an unknown table has none, and ids of no type yet."""
        if name not in self._tables:
            return self.spark.createDataFrame([], "_id void")
        load, key = self._tables[name]
        df = load()
        return df.withColumn("_id", column(key)) if key is not None and key != "_id" else df
