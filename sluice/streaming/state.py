"""Versioned state in files: tables, result logs and the manifest that names the current ones."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import column
from ..operators.rows import WEIGHT, settled, visible, widen
from .zset import ChangeSet, conform, consolidate, union, weighted

#: Changed rows beside a table's base, as a share of it, before both are merged; and log files of a result.
MERGE_SHARE, MERGE_ROWS, MERGE_LOGS = 0.2, 10_000, 16
#: Manifests that stay: the newest, and the one before in case the newest is cut short.
MANIFESTS = 2


def fresh_folder(spark: SparkSession) -> str:
    """A new folder where ``spark.checkpoint.dir`` says; only where that is unset, on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/engine-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="sluice-engine-")


class Store:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: Files written by this engine or named by the manifest it began with, and those of this transaction.
        self.known: set[str] = set()
        self.fresh: set[str] = set()
        self._number = 0

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def write(self, df: DataFrame, kind: str) -> str:
        path = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.known.add(path)
        self.fresh.add(path)
        return path

    def read(self, path: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)
        self.known.discard(path)
        self.fresh.discard(path)

    def keep_only(self, live: set[str]) -> None:
        """Delete all known files but these."""
        for path in self.known - live:
            self.drop(path)

    def _manifests(self) -> list[tuple[int, str]]:
        """(number, path) of all whole manifests, newest last; unfinished ones have another name."""
        fs, folder = self._fs(self.path)
        if not fs.exists(folder):
            return []
        found = [str(s.getPath().toString()) for s in fs.listStatus(folder)]
        return sorted((int(m[1]), p) for p in found if (m := re.search(r"/manifest-(\d+)\.json$", p)))

    def save(self, manifest: dict) -> None:
        """Write the manifest under the next number; older ones go after that."""
        older = self._manifests()
        self._number = max([self._number, *(n for n, _ in older)]) + 1
        target = f"{self.path}/manifest-{self._number:012d}.json"
        fs, unfinished = self._fs(f"{target}.part")
        out = fs.create(unfinished, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(unfinished, self._fs(target)[1]):
            raise OSError(f"can't write {target}")
        for _, path in older[: len(older) + 1 - MANIFESTS]:
            fs.delete(self._fs(path)[1], False)

    def load(self) -> dict | None:
        found = self._manifests()
        if not found:
            return None
        fs, at = self._fs(found[-1][1])
        stream = fs.open(at)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)


@dataclass(frozen=True)
class TableState:
    """A table at one version: a base and a small overlay of rows changed since, by id."""

    store: Store
    schema: T.StructType
    base: str | None = None
    overlay: str | None = None
    base_rows: int = 0

    def _overlay(self) -> DataFrame | None:
        if self.overlay is None:
            return None
        return self.store.read(self.overlay, T.StructType([*self.schema.fields, T.StructField("_deleted", T.BooleanType())]))

    def files(self) -> set[str]:
        return {p for p in (self.base, self.overlay) if p}

    def frame(self) -> DataFrame:
        """The table's documents."""
        base = self.store.read(self.base, self.schema) if self.base else self.store.spark.createDataFrame([], self.schema)
        over = self._overlay()
        if over is None:
            return base
        kept = base.join(over.select(F.col("_id").alias("_o")), F.col("_id").eqNullSafe(F.col("_o")), "left_anti")
        return kept.unionByName(over.where("not _deleted").drop("_deleted"))

    def apply(self, puts: DataFrame, deletes: DataFrame) -> tuple[TableState, DataFrame]:
        """(next version, weighted change, not consolidated) for documents put (whole, one per id) and ids deleted."""
        schema = widen(self.schema, T.StructType([f for f in puts.schema.fields])) if self.schema.fields else puts.schema
        wide = replace(self, schema=schema)
        if schema != self.schema:
            wide = replace(wide, base=self.store.write(conform(self.frame(), schema), "tables") if self.base or self.overlay else None, overlay=None)
        puts = conform(puts, schema)
        if not wide.base and not wide.overlay:
            # Nothing is there to be retracted: the documents are the table and its change.
            base = self.store.write(puts, "tables")
            after = replace(wide, base=base, base_rows=self.store.read(base, schema).count())
            return after, weighted(after.frame(), 1)
        # Written first: from then on its size is known, and a small one is sent to the table instead of the table being moved.
        gone = conform(deletes.select(F.col("_id").cast(schema["_id"].dataType).alias("_id")), schema).withColumn("_deleted", F.lit(True))
        path = self.store.write(puts.withColumn("_deleted", F.lit(False)).unionByName(gone), "overlays")
        fresh = replace(wide, overlay=path)._overlay()
        ids = fresh.select(F.col("_id").alias("_o"))
        old = wide.frame().join(ids, F.col("_id").eqNullSafe(F.col("_o")), "left_semi")
        # What is put unchanged stands with both weights; every reader consolidates.
        delta = weighted(fresh.where("not _deleted").drop("_deleted"), 1).union(weighted(old, -1))

        def overlaid() -> TableState:
            over, at = wide._overlay(), path
            if over is not None:
                at = self.store.write(over.join(ids, F.col("_id").eqNullSafe(F.col("_o")), "left_anti").unionByName(fresh), "overlays")
            after = replace(wide, overlay=at)
            if after._overlay().count() <= max(MERGE_ROWS, MERGE_SHARE * self.base_rows):
                return after
            base = self.store.write(after.frame(), "tables")
            return replace(after, base=base, overlay=None, base_rows=self.store.spark.read.parquet(base).count())

        with ThreadPoolExecutor(2) as pool:
            after, delta_path = pool.submit(overlaid), pool.submit(self.store.write, delta, "changes")
        return after.result(), self.store.read(delta_path.result(), T.StructType([*schema.fields, T.StructField("_w", T.LongType())]))

    def saved(self) -> dict:
        return {"schema": self.schema.json(), "base": self.base, "overlay": self.overlay, "base_rows": self.base_rows}

    @classmethod
    def restored(cls, store: Store, x: dict) -> TableState:
        state = cls(store, T.StructType.fromJson(json.loads(x["schema"])), x["base"], x["overlay"], x["base_rows"])
        store.known |= state.files()
        return state


@dataclass(frozen=True)
class ResultLog:
    """A query's result as a log of weighted changes.

    A ``partial`` result began empty although its tables held documents: changes can
    retract rows that it never had, and those retractions are left out.
    """

    store: Store
    logs: tuple[tuple[str, str], ...] = ()
    partial: bool = False

    def append(self, delta: DataFrame) -> tuple[ResultLog, ChangeSet]:
        """(next version, the change); an empty change leaves the log as it is.

        Files hold untyped nulls as strings; the log's own schema remembers that
        no document has had such a field yet.
        """
        if self.partial:
            delta = self._without_strangers(delta)
        schema = delta.schema
        path = self.store.write(conform(delta, settled(schema)), "results")
        change = self.store.read(path, settled(schema))
        if change.isEmpty():
            self.store.drop(path)
            return self, ChangeSet()
        log = replace(self, logs=(*self.logs, (path, schema.json())))
        if len(log.logs) > MERGE_LOGS:
            whole = log._consolidated()
            path = self.store.write(conform(whole, settled(whole.schema)), "results")
            log = replace(log, logs=((path, whole.schema.json()),))
        return log, ChangeSet(change)

    def _without_strangers(self, delta: DataFrame) -> DataFrame:
        """The change without retractions of rows that the result doesn't hold."""
        held = self.frame()
        if held is None:
            return delta.where(F.col(WEIGHT) > 0)
        names = visible(delta)
        schema = settled(widen(T.StructType([f for f in delta.schema.fields if f.name in names]), held.schema))
        rows = conform(held, schema).toDF(*(f"h{i}" for i in range(len(schema.fields))))
        own = conform(delta, T.StructType([*schema.fields, T.StructField(WEIGHT, T.LongType())]))
        on = reduce(lambda a, b: a & b, (column(f.name).eqNullSafe(F.col(f"h{i}")) for i, f in enumerate(schema.fields)), F.lit(True))
        return own.where(F.col(WEIGHT) > 0).union(own.where(F.col(WEIGHT) < 0).join(rows, on, "left_semi"))

    def fill(self, rows: DataFrame) -> ResultLog:
        """A log that begins with the given rows."""
        delta = weighted(rows, 1)
        path = self.store.write(conform(delta, settled(delta.schema)), "results")
        return replace(self, logs=((path, delta.schema.json()),))

    def files(self) -> set[str]:
        return {p for p, _ in self.logs}

    def _read(self, path: str, schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        return conform(self.store.read(path, settled(kind)), kind)

    def _consolidated(self) -> DataFrame:
        return consolidate(union(*(self._read(p, s) for p, s in self.logs)))

    def frame(self) -> DataFrame | None:
        """The rows of the result, or None if it never had any."""
        return self._consolidated().where("_w > 0").drop("_w") if self.logs else None

    def saved(self) -> dict:
        return {"logs": [list(x) for x in self.logs], "partial": self.partial}

    @classmethod
    def restored(cls, store: Store, x: dict) -> ResultLog:
        log = cls(store, tuple(map(tuple, x["logs"])), x["partial"])
        store.known |= log.files()
        return log


def latest(changes: DataFrame) -> DataFrame:
    """Of a changelog (_id, _op, _seq ...) the last entry of every id."""
    order = Window.partitionBy("_id").orderBy(F.desc("_seq"))
    return changes.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_seq")
