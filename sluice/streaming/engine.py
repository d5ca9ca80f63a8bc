"""Registered queries that follow transactions."""

from __future__ import annotations

import atexit
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import batch as B
from ..operators.rows import frame_of
from ..plans import nodes as N
from ..plans.dsl import Q
from ..plans.parser import parse
from ..sources.catalog import Catalog
from .incremental import Changes
from .index import TableIndex
from .state import ResultLog, Store, TableState, fresh_folder, latest
from .zset import ChangeSet, conform

Callback = Callable[[ChangeSet], None]


@dataclass
class RegisteredQuery:
    id: str
    text: str | None
    plan: N.Node
    callback: Callback | None
    results: ResultLog
    created_at: float = field(default_factory=time.time)

    @property
    def tables(self) -> frozenset[str]:
        return self.plan.tables()


@dataclass(frozen=True)
class TxResult:
    affected_query_count: int
    callbacks_fired: int
    errors: dict[str, Exception]
    changes: dict[str, ChangeSet]


def _drop_folder(store: Store) -> None:
    try:
        store.drop(store.path)
    except Exception:  # noqa: BLE001 - the session may have ended already
        pass


class Engine:
    """Tables, queries over them, and their results, kept in a folder (``path``).

    Without a path the folder is a temporary one and goes when the program ends.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, parallel: int = 4):
        self.spark, self.parallel = spark, parallel
        self.store = Store(spark, path or fresh_folder(spark))
        if path is None:
            atexit.register(_drop_folder, self.store)
        self.tables: dict[str, TableState] = {}
        self.queries: dict[str, RegisteredQuery] = {}
        self.index = TableIndex()
        #: The last batch applied of every feed, by source and table.
        self.batches: dict[str, int] = {}
        self._saved_results: dict[str, dict] = {}
        self._recent: list[set[str]] = []
        if manifest := self.store.load():
            self.tables = {n: TableState.restored(self.store, x) for n, x in manifest["tables"].items()}
            self.batches = manifest["batches"]
            self._saved_results = manifest["results"]

    # -- registry -----------------------------------------------------------

    def register_query(self, query_id: str, query: str | Q | N.Node, callback: Callback | None = None, backfill: bool = False) -> RegisteredQuery:
        """Follow a query from now on; with ``backfill`` its result starts with what the tables hold.

        After a restart, a query of the same id goes on from its saved result.
        """
        if not query_id or query is None:
            raise ValueError("a query needs an id and a text")
        plan = parse(query) if isinstance(query, str) else query.plan if isinstance(query, Q) else query
        saved = self._saved_results.pop(query_id, None)
        results = ResultLog.restored(self.store, saved) if saved else self._fresh_result(plan, backfill)
        q = RegisteredQuery(query_id, query if isinstance(query, str) else None, plan, callback, results)
        self.queries[query_id] = q
        self.index.add(query_id, q.tables)
        return q

    def _fresh_result(self, plan: N.Node, backfill: bool) -> ResultLog:
        # A query over inline rows alone has its result at once, and it never changes.
        if backfill or not plan.tables():
            return ResultLog(self.store).fill(B.compile_plan(plan, self.catalog()))
        return ResultLog(self.store, partial=bool(plan.tables() & self.tables.keys()))

    def unregister_query(self, query_id: str) -> RegisteredQuery | None:
        """Forget a query; the files of its result go with the next transactions."""
        self.index.remove(query_id)
        return self.queries.pop(query_id, None)

    def list_queries(self) -> list[str]:
        return sorted(self.queries)

    def query_info(self, query_id: str) -> dict[str, Any] | None:
        q = self.queries.get(query_id)
        return q and {"query_id": q.id, "query": q.text, "tables": sorted(q.tables), "created_at": q.created_at}

    def query_results(self, query_id: str) -> DataFrame:
        """The query's result as it stands; its files are kept until two more transactions have ended."""
        q = self.queries[query_id]
        frame = q.results.frame()
        return B.conform(frame) if frame is not None else self.spark.createDataFrame([], T.StructType([]))

    def query_state(self, query_id: str) -> dict[str, Any]:
        """What is kept for a query: its nodes from the source on, the files of its result, and whether it began late."""
        q = self.queries[query_id]
        return {"nodes": q.plan.outline(), "result_files": sorted(q.results.files()), "partial": q.results.partial}

    def table_state(self, table: str) -> dict[str, Any]:
        state = self.tables[table]
        return {"schema": state.schema.simpleString(), "files": sorted(state.files()), "base_rows": state.base_rows}

    def reset_query(self, query_id: str) -> None:
        """Forget one result; the query follows changes from here."""
        q = self.queries[query_id]
        q.results = self._fresh_result(q.plan, False)

    def reset_all_queries(self) -> None:
        """Forget all results; queries follow changes from here."""
        for query_id in self.queries:
            self.reset_query(query_id)

    def registry_stats(self) -> dict[str, int]:
        return self.index.stats()

    def find_affected(self, tables: set[str]) -> list[RegisteredQuery]:
        return [self.queries[i] for i in sorted(self.index.find(tables))]

    def catalog(self, tables: dict[str, TableState] | None = None) -> Catalog:
        catalog = Catalog(self.spark)
        for name, state in (self.tables if tables is None else tables).items():
            catalog.add(name, state.frame, "_id")
        return catalog

    # -- transactions -------------------------------------------------------

    def execute_tx(self, ops: list[tuple]) -> TxResult:
        """Apply ("put-docs", table, doc ...) and ("delete-docs", table, id ...) in order; other operations are ignored.

        Of several entries for one id the last holds.
        """
        last: dict[str, dict[Any, tuple[str, Any]]] = {}
        for op, *rest in ops:
            if op == "put-docs":
                table, *docs = rest
                for doc in docs:
                    doc = {{"xt/id": "_id"}.get(k, k): v for k, v in doc.items()}
                    last.setdefault(table, {})[doc.get("_id")] = ("put", doc)
            elif op == "delete-docs":
                table, *ids = rest
                for i in ids:
                    last.setdefault(table, {})[i] = ("delete", i)
        frames = {}
        for table, entries in last.items():
            puts = [doc if "_id" in doc else {"_id": None} | doc for kind, doc in entries.values() if kind == "put"]
            gone = [{"_id": i} for kind, i in entries.values() if kind == "delete"]
            known = self.tables[table].schema if table in self.tables else None
            if not puts and known is None:
                continue  # deletes from a table that has no rows
            id_type = known["_id"].dataType if known is not None else None
            put_frame = frame_of(self.spark, puts) if puts else self.spark.createDataFrame([], T.StructType([T.StructField("_id", id_type)]))
            schema = T.StructType([T.StructField("_id", id_type or put_frame.schema["_id"].dataType)])
            frames[table] = (put_frame, frame_of(self.spark, gone, schema))
        return self._apply(frames, {})

    def apply_changes(self, table: str, changes: DataFrame, batch_id: int | None = None, source: str = "") -> TxResult:
        """Apply a changelog (_id, _op: put or delete, optional _seq, fields).

        Of several entries for one id that with the highest ``_seq`` holds, without
        ``_seq`` the last in reading order.  A batch of this source and table that was
        applied before is skipped.
        """
        feed = f"{source}#{table}"
        if batch_id is not None and batch_id <= self.batches.get(feed, -1):
            return TxResult(0, 0, {}, {})
        log = changes if "_seq" in changes.columns else changes.withColumn("_seq", F.monotonically_increasing_id())
        log = latest(log)
        puts = log.where("_op = 'put'").drop("_op")
        return self._apply({table: (puts, log.where("_op = 'delete'").select("_id"))}, {} if batch_id is None else {feed: batch_id})

    def _apply(self, frames: dict[str, tuple[DataFrame, DataFrame]], batches: dict[str, int]) -> TxResult:
        after, deltas = dict(self.tables), {}
        before = dict(self.tables)
        for table, (puts, deletes) in frames.items():
            state = self.tables.get(table) or TableState(self.store, T.StructType([]))
            after[table], deltas[table] = state.apply(puts, deletes)
        # The old state is read in the new, wider schema.
        old = Catalog(self.spark)
        for name, state in before.items():
            schema = after[name].schema
            old.add(name, state.frame if state.schema == schema else (lambda s=state, w=schema: conform(s.frame(), w)), "_id")
        for name in after.keys() - before.keys():
            old.add(name, self.spark.createDataFrame([], after[name].schema), "_id")
        changes = Changes(old, self.catalog(after), deltas)
        affected, fired, errors, told = self.find_affected(set(frames)), 0, {}, {}
        pending: list[tuple[RegisteredQuery, ChangeSet]] = []

        def follow(q: RegisteredQuery) -> tuple[ResultLog, ChangeSet] | Exception:
            try:
                delta = changes.of_result(q.plan)
                return (q.results, ChangeSet()) if delta is None else q.results.append(delta)
            except Exception as e:  # noqa: BLE001 - one query's failure leaves the others be
                return e

        # Small changes make small jobs: queries run side by side.
        with ThreadPoolExecutor(self.parallel) as pool:
            for q, done in zip(affected, pool.map(follow, affected), strict=True):
                if isinstance(done, Exception):
                    errors[q.id] = done
                    # What the result lacks from here on can't be retracted from it.
                    q.results = replace(q.results, partial=True)
                else:
                    q.results, told[q.id] = done
                    pending.append((q, done[1]))
        self.tables = after
        self.batches |= batches
        self._save()
        for q, change in pending:
            if change and q.callback:
                try:
                    q.callback(change)
                    fired += 1
                except Exception as e:  # noqa: BLE001
                    errors[q.id] = e
        return TxResult(len(affected), fired, errors, told)

    def _save(self) -> None:
        results = self._saved_results | {q.id: q.results.saved() for q in self.queries.values()}
        self.store.save({"tables": {n: t.saved() for n, t in self.tables.items()}, "results": results, "batches": self.batches})
        live = set().union(*(t.files() for t in self.tables.values()), *(q.results.files() for q in self.queries.values()))
        live |= {path for x in self._saved_results.values() for path, _ in x["logs"]}
        # Change sets and results handed out may be read until two more transactions have ended.
        self._recent = [*self._recent[-1:], live | self.store.fresh]
        self.store.fresh = set()
        self.store.keep_only(live.union(*self._recent))
