"""Approximate nearest neighbours: an NN-descent graph and greedy graph search.

Building.  Equal vectors are one node.  Random hyperplanes put nodes into buckets
whose members propose each other; then each round joins the graph with itself:
the neighbours and reverse neighbours of every node meet and propose each other
(neighbours of neighbours), and every node keeps its ``K`` best.  Proposals are
compared on 8-bit codes; a node hears only of those that beat its worst
neighbour.  Rounds end when hardly an edge is new.  Groups of more than ``BLOCK`` members are dealt into blocks, anew in
every round, so a hub that many nodes point to never meets in one task.

Searching.  Every query holds its ``BEAM`` nearest nodes so far.  A step joins
those not yet expanded with the graph in both directions, scores the new nodes
on the original vectors in double precision, and keeps the best, until no query
finds anything nearer.  Nodes found are then expanded to all rows they stand for.

Edge cases: null, zero and empty vectors and vectors with null or non-finite
components take no part, as queries or as candidates, nor do null ids; vectors of
different lengths are never compared; of rows with one id the smallest vector
counts; a query gets fewer results where there are fewer candidates; ties go to the
smaller id; an empty table gives no rows.  Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, materialize, ship

K, BEAM, BLOCK, TABLES, BUCKET = 32, 96, 256, 6, 96
#: Share of edges that a round may renew once the graph counts as finished.
SETTLED = 0.01
#: Nodes, spread over the graph, from which every query starts besides its own.
ENTRIES = 64


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): one usable vector of doubles per id."""
    v = F.col("v")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _codes(nodes: DataFrame) -> DataFrame:
    """(id, code): scale (4 bytes) and 8-bit components of the unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = _units(b.column(1))
                scale = np.abs(unit).max(axis=1) / 127
                q = np.rint(unit / scale[:, None]).astype(np.int8)
                codes = [s.tobytes() + r.tobytes() for s, r in zip(scale.astype(np.float32), q, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], ["id", "code"])

    return nodes.select("id", "v").mapInArrow(run, "id long, code binary")


def _units(column: pa.Array) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _decode(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def _buckets(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(g, u): bucket of every node in every table of random hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = _units(b.column(1))
                planes = np.random.default_rng(7).normal(size=(unit.shape[1], tables * max(1, bits)))
                sign = (unit @ planes > 0).reshape(len(unit), tables, -1)[:, :, :bits]
                g = sign @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << 48)
                yield pa.RecordBatch.from_arrays([pa.array(g.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), tables))], ["g", "u"])

    return nodes.select("id", "v").mapInArrow(run, "g long, u long")


def _local_join(members: DataFrame, nodes: DataFrame, k: int, turn: int) -> DataFrame:
    """(u, v, s): members (g, u) of a group propose each other, at most the ``k`` best that beat ``low``.

    ``nodes``: id, code, low (similarity of the node's worst neighbour).
    """
    sizes = members.groupBy("g").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("u", F.lit(turn)), F.ceil(F.col("n") / BLOCK))
    dealt = members.join(sizes, "g").where("n > 1").select(F.xxhash64("g", block).alias("g"), "u")
    rows = dealt.join(nodes, dealt.u == nodes.id).select("g", "u", "low", "code")
    rows = rows.repartition("g").sortWithinPartitions("g")

    def propose(u: np.ndarray, low: np.ndarray, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = _decode(codes)
        s = m @ m.T
        s[u[:, None] == u[None, :]] = -2.0
        if k < len(u) - 1:
            best = np.argpartition(-s, k, axis=1)[:, :k]
        else:
            best = np.broadcast_to(np.arange(len(u)), s.shape)
        value = np.take_along_axis(s, best, axis=1)
        keep = value > np.maximum(low[:, None], -1.5)
        return np.broadcast_to(u[:, None], best.shape)[keep], u[best][keep], value[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            yield from groups(t.slice(0, cut)) if (cut := last_group(t)) else ()
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from groups(held)

    def last_group(t: pa.Table) -> int:
        g = t.column("g").to_numpy()
        return int(np.searchsorted(g, g[-1], "left")) if len(g) else 0

    def groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
        g, u, low = (t.column(c).to_numpy() for c in ("g", "u", "low"))
        codes = t.column("code").to_pylist()
        edges = np.concatenate([np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), [len(g)]])
        found, n = [], 0
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for p in range(a, z, 4 * BLOCK):  # a block that chance made large is cut again
                q = min(z, p + 4 * BLOCK)
                if q - p > 1:
                    found.append(propose(u[p:q], low[p:q], codes[p:q]))
                    n += len(found[-1][0])
            if n > 100_000:
                yield pa.RecordBatch.from_arrays(*_columns(found))
                found, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays(*_columns(found))

    return rows.mapInArrow(run, "u long, v long, s float")


def _columns(found: list[tuple]) -> tuple[list[pa.Array], list[str]]:
    us, vs, ss = (np.concatenate(x) for x in zip(*found, strict=True))
    return [pa.array(us), pa.array(vs), pa.array(ss.astype(np.float32))], ["u", "v", "s"]


def _best(edges: DataFrame, k: int) -> DataFrame:
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    order = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("u", "v", "s", "new")


def build(nodes: DataFrame, k: int = K, settled: float = SETTLED) -> DataFrame:
    """(u, v, s): the ``k`` nearest neighbours found for every node (id, v).

    Rounds go on until at most the share ``settled`` of all edges is new.  They end:
    every new edge is better than the one it replaces.
    """
    ship(nodes.sparkSession)
    codes = materialize(_codes(nodes), "codes")
    bits = max(0, math.ceil(math.log2(max(1, codes.count() / BUCKET))))
    start = codes.select("id", "code", F.lit(-2.0).cast("float").alias("low"))
    new = F.lit(1).alias("new")
    graph = materialize(_best(_local_join(_buckets(nodes, bits, TABLES), start, k, 0).select("*", new), k), "graph")
    turn, edges, fresh = 0, 1, 1
    while fresh > settled * edges:
        turn += 1
        low = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("low"))
        known = codes.join(low, codes.id == low.u, "left").select("id", "code", F.coalesce("low", F.lit(-2.0).cast("float")).alias("low"))
        members = graph.select(F.col("u").alias("g"), F.col("v").alias("u")).union(graph.select(F.col("v").alias("g"), "u")).distinct()
        found = _local_join(members, known, k, turn).select("*", new)
        better = materialize(_best(graph.withColumn("new", F.lit(0)).union(found), k), "graph")
        discard(graph)
        graph = better
        edges, fresh = graph.agg(F.count("*"), F.coalesce(F.sum("new"), F.lit(0))).first()
    discard(codes)
    return graph.drop("new")


def _scaled(x, by):
    """Column: x / 2**by in two halves, as 2**by itself may be out of range."""
    half = F.floor(by / 2)
    return x / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), by - half)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM) -> DataFrame:
    """(q, id, s): for every query (q, qv, own) its ``beam`` nearest nodes by greedy graph search.

    ``own``: a node at which the query's search starts as well, or null.
    """
    both = materialize(graph.select("u", "v").union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both")
    entries = nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(ENTRIES)
    queries = materialize(queries.select("q", "qv", "own", F.sqrt(_dot("qv", "qv")).alias("qn")), "queries")
    nodes = materialize(nodes.select("id", "v", F.sqrt(_dot("v", "v")).alias("vn")), "norms")

    def scored(pairs: DataFrame) -> DataFrame:
        found = pairs.join(queries.select("q", "qv", "qn"), "q").join(nodes, "id")
        return found.select("q", "id", (_dot("qv", "v") / (F.col("qn") * F.col("vn"))).alias("s"), F.lit(False).alias("done"))

    def nearest(pairs: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy(F.desc("s"), "id")
        return pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= beam).drop("r")

    begin = queries.select("q", F.explode(F.lit([r["id"] for r in entries.collect()]).cast("array<long>")).alias("id"))
    begin = begin.union(queries.where("own is not null").select("q", F.col("own").alias("id"))).distinct()
    visited = materialize(begin, "visited")
    seen = [visited]
    held = materialize(nearest(scored(visited)), "beam")
    # A step visits only new nodes, so the search ends.
    while not (open_ := held.where(~F.col("done"))).isEmpty():
        new = open_.select("q", F.col("id").alias("u")).join(both, "u").select("q", F.col("v").alias("id")).distinct()
        new = materialize(new.join(visited, ["q", "id"], "left_anti"), "new")
        seen.append(new)
        visited = visited.union(new)
        nearer = materialize(nearest(held.withColumn("done", F.lit(True)).union(scored(new))), "beam")
        discard(held)
        held = nearer
    discard(both, queries, nodes, *seen)
    return held.select("q", "id", "s")


def neighbours(rows: DataFrame, is_query: F.Column, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found for every row where ``is_query`` (of ``vec_id``) holds.

    Vectors of different lengths have no cosine: each length is searched on its own.
    """
    usable = materialize(valid_vectors(rows, id_col, vector_col), "vectors")
    sizes = [r["n"] for r in usable.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    found = [_neighbours(usable.where(F.size("v") == n), is_query, top) for n in sizes or [0]]
    return reduce(DataFrame.union, found)


def _neighbours(usable: DataFrame, is_query: F.Column, top: int) -> DataFrame:
    nodes = usable.groupBy("v").agg(F.min("vec_id").alias("id")).select("id", "v")
    nodes = materialize(nodes, "nodes")
    members = materialize(usable.join(nodes, "v").select("vec_id", "id"), "members")
    # By a power of two, which changes no cosine, so that no product leaves the range of doubles.
    most = F.array_max(F.transform("v", F.abs))
    nodes = nodes.withColumn("_by", F.floor(F.log2(most))).withColumn("v", F.transform("v", lambda x: _scaled(x, F.col("_by")))).drop("_by")
    graph = build(nodes)
    # Queries with equal vectors search once, as the node that they share.
    asked = members.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
    distinct = asked.select("q").distinct().join(nodes, F.col("q") == nodes.id).select("q", F.col("v").alias("qv"), F.col("q").alias("own"))
    found = search(distinct, nodes, graph)
    # Of the rows that a node stands for, a query needs the first few ids, its own aside.
    order = Window.partitionBy("id").orderBy("vec_id")
    first = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1).drop("r")
    near = found.join(first, "id").select("q", "vec_id", "s")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "vec_id")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1).drop("r")
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    answers = asked.join(near, "q").where("query_id <> vec_id").withColumn("rank", F.row_number().over(order))
    return answers.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", F.col("s").alias("score"))
