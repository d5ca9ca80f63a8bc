"""Near-duplicate detection on SimHash fingerprints by anchor-point covering.

Fingerprints of 64 bits link at ``THRESHOLD`` = 3 or fewer differing bits.  Of
two linked fingerprints one 32-bit half differs in at most one bit, so each half
is searched on its own with threshold 1:

* The anchors of a half are a covering code: the perfect Hamming code [31, 26]
  (covering radius 1) on bits 0-30, times both values of bit 31.
* A fingerprint's *home* is the anchor within the covering radius.
* A fingerprint is replicated to every anchor within covering radius plus
  threshold: 17 of the 2^27 anchors.  A partner's home is always one of them.
* Per anchor, homes are compared with replicas: the full 64-bit distance decides.

Equal fingerprints are one node, whatever their number.  The links join nodes,
and the components come from alternating large-star and small-star steps over
tables; nothing that grows with the corpus reaches the driver.

``similar`` links documents by the Jaccard similarity of their shingles, as the
pipeline asks.  Fingerprints of these shingles link by anchors as above; a linked
pair that is similar by its whole sets of shingle hashes joins two sets to a class.
Pairs at 0.8 differ in about 10 fingerprint bits and often in more, beyond what
anchors can cover, so an exact search between sets of different classes follows: by
a prefix filter, as under any one order of shingles (here by the count of a hashed
bucket, rare first) two such sets share a shingle of their prefixes.  Its candidates
are verified in the same way.  In lists of over ``SHORT`` sets, all are first held
against the first one; pairs of sets that are both linked to it, or in its class,
are connected already and are left out.

Edge cases: a null or blank text has fingerprint zero and links like any other;
a null id takes part but never names a component (a component without any id is
null); repeated rows give repeated result rows; an empty table gives no rows.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, ship

SEED, SHINGLE, THRESHOLD = 42, 3, 3
#: Shingle length and Jaccard similarity (as a fraction) of ``similar``.
WIDE, SIMILARITY = 5, (4, 5)
BUCKETS, SHORT = 1 << 18, 64
#: Words whose hashes a Python worker keeps at once; an odd factor that mixes them.
CACHE, _ODD = 400_000, np.uint64(0x9E3779B97F4A7C15)
#: Hashes whose bits are counted at once; bounds memory for very long texts.
_BLOCK = 1 << 16


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of the 64 bits."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return ones


def _majority(ones: np.ndarray, m: int) -> int:
    """The bits that over half of ``m`` hashes set."""
    return int.from_bytes(np.packbits(2 * ones > m, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: a bit is set if over half the shingle hashes set it."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, SEED)
    length = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(length + 1) - 1
    first, last = (end - length)[: n - shingle + 1], end[shingle - 1 :]
    m, ones = len(first), np.zeros(64, np.int64)
    for at in range(0, m, _BLOCK):
        spans = zip(first[at : at + _BLOCK].tolist(), last[at : at + _BLOCK].tolist(), strict=True)
        ones += _ones(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))
    return _majority(ones, m)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _anchors(half):
    """Column: home anchor and all anchors within two bits of ``half`` (32 bits in a long)."""
    #: Parity checks of the Hamming code: bit j of the syndrome covers the positions whose number has bit j.
    checks = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]

    def nearest(v):
        syndrome = sum(
            (F.shiftleft((F.bit_count(v.bitwiseAND(F.lit(c))) % 2).cast("int"), j) for j, c in enumerate(checks)),
            F.lit(0),
        )
        flip = F.when(syndrome > 0, F.expr("1L")).otherwise(F.expr("0L"))
        return v.bitwiseXOR(F.call_function("shiftleft", flip, syndrome - 1))

    flips = F.expr("transform(sequence(0, 31), i -> shiftleft(1L, i))")
    near = F.array_distinct(F.transform(flips, lambda e: nearest(half.bitwiseXOR(e))))
    return nearest(half), F.array_union(F.array(nearest(half)), near)


def links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct longs ``fp`` at ``threshold`` or fewer differing bits."""
    if threshold > 3:
        raise ValueError("two halves cover thresholds up to 3")
    halves = F.explode(
        F.array(
            F.struct(F.lit(0).alias("h"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")),
            F.struct(F.lit(1).alias("h"), F.shiftrightunsigned("fp", 32).alias("v")),
        )
    )
    halved = nodes.select("fp", halves.alias("x")).select("fp", "x.h", "x.v")
    home, near = _anchors(F.col("v"))
    homes = halved.select(F.col("fp").alias("a"), "h", home.alias("anchor"))
    replicas = halved.select(F.col("fp").alias("b"), "h", F.explode(near).alias("anchor"))
    # Spark takes an exploded table to be no larger than its source and would broadcast the replicas, 34 a node.
    found = homes.join(replicas.hint("merge"), ["h", "anchor"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    )
    return found.select("a", "b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Large-star and small-star steps in turn until nothing changes; every round
    is a table in the shared folder.
    """
    now = materialize(edges.select("a", "b"), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b")
        large = materialize(large.where("a <> b").distinct(), "large")
        up = large.select(F.col("b").alias("x"), F.col("a").alias("y"))  # y < x
        low = up.groupBy("x").agg(F.min("y").alias("m"))
        small = up.join(low, "x").select(F.col("m").alias("a"), F.explode(F.array("x", "y")).alias("b"))
        small = materialize(small.where("a <> b").distinct(), "small")
        discard(now, large)
        now = small
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable, itself included)."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), threshold))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = placed.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp", "left").select("doc_id", "fp", "component_id")


class Shingles:
    """Hashes of word shingles, mixed from the words' hashes; one per Python worker, with a bounded memory of words."""

    _open: Shingles | None = None

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    @classmethod
    def open(cls) -> Shingles:
        cls._open = cls._open or cls()
        return cls._open

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w, SEED)
            return np.array([known[w] for w in words], np.uint64)

    def of(self, text: bytes | None, shingle: int = WIDE) -> np.ndarray:
        """Hashes of all shingles of a UTF-8 text, repeats included; a shorter text is one shingle, a blank one has none."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        w = self.word_hashes(words)
        m = max(1, len(w) - shingle + 1)
        h = np.full(m, min(len(w), shingle), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(min(len(w), shingle)):
                h = (h ^ w[j : j + m]) * _ODD
                h ^= h >> np.uint64(29)
        return h


def _keys(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sorted keys of shingle hashes: the class of the bucket, then the hash, so rare ones come first."""
    return np.unique((classes[(h & np.uint64(BUCKETS - 1)).astype(np.int64)] << np.uint64(58)) | (h >> np.uint64(6))).view(np.int64)


def shingle_classes(texts: DataFrame) -> np.ndarray:
    """The frequency class of every bucket of shingles: ``BUCKETS`` numbers, whatever the size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, shingles = np.zeros(BUCKETS, np.int64), Shingles.open()
        for b in batches:
            held, n = [], 0
            for x in b.column(0):
                held.append(shingles.of(x.as_py()))
                n += len(held[-1])
                if n > _BLOCK * 16:
                    seen += np.bincount((np.concatenate(held) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                    held, n = [], 0
            if n:
                seen += np.bincount((np.concatenate(held) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["b", "c"])

    got = texts.select("_t").mapInArrow(run, "b int, c long").groupBy("b").agg(F.sum("c").alias("c"))
    found = got.select("b", F.least(F.lit(31), F.floor(F.log2(F.col("c") + 1))).cast("int").alias("k")).toArrow()
    out = np.zeros(BUCKETS, np.uint64)
    out[found.column("b").to_numpy()] = found.column("k").to_numpy()
    return out


def linked_pairs(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b), a < b: pairs of the sets ``node`` whose fingerprints ``fp`` link.

    A set meets the least one of its own fingerprint, and that one meets those of linked fingerprints.
    """
    leads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    own = nodes.join(leads, "fp").where("node <> lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))
    side = lambda f, n: leads.select(F.col("fp").alias(f), F.col("lead").alias(n))
    other = links(leads.select("fp"), threshold).join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    return own.union(other).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id reachable by pairs of ``SIMILARITY``, itself included)."""
    num, den = SIMILARITY
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("binary").alias("_t"))
    sent = spark.sparkContext.broadcast(shingle_classes(texts))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles.open()
        for b in batches:
            nodes, ns, fps, prefix = [], [], [], []
            for x in b.column(2):
                h = shingles.of(x.as_py())
                s = _keys(h, sent.value)
                n = len(s)
                fps.append(_majority(_ones(h), len(h)))
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                ns.append(n)
                prefix.append(s[: n + (num * n) // -den + 1] if n else s)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(ns, pa.int32()),
                    pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(prefix, pa.list_(pa.int64())),
                ],
                ["doc_id", "t", "node", "n", "fp", "prefix"],
            )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles.open()
        for b in batches:
            sets = [np.unique(shingles.of(x.as_py())).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    own = materialize(texts.mapInArrow(prefixes, "doc_id long, t long, node long, n int, fp long, prefix array<long>"), "prefixes")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("t").alias("t"), F.min(F.struct("n", "fp", "prefix")).alias("x"))
    nodes = materialize(nodes.select("node", "least", "t", "x.n", "x.fp", "x.prefix"), "nodes")

    def needed(an: F.Column, bn: F.Column) -> F.Column:
        """Prefix keys that a similar pair of these sizes has in common, at least (see ``line_dedup``)."""
        return F.ceil(num * (an + bn) / (num + den)) - F.greatest(F.ceil(num * an / den), F.ceil(num * bn / den)) + 1

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("k", *(F.col(c).alias(f"{s}{c}") for c in ("node", "n", "i", "class")))

    def candidates(a: DataFrame, b: DataFrame, ordered: bool = False) -> DataFrame:
        """(a, b, needed): a row for each key that two nodes of different classes share, if size and place allow them to be similar.

        Of a table with itself, ``ordered`` gives every such row once instead of both ways round.
        """
        an, bn, ai, bi = (F.col(c) for c in ("an", "bn", "ai", "bi"))
        length = (den * an >= num * bn) & (den * bn >= num * an)
        place = (num + den) * (F.least(ai, bi) + F.least(an - ai, bn - bi)) >= num * (an + bn)
        met = side(a, "a").join(side(b, "b"), "k").where((F.col("anode") < F.col("bnode") if ordered else F.col("anode") != F.col("bnode")) & (F.col("aclass") != F.col("bclass")) & length & place)
        return met.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b"), needed(an, bn).alias("needed"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) that are similar by their whole sets."""
        pairs = materialize(pairs, f"{name}_pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "t"), "node")
        found = wanted.join(texts.select("t", "_t"), "t").dropDuplicates(["node"]).select("node", "_t")
        sets = materialize(found.mapInArrow(whole, "node long, s array<long>"), "sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        out = materialize(both.where((num + den) * common >= num * (F.size("sa") + F.size("sb"))).select("a", "b"), name)
        discard(pairs, sets)
        return out

    close = verified(linked_pairs(nodes.where("n > 0").select("node", "fp")), "close")
    classes = components(close)
    every = nodes.join(classes.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    every = every.select("node", "n", F.coalesce("root", "node").alias("class"), F.posexplode("prefix").alias("i", "k"))
    counts = nodes.select(F.explode("prefix").alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    lists = materialize(every.join(counts.where("c > 1"), "k"), "lists")

    hot, cold = lists.where(F.col("c") > SHORT), lists.where(F.col("c") <= SHORT)
    lead = hot.groupBy("k").agg(F.min(F.struct("node", "n", "i", "class")).alias("x")).select("k", "x.node", "x.n", "x.i", "x.class")
    # Pairs with a leader have their common prefix keys counted on the prefixes.
    near = materialize(candidates(hot, lead).distinct(), "near")
    prefix_of = lambda c: nodes.select(F.col("node").alias(c), F.col("prefix").alias(f"prefix_{c}"))
    near_enough = near.join(prefix_of("a"), "a").join(prefix_of("b"), "b").where(F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.col("needed"))
    led = verified(near_enough.select("a", "b"), "led")
    of_lead = hot.join(lead.select("k", F.col("node").alias("l"), F.col("class").alias("lclass")), "k")
    akin = of_lead.where(F.col("class") == F.col("lclass")).select("k", "node")  # the leader itself, too
    of_lead = of_lead.select("k", "node", F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b"))
    bound = of_lead.join(led, ["a", "b"], "left_semi").select("k", "node").union(akin)
    free = hot.join(bound, ["k", "node"], "left_anti")
    # A pair of two classes that meets on too few keys is not similar, or both are bound to the leader of a list and so connected.
    met = candidates(cold, cold, ordered=True).union(candidates(free, hot)).groupBy("a", "b", "needed").agg(F.count("*").alias("c"))
    edges = close.union(led).union(verified(met.where(F.col("c") >= F.col("needed")).select("a", "b"), "similar"))
    roots = components(edges.distinct())
    discard(lists, near)
    placed = nodes.select("node", "least").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    placed = placed.select("node", "least", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.select("doc_id", "node").join(placed.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def hex_of(fp):
    """Column: 16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
