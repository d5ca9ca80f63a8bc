"""Hidden Markov language model over whole texts.

Tokens are the lower-cased words of a text, then one end token.  The model draws
hidden states, from each state a word class, and from the class a word:

    P(text) = sum over state paths of  prod A(state, next) * B(state, class(word))
              times  prod P(word | class(word))

* The most frequent words are classes of their own; every other word falls into
  one of ``SUFFIXES`` classes by its last bytes.  Classes are bounded in number,
  so the model is, however large the vocabulary.
* ``A`` and ``B`` come from Baum-Welch: each iteration runs the scaled forward and
  backward recursions over all training texts where they lie, sums the expected
  counts across partitions, and brings states x classes numbers to the driver.
  Blocks of a long text run side by side; what enters and leaves each of them comes
  from products of the blocks' transfer matrices, so the counts are the whole text's.
* P(word | class) comes from exact counts over all training texts with absolute
  discounting; what the discount frees is the unseen words' share of the class.
* Scoring runs the scaled forward recursion over each whole text.

Counts of up to ``TOP`` most frequent words travel to the tasks; occurrences of all others join the count table by word.

Edge cases: a null or empty text is the end token alone; a null id belongs to the
training part; repeated rows count and are scored each on its own; with no
training text every word is unseen; ties in frequency go to the smaller word; an
empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, ship

STATES, OWN, SUFFIXES, TOP = 8, 4096, 1024, 100_000
CLASSES = OWN + SUFFIXES
ITERATIONS = 5
#: Class of the end token; other words of their own have classes 1 .. OWN-1.
END = 0
#: Weight of the corpus-wide class distribution in each state's emissions, in tokens.
SMOOTH = 50.0
#: Tokens per block of a longer text in training; counts don't depend on it.
BLOCK = 1024
#: Distinct words that a task counts before it hands them on; cells in a padded batch whose values are kept.
_FLUSH, _CELLS = 400_000, 1 << 18


def suffix_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % SUFFIXES


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, k, c): training count and suffix class of every word of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen: Counter) -> pa.RecordBatch:
            ws = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(ws, pa.binary()), pa.array([suffix_class(w) for w in ws], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["w", "k", "c"]
            )

        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update((t.as_py() or b"").lower().split())
                if len(seen) > _FLUSH:
                    yield flush(seen)
                    seen.clear()
        if seen:
            yield flush(seen)

    counted = docs.select(F.col(text_col).cast("binary").alias("_t")).mapInArrow(run, "w binary, k int, c long")
    return counted.groupBy("w", "k").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int = TOP) -> list[tuple[bytes, int]]:
    """At most ``most`` words with their counts, most frequent first: all whose count reaches a threshold.

    The threshold comes from counts of counts on a logarithmic scale, so no task
    and no driver holds more candidates than are kept.
    """
    scale = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r["b"], r["n"]) for r in counts.groupBy(scale.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, kept = None, 0
    for b, n in sizes:
        if kept + n > most:
            break
        least, kept = b, kept + n
    if least is None:
        return []
    got = counts.where(scale >= least).select("w", "c").toArrow()
    return sorted(zip(got.column("w").to_pylist(), got.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


# -- recursions ---------------------------------------------------------------


def _padded(sequences: list[np.ndarray], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (which, x, active): sequences of like length side by side, time first, longest first."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        which = np.array(order[at : at + max(1, min(512, cells // longest))])
        at += len(which)
        lengths = np.array([len(sequences[i]) for i in which])
        x = np.zeros((longest, len(which)), np.int32)
        for j, i in enumerate(which):
            x[: lengths[j], j] = sequences[i]
        yield which, x, np.searchsorted(-lengths, -np.arange(longest), "left")


def log_likelihoods(x: np.ndarray, active: np.ndarray, pi: np.ndarray, a: np.ndarray, emit: np.ndarray, block: int = 128) -> np.ndarray:
    """Natural log-likelihood of every column of a batch, by the scaled forward recursion."""
    t_max, n = x.shape
    total, ones = np.zeros(n), np.ones(len(pi))
    alpha = np.broadcast_to(pi, (n, len(pi)))
    for first in range(0, t_max, block):
        last = min(t_max, first + block)
        width = active[first]
        seen, scales = emit[x[first:last, :width]], np.ones((last - first, width))
        for t in range(first, last):
            b = active[t]
            alpha = (alpha[:b] @ a if t else alpha) * seen[t - first, :b]
            scale = np.matmul(alpha, ones, out=scales[t - first, :b])
            alpha /= scale[:, None]
        total[:width] += np.log(scales).sum(axis=0)
    return total


def _transfers(blocks: list[np.ndarray], a: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Per block, up to a factor: the probability of its tokens and last state, by the state at its first token."""
    s = len(a)
    out = np.zeros((len(blocks), s, s))
    for which, x, active in _padded(blocks, _CELLS):
        m = np.eye(s) * emit[x[0]][:, None, :]
        for t in range(1, len(x)):
            b = active[t]
            step = np.matmul(m[:b].reshape(-1, s), a).reshape(-1, s, s)
            step *= emit[x[t, :b]][:, None, :]
            if t % 16 == 0:  # far from underflow
                step /= step.sum(axis=(1, 2), keepdims=True)
            m[:b] = step
        out[which] = m / m.sum(axis=(1, 2), keepdims=True)
    return out


def _blocks(sequences: list[np.ndarray], pi: np.ndarray, a: np.ndarray, emit: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(blocks, before, after) of whole sequences, a row per block.

    ``before``: state probabilities at the end of the block before, given the tokens so
    far, or zeros at a sequence's start; ``after``: what follows the block, by its last state, up to a factor.
    """
    blocks = [x[i : i + size] for x in sequences for i in range(0, len(x), size)]
    before, after = np.zeros((len(blocks), len(pi))), np.ones((len(blocks), len(pi)))
    parts = np.array([-(-len(x) // size) for x in sequences], np.int64)
    ends = np.cumsum(parts)
    split = np.flatnonzero(parts > 1)
    inside = [i for j in split for i in range(ends[j] - parts[j], ends[j])]
    transfer = dict(zip(inside, _transfers([blocks[i] for i in inside], a, emit), strict=True))
    for j in split:
        first, last = ends[j] - parts[j], ends[j] - 1
        enter = pi
        for i in range(first, last):
            leave = enter @ transfer[i]
            before[i + 1] = leave / leave.sum()
            enter = before[i + 1] @ a
        for i in range(last, first, -1):
            back = a @ (transfer[i] @ after[i])
            after[i - 1] = back / back.sum()
    return blocks, before, after


def expected_counts(sequences: list[np.ndarray], pi: np.ndarray, a: np.ndarray, emit: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of whole sequences: starts, transitions, emissions (classes x states), and the log-likelihood."""
    s = len(pi)
    starts, moves, emits, logl = np.zeros(s), np.zeros((s, s)), np.zeros((emit.shape[0], s)), 0.0
    ones, back = np.ones(s), np.ascontiguousarray(a.T)
    blocks, before, beyond = _blocks(sequences, pi, a, emit, size)
    opens = ~before.any(axis=1)
    for which, x, active in _padded(blocks, _CELLS):
        t_max, n = x.shape
        seen = emit[x]
        enter = np.where(opens[which, None], pi, before[which] @ a)
        alphas, scales = np.zeros((t_max, n, s)), np.ones((t_max, n))
        for t in range(t_max):
            b = active[t]
            now, scale = alphas[t, :b], scales[t, :b]
            if t:
                np.matmul(alphas[t - 1, :b], a, out=now)
                now *= seen[t, :b]
            else:
                np.multiply(enter, seen[0], out=now)
            np.matmul(now, ones, out=scale)
            now /= scale[:, None]
        logl += float(np.log(scales).sum())
        # after: what follows a cell, as seen from the state it is entered in.
        betas, after = np.ones((t_max, n, s)), np.zeros((t_max, n, s))
        ends = np.array([len(blocks[i]) - 1 for i in which]), np.arange(n)
        betas[ends] = beyond[which] / (alphas[ends] * beyond[which]).sum(axis=1, keepdims=True)
        for t in range(t_max - 2, -1, -1):
            c = active[t + 1]
            into = after[t + 1, :c]
            np.multiply(seen[t + 1, :c], betas[t + 1, :c], out=into)
            into /= scales[t + 1, :c, None]
            np.matmul(into, back, out=betas[t, :c])
        moves += a * (alphas[:-1].reshape(-1, s).T @ after[1:].reshape(-1, s))
        moves += a * (before[which].T @ (seen[0] * betas[0] / scales[0, :, None]))  # from block to block
        gamma = np.multiply(betas, alphas, out=betas)  # idle cells are zero
        starts += gamma[0, opens[which]].sum(axis=0)
        # Expected emissions: cells sorted by class, then summed run by run.
        flat = x.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        by_class = flat[order]
        runs = np.flatnonzero(np.r_[True, by_class[1:] != by_class[:-1]])
        emits[by_class[runs]] += np.add.reduceat(gamma.reshape(-1, s)[order], runs, axis=0)
    return starts, moves, emits, logl


def initial(class_counts: np.ndarray, states: int = STATES, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of Baum-Welch: sticky states whose emissions differ at random from the corpus."""
    rng = np.random.default_rng(seed)
    base = (class_counts + 1.0) / (class_counts + 1.0).sum()
    emit = base[:, None] * np.exp(rng.normal(0.0, 1.0, (len(base), states)))
    a = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(a, 0.95 if states > 1 else 1.0)
    return np.full(states, 1.0 / states), a, emit / emit.sum(axis=0)


def maximised(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, class_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = (class_counts + 1.0) / (class_counts + 1.0).sum()
    pi = (starts + 1.0) / (starts + 1.0).sum()
    a = moves + 0.1
    emit = emits + SMOOTH * base[:, None]
    return pi, a / a.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)


# -- tables -------------------------------------------------------------------


def encode(docs: DataFrame, top: list[tuple[bytes, int]], discount: float, id_col: str, text_col: str) -> DataFrame:
    """Per document: classes of its tokens, sums over its frequent words, and its other words.

    ``words_part`` sums log10(c - discount) of frequent words in suffix classes.
    """
    spark = docs.sparkSession
    ids = {w: i for i, (w, _) in enumerate(top)}
    counts = np.array([c for _, c in top], np.float64)
    classes = np.array([i + 1 if i + 1 < OWN else suffix_class(w) for i, (w, _) in enumerate(top)], np.uint16)
    sent = spark.sparkContext.broadcast((ids, classes, np.log10(counts + 1), np.where(classes >= OWN, np.log10(np.maximum(counts - discount, 1e-9)), 0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, classes, base, within = sent.value
        key, get = TaskContext.get().partitionId() << 33, ids.get
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            ends, rare_words, rare_classes = [0], [], []
            for t in b.column(2):
                ws = (t.as_py() or b"").lower().split()
                at = np.array([get(w, -1) for w in ws], np.int64)
                rare = np.flatnonzero(at < 0)
                known = at[at >= 0]
                cls = np.zeros(len(ws) + 1, np.uint16)
                cls[-1] = END
                if len(known):
                    cls[:-1] = classes[at]
                others = [ws[i] for i in rare.tolist()]
                ks = [suffix_class(w) for w in others]
                cls[rare] = ks
                rare_words += others
                rare_classes += ks
                ends.append(len(rare_words))
                row = (cls.tobytes(), len(ws) + 1, len(known), float(base[known].sum()) if len(known) else 0.0, float(within[known].sum()) if len(known) else 0.0)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            keys = pa.array(range(key, key + b.num_rows), pa.int64())
            key += b.num_rows
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_classes, pa.int32())], ["w", "k"])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            arrays = [keys, b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), rest]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "held_out", "cls", "n_tokens", "n_top", "base_part", "words_part", "rare"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("_t"))
    schema = "key long, doc_id long, held_out boolean, cls binary, n_tokens long, n_top long, base_part double, words_part double, rare array<struct<w:binary,k:int>>"
    return rows.mapInArrow(run, schema)


def baum_welch_step(training: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of one iteration over a table with ``cls``, summed across partitions."""
    sent = training.sparkSession.sparkContext.broadcast(model)
    s, c = len(model[0]), model[2].shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s + s * s + c * s + 1)
        for b in batches:
            sequences = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(0)]
            starts, moves, emits, logl = expected_counts(sequences, *sent.value)
            total += np.concatenate([starts, moves.ravel(), emits.ravel(), [logl]])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "v"])

    summed = training.select("cls").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(s + s * s + c * s + 1)
    total[summed["at"].to_numpy()] = summed["v"].to_numpy()
    return total[:s], total[s : s + s * s].reshape(s, s), total[s + s * s : -1].reshape(c, s), float(total[-1])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", iterations: int = ITERATIONS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    ship(spark)
    training = docs.where(~held_out(id_col))
    counts = materialize(word_counts(training, text_col), "word_counts")
    n_train = training.count()
    n1, n2, n_words, n_kinds = counts.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    discount = min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2)))
    train_tokens = n_words + n_train
    kinds = n_kinds + (n_train > 0)
    top = frequent(counts)
    rows = materialize(encode(docs, top, discount, id_col, text_col), "encoded")

    # Members of suffix classes: all words but those that are classes of their own.
    own = {w for w, _ in top[: OWN - 1]}
    of_class = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n_k, v_k, class_counts = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros(CLASSES)
    for k, (n, v) in of_class.items():
        n_k[k], v_k[k] = n, v
    for i, (w, c) in enumerate(top[: OWN - 1], 1):
        k = suffix_class(w)
        n_k[k], v_k[k], class_counts[i] = n_k[k] - c, v_k[k] - 1, c
    assert len(own) == len(top[: OWN - 1])
    class_counts[OWN:] = n_k[OWN:]
    class_counts[END] = n_train
    with np.errstate(divide="ignore"):
        per_token = np.where(n_k > 0, -np.log10(np.maximum(n_k, 1e-9)), 0.0)  # of every token in a suffix class
        unseen = np.where(n_k > 0, np.log10(discount * np.maximum(v_k, 1e-9)), 0.0)  # an unseen word's part, by class

    model = initial(class_counts)
    seen = rows.where(~F.col("held_out"))
    for _ in range(iterations):
        starts, moves, emits, _logl = baum_welch_step(seen, model)
        model = maximised(starts, moves, emits, class_counts)

    classes = spark.createDataFrame([(int(k), float(unseen[k])) for k in range(OWN, CLASSES)], "k int, unseen double")
    rare = rows.select("key", F.explode("rare").alias("x")).select("key", "x.w", "x.k")
    rare = rare.join(counts.select("w", "c"), "w", "left").join(F.broadcast(classes), "k")  # SUFFIXES rows
    rare = rare.groupBy("key").agg(
        F.count("c").alias("n_rare"),
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base_rare"),
        F.sum(F.when(F.col("c").isNull(), F.col("unseen")).otherwise(F.log10(F.col("c") - discount))).alias("words_rare"),
    )
    sent = spark.sparkContext.broadcast((*model, per_token))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pi, a, emit, per = sent.value
        for b in batches:
            sequences = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(1)]
            out = np.zeros(b.num_rows)
            for which, x, active in _padded(sequences, 1 << 24):
                out[which] = log_likelihoods(x, active, pi, a, emit) / math.log(10)
            out += np.array([per[s].sum() for s in sequences])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["key", "path_part"])

    path = rows.select("key", "cls").mapInArrow(run, "key long, path_part double")
    zero = F.lit(0.0)
    whole = rows.drop("cls", "rare").join(path, "key").join(rare, "key", "left")
    end_known, per_base = int(n_train > 0), math.log10(train_tokens + kinds + 1)
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_rare", F.lit(0)) + end_known).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base_part") + F.coalesce("base_rare", zero) + math.log10(n_train + 1) - F.col("n_tokens") * per_base).alias("base_score"),
        (F.col("path_part") + F.col("words_part") + F.coalesce("words_rare", zero)).alias("score"),
    )
