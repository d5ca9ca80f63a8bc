"""Mixing documents to target weights of domains with soft membership.

1. A softmax classifier learns the domains of a labelled table (low: quality 0;
   toxic: toxic 1; clean: quality 1 and toxic 0) on at most ``MAX_LABELLED``
   labelled documents, chosen by the hash of their ids.  Its features are shares
   of symbols, capitals and repeated words and the words of a learned lexicon.
2. Every document gets posteriors p over the domains.
3. Projected-gradient least squares fits a rate r >= 0 per document so that the
   expected token totals, the sum of r * tokens * p over all documents, match the
   targets.  A gradient has one number per domain, so an iteration is one
   aggregation; documents carry no state, as their rate follows from their
   posteriors and the steps so far.  Documents whose likeliest domain is the one
   of the largest weight keep a rate of 1 at least: they are never lost.  Steps are scaled by the inverse Gram matrix
   of the documents with positive rates and halved while they don't help.

``draw`` turns rates into copies: every rate is rounded up with the probability of
its fraction, by the hash of the id, so the expected totals of the drawn documents
are the fitted ones.

Edge cases: a null text has no tokens and gets the posteriors of an empty text;
null labels teach nothing; without labels all documents have equal posteriors; a
domain that no document can belong to leaves its target unmet; null ids draw at
one half; repeated rows count and get equal rates; an empty table gives no rows.
Other columns pass through ``draw`` untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, ship

DOMAINS = ("low", "clean", "toxic")
#: Target share of each domain in the mixture; the clean domain keeps its size.
WEIGHTS = {"low": 0.01, "clean": 0.98, "toxic": 0.01}
MAX_LABELLED, LEXICON, ITERATIONS = 20_000, 200, 40
_FEATURES = ["symbols", "capitals", "bangs", "repeats", "word_length", "short", *(f"lexicon_{d}" for d in DOMAINS)]
_CAPITALS, _SYMBOLS = bytes(range(65, 91)), b"#*$%&|<>"


def domain() -> F.Column:
    """Column: the number of a label row's domain, null where it can't be told."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return F.when(low, 0).when(toxic, 2).when((F.col("quality") == 1) & (F.col("toxic") == 0), 1)


def labelled_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(id, d): at most ``limit`` labelled documents, one domain each."""
    told = labels.select(F.col("doc_id").alias("id"), domain().alias("d")).where("id is not null and d is not null")
    return told.groupBy("id").agg(F.min("d").alias("d")).orderBy(F.xxhash64("id"), "id").limit(limit)


def lexicon(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, most: int = LEXICON) -> dict[bytes, int]:
    """Words that tell a domain from the others: at most ``most`` of each, by log-odds of the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[tuple[bytes, int]] = Counter()
            for t, d in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen.update((w, d) for w in set((t.as_py() or b"").lower().split()))
                seen[(b"", d)] += 1  # no word: the documents themselves
            ws, ds = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), pa.array(ds, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["w", "d", "c"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_t"))
    texts = texts.join(F.broadcast(sample), texts.doc_id == sample.id).select("_t", "d")
    counts = texts.mapInArrow(run, "w binary, d int, c long").groupBy("w").agg(*(F.sum(F.when(F.col("d") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(len(DOMAINS))))
    counts = materialize(counts, "lexicon")
    whole = counts.where("length(w) = 0").first()
    if whole is None:
        return {}
    size = [whole[f"c{k}"] for k in range(len(DOMAINS))]
    out: dict[bytes, int] = {}
    for k in range(len(DOMAINS)):
        others = sum((F.col(f"c{j}") for j in range(len(DOMAINS)) if j != k), F.lit(0))
        odds = F.log((F.col(f"c{k}") + 0.5) / (size[k] + 1)) - F.log((others + 0.5) / (sum(size) - size[k] + 1))
        told = counts.where((F.length("w") > 0) & (F.col(f"c{k}") >= max(3, size[k] // 50)) & (odds > 1.6))
        for r in told.orderBy(F.desc(odds * F.col(f"c{k}")), "w").limit(most).collect():
            out.setdefault(bytes(r["w"]), k)
    return out


def features(docs: DataFrame, words: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_tokens, x): tokens (words) and features of every whole text."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        keys = words.keys()
        for b in batches:
            ns, xs = [], []
            for t in b.column(1):
                raw = t.as_py() or b""
                ws = raw.lower().split()
                kinds, n, chars = set(ws), len(ws), len(raw)
                hits = [0] * len(DOMAINS)
                for w in keys & kinds:
                    hits[words[w]] += 1
                part = lambda a, m: a / m if m else 0.0
                x = [
                    part(chars - len(raw.translate(None, _SYMBOLS)), chars),
                    part(chars - len(raw.translate(None, _CAPITALS)), chars),
                    part(raw.count(b"!"), n),
                    1 - part(len(kinds), n),
                    part(chars, n),
                    1 / (1 + n),
                    *(part(h, len(kinds)) ** 0.5 for h in hits),
                ]
                ns.append(n)
                xs.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(xs, pa.list_(pa.float64()))], ["doc_id", "n_tokens", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, x array<double>")


class Softmax:
    """Multinomial logistic regression on standardised features."""

    def __init__(self, x: np.ndarray, d: np.ndarray, classes: int, rounds: int = 600, ridge: float = 1e-4):
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        #: Domains without a labelled document have posterior 0 (all equal if none has one).
        self.absent = np.where(np.bincount(d, minlength=classes) > 0, 0.0, -np.inf) if len(d) else np.zeros(classes)
        z, y = self._design(x), np.eye(classes)[d]
        self.w = now = np.zeros((z.shape[1], classes))
        if not len(x):
            return
        step, t = 1.0 / (0.5 * np.linalg.norm(z.T @ z / len(z), 2) + ridge), 1.0
        for _ in range(rounds):
            g = z.T @ (self._softmax(z @ now) - y) / len(z) + ridge * now
            new = now - step * g
            u = (1 + (1 + 4 * t * t) ** 0.5) / 2
            now, self.w, t = new + (t - 1) / u * (new - self.w), new, u

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def _softmax(self, s: np.ndarray) -> np.ndarray:
        s = s + self.absent
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(self._design(x) @ self.w)


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, p): domain posteriors of every document."""
    ship(docs.sparkSession)
    sample = materialize(labelled_sample(labels), "sample")
    table = materialize(features(docs, lexicon(docs, sample, id_col, text_col), id_col, text_col), "features")
    told = table.join(F.broadcast(sample), table.doc_id == sample.id).select("x", "d").limit(2 * MAX_LABELLED).toPandas()
    x = np.stack(told["x"].to_numpy()) if len(told) else np.zeros((0, len(_FEATURES)))
    model = Softmax(x, told["d"].to_numpy(np.int64), len(DOMAINS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = model(b.column(2).flatten().to_numpy().reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return table.mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def _rates(p: np.ndarray, steps: np.ndarray, keep: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rates after projected steps from rate 1, their lower bounds): 0, but 1 where domain ``keep`` is the likeliest."""
    least = np.zeros(len(p)) if keep is None else (p.argmax(axis=1) == keep).astype(float)
    r = np.ones(len(p))
    for step in steps:
        r = np.maximum(least, r - p @ step)
    return r, least


def anchor_of(weights: dict[str, float]) -> int:
    """The domain of the largest weight: the mixture keeps its documents and its size."""
    return max(range(len(DOMAINS)), key=lambda k: weights[DOMAINS[k]])


def fit_steps(table: DataFrame, weights: dict[str, float] = WEIGHTS, iterations: int = ITERATIONS, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, targets, totals reached) of the projected gradient on a table (doc_id, n_tokens, p)."""
    k, anchor = len(DOMAINS), anchor_of(weights)

    def totals(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k + k * k)
            for b in batches:
                if b.num_rows:
                    n, p = b.column(0).to_numpy().astype(float), b.column(1).flatten().to_numpy().reshape(b.num_rows, k)
                    r, least = _rates(p, steps, anchor)
                    out[:k] += (n * r) @ p
                    out[k:] += ((n * (r > least))[:, None] * p).T.dot(p).ravel() if len(steps) else (n[:, None] * p).T.dot(p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["at", "v"])

        got = table.select("n_tokens", "p").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(k + k * k)
        for r in got:
            out[r["at"]] = r["v"]
        return out[:k], out[k:].reshape(k, k)

    steps = np.zeros((0, k))
    now, gram = totals(steps)
    # What no document can belong to has no target; the other weights keep their proportions.
    share = np.where(now > 0, np.array([weights[d] for d in DOMAINS]), 0.0)
    if not share.any():
        return steps, np.zeros(k), now
    share = share / share.sum()
    if not share[anchor]:
        return steps, share * now.sum(), now
    targets = share * now[anchor] / share[anchor]
    size = 1.0
    for _ in range(iterations):
        gap = now - targets
        if np.abs(gap).max() <= tolerance * max(1.0, targets.sum()) or size < 1e-3:
            break
        ridge = np.diag(1e-6 * np.diag(gram) + 1e-12 * np.trace(gram) + 1e-12)
        tried = np.vstack([steps, size * np.linalg.solve(gram + ridge, gap)])
        new, new_gram = totals(tried)
        if np.square(new - targets).sum() < np.square(gap).sum():
            steps, now, gram, size = tried, new, new_gram, min(1.0, 2 * size)
        else:
            size /= 2
    return steps, targets, now


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, p_low, p_clean, p_toxic, rate."""
    table = materialize(posteriors(docs, labels, id_col, text_col), "posteriors")
    steps, _, _ = fit_steps(table, weights)
    anchor = anchor_of(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                columns = [b.column(0), b.column(1), *(pa.array(c) for c in p.T.copy()), pa.array(_rates(p, steps, anchor)[0])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate"])

    return table.mapInArrow(run, "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS) + ", rate double")


def copies(rate: F.Column, id_col: F.Column) -> F.Column:
    """Column: how often a document of this rate stands in the mixture."""
    u = F.when(id_col.isNull(), F.lit(0.5)).otherwise(F.pmod(F.xxhash64(id_col, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30))
    return F.floor(rate + u).cast("int")


def draw(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents of the mixture, all columns kept: each as often as its rate says."""
    rates = mixed.groupBy(F.col("doc_id").alias("_id")).agg(F.max("rate").alias("_rate"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that none clashes
    own, at = docs.toDF(*names.values()), F.col(names[id_col])
    joined = own.join(rates, at.eqNullSafe(F.col("_id")), "left")
    times = F.greatest(F.lit(0), copies(F.col("_rate"), at))
    repeated = joined.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return repeated.select(*(F.col(n).alias(c) for c, n in names.items()))
