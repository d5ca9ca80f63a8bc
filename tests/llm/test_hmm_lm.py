import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sluice.llm import hmm_lm as H

from .helpers import awkward, clashing, documents, rows_of


def brute_likelihood(x, pi, a, emit):
    """Sum over all state paths."""
    v = pi * emit[x[0]]
    for t in x[1:]:
        v = (v @ a) * emit[t]
    return math.log(v.sum())


def brute_counts(sequences, pi, a, emit):
    """Expected counts by enumerating paths one state at a time, unscaled."""
    s = len(pi)
    starts, moves, emits = np.zeros(s), np.zeros((s, s)), np.zeros_like(emit)
    for x in sequences:
        n = len(x)
        al = [pi * emit[x[0]]]
        for t in range(1, n):
            al.append((al[-1] @ a) * emit[x[t]])
        be = [np.ones(s)]
        for t in range(n - 1, 0, -1):
            be.insert(0, a @ (emit[x[t]] * be[0]))
        z = al[-1].sum()
        starts += al[0] * be[0] / z
        for t in range(n):
            emits[x[t]] += al[t] * be[t] / z
        for t in range(n - 1):
            moves += al[t][:, None] * a * (emit[x[t + 1]] * be[t + 1])[None, :] / z
    return starts, moves, emits


@pytest.fixture
def model():
    rng = np.random.default_rng(0)
    pi, a, emit = rng.random(3), rng.random((3, 3)), rng.random((6, 3))
    return pi / pi.sum(), a / a.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)


def sequences():
    rng = np.random.default_rng(1)
    return [rng.integers(0, 6, n).astype(np.uint16) for n in (1, 7, 3, 12, 1, 5)]


def test_forward_and_counts(model):
    xs = sequences()
    got = np.zeros(len(xs))
    for which, x, active in H._padded(xs, 20):
        got[which] = H.log_likelihoods(x, active, *model, block=3)
    assert np.allclose(got, [brute_likelihood(x, *model) for x in xs])
    starts, moves, emits, logl = H.expected_counts(xs, *model)
    for mine, want in zip((starts, moves, emits), brute_counts(xs, *model), strict=True):
        assert np.allclose(mine, want)
    assert math.isclose(logl, got.sum())


@pytest.mark.parametrize("size", [1, 2, 5])
def test_blocks_count_as_the_whole_text(model, size):
    xs = [*sequences(), np.random.default_rng(2).integers(0, 6, 40).astype(np.uint16)]
    whole = H.expected_counts(xs, *model, size=100)
    for mine, want in zip(whole, brute_counts(xs, *model), strict=False):
        assert np.allclose(mine, want)
    for mine, want in zip(H.expected_counts(xs, *model, size=size), whole, strict=True):
        assert np.allclose(mine, want)


def test_long_texts_in_blocks_of_the_query():
    rng = np.random.default_rng(5)
    model = H.initial(rng.integers(1, 1000, H.CLASSES).astype(float))
    xs = [rng.integers(0, H.CLASSES, n).astype(np.uint16) for n in (5000, H.BLOCK, H.BLOCK + 1, 3)]
    for mine, want in zip(H.expected_counts(xs, *model), H.expected_counts(xs, *model, size=1 << 20), strict=True):
        assert np.allclose(mine, want, rtol=1e-9)


def test_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in H.score(docs, iterations=3).collect()}
    rows = [(r["doc_id"], r["text"].encode().lower().split()) for r in docs.collect()]
    train = [w for i, w in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, ws in rows:
        r = got[i]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws) + 1, sum(w in c for w in ws) + 1, n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 100


def test_scores_of_a_model_computed_outside(spark):
    """Five iterations, as the query runs, by unscaled recursions; every training word is a class of its own."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 9, rng.integers(0, 12)))) for i in range(40)]
    train = [text.split() for i, text in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for ws in train for w in ws)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    number = {w: k for k, w in enumerate(ranked, 1)}
    assert all(w in number for _, text in rows for w in text.split())
    class_counts = np.zeros(H.CLASSES)
    class_counts[: len(ranked) + 1] = [len(train), *(counts[w] for w in ranked)]
    classes = lambda ws: np.array([*(number[w] for w in ws), H.END])
    model = H.initial(class_counts)
    for _ in range(H.ITERATIONS):
        model = H.maximised(*brute_counts([classes(ws) for ws in train], *model), class_counts)
    got = {r["doc_id"]: r["score"] for r in H.score(documents(spark, rows)).collect()}
    for i, text in rows:
        assert math.isclose(got[i], brute_likelihood(classes(text.split()), *model) / math.log(10), rel_tol=1e-9)


def test_score_is_a_distribution(spark):
    """Over one-word texts, an unseen word among them, and longer ones, probabilities stay below 1 in sum."""
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(words[: i % 12 + 1])) for i in range(40)] + [(1000 + i, w) for i, w in enumerate([*words, "unseen", ""])]
    got = {r["doc_id"]: r["score"] for r in H.score(documents(spark, rows), iterations=1).collect()}
    assert 0 < sum(10 ** got[1000 + i] for i in range(14)) <= 1


def test_edges(spark):
    docs = awkward(spark)
    got = H.score(docs, iterations=1)
    assert got.count() == docs.count()
    empty = [r for r in got.collect() if r["doc_id"] in (2, 3, 4)]
    assert len({(r["n_tokens"], r["base_score"]) for r in empty}) == 1 and empty[0]["n_tokens"] == 1
    assert not any(r["held_out"] for r in got.where("doc_id is null").collect())
    assert H.score(documents(spark, []), iterations=1).count() == 0
    alone = H.score(documents(spark, [(6, "only held out")]).where("doc_id = 6"), iterations=1).first()
    assert alone["held_out"] == (zlib.crc32(b"6") % 7 == 2)
    as_text = lambda df: sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in df.collect())
    assert as_text(H.score(clashing(docs), iterations=1)) == as_text(got)
    assert rows_of(got.select("n_known"))
