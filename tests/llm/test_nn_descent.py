import numpy as np
from pyspark.sql import functions as F

from sluice.llm import nn_descent as NN

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, top=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for k, i in enumerate(ids):
        s = x @ x[k]
        order = sorted((j for j in range(len(ids)) if j != k), key=lambda j: (-round(s[j], 12), ids[j]))[:top]
        out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 24))
    data = (centres[rng.integers(0, 8, 1500)] + 0.7 * rng.normal(size=(1500, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    got = answers(NN.neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0))
    want = brute(rows)
    assert set(got) == set(range(0, 1500, 10))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in got)
    assert hits / (5 * len(got)) >= 0.95
    true = {(q, v): s for q in got for v, s in want[q]}
    assert all(abs(s - true[q, v]) < 1e-12 for q in got for v, s in got[q] if (q, v) in true)
    assert all([(-s, v) for v, s in r] == sorted((-s, v) for v, s in r) for r in got.values())


def test_edges(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 1.0]), (6, None), (7, [0.0, 0.0]), (8, [float("nan"), 1.0]),
        (9, [float("inf"), 1.0]), (10, [None, 1.0]), (11, []), (12, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (4, [0.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = answers(NN.neighbours(df, F.col("vec_id") > 0))
    assert set(got) == {1, 2, 3, 4, 5}  # 12 has no other of its length
    assert [v for v, _ in got[1]] == [2, 3, 5, 4] and [v for v, _ in got[2]] == [1, 3, 5, 4]
    assert abs(got[5][0][1] - 0.5**0.5) < 1e-12
    wide = df.select("*", *(F.lit("z").alias(c) for c in ("id", "v", "u", "g", "s", "q", "code")))
    assert answers(NN.neighbours(wide, F.col("vec_id") > 0)) == got
    assert NN.neighbours(df.limit(0), F.lit(True)).count() == 0
    assert NN.neighbours(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 1.0]) for i in range(40)]
    got = answers(NN.neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0))
    assert [v for v, _ in got[100]] == [0, 1, 2, 3, 4] and [v for v, _ in got[0]] == [1, 2, 3, 4, 5]


def test_extreme_components(spark):
    rows = [(i, [x * a, x * b]) for i, (x, a, b) in enumerate([(1e-200, 1, 1), (1e200, 1, 2), (1e-310, 2, 1), (1.0, 1, 0), (1.7e308, 1, 1), (5e-324, 1, 1)])]
    got = answers(NN.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 0))
    assert [v for v, _ in got[0]] == [4, 5, 1, 2, 3] and all(abs(s) <= 1 + 1e-12 for r in got.values() for _, s in r)
    assert abs(dict(got[1])[3] - 5**-0.5) < 1e-9 and abs(dict(got[0])[4] - 1) < 1e-12


def test_lengths_are_searched_apart(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.1, 0.0]), (5, [0.0, 1.0, 0.0])]
    got = answers(NN.neighbours(spark.createDataFrame(rows, SCHEMA), F.lit(True)))
    assert {q: [v for v, _ in r] for q, r in got.items()} == {1: [2], 2: [1], 3: [4, 5], 4: [3, 5], 5: [4, 3]}
