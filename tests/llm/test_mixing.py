import numpy as np
import pytest

from sluice.llm import mixing as M

from .helpers import awkward, clashing, documents, rows_of


def corpus(spark):
    clean = [(i, f"calm sentence {i} about rivers and hills and old houses by the sea " * 5) for i in range(120)]
    toxic = [(1000 + i, f"vile rotten sentence {i} about rivers and hills and old houses by the sea " * 5) for i in range(40)]
    low = [(2000 + i, f"spam{i}$$$ buy%%% now*** " * 12) for i in range(40)]
    docs = documents(spark, clean + toxic + low)
    labels = [(i, 1, 0) for i, _ in clean[::2]] + [(i, 1, 1) for i, _ in toxic[::2]] + [(i, 0, 0) for i, _ in low[::2]]
    return docs, spark.createDataFrame([*labels, (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_held_out_domains_and_targets(spark):
    docs, labels = corpus(spark)
    mixed = M.mix(docs, labels).toPandas()
    p = mixed[["p_low", "p_clean", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1)
    want = np.where(mixed["doc_id"] < 1000, 1, np.where(mixed["doc_id"] < 2000, 2, 0))
    assert (p.argmax(axis=1) == want).mean() > 0.98
    assert (mixed["rate"] >= 0).all()
    totals = (mixed["rate"] * mixed["n_tokens"]).to_numpy() @ p
    share = totals / totals.sum()
    assert np.allclose(share, [M.WEIGHTS[d] for d in M.DOMAINS], atol=1e-3)
    drawn = M.draw(docs, spark.createDataFrame(mixed))
    ids = [r["doc_id"] for r in drawn.select("doc_id").collect()]
    assert set(range(120)) <= set(ids) and sum(i >= 1000 for i in ids) < 25
    assert drawn.columns == docs.columns


def test_drawn_shares_meet_targets(spark):
    kinds = {"low": (0, 1000, "spam{0}$$$ buy%%% now*** " * 2), "clean": (10000, 8000, "calm sentence {} about rivers and hills "), "toxic": (20000, 1000, "vile rotten sentence {} about rivers and hills ")}
    rows = {d: [(at + i, text.format(i) * 10) for i in range(n)] for d, (at, n, text) in kinds.items()}
    docs = documents(spark, [r for part in rows.values() for r in part])
    told = {"low": (0, 0), "clean": (1, 0), "toxic": (1, 1)}
    labels = spark.createDataFrame([(i, *told[d]) for d, part in rows.items() for i, _ in part[::2]], "doc_id long, quality int, toxic int")
    mixed = M.materialize(M.mix(docs, labels), "mixed")
    assert mixed.where("p_clean < 0.5 and rate <= 0.1").count() == 2000  # small rates, not none
    tokens = dict.fromkeys(kinds, 0)
    for r in M.draw(docs, mixed).collect():
        tokens[M.DOMAINS[r["doc_id"] // 10000]] += len(r["text"].split())
    share = {d: n / sum(tokens.values()) for d, n in tokens.items()}
    assert all(abs(share[d] - w) < 5e-3 for d, w in M.WEIGHTS.items()), share  # three standard deviations of the clean share


def squared_misses(spark, p, n):
    """(ours, that of an independent projected gradient with a rate per document of its own, size of the targets)."""
    rows = [(i, int(n[i]), p[i].tolist()) for i in range(len(n))]
    steps, targets, reached = M.fit_steps(spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>"))
    least = (p.argmax(axis=1) == M.anchor_of(M.WEIGHTS)).astype(float)
    a = n[:, None] * p
    assert np.allclose(a.T @ M._rates(p, steps, M.anchor_of(M.WEIGHTS))[0], reached)
    r, step = np.maximum(least, 1.0), 1.0 / np.linalg.norm(a.T @ a, 2)
    for _ in range(20_000):
        r = np.maximum(least, r - step * (a @ (a.T @ r - targets)))
    return np.square(reached - targets).sum(), np.square(a.T @ r - targets).sum(), np.square(targets).sum()


def test_fit_against_a_plain_solver(spark):
    rng = np.random.default_rng(4)
    p = np.full((300, 3), 0.001) + 0.997 * np.eye(3)[rng.integers(0, 3, 300)]
    ours, plain, size = squared_misses(spark, p, rng.integers(20, 400, 300))
    assert ours <= plain + 1e-6 * size


@pytest.mark.xfail(reason="known limit: where kept documents alone exceed a target, the fit stops short of the least miss", strict=True)
def test_fit_of_targets_out_of_reach(spark):
    rng = np.random.default_rng(4)
    ours, plain, size = squared_misses(spark, rng.dirichlet([0.4, 1.0, 0.4], 300), rng.integers(20, 400, 300))
    assert ours <= 1.05 * plain + 1e-6 * size


def test_query(spark, sf):
    from sluice.llm import queries

    rows = queries.QUERIES["op5_mixing"](spark, sf).toPandas()
    assert len(rows) == 200 and (rows["rate"] >= 0).all()
    # A document stands in the mixture as often as its rate says, its fraction drawn by its id.
    assert ((rows["copies"] >= np.floor(rows["rate"])) & (rows["copies"] <= np.ceil(rows["rate"]))).all()


def test_projection_keeps_rates_nonnegative():
    p = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]])
    steps = np.array([[5.0, 0.0], [-1.0, 0.0]])
    assert M._rates(p, steps)[0].tolist() == [1.0, 0.5, 1.0]
    assert M._rates(p, steps[:1], keep=0)[0].tolist() == [1.0, 1.0, 1.0]


def test_edges(spark):
    docs, labels = corpus(spark)
    odd = awkward(spark)
    none = labels.limit(0)
    mixed = M.mix(odd, none)
    assert mixed.count() == odd.count() and {round(r["p_clean"], 6) for r in mixed.collect()} == {round(1 / 3, 6)}
    assert M.mix(documents(spark, []), labels).count() == 0
    assert rows_of(M.mix(clashing(odd), labels)) == rows_of(M.mix(odd, labels))
    wide = clashing(odd)
    assert M.draw(wide, M.mix(wide, labels)).columns == wide.columns
