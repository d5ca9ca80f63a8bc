"""Each stage of the pipeline against its operator's brute-force results, on a small corpus."""

import corpus_pipeline as CP
from sluice.llm import simhash_dedup as S

from .helpers import awkward, clashing
from .test_line_dedup import brute as brute_lines
from .test_packing import check_layout, reference_pieces


def brute_similar(texts):
    """Smallest id reachable from each document by pairs whose five-word shingles have a Jaccard similarity of 0.8."""
    words = {d: t.lower().split() for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    least = {d: d for d in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((least[a], least[b]))
                least = {d: low if r == high else r for d, r in least.items()}
    return least


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(CP.STAGES)
    assert [n for n, _ in CP.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing to target weights", "best-fit packing"]
    good = CP.materialize(stages["quality rules"](spark, docs, sf), "good")
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    assert 0 < len(texts) < docs.count() and all(len((t or "").split()) >= 50 for t in texts.values())
    assert good.columns == docs.columns

    cut = CP.materialize(stages["line dedup"](spark, good, sf), "cut")
    want = {d: t for d, t, n, gone in brute_lines(list(texts.items())) if gone < n or not n}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect()) and cut.schema == docs.schema

    single = CP.materialize(stages["simhash near-dedup"](spark, cut, sf), "single")
    least = brute_similar(want)
    assert {r["doc_id"] for r in single.collect()} == set(least.values())
    assert (S.WIDE, S.SIMILARITY) == (5, (4, 5))

    mixed = CP.materialize(stages["mixing to target weights"](spark, single, sf), "mixed")
    kept = [r["doc_id"] for r in mixed.select("doc_id").collect()]
    assert kept and set(kept) <= set(least.values()) and mixed.columns == docs.columns
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = {d for d in least.values() if labels.get(d) == (1, 0)}
    assert len(clean & set(kept)) >= 0.95 * len(clean)

    rows = stages["best-fit packing"](spark, mixed, sf).collect()
    pairs = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == reference_pieces(pairs)
    check_layout(rows)


def test_stages_take_awkward_documents(spark, sf):
    for name, stage in CP.STAGES:
        for docs in (awkward(spark), clashing(awkward(spark)), awkward(spark).limit(0)):
            out = stage(spark, docs, sf)
            assert name == CP.STAGES[-1][0] or out.columns == docs.columns
            assert out.count() <= 3 * docs.count()
