import collections

import pytest

from sluice.llm import quality_rules as Q

from .helpers import awkward, clashing, documents, rows_of


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(awkward(spark).select("doc_id", "text").where("doc_id <> 7 and doc_id is not null").selectExpr("-doc_id", "text"))
    want = {r["doc_id"]: brute(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: tuple(r[c] for c in BASE) for r in Q.statistics(docs).collect()}
    assert got == want


def test_learned_list_and_held_out_accuracy(spark):
    clean = [(i, " ".join(f"plain{i}x{k} words" for k in range(40)) + " end.") for i in range(240)]
    junk = [(1000 + i, " ".join(f"word{i}x{k}### thing{k}***" for k in range(40))) for i in range(80)]
    docs = documents(spark, clean + junk)
    told = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in clean[::2] + junk[::2]] + [(5, None, None), (None, 0, 0), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    judged, rules = Q.judge(docs, told)
    assert rules
    kept = {r["doc_id"]: r["kept"] for r in judged.where("not base_failed").collect()}
    assert kept and all(v == (i < 1000) for i, v in kept.items())
    # The list as Spark columns and as plain Python agree.
    for r in judged.collect():
        first = next((k for k, rule in enumerate(rules, 1) if all((r[c.feature] > c.threshold) == c.above for c in rule)), None)
        assert r["base_failed"] or r["rule"] == first


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_edges(spark, no_labels):
    docs = awkward(spark)
    judged, rules = Q.judge(docs, no_labels)
    assert rules == [] and judged.count() == docs.count()
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"]) for r in judged.collect())
    assert Q.judge(documents(spark, []), no_labels)[0].count() == 0
    assert rows_of(Q.statistics(clashing(docs))) == rows_of(Q.statistics(docs))
