import random

import pytest
import sentencepiece

from sluice.llm import token_counts as T
from sluice.llm._common import file_of

from .helpers import LONG, awkward, clashing, documents, rows_of


@pytest.fixture(scope="module")
def counter():
    return T.SegmentCounter(file_of(T.MODEL))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    parts = ["a", "b", " ", "\n", "  ", "é", "日", "th", "e", "▁", "\t", "1", "23", ".", "<s>", "</s>", "🙂", "　", "<0x0A>"]
    return ["", " ", "\n", " \n ", "x" * 50, "a" + " " * 40 + "b   "] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)]


def test_totals_are_the_library_s(counter, texts, spark, sf):
    texts = texts + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert [counter.total(t) for t in texts] == [len(x) for x in counter.sp.encode(texts)]


def test_every_prefix_and_budget(counter, texts):
    for t in texts[:150]:
        want = [len(counter.sp.encode(t[:i])) for i in range(len(t) + 1)]
        p = T.PrefixCounts(counter, t)
        assert [p.at(i) for i in range(len(t) + 1)] == want
        for budget in (0, 1, 4, 9, 1000):
            assert p.fit(budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_stored_tables(counter, texts, spark):
    some = texts[:60]
    rows = T.prefix_tables(documents(spark, [*enumerate(some), (99, None)])).collect()
    assert len(rows) == len(some) + 1
    for r in rows:
        t = some[r["doc_id"]] if r["doc_id"] < 99 else ""
        assert r["tokens"] == [len(counter.sp.encode(t[:e])) for e in r["ends"]] and r["ends"][-1] == len(t)


def test_small_cache(texts, monkeypatch):
    monkeypatch.setattr(T, "CACHE", 5)
    small = T.SegmentCounter(file_of(T.MODEL))
    assert [small.total(t) for t in texts] == [len(x) for x in small.sp.encode(texts)]


def test_edges(spark):
    docs = awkward(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=file_of(T.MODEL))
    want = []
    for r in docs.collect():
        n = len(sp.encode(r["text"] or ""))
        want.append((str(r["doc_id"]), len((r["text"] or "").encode()), n, n > 4096))
    got = T.token_counts(docs)
    assert sorted((str(r[0]), *r[1:4]) for r in got.collect()) == sorted(want)
    assert got.where("over_limit").first()["fit_chars"] < len(LONG)
    assert rows_of(T.token_counts(clashing(docs))) == rows_of(got)
    assert T.token_counts(documents(spark, [])).count() == 0
