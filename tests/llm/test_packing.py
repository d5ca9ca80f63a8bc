import random
import struct
import zlib
from collections import Counter
from pathlib import Path

import pytest
import tokenizers

from sluice.llm import packing as P
from sluice.llm import queries
from sluice.llm._common import file_of

from .helpers import awkward, clashing, documents


def reference_pieces(rows, max_len=4096):
    tok = tokenizers.Tokenizer.from_file(file_of(P.TOKENIZER))
    out = []
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), max_len)):
            part = ids[at : at + max_len]
            out.append((str(doc), k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out)


def check_layout(rows, max_len=4096):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= max_len
    return len(places)


def test_query(spark, sf):
    rows = queries.QUERIES["op10_best_fit_packing"](spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == reference_pieces(docs)
    total = sum(r["length"] for r in rows)
    assert check_layout(rows) <= -(-total // 4096) * 1.02 + 1


def test_words_are_the_library_s():
    words = P.WordIds(file_of(P.TOKENIZER))
    rng = random.Random(5)
    bits = ["it's", "we'll", "a", "B", "12", "<|endoftext|>", "<|startoftext|>", " ", "\x85", "\x1c", "\n", "ﬁ", "é", "é", "İ", "Σς", "!!", '"', "日本", "🙂", "\x00", "\x7f", "'s", "’", "_", "#", "ß", "Ñ", "œuvre", "Ǆ", "ŉ", "ª", "²", "½", "×", "\xa0", "\xad", "“", "…", "€", "Ÿ", "ﬀ", "e\u0301", "\u2028"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert words.ids(text.encode()) == words.pack(words.tok.encode(text, add_special_tokens=False).ids), repr(text)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="isn't known"):
        P.WordIds(next(p for p in map(str, Path(file_of(P.TOKENIZER)).parent.glob("*.json")) if p != file_of(P.TOKENIZER)))


def test_plans_are_whole_and_tight():
    rng = random.Random(6)
    for _ in range(150):
        m = rng.choice([64, 128, 4096])
        histogram = {rng.randint(1, m): rng.randint(1, 200) for _ in range(rng.randint(1, 60))}
        rows = P.plan(histogram, m, grid=m // 64)
        numbers, sequences = {}, {}
        for length, first, count, sequence, offset in rows:
            for i in range(count):
                numbers.setdefault(length, []).append(first + i)
                sequences.setdefault(sequence + i, []).append((offset, length))
        assert {n: sorted(v) for n, v in numbers.items()} == {n: list(range(c)) for n, c in histogram.items()}
        for spans in sequences.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= m


def test_as_few_sequences_as_best_fit_alone():
    rng = random.Random(7)
    histogram = Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    used = lambda **kw: max(s + c for _, _, c, s, _ in P.plan(histogram, **kw))
    assert used() <= used(most=0) * 1.001 + 1
    assert P.plan({}) == []


def test_edges(spark):
    docs = awkward(spark)
    rows = P.pack(docs).collect()
    want = reference_pieces([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    check_layout(rows)
    assert max(r["piece"] for r in rows) > 5
    wide = P.pack(clashing(docs)).collect()
    assert len(wide) == len(rows)
    check_layout(wide)
    assert P.pack(documents(spark, [])).count() == 0
