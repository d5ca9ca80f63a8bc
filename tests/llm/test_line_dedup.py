import random

from pyspark.sql import functions as F

from sluice.llm import line_dedup as L
from sluice.llm import queries

from ..oracle import compare, connect
from .helpers import SCHEMA, awkward, clashing, documents, rows_of


def brute(rows):
    """(doc_id, text, n_lines, n_removed), every line against all earlier ones."""
    seen, out = [], []
    for doc, text in sorted(rows):
        kept, n, gone = [], 0, 0
        for line in text.split("\n"):
            s = set(line.encode().split())
            if not s:
                kept.append(line)
                continue
            n += 1
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone += 1
            else:
                kept.append(line)
            seen.append(s)
        out.append((doc, "\n".join(kept), n, gone))
    return out


def near_copies(seed, docs, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, words))] for _ in range(12)]
    rows = []
    for d in range(docs):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(rng.choice(["", " "]) + " ".join(line))
        rows.append((d, "\n".join(lines)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "SHORT", 8)  # long lists, so that leaders come into play
    rows = near_copies(3, 60)
    got = L.deduplicate(documents(spark, rows).select("doc_id", "text"))
    want = brute(rows)
    assert sum(r[3] for r in want) > 50
    assert sorted(map(tuple, got.collect())) == want


def test_first_and_last_bit_of_the_document_bitmap(spark):
    text = "a b c d e f g h i j\na b c d e f g h i k"
    bit = F.pmod(F.xxhash64("id", F.xxhash64(F.lit(text))), F.lit(L.DOC_BITS))
    ids = spark.range(20_000_000).select("id", bit.alias("b")).where(F.col("b").isin(0, L.DOC_BITS - 1))
    for r in ids.groupBy("b").agg(F.min("id").alias("id")).collect():
        got = L.deduplicate(documents(spark, [(r["id"], text)]).select("doc_id", "text")).collect()
        assert [tuple(x) for x in got] == [(r["id"], text.split("\n")[0], 2, 1)], r["b"]
    assert ids.select("b").distinct().count() == 2


def test_against_sql(spark, sf):
    df = queries.QUERIES["op1_line_dedup"](spark, sf)
    assert compare(df, connect(sf), queries.ORACLE_SQL["op1_line_dedup"]) == 200


def test_native(spark, sf):
    plan = queries.QUERIES["op1_line_dedup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_edges(spark):
    docs = awkward(spark)
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in L.deduplicate(docs).collect()}
    assert (2, None, 0, 0) in got and (3, "", 0, 0) in got and (None, None, 0, 0) in got
    assert (6, "", 2, 2) in got and (1, "the quick brown fox jumps over the lazy dog\nagain and again", 2, 0) in got
    assert (10, "A\n\n\na", 3, 1) in got
    assert (None, "a text without id", 1, 0) in got and (7, "repeated row", 1, 0) in got
    assert L.deduplicate(docs).count() == docs.count()
    assert L.deduplicate(documents(spark, [])).count() == 0
    wide = L.deduplicate(clashing(docs))
    assert rows_of(wide.select("doc_id", "text", "n_lines", "n_removed")) == rows_of(L.deduplicate(docs).select("doc_id", "text", "n_lines", "n_removed"))
    assert SCHEMA.split()[0] == "doc_id"


def test_class_table_is_short_in_plans(spark):
    docs = documents(spark, [(1, "a b c\nd e f"), (2, "a b c")])
    plan = L.first_lines(docs, ",".join(["62"] * L.BUCKETS), "doc_id", "text")._jdf.queryExecution().toString()
    assert len(plan) < 20 * L.BUCKETS
    ranks = {k >> L._HASH_BITS for r in L.first_lines(docs, ",".join(["62"] * L.BUCKETS), "doc_id", "text").collect() for k in r["prefix"]}
    assert ranks == {62}


def test_similar_pairs_meet_on_short_prefixes(spark):
    """Pairs of every pair of lengths that just suffice share as many offered keys in the list of the longer one's band as asked."""
    num, den = L.THRESHOLD
    pairs = [(n, m, -(-num * (n + m) // (num + den))) for n in range(1, 300) for m in range(n, den * n // num + 1)]
    df = spark.createDataFrame(pairs, "n int, m int, o int")
    got = df.select("n", "m", "o", L._short_prefix(F.col("n"), L._band(F.col("m"))).alias("p"), L._prefix(F.col("m")).alias("q"), L._needed(F.col("n"), F.col("m")).alias("c"), (L._band(F.col("m")) - L._band(F.col("n"))).alias("d"))
    for r in got.collect():
        # The words that only one of both has may all stand first.
        assert 0 < r["c"] <= min(r["p"] - (r["n"] - r["o"]), r["q"] - (r["m"] - r["o"])) and r["d"] in (0, 1), r


def test_lists_hold_few_pairs_of_unlike_lengths(spark, monkeypatch):
    """Lines of many lengths with one rare word in common: those too long or too short for each other don't meet."""
    rows = [(d, " ".join(["rare", *(f"w{d}x{j}" for j in range(4 + 3 * d))])) for d in range(40)]
    docs = documents(spark, rows).select("doc_id", "text")
    firsts = L.first_lines(docs, L.frequency_classes(docs, "text"), "doc_id", "text")
    lists = L._list_of(L.offers(firsts, 0, 1), F.col("band"), "x").join(L._list_of(L.postings(firsts), L._band(F.col("n")), "y"), "g")
    assert lists.where("xsid <> ysid").count() < 40 * 39 / 4
    assert sorted(map(tuple, L.deduplicate(docs).collect())) == brute(rows)
