import random

import xxhash

from sluice.llm import simhash_dedup as S

from .helpers import awkward, clashing, documents, rows_of


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest node reachable by links of 3 or fewer bits."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    for text in ("", "a", "abcd", "abcdefgh", "x" * 31, "y" * 32, "héllo wörld " * 9):
        assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == signed(xxhash.xxh64(text.encode(), seed=42).intdigest())


def test_fingerprints(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()] + ["", "A b", "one two three four"]
    assert [S.fingerprint(t.encode()) for t in texts] == [brute_print(t) for t in texts]


def test_links_lose_nothing(spark):
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(6):
            q = p
            for _ in range(rng.randint(0, 5)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
    want = {tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = [tuple(r) for r in S.links(nodes).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_replicas_are_never_broadcast(spark, tmp_path):
    spark.range(5000).selectExpr("xxhash64(id) AS fp").write.parquet(f"{tmp_path}/nodes")
    plan = S.links(spark.read.parquet(f"{tmp_path}/nodes"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 102), (55, 60), (60, 57)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: r for n, r in got.items() if n <= 40} == {i: 1 for i in range(2, 41)}
    assert (got[101], got[102], got[57], got[60]) == (100, 100, 55, 55)


def test_edges(spark):
    docs = awkward(spark)
    rows = S.near_duplicates(docs).collect()
    prints = {(r["doc_id"], t): brute_print(t) for r, t in zip(docs.collect(), [d["text"] for d in docs.collect()], strict=True)}
    assert sorted((str(d["doc_id"]), signed(brute_print(d["text"]))) for d in docs.collect()) == sorted((str(r["doc_id"]), r["fp"]) for r in rows)
    root = brute_components(set(prints.values()))
    least = {}
    for (doc, _), p in prints.items():
        if doc is not None:
            least[root[p]] = min(doc, least.get(root[p], doc))
    want = sorted((str(doc), signed(p), least.get(root[p])) for (doc, _), p in prints.items())
    assert sorted({(str(r["doc_id"]), r["fp"], r["component_id"]) for r in rows}) == want
    assert rows_of(S.near_duplicates(clashing(docs))) == rows_of(S.near_duplicates(docs))
    assert S.near_duplicates(documents(spark, [])).count() == 0


def test_similar_takes_links_of_fingerprints(spark, monkeypatch):
    base = [f"w{i}" for i in range(600)]
    texts = [" ".join(base), " ".join([*base[:300], "x", *base[301:]]), " ".join([*base, "y"]), " ".join(f"z{i}" for i in range(600)), ""]
    asked, links = [], S.links

    def spied(nodes, threshold=S.THRESHOLD):
        found = links(nodes, threshold)
        asked.append(({r["fp"] for r in nodes.collect()}, found.count()))
        return found

    monkeypatch.setattr(S, "links", spied)
    got = sorted(tuple(r) for r in S.similar(documents(spark, list(enumerate(texts)))).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)]
    shingles = [S.Shingles.open().of(t.encode()) for t in texts[:4]]
    prints = {signed(sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s))) for s in shingles}
    near = sum((a ^ b).bit_count() <= 3 for a in (p % 2**64 for p in prints) for b in (p % 2**64 for p in prints) if a < b)
    assert asked == [(prints, near)] and (near or len(prints) < 4)


def test_similar_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "SHORT", 4)  # long lists, so that leaders come into play
    rng = random.Random(6)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 60, 120]))]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(500)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(500, None), (501, " "), (None, rows[0][1]), (502, rows[0][1].upper())]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t in rows)]
    root = list(range(len(rows)))
    apart = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                apart += (S.fingerprint((rows[i][1] or "").encode()) ^ S.fingerprint((rows[j][1] or "").encode())).bit_count() > 3
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min((d for (d, _), q in zip(rows, root, strict=True) if q == r and d is not None), default=None) for r in root}
    got = {(r["doc_id"], r["component_id"]) for r in S.similar(documents(spark, rows)).collect()}
    assert apart > 20 and got == {(d, least[r]) for (d, _), r in zip(rows, root, strict=True)}
