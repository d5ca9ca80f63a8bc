import hashlib
import random

from pyspark.sql import functions as F

from sluice.llm import chat_format as C
from sluice.llm import queries

from .helpers import rows_of

SCHEMA = "conv_id long, turn long, role string, text string"


def test_escapes_and_parse():
    rng = random.Random(3)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "\\", "\\l", "\\b", "[", "<", " ", "\n", "é", "[ROLE]", "[/TURN]", "x", ""]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[ROLE]", "a\\b"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        whole = C.format_turns(turns)
        back, mask = C.parse(whole)
        assert back == turns
        assert [C.unescape(whole[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def brute(rows):
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((str(conv), len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


def view(df):
    return sorted((str(r["conv_id"]), r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect())


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    assert view(queries.QUERIES["op9_chat_format"](spark, sf)) == brute([*rows, (-7, 0, "user", odd), (-7, 1, "assistant", odd)])


def test_trees(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6 (best), and a tree of one message; 9 answers a message that is not there.
    rows = [(1, None, "t", 0.0), (2, 1, "t", 5.0), (4, 2, "t", 1.0), (3, 1, "t", 1.0), (5, 3, "t", 4.0), (6, 5, "t", 4.0), (7, None, "u", None), (9, 8, "v", 1.0), (20, 21, "c", 1.0), (21, 20, "c", 1.0)]
    # 20 and 21 answer each other, and 22 answers 21: no path.
    messages = spark.createDataFrame([*rows, (22, 21, "c", 1.0)], "id long, up long, tree string, score double")
    best = C.best_branches(messages, per_tree=2).orderBy("tree", "rank", "place").collect()
    found = {}
    for r in best:
        found.setdefault((r["tree"], r["rank"], r["branch_score"]), []).append(r["id"])
    assert found == {("t", 1, 9.0): [1, 3, 5, 6], ("t", 2, 6.0): [1, 2, 4], ("u", 1, 0.0): [7], ("v", 1, 1.0): [9]}
    long = spark.createDataFrame([(i, i - 1 if i else None, "x", 1.0) for i in range(70)], "id long, up long, tree string, score double")
    assert [r["id"] for r in C.best_branches(long).orderBy("place").collect()] == list(range(70))


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, None, "assistant", "y"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (2, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = C.digests(C.format_conversations(df))
    assert {(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got.collect()} == {(1, 4, 1), (None, 2, 1), (2, 1, 100_000)}
    assert C.digests(C.format_conversations(df.limit(0))).count() == 0
    wide = df.select("*", *(F.lit("z").alias(c) for c in ("id", "up", "tree", "score", "n", "leaf", "rank", "place")))
    assert rows_of(C.digests(C.format_conversations(wide))) == rows_of(got)
