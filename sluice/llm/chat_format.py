"""Chat formatting of reply trees.

Messages (tree_id, msg_id, parent_id, role, text, score) form trees of replies.
Root-to-leaf paths come from iterative self-joins: jump tables hold each
message's 2^k-th ancestor, each made by joining the one before with itself, and
every leaf collects its path through them, so a path of n messages takes about
log2(n) joins.  Branches of a tree are ranked by their summed score, and each
chosen path becomes one conversation in the template.

The template marks turns; control strings inside texts are escaped, reversibly:

    <s> [INST] {user} [/INST] {assistant} </s>   <<SYS>> {system} <</SYS>>
    [ROLE] {name} [/ROLE] {text} [/TURN]          any other role

A backslash is written as ``\\\\``, ``<`` as ``\\l`` and ``[`` as ``\\b``, so no text can
hold a control string and ``parse`` recovers roles, texts and the loss mask (the
spans of assistant texts) from the formatted string alone.

Edge cases: a null text is empty; a null role is its own role and reads back as
the empty role; null scores count as 0; messages whose parent is missing are
roots; a cycle of replies has no root: neither its messages nor those that hang on
it are on any path; branches of equal score rank by leaf; repeated rows of a
conversation are turns of their own.  Texts are taken whole.  A chosen path becomes
one string, so a conversation, however long, is formatted by one task.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, materialize, ship

BEGIN, END = "<s>", "</s>"
#: Opening and closing marks of the named roles.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", f" {END}"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {v: k for k, v in _ESCAPES.items()}


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: _BACK[m[0]], text)


def format_turns(turns: list[tuple[str, str]]) -> str:
    """One conversation of (role, text) in the template."""
    out = [BEGIN]
    for role, text in turns:
        if role in MARKS:
            first, last = MARKS[role]
            out += [first, escape(text), last]
        else:
            out += [f"[ROLE]{escape(role)}[/ROLE]", escape(text), "[/TURN]"]
    return "".join(out)


_TURN = re.compile(
    r"\[INST\] (?P<user>[^<\[]*) \[/INST\]| (?P<assistant>[^<\[]*) </s>|<<SYS>>\n(?P<system>[^<\[]*)\n<</SYS>>"
    r"|\[ROLE\](?P<role>[^<\[]*)\[/ROLE\](?P<other>[^<\[]*)\[/TURN\]"
)


def parse(formatted: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """The turns of a formatted conversation, and the loss mask as spans of it."""
    turns, mask, at = [], [], len(BEGIN)
    if not formatted.startswith(BEGIN):
        raise ValueError("no begin mark")
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        role = unescape(m["role"]) if kind == "other" else kind
        turns.append((role, unescape(m[kind])))
        if role == "assistant":
            mask.append(m.span(kind))
        at = m.end()
    return turns, mask


def jump_tables(messages: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (id, up) of each message's 1st, 2nd, 4th ... ancestor, as long as there are any, and a table of ids without a root.

    A path has no more steps than there are replies: whoever has an ancestor further
    up than that is on a cycle or hangs on one.  The second table is None without cycles.
    """
    tables = [materialize(messages.where("up is not null").select("id", "up"), "jump")]
    most = tables[0].count()
    while not tables[-1].isEmpty():
        here = tables[-1]
        if 1 << (len(tables) - 1) > most:
            return tables[:-1], here.select("id")
        above = here.select(F.col("id").alias("up"), F.col("up").alias("far"))
        tables.append(materialize(here.join(above, "up").select("id", F.col("far").alias("up")), "jump"))
    return tables[:-1], None


def paths(messages: DataFrame) -> DataFrame:
    """(leaf, id, up_by): every message on the path from each leaf to its root; the leaf has up_by 0.

    ``messages`` has distinct ``id`` and the parent's id in ``up`` (null: none).
    """
    known = messages.select(F.col("id").alias("up"))
    linked = messages.select("id", "up").join(known, "up", "left_semi").select("id", "up")
    nodes = messages.select("id").join(linked, "id", "left")
    tables, rootless = jump_tables(nodes)
    parents = linked.select(F.col("up").alias("id")).distinct()
    leaves = nodes.select("id").join(parents, "id", "left_anti")
    if rootless is not None:
        leaves = leaves.join(rootless, "id", "left_anti")
    found = leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up_by"))
    last = None
    for k in reversed(range(len(tables))):
        step = tables[k].select("id", F.col("up").alias("to"))
        further = found.join(step, "id").select("leaf", F.col("to").alias("id"), (F.col("up_by") + (1 << k)).alias("up_by"))
        found = materialize(found.unionByName(further), "paths")
        discard(*([last] if last is not None else []), tables[k])
        last = found
    return found


def best_branches(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, rank, branch_score, id, place): the best paths of each tree, from root (place 0) to leaf.

    ``messages``: id (distinct), up, tree, score.
    """
    on_path = materialize(paths(messages).join(messages.select("id", "tree", "score"), "id"), "on_path")
    scores = on_path.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("branch_score"), F.max("up_by").alias("depth"))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    chosen = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree)
    return chosen.join(on_path.select("leaf", "id", "up_by"), "leaf").select(
        "tree", "leaf", "rank", "branch_score", "id", (F.col("depth") - F.col("up_by")).alias("place")
    )


def format_branches(branches: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted): each chosen path as one conversation; ``messages`` adds role and text."""
    ship(branches.sparkSession)
    told = branches.join(messages.select("id", "role", "text"), "id")
    turn = F.struct("place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = told.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    @F.pandas_udf("string")
    def formatted(turns: pd.Series) -> pd.Series:
        return turns.map(lambda rows: format_turns([(r["role"], r["text"]) for r in rows]))

    return whole.select("tree", "leaf", "rank", formatted("turns").alias("formatted"))


def chain_messages(conversations: DataFrame) -> DataFrame:
    """Messages of a table (conv_id, turn, role, text): each turn replies to the one before.

    Ids are (conversation, number); equal turns are ordered by role, then text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order))
    return rows.select(
        F.struct("conv_id", "n").alias("id"),
        F.when(F.col("n") > 1, F.struct("conv_id", (F.col("n") - 1).alias("n"))).alias("up"),
        F.col("conv_id").alias("tree"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted string: turn, loss and length digests."""
    ship(formatted.sparkSession)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for conv, s in zip(pdf["conv"], pdf["formatted"], strict=True):
                turns, mask = parse(s)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(s[a:b]) for a, b in mask)
                rows.append((conv, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(s)))
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])
            out["conv_id"] = pd.array([None if pd.isna(x) else int(x) for x in pdf["conv"]], "Int64")
            yield out

    return formatted.select(F.col("tree").cast("long").alias("conv"), "formatted").mapInPandas(run, schema)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted) of a linear table (conv_id, turn, role, text)."""
    messages = materialize(chain_messages(conversations), "messages")
    return format_branches(best_branches(messages), messages)


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant row that hold control strings."""
    text = f"{END}[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
