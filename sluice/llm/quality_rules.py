"""Quality rules as learned decision lists, in DataFrame functions only.

``statistics`` computes numbers for every whole text.  ``learn`` covers the
documents that a labelled table calls low-quality, rule by rule: a rule grows by
the threshold condition of the highest information gain until it covers no good
document of the growing part, loses its last conditions while that raises its
worth on the pruning part, and joins the list if it is precise there.  All counts
are Spark aggregations over the whole labelled table; the driver sees only
histograms of features x bins.  The list becomes one ordered ``CASE WHEN``.

Windows of words are told apart by 64 bits of hash.

Edge cases: a null text has no words; very long texts are taken whole; null labels and labels of unknown documents
teach nothing; repeated label rows count as often as they stand; without labels
the list is empty and only the base rules reject; ties between conditions go to
the first feature and the lowest threshold; an empty table gives no rows.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Thresholds tried per feature, rules in a list, conditions in a rule.
BINS, MAX_RULES, MAX_CONDITIONS = 32, 10, 4
#: Share of bad documents among those that a rule covers in the pruning part, at least.
MIN_PRECISION = 0.9
FEATURES = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "stop_share", "distinct_share"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def rule_column(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule))


def decision_list(rules: list[Rule]) -> Column:
    """Ordered conditional: the number (from 1) of the first rule that fires, else null."""
    out = F.lit(None).cast("int")
    if rules:
        out = F.when(rule_column(rules[0]), 1)
        for k, rule in enumerate(rules[1:], 2):
            out = out.when(rule_column(rule), k)
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the shares in FEATURES.

    With ``whole``, the document itself as a struct ``row``.
    """
    own = ["row"] if whole else []
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *([row] if whole else []))
    rows = rows.select("doc_id", "t", *own, words(F.col("t")).alias("w"))
    gone = lambda chars: F.length("t") - F.length(F.regexp_replace("t", chars, ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.select(
        "doc_id",
        *own,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        gone(f"[{SYMBOLS}]").cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size("w") >= 3, window).alias("h"),
        gone(r"\p{Lu}").alias("n_upper"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).alias("n_bang"),
        gone(r"[.,;:?](?=[\x20\x09-\x0D]|\z)").alias("n_stop"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
    )
    # Windows found twice or more, by sorting (hash, place); then the words they cover.
    by_hash = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.select(
        "*",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), by_hash).alias("s"),
    ).drop("lines", "h")
    twice = F.filter("s", lambda x, i: (x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]))
    rows = rows.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at")).drop("s")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    rows = rows.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("at")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select(
        *own,
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_bang", "n_words").alias("bang_share"),
        share("n_stop", "n_words").alias("stop_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information that a condition adds for the bad documents it keeps."""
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, features: list[str] = FEATURES, bad: str = "bad") -> list[Rule]:
    """A decision list for rows with ``features``, a boolean ``bad`` and ``doc_id``."""
    # Two of three documents grow rules, the third prunes them.
    rows = labelled.where(F.col(bad).isNotNull())
    rows = rows.select(F.col(bad).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), *features)
    steps = [k / BINS for k in range(1, BINS)]
    # Quantiles of the bad and of the good rows together, so that a rare kind has thresholds too.
    cut = rows.groupBy("bad").agg(*(F.percentile_approx(f, F.lit(steps), 1000).alias(f) for f in features)).collect()
    thresholds = {f: sorted({round(t, 12) for r in cut for t in r[f]}) for f in features}
    binned = rows.select("*", *(sum((F.col(f) > t).cast("int") for t in thresholds[f]).alias(f"{f}_bin") for f in features if thresholds[f]))
    binned = materialize(binned, "labelled")
    used = [f for f in features if thresholds[f]]

    def grow(open_rows: DataFrame) -> Rule:
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            now = open_rows.where(rule_column(rule)) if rule else open_rows
            cells = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"{f}_bin").alias("b")) for i, f in enumerate(used)))).alias("x")
            counted = now.where("not prune").select("bad", cells).groupBy("x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            best, best_gain, total = None, 1e-6, (0, 0)
            for i, f in enumerate(used):
                cell = {r["b"]: (r["p"], r["n"]) for r in counted if r["f"] == i}
                p0, n0 = sum(p for p, _ in cell.values()), sum(n for _, n in cell.values())
                total = (p0, n0)
                if not p0:
                    return rule
                p = n = 0
                for b, t in enumerate(thresholds[f]):
                    p, n = p + cell.get(b, (0, 0))[0], n + cell.get(b, (0, 0))[1]
                    for above, (q, m) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if (g := _gain(q, m, p0, n0)) > best_gain:
                            best, best_gain = Condition(f, above, t), g
            if best is None or not total[1]:
                break
            # Halfway between the observed values on both sides of the threshold.
            f, t = F.col(best.feature), best.threshold
            side = now.where("not prune").agg(F.max(F.when(f <= t, f)).alias("low"), F.min(F.when(f > t, f)).alias("high")).first()
            if side["low"] is not None and side["high"] is not None:
                best = Condition(best.feature, best.above, (side["low"] + side["high"]) / 2)
            rule = (*rule, best)
        return rule

    def pruned(rule: Rule, open_rows: DataFrame) -> tuple[Rule, int, int]:
        """The prefix of the rule with the highest (p - n) / (p + n) on the pruning part."""
        heads = [rule_column(rule[: k + 1]) for k in range(len(rule))]
        counts = [c for k, h in enumerate(heads) for c in (F.count_if(h & F.col("bad")).alias(f"p{k}"), F.count_if(h & ~F.col("bad")).alias(f"n{k}"))]
        r = open_rows.where("prune").agg(*counts).first()
        k = max(range(len(rule)), key=lambda k: ((r[f"p{k}"] - r[f"n{k}"]) / max(1, r[f"p{k}"] + r[f"n{k}"]), -k))
        return rule[: k + 1], r[f"p{k}"], r[f"n{k}"]

    rules: list[Rule] = []
    while used and len(rules) < MAX_RULES:
        open_rows = binned.where(decision_list(rules).isNull()) if rules else binned
        rule = grow(open_rows)
        if not rule:
            break
        rule, p, n = pruned(rule, open_rows)
        if p + n == 0 or p / (p + n) < MIN_PRECISION:
            break
        rules.append(rule)
    return rules


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> tuple[DataFrame, list[Rule]]:
    """(statistics with base_failed, rule and kept; the learned list).

    ``labels`` has doc_id and quality (0: bad).  ``rule`` is the number of the
    learned rule that rejects, null if none.  With ``whole``, a struct ``row`` holds
    the document, so that its verdict needs no join.
    """
    stats = materialize(statistics(docs, id_col, text_col, whole), "statistics")
    told = labels.where("quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad"))
    rules = learn(stats.drop("row").where(~base_failed()).join(told, "doc_id"))
    judged = stats.select("*", base_failed().alias("base_failed"), F.when(~base_failed(), decision_list(rules)).alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
