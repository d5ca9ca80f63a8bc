"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, hmm_lm, line_dedup, mixing, nn_descent, packing, quality_rules, simhash_dedup, token_counts, warc
from ._common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, "rule")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_of("fp").alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("*", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nn_descent.neighbours(rows, F.col("vec_id") % 50 == 0)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat_format.format_conversations(rows.unionByName(chat_format.planted(spark)))
    return chat_format.digests(formatted)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_mixing": op5_mixing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_warc": op7_warc,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_chat_format": op9_chat_format,
    "op10_best_fit_packing": op10_best_fit_packing,
}

#: Sets of words of all lines, joined on the rare words that similar sets must share.
_LINE_DEDUP = r"""
WITH split AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS ln, unnest(ls) AS line FROM split
), sets AS (
  SELECT doc_id, ln, line,
         list_sort(list_distinct(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS s
  FROM line
), firsts AS (
  SELECT s, len(s) AS n, min({'d': doc_id, 'ln': ln}) AS pos FROM sets WHERE len(s) > 0 GROUP BY s
), words AS (
  SELECT pos, n, unnest(s) AS w FROM firsts
), df AS (
  SELECT w, count(*) AS c FROM words GROUP BY w
), ranked AS (
  SELECT pos, n, w, row_number() OVER (PARTITION BY pos ORDER BY c, w) AS i FROM words JOIN df USING (w)
), prefix AS (
  SELECT pos, w FROM ranked WHERE i <= n - ceil(n * 4 / 5.0) + 1
), pairs AS (
  SELECT DISTINCT a.pos AS later, b.pos AS earlier FROM prefix a JOIN prefix b ON a.w = b.w AND b.pos < a.pos
), similar_to AS (
  SELECT DISTINCT later FROM pairs
  JOIN firsts a ON a.pos = later JOIN firsts b ON b.pos = earlier
  WHERE 9 * len(list_intersect(a.s, b.s)) >= 4 * (a.n + b.n)
), stay AS (
  SELECT pos.d AS doc_id, pos.ln AS ln FROM firsts WHERE pos NOT IN (SELECT later FROM similar_to)
), kept AS (
  SELECT doc_id, ln, line, s, (stay.ln IS NOT NULL) AS stays FROM sets LEFT JOIN stay USING (doc_id, ln)
)
SELECT doc_id,
       coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE stays OR len(s) = 0), '') AS text,
       count(*) FILTER (WHERE len(s) > 0) AS n_lines,
       count(*) FILTER (WHERE len(s) > 0 AND NOT stays) AS n_removed
FROM kept GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": _LINE_DEDUP,
}
