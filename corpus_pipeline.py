"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``; ``n_chars`` follows the text.

Edge cases (beside those of the operators): quality rules judge every row by its
own text; after them, rows with equal ids stand for one document and stay or go
together; documents that line dedup leaves without any
word go; of a near-duplicate group the smallest id stays, and rows without an id
stay if no member of their group has one.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import line_dedup, mixing, packing, quality_rules, simhash_dedup
from sluice.llm._common import discard, materialize, recorded, table

_held = threading.local()


def _stage(run):
    """A stage.  As it starts, the tables go that the stage before it in this thread left: its output has been written."""

    @functools.wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*getattr(_held, "tables", ()))
        with recorded() as _held.tables:
            return run(spark, docs, sf_dir)

    return stage


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (one column); a null id matches a null id."""
    wanted = ids.toDF("_wanted_id").distinct()
    return docs.join(wanted, docs.doc_id.eqNullSafe(wanted._wanted_id), "left_semi")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a base rule nor a learned rule rejects."""
    judged, _ = quality_rules.judge(docs, table(spark, sf_dir, "labels"), whole=True)
    return judged.where("kept").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line resembles."""
    columns = docs.columns
    cut = line_dedup.deduplicate(docs, prefix="_dedup_")
    cut = cut.where("_dedup_n_lines = 0 or _dedup_n_removed < _dedup_n_lines")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles of similarity 0.8 or more."""
    found = simhash_dedup.similar(docs)
    return _only(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the domains ask for."""
    return mixing.draw(docs, materialize(mixing.mix(docs, table(spark, sf_dir, "labels")), "mix"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing to target weights", mixture),
    ("best-fit packing", pack),
]

#: Learned rules, XXH64 and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
