"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of ``documents``; the last adds ``rate`` and ``copies`` to the rows that the mixture takes. What a stage returns is written as
Parquet and read again by the next one, so a lost executor costs no earlier stage; scratch tables go as soon as a stage is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom import scratch
from auditloom.llm import common, decontam, exact_dedup, language_id, mixing, ngram_join


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the labelled rows show, go; which of the learned languages it is decides nothing."""
    return language_id.keep_known(spark, docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles with a Jaccard similarity of 0.8 or more the smallest doc_id stays."""
    return ngram_join.one_of_each(docs, 5, 80, 100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes no copy of go; the others carry their rate and copies."""
    return mixing.take(docs, common.table(spark, sf_dir, "labels"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Fitted classifiers decide in the first and the last stage, which SQL can't restate.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs, begun = common.table(spark, sf_dir, "documents"), scratch.mark()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, f"stage-{name}")
            scratch.release(spark, begun, keep=docs)
    return docs
