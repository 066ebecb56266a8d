"""The corpus pipeline: quality rules, near duplicates, passages, benchmarks, mix.

Counted as part of the subpackage ``llm``.  Each stage takes any table with
doc_id, text and lang, keeps all columns, treats repeated rows alike and gives an
empty table for an empty one.  A row without a doc_id passes the first four
stages, as nothing there can name it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnledger.llm import decontaminate, jaccard_join, mixing, quality_rules, substring_dedup
from turnledger.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null, empty and short texts among them."""
    return quality_rules.quality_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays.

    Links follow the pipeline's rule for word shingles: five words and a
    similarity of 0.8 or more.  Null and empty texts are classes of their own.
    """
    return jaccard_join.near_duplicate_stage(docs, n=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; a document of which no word is left goes."""
    return substring_dedup.passage_stage(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go; null and empty texts aren't."""
    return decontaminate.decontamination_stage(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates and copies that bring the domains' tokens to their targets; documents without a copy go, texts without words have one."""
    return mixing.mixing_stage(docs, mixing.label_domains(table(spark, sf_dir, "labels")))


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("substring_dedup", passages), ("decontamination", benchmarks), ("mixing", mix)]

#: The language model's bands, chained alignments and fitted rates have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and goes when the next one is written."""
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
