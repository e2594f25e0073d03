"""From raw documents to token files: quality rules, one of each group of near copies, no benchmark passages, a mix of sources, token ids.

Each stage takes (spark, docs, sf_dir) and reads docs only; all but the last return the columns of documents. run() writes what a stage
returns and reads it again for the next one; then what the stage and the one before it left in the shared folder is deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, jaccard, mixing, quality, token_files
from tidemark.llm.tables import passing, place, removed, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What policy full-1 of the quality rules keeps."""
    return quality.filtered(docs, "full-1")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of 5-word shingle sets that are alike to 0.75 the document with the smallest id; all that link with nothing, whatever their ids."""
    return jaccard.representatives(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of sources by weights 5, 2, 1 takes them: 0 to 3 times."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all that is left, in packed files; a row for each document in them."""
    return token_files.tokenized(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard", near_copies_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mix_stage),
    ("token_files", token_stage),
]

#: A draw decides in the mix and a tokenizer after it: no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = place(spark, f"stage-{name}")
        with passing(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(kept)
        docs = spark.read.schema(made.schema).parquet(kept)
        if read:
            removed(spark, read)
        read = kept
    return STAGES[-1][1](spark, docs, sf_dir)
