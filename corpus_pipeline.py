"""The corpus pipeline: quality rules, near-dedup, decontamination, PII, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  ``run`` writes each stage's rows to the
shared folder and reads them back as the next one's docs.

Defined cases: a null doc_id is carried through all stages, and its row is never
a copy of another; an empty table stays empty; columns beside those of documents
are kept, whatever their names, up to packing, which returns its pieces only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwork.llm.decontaminate import without_leaks
from siftwork.llm.near_dedup import one_of_each
from siftwork.llm.packing import pack
from siftwork.llm.pii import sanitise
from siftwork.llm.quality import clean
from siftwork.llm.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line rules reject go; the others lose their failing lines.

    Null, empty and very short texts go; very long lines and texts are judged whole; repeated rows stay or go together, each row by itself.
    """
    return clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8.

    Of a group the least doc_id stays (ties: the least text key); of repeated rows one; a text without words has no group and stays;
    rows that share a doc_id but no text are judged by their texts, so neither text is lost.
    """
    return one_of_each(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; items without words match nothing, so an empty benchmark removes nothing; repeated rows go together.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced by their kind.

    Null and empty texts stay as they are; copies count once in the statistics and get equal replacements; of overlapping spans the
    first one names the kind.
    """
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens.

    A null text is an empty one, its end token alone; repeated rows are packed each; longer texts are cut, first piece short.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", private), ("packing", packing)]

#: The near-dedup, template and packing stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: all stages in order over the whole table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
