"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. The mixing stage returns a row for every time a document is read: its repeats limit is at least 1 for every
source, so that it loses no document.

Defined cases, in every stage: an empty table gives no rows; a null or empty text fails the quality rules, and as an
input of a later stage has no lines, is a near duplicate of nothing, has a length of 0 and is packed as the end id alone;
rows without doc_id are kept by line dedup and near-duplicate removal, and packed; ties between equal lines or texts go to
the smallest doc_id; repeated rows of one doc_id are one document to line dedup and near-duplicate removal, which keep or
change them all alike; columns beside those of documents are kept, whatever their names, up to the last stage; texts
are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import line_dedup, mixing, near_duplicates, packing, quality_rules
from auditlake.llm.common import discard, table, written
from auditlake.llm.tokens import public_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.kept(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line matches."""
    return line_dedup.cleaned(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return near_duplicates.kept(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's weight has them read."""
    return mixing.apply(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.digests(packing.pack(docs, public_path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Near-duplicate components and packing plans aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written and read again for the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = written(out, f"stage-{name}")
        if before is not None:
            discard(spark, before)
        before = docs
