"""Shared helpers: reading tables, words, and rows without others; the tables in the shared folder are those of auditlake.storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bucket_values, discard, fresh_path, marked, released, scratch, shared_dir, written  # noqa: F401

#: White space between words: blank, and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows whose doc_id is in gone (doc_id). Only rows that may be in it are shuffled, not all texts.

    doc_id may be of any integer type; rows without doc_id stay, and so do ids that aren't whole numbers.
    """
    gone = written(gone.select(F.col("doc_id").try_cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "gone")
    test = marked(gone)
    test = F.coalesce(test, F.lit(False))
    maybe = docs.where(test)
    of = gone.select(F.col("doc_id").alias("_gone"))
    return docs.where(~test).unionByName(maybe.join(of, maybe["doc_id"].try_cast("long") == of["_gone"], "left_anti"))


def words(text: str = "text") -> str:
    """SQL for the array of words of a text column; a null text has none."""
    return f"array_remove(split(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), '')"


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with those an operator adds."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
