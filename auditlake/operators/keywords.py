"""Keyword profiles: n-gram counts per text, top k by count and first occurrence, and site sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Terms kept per text for n-grams of 1, 2 and 3 words.
KEPT = {1: 25, 2: 15, 3: 10}


def profile(texts: DataFrame, key: str, text: str, n: int, top: int | None = None) -> DataFrame:
    """key, term, count, first_pos, density_pct, place: the top terms of every text; ties go to the earlier term."""
    words = texts.select(key, F.expr(T.words(f"coalesce({text}, '')")).alias("words"))
    rows = words.select(key, F.greatest(F.lit(1), F.size("words")).alias("total"), F.posexplode(F.expr(T.ngrams("words", n))).alias("pos", "term"))
    counts = rows.groupBy(key, "total", "term").agg(F.count("*").alias("count"), F.min("pos").alias("first_pos"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "first_pos"))
    best = counts.withColumn("place", place).where(F.col("place") <= (top or KEPT[n]))
    return best.select(key, "term", "count", "first_pos", F.round(100 * F.col("count") * n / F.col("total"), 2).alias("density_pct"), "place")


def placed(found: DataFrame, haystacks: dict[str, str]) -> DataFrame:
    """Adds the names of the columns whose text holds the term."""
    names = [F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.col("term")), F.lit(k)) for k, c in haystacks.items()]
    return found.withColumn("in", F.array_compact(F.array(*names)))


def site_terms(found: DataFrame, by: str, top: int) -> DataFrame:
    """Sums over the texts' truncated lists: term, uses, texts per group, the top ones."""
    sums = found.groupBy(by, "term").agg(F.sum("count").alias("uses"), F.count("*").alias("texts"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("uses"), "term"))
    return sums.withColumn("place", place).where(F.col("place") <= top)
