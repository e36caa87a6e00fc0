"""Field coverage and site summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import url as U


def meaningful(name: str, kind: T.DataType) -> Column:
    """A boolean always counts; otherwise neither null, 0, blank, empty, nor a struct of nothing but these."""
    c = F.col(name)
    if isinstance(kind, T.BooleanType):
        return c.isNotNull()
    if isinstance(kind, T.StringType):
        return F.coalesce(F.trim(c) != "", F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(kind, T.StructType):
        parts = [meaningful(f"{name}.{f.name}", f.dataType) for f in kind.fields]
        out = F.lit(False)
        for p in parts:
            out = out | p
        return c.isNotNull() & out
    if isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def fill(df: DataFrame, fields: dict[str, str], by: str) -> DataFrame:
    """Percentage of rows with a meaningful value per field, by a key and over all rows."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    flags = df.select(by, *[meaningful(c, kinds[c]).cast("int").alias(k) for k, c in fields.items()])
    out = flags.rollup(by).agg(F.count("*").alias("pages"), *[F.round(100 * F.avg(k), 1).alias(f"{k}_pct") for k in fields])
    return out.withColumn(by, F.coalesce(by, F.lit("ALL")))


def never_filled(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The fields without any meaningful value."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    sums = df.agg(*[F.sum(meaningful(c, kinds[c]).cast("int")).alias(k) for k, c in fields.items()])
    rows = sums.unpivot([], list(fields), "field", "filled")
    return rows.where(F.coalesce("filled", F.lit(0)) == 0).select("field")


def site_summary(head: DataFrame) -> DataFrame:
    words = F.greatest(F.lit(1), F.size(F.expr(X.words("text"))))
    own = head.withColumn("words", words).withColumn("host", U.site(F.col("url")))
    percent = lambda test: F.round(100.0 * F.sum(test.cast("int")) / F.count("*")).cast("long")
    return own.groupBy("host").agg(
        F.count("*").alias("pages"),
        F.bool_and(U.scheme(F.col("url")) == "https").alias("https"),
        F.round(F.avg("words")).cast("long").alias("avg_word_count"),
        F.round(F.avg("title_length")).cast("long").alias("avg_title_len"),
        percent(F.col("description") != "").alias("pct_with_description"),
        percent(F.col("canonical") != "").alias("pct_with_canonical"),
        percent(F.col("jsonld_count") > 0).alias("pct_with_jsonld"),
        percent(F.col("h1_count") == 1).alias("pct_single_h1"),
        F.countDistinct(F.nullif("description", F.lit(""))).alias("unique_descriptions"),
        F.sum("image_count").alias("total_images"),
        F.countDistinct("title").alias("unique_titles"),
    )


def improvements(summary: DataFrame) -> DataFrame:
    """Advice per site from its summary, in fixed order."""
    rules = (
        (F.col("pct_with_description") < 90, "Write a meta description for every page"),
        (F.col("pct_with_canonical") < 90, "Set a canonical link on every page"),
        (F.col("pct_with_jsonld") < 60, "Add structured data"),
        (F.col("pct_single_h1") < 90, "Use exactly one H1 a page"),
        (F.col("avg_word_count") < 300, "Deepen thin pages"),
        (~F.col("https"), "Serve every page over HTTPS"),
        (F.col("avg_title_len") > 60, "Shorten titles"),
        (F.col("unique_titles") < F.col("pages"), "Make titles unique"),
    )
    return summary.select("host", F.array_compact(F.array(*[F.when(test, F.lit(said)) for test, said in rules])).alias("advice"))
