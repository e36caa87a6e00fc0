"""Comparison of sites signal by signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signals(summary: DataFrame, key: str, higher: dict[str, bool]) -> DataFrame:
    """One row per site and signal: its value, the best value, and whether sites differ (to 3 decimals)."""
    long = summary.select(key, *[F.col(k).cast("double").alias(k) for k in higher]).unpivot([key], list(higher), "signal", "value")
    # A signal's extremes are aggregated first: no window gathers all sites of a signal.
    ends = long.groupBy("signal").agg(F.max("value").alias("most"), F.min("value").alias("least"))
    up = F.create_map(*[x for k, v in higher.items() for x in (F.lit(k), F.lit(v))])
    best = F.when(F.element_at(up, F.col("signal")), F.col("most")).otherwise(F.col("least"))
    return long.join(F.broadcast(ends), "signal").select(
        key, "signal", "value", best.alias("best"), (F.round("most", 3) != F.round("least", 3)).alias("differs")
    )


def wins(summary: DataFrame, key: str, higher: dict[str, bool]) -> DataFrame:
    """Signals won per site; ties all win, signals on which all agree don't count."""
    rows = signals(summary, key, higher)
    won = (F.abs(F.col("value") - F.col("best")) < 1e-9) & F.col("differs")
    return rows.groupBy(key).agg(F.sum(won.cast("int")).alias("signals_won"))


def champion(won: DataFrame, key: str) -> DataFrame:
    """The site with strictly more wins than any other, else 'gelijk'; no row for fewer than two sites."""
    top = won.orderBy(F.desc("signals_won"), key).limit(2)
    row = top.agg(F.sort_array(F.collect_list(F.struct("signals_won", F.col(key).alias("site"))), asc=False).alias("t"))
    lead = F.col("t")[0]["signals_won"] > F.col("t")[1]["signals_won"]
    return row.where(F.size("t") > 1).select(F.when(lead, F.col("t")[0]["site"]).otherwise("gelijk").alias("champion"))


def winner(rows: DataFrame, key: str) -> DataFrame:
    """Per signal: its only winner, else 'gelijk'."""
    best = rows.where(F.abs(F.col("value") - F.col("best")) < 1e-9).groupBy("signal").agg(F.count("*").alias("n"), F.min(key).alias("site"))
    return best.select("signal", F.when(F.col("n") == 1, F.col("site")).otherwise("gelijk").alias("winner"))
