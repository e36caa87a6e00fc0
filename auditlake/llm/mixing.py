"""Temperature mixing of sources, in DataFrame expressions only.

A source's weight is its share of all tokens (words) to the power `alpha`, normalised. alpha is bisected: the
largest whose weights reach target_entropy bits, then raised as far as max_repeats demands, so that no source is
read more often than that. Without a token budget, the budget is the one that reads the largest source exactly
once, so that no document is lost. Weights are realised as block permutations: each epoch of a source orders its
documents by a hash, whose leading digits are the block; full epochs take every document, the last one takes
blocks in order up to the budget, and documents of the block that the budget ends in, in order.

Defined cases: a null source is a source of its own; a document without words costs nothing and comes with every
full epoch; a null doc_id is hashed as an empty string; equal ids share a place in the order and may come
together or not at all; one source or equal shares give repeats of 1; an empty table gives no rows; extra columns
stay in apply() and are ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, words, written


@dataclass(frozen=True)
class Mix:
    target_entropy: float | None = None  # bits
    max_repeats: float | None = 1.5
    budget: int | None = None  # tokens
    seed: int = 7
    block_digits: int = 3  # of the hash, in hexadecimal
    broadcast_sources: int = 100_000  # more sources are joined by a shuffle


def _key(m: Mix, epoch: str) -> str:
    return f"md5(concat('{m.seed}:', {epoch}, ':', coalesce(cast(doc_id as string), '')))"


def _narrowed(holds: Callable[[list[float]], list[bool]], low: bool) -> float:
    """The least (low) or largest point of 0, 2**-20, .. 1 that holds, of points that hold from some point on (up to it); four bisections a round. 1 or 0 if none does."""
    n, lo, hi = 1 << 20, 0, 1 << 20
    while hi > lo:
        step = max(1, (hi - lo) // 16)
        at = sorted({*range(lo, hi + 1, step), hi})
        ok = holds([x / n for x in at])
        if low:
            first = next((k for k, x in enumerate(ok) if x), None)
            if first is None:
                return 1.0
            lo, hi = (at[first - 1] + 1 if first else at[0]), at[first]
        else:
            last = next((k for k in reversed(range(len(ok))) if ok[k]), None)
            if last is None:
                return 0.0
            lo, hi = at[last], (at[last + 1] - 1 if last + 1 < len(at) else at[last])
    return lo / n


def exponent(shares: DataFrame, m: Mix, total: int) -> tuple[float, float, float]:
    """alpha, the sum of the shares to that power, and the largest share; one aggregate over the sources a round, whatever their number."""
    ends = shares.agg(F.min("share"), F.max("share")).first()
    least, most = ends[0], ends[1]

    def sums(points: list[float]) -> list[tuple[float, float]]:
        power = lambda x: F.pow("share", F.lit(x))
        parts = [c for x in points for c in (F.sum(power(x)), F.sum(power(x) * F.log2("share")))]
        row = shares.agg(*parts).first()
        return [(row[2 * k], row[2 * k + 1]) for k in range(len(points))]

    def entropy(points):
        from math import log2

        return [log2(z) - x * a / z >= m.target_entropy for x, (z, a) in zip(points, sums(points), strict=True)]

    def repeats(points):
        if m.budget is None:
            return [(least / most) ** (x - 1) <= m.max_repeats for x in points]
        return [m.budget / total * least ** (x - 1) / z <= m.max_repeats for x, (z, _) in zip(points, sums(points), strict=True)]

    alpha = 0.0 if m.target_entropy is None else _narrowed(entropy, low=False)
    if m.max_repeats is not None:
        alpha = max(alpha, _narrowed(repeats, low=True))
    return alpha, sums([alpha])[0][0], most


def plan(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """Per source: n_docs, n_tokens, weight, repeats, epochs (full ones) and the last hash that the partial epoch takes."""
    counted = written(only(docs, "doc_id", "source", "text").select("doc_id", "source", F.expr(f"size({words()})").cast("long").alias("n")), "counted")
    sources = written(counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens")), "sources")
    total = sources.agg(F.sum("n_tokens")).first()[0] or 0
    shares = sources.where("n_tokens > 0").withColumn("share", F.col("n_tokens") / F.lit(total))
    if total:
        alpha, z, most = exponent(shares, m, total)
        if m.budget is None:
            repeats = F.pow(F.col("share") / F.lit(most), F.lit(alpha - 1))
        else:
            repeats = F.lit(m.budget / total) * F.pow("share", F.lit(alpha - 1)) / F.lit(z)
        weight = F.pow("share", F.lit(alpha)) / F.lit(z)
    else:
        repeats, weight = F.lit(1.0), F.lit(0.0)
    shared = sources.withColumn("share", F.col("n_tokens") / F.lit(total or 1))
    planned = shared.select(
        "source",
        "n_docs",
        "n_tokens",
        F.when(F.col("n_tokens") > 0, weight).otherwise(F.lit(0.0)).alias("weight"),
        F.when(F.col("n_tokens") > 0, repeats).otherwise(F.lit(1.0)).alias("repeats"),
    )
    planned = planned.withColumn("epochs", F.floor("repeats").cast("int")).withColumn(
        "rest", F.floor((F.col("repeats") - F.col("epochs")) * F.col("n_tokens")).cast("long")
    )
    planned = written(planned, "planned")
    # The partial epoch: sums by block, then the running sum inside the block that the budget ends in.
    of = planned.select(F.col("source").alias("_source"), "epochs", "rest")
    small = planned.count() <= m.broadcast_sources
    keyed = counted.join(F.broadcast(of) if small else of, F.col("source").eqNullSafe(F.col("_source")))
    keyed = keyed.withColumn("key", F.expr(_key(m, "cast(epochs as string)"))).withColumn("block", F.expr(f"substr(key, 1, {m.block_digits})"))
    blocks = keyed.groupBy("source", "rest", "block").agg(F.sum("n").alias("b"))
    run = F.sum("b").over(Window.partitionBy("source").orderBy("block"))
    blocks = blocks.withColumn("upto", run).where("upto > rest").withColumn("before", F.col("upto") - F.col("b"))
    last = blocks.groupBy("source", "rest").agg(F.min(F.struct("block", "before")).alias("x"))
    last = last.select(F.col("source").alias("_s"), F.col("x.block").alias("_block"), F.col("x.before").alias("_before"))
    inside = keyed.join(F.broadcast(last) if small else last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_block")))
    inside = inside.withColumn("upto", F.col("_before") + F.sum("n").over(Window.partitionBy("source").orderBy("key")))
    taken = inside.where("upto <= rest").groupBy("source").agg(F.max("key").alias("_key")).withColumnRenamed("source", "_t")
    out = planned.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").join(taken, F.col("source").eqNullSafe(F.col("_t")), "left")
    # 'g' is past every key; a block's own digits come before the keys in it
    return out.select(
        "source", "n_docs", "n_tokens", "weight", "repeats", "epochs", F.expr("coalesce(_key, _block, 'g')").alias("last_key")
    )


def apply(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """docs with a row for every time a document is read, and its epoch and block in `__mix_epoch` and `__mix_block`."""
    planned = written(plan(docs, m), "mix")
    of = planned.select(F.col("source").alias("__mix_source"), "epochs", "last_key")
    if planned.count() <= m.broadcast_sources:
        of = F.broadcast(of)
    renamed = docs.withColumn("__mix_own", F.col("source"))
    joined = renamed.join(of.toDF("__mix_source", "__mix_epochs", "__mix_last"), F.col("__mix_own").eqNullSafe(F.col("__mix_source")))
    times = F.expr(f"__mix_epochs + if({_key(m, 'cast(__mix_epochs as string)')} <= __mix_last, 1, 0)")
    read = joined.withColumn("__mix_times", times).where("__mix_times > 0").withColumn("__mix_epoch", F.explode(F.expr("sequence(0, __mix_times - 1)")))
    block = F.expr(f"substr({_key(m, 'cast(__mix_epoch as string)')}, 1, {m.block_digits})")
    return read.withColumn("__mix_block", block).drop("__mix_own", "__mix_source", "__mix_epochs", "__mix_last", "__mix_times")


def schedule(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block of every reading."""
    own = only(docs, "doc_id", "source", "text")
    return apply(own, m).select(
        "doc_id", "source", F.expr(f"size({words()})").cast("long").alias("n_tokens"), F.col("__mix_epoch").alias("epoch"), F.col("__mix_block").alias("block")
    )
