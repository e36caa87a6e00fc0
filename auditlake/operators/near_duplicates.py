"""Near-duplicate texts of a site: shingle sets, exact Jaccard links, clusters.

Texts of equal content are one node. Pairs come from an inverted index over the rarest shingles of each set
(prefix filter), so that texts without a chance to reach the threshold never meet; the similarity is then taken on
the full sets. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import bucket_values, marked, released, scratch, written


def shingle_sets(texts: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """key, md5 of the text, set of shingles as hashes. Fewer than k tokens: the set of tokens."""
    own = texts.select(key, F.md5(F.coalesce(text, F.lit(""))).alias("md5"), F.expr(T.shingle_tokens(f"coalesce({text}, '')")).alias("tokens"))
    return own.select(key, "md5", F.expr(T.shingles("tokens", k)).alias("shingles"))


def exact_groups(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Texts that occur more than once: md5, copies, first key."""
    own = texts.select(F.md5(F.coalesce(text, F.lit(""))).alias("md5"), key)
    return own.groupBy("md5").agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")


def _rows(classes: DataFrame) -> DataFrame:
    """token, the token before it in the prefix (-1: none), id, at (size and position in one)."""
    tokens = "transform(prefix, (x, i) -> struct(x as token, if(i = 0, -1L, prefix[i - 1]) as prev))"
    row = classes.select("id", "n", F.posexplode_outer(F.expr(tokens)).alias("at", "t"))
    return row.select("t.token", "t.prev", "id", F.expr("shiftleft(cast(n as bigint), 32) | at").alias("at"))


def _test(percent: int) -> str:
    """Whether two rows of _rows(), a of the smaller set and b, can match and are the first of a run of common tokens."""
    na, nb, pa, pb = "shiftright(at_a, 32)", "shiftright(at_b, 32)", "(at_a & 4294967295L)", "(at_b & 4294967295L)"
    needed = f"(({percent} * ({na} + {nb}) + {99 + percent}) div {100 + percent})"
    return (
        f"({na} < {nb} or ({na} = {nb} and a < b)) and 100 * {na} >= {percent} * {nb}"
        f" and least({na} - {pa}, {nb} - {pb}) >= {needed}"
        # a's shorter prefix; b is named to keep the test above the exchange, which both sides share
        f" and {pa} < {na} - (2 * {percent} * {na} + {99 + percent}) div {100 + percent} + 1 + (at_b - at_b)"
        " and (prev_a <> prev_b or prev_a = -1)"
    )


def candidates(sets: DataFrame, key: str, percent: int, passes: int = 4, buckets: int = 1 << 16) -> DataFrame:
    """Pairs (a, b, na, nb) of representatives that pass the prefix, length and positional filters; na <= nb are their sizes.

    Shingles are ordered by the count of their hash bucket, then by hash: any order gives the same result, one by rarity
    fewer candidates. A pair that goes on from one common token to the next in both prefixes is taken at the first of
    them, where the filters leave the most room. One share of the tokens at a time bounds the exchange.
    """
    slot = f"cast(pmod(x, {buckets}) as int)"
    # explode() would have the sets made a second time, for a filter of the empty ones
    counts = sets.select(F.explode_outer("shingles").alias("x")).where("x is not null").groupBy(F.expr(slot).alias("b")).agg(F.count("*").alias("v"))
    table = written(counts.select("b", F.expr("least(v, 8388607L)").alias("v")), "rarity")
    order = f"transform(array(rarity), r -> sort_array(transform(shingles, x -> shiftleft(cast(r[{slot}] as bigint), 40) | shiftrightunsigned(x, 24))))[0]"
    own = sets.withColumn("rarity", bucket_values(table, buckets, "int"))
    own = own.select(F.unhex("md5").alias("md5"), F.col(key).alias("id"), F.size("shingles").alias("n"), F.expr(order).alias("o"))
    own = own.select("md5", F.struct("id", "n", F.expr(f"slice(o, 1, n * {100 - percent} div 100 + 1)").alias("prefix")).alias("c"))
    classes = written(own.groupBy("md5").agg(F.min("c").alias("c")).select("c.*").where("n > 0"), "prefixes")
    released(sets.sparkSession)
    row, found = _rows(classes), None
    for k in range(passes):
        part = row.where(f"pmod(token, {passes}) = {k}")
        left, right = part.toDF("token", "prev_a", "a", "at_a"), part.toDF("token", "prev_b", "b", "at_b")
        some = left.join(right, "token").where(_test(percent))
        some = written(some.selectExpr("a", "b", "cast(shiftright(at_a, 32) as int) as na", "cast(shiftright(at_b, 32) as int) as nb"), "pass")
        found = some if found is None else found.unionByName(some)
        released(sets.sparkSession)
    return found.distinct()


def similar(sets: DataFrame, key: str, percent: int = 80, most_passes: int = 16) -> DataFrame:
    """Pairs (a, b) of representatives, a < b, with shared and together, at a Jaccard similarity of percent / 100 or more.

    The full sets of the candidates alone are made again from the texts, and confirmed in as many passes as a set has
    pairs on average, so that what is exchanged at once stays near the size of the sets.
    """
    spark = sets.sparkSession
    with scratch(spark) as mine:
        pairs = written(candidates(sets, key, percent), "candidates")
        either = pairs.select(F.explode(F.expr("array(struct(a as id, na as n), struct(b as id, nb as n))")).alias("s")).select("s.*")
        wanted = written(either.distinct().withColumnRenamed("id", key), "wanted")
        again = sets.where(marked(wanted, f"xxhash64(`{key}`)")).join(wanted, key).where("size(shingles) = n")
        full = again.groupBy(key).agg(F.min(F.struct("md5", "shingles")).alias("s"))
        full = written(full.select(F.col(key).alias("id"), F.col("s.shingles").alias("h")), "sets")
        released(spark)
        sizes = pairs.agg(F.sum("na")).first()[0] or 0
        passes = min(most_passes, -(-sizes // max(1, wanted.agg(F.sum("n")).first()[0] or 0)) or 1)
        found = None
        for k in range(passes):
            some = pairs.where(f"pmod(xxhash64(a, b), {passes}) = {k}").select("a", "b")
            some = some.join(full.toDF("a", "ha"), "a").join(full.toDF("b", "hb"), "b")
            some = some.select("a", "b", F.expr("size(array_intersect(ha, hb))").alias("shared"), F.expr("size(ha) + size(hb)").alias("sizes"))
            some = some.selectExpr("least(a, b) as a", "greatest(a, b) as b", "shared", "sizes - shared as together")
            some = written(some.where(f"100 * shared >= {percent} * together"), "similar")
            mine.remove(some)
            found = some if found is None else found.unionByName(some)
            released(spark)
    return found


def clusters(sets: DataFrame, pairs: DataFrame, key: str, connect) -> DataFrame:
    """One row per cluster of two or more texts: its smallest key, size, largest similarity, and whether it holds equal texts."""
    of = sets.groupBy("md5").agg(F.min(key).alias("id"), F.count("*").alias("copies"))
    groups = connect(pairs.select("a", "b")).withColumnRenamed("component", "cluster")
    member = of.join(groups, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    best = pairs.join(groups.select(F.col("id").alias("a"), "cluster"), "a").groupBy("cluster").agg(F.max(F.expr(T.rounded("(shared / together)", 3))).alias("best"))
    by = member.groupBy("cluster").agg(F.sum("copies").alias("size"), F.max(F.col("copies") > 1).alias("exact")).where("size > 1")
    out = by.join(best, "cluster", "left")
    return out.select("cluster", "size", F.when(F.col("exact"), 1.0).otherwise(F.col("best")).alias("max_similarity"), "exact")
