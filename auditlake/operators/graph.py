"""Link-graph operators over edge tables (src, dst)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the checkpoint folder, that of the session if it names one."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="auditlake-"))
    return df.checkpoint(eager=True)


def closed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges between given nodes, without loops."""
    own = edges.where("src <> dst").join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return own.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, in_degree, out_degree over distinct edges without loops."""
    own = edges.where("src <> dst").select("src", "dst").distinct()
    into = own.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    out = own.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    return nodes.select("node").distinct().join(into, "node", "left").join(out, "node", "left").na.fill(0, ["in_degree", "out_degree"])


def inbound(edges: DataFrame) -> DataFrame:
    """Links to each target, repeats included, loops not."""
    return edges.where("src <> dst and dst <> ''").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inbound"))


def orphans(nodes: DataFrame, edges: DataFrame, home: DataFrame | None = None) -> DataFrame:
    """Nodes that no edge reaches, but for home."""
    found = nodes.select("node").distinct().join(inbound(edges).select("node"), "node", "left_anti")
    return found if home is None else found.join(home.select("node"), "node", "left_anti")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 40) -> DataFrame:
    """node, pagerank (5 decimals): uniform start, dangling mass spread evenly, normalised at the end.

    Ranks are cut from their lineage every round: each round reads them twice, so that uncut plans would double.
    Only the dangling mass, one number, reaches the driver.
    """
    own = nodes.select("node").distinct()
    links = closed(edges, own)
    out = links.groupBy("src").agg(F.count("*").alias("n"))
    links = cut(links.join(out, "src").select("src", "dst", (1 / F.col("n")).alias("share")))
    ends = own.join(out.select(F.col("src").alias("node"), F.lit(True).alias("linked")), "node", "left")
    ends = cut(ends.select("node", F.coalesce("linked", F.lit(False)).alias("linked")))
    total = ends.count()
    if not total:
        return own.withColumn("pagerank", F.lit(0.0))
    ranks = ends.withColumn("rank", F.lit(1.0 / total))
    for _ in range(iterations):
        lost = ranks.agg(F.sum(F.when(~F.col("linked"), F.col("rank")))).first()[0] or 0.0
        gained = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src")
        gained = gained.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("gain"))
        spread = (1 - damping) / total + damping / total * lost
        ranks = cut(
            ranks.drop("rank")
            .join(gained, "node", "left")
            .select("node", "linked", (F.lit(spread) + F.lit(damping) * F.coalesce("gain", F.lit(0.0))).alias("rank"))
        )
    whole = ranks.agg(F.sum("rank")).first()[0]
    return ranks.select("node", F.round(F.col("rank") / whole, 5).alias("pagerank"))


def reached(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, depth of everything at most `depth` links from start: the order in which a crawl would see pages."""
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        last = seen.where(F.col("depth") == level - 1).select(F.col("node").alias("src"))
        found = edges.join(last, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        if found.isEmpty():
            break
        seen = cut(seen.unionByName(found.withColumn("depth", F.lit(level))))
    return seen


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component): the smallest id reachable, by stars that shrink to one edge a node."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(down, F.col("u") == F.col("c"))
        now = cut(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before = mark


def trade_graph(spark: SparkSession, customer: DataFrame, orders: DataFrame, lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Edges between nations whose quantity is over 1.2 times the mean of all pairs: a graph with structure for link operators."""
    sold = (
        lineitem.select("l_orderkey", "l_suppkey", "l_quantity")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .where("c_nationkey <> s_nationkey")
        .groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
        .agg(F.sum("l_quantity").alias("q"))
    )
    return sold.where(F.col("q") > 1.2 * sold.agg(F.avg("q")).scalar()).select("src", "dst")
