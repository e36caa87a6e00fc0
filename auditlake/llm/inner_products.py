"""Exact top-k inner products over vectors in descending order of length.

Components are floor(scale * x) as integers, so that scores are exact. Vectors are ranged by length into blocks;
a rotation by the eigenvectors of the Gram matrix of all vectors (their right singular vectors) moves most of a
product into its first terms. Each block of queries first meets the block of the longest vectors, which gives
every query a k-th best score to beat. A block is then read only if its longest vector times some query's length
can reach that query's score, and inside it a candidate only lives on while its partial sum plus the
Cauchy-Schwarz bound of the residual can. Survivors get their exact integer product.

Defined cases: vectors that are null or empty, hold null or non-finite components or have a null vec_id take no
part; only vectors of equal dimension meet; a query's own vec_id is no candidate; equal scores go to the smaller
vec_id; repeated query rows answer once, repeated candidate rows are candidates each; an empty table gives no
rows; extra columns are ignored. Scores are exact while they fit 53 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import only, written

FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim, v (array of long), norm; only vectors that take part."""
    finite = "x is not null and not isnan(x) and abs(x) < double('infinity')"
    return (
        only(vectors, "vec_id", "embedding")
        .where(f"vec_id is not null and size(embedding) > 0 and forall(embedding, x -> {finite})")
        .select(
            "vec_id",
            F.expr("size(embedding)").alias("dim"),
            F.expr(f"transform(embedding, x -> cast(floor({scale}D * cast(x as double)) as long))").alias("v"),
        )
        .withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + cast(x as double) * x))"))
    )


def rotations(stored: DataFrame) -> dict[int, np.ndarray]:
    """Eigenvectors of each dimension's Gram matrix, largest first. dim * dim numbers a dimension reach the driver, however many vectors there are."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d)).column("v")
                m = own.flatten().to_numpy().astype(float).reshape(-1, d)
                sums[int(d)] = sums.get(int(d), 0) + m.T @ m
        for d, gram in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(gram), pa.list_(pa.float64()))],
                names=["dim", "i", "row"],
            )

    parts = stored.select("dim", "v").mapInArrow(partial, "dim int, i int, row array<double>")
    cells = parts.select("dim", "i", F.posexplode("row").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x"))
    grams: dict[int, np.ndarray] = {}
    for r in cells.collect():
        grams.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["i"], r["j"]] = r["x"]
    return {d: np.linalg.eigh((g + g.T) / 2)[1][:, ::-1].copy() for d, g in grams.items()}


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([x.flatten().to_numpy() for x in column.chunks]).reshape(len(column), -1)


def best(
    queries: tuple[np.ndarray, np.ndarray, np.ndarray],
    candidates: tuple[np.ndarray, np.ndarray],
    rotation: np.ndarray,
    k: int,
    step: int = 512,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, vec_id and score of the k best candidates of each query that reach its floor.

    queries: ids, integer vectors, floors; candidates: ids, integer vectors.
    """
    q_ids, q, floors = queries
    c_ids, c = candidates
    dim = q.shape[1]
    rotated_q, rotated_c = q @ rotation, c @ rotation
    q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    order = np.argsort(-c_norm, kind="stable")
    cuts = [h for h in (dim // 8, dim // 2) if h]
    rest = lambda m, h: np.linalg.norm(m[:, h:], axis=1)
    q_rest, c_rest = {h: rest(rotated_q, h) for h in cuts}, {h: rest(rotated_c, h) for h in cuts}
    floors = floors.astype(float).copy()
    slop = lambda a, b: 0.5 + 1e-9 * a * b  # noqa: E731  rounding of the bounds; scores are integers
    rows = vecs = scores = np.empty(0, np.int64)
    for low in range(0, len(order), step):
        own = order[low : low + step]
        longest = c_norm[own[0]]
        live = np.flatnonzero(q_norm * longest + slop(q_norm, longest) >= floors)
        if not len(live):
            break
        qi, ci = np.repeat(live, len(own)), np.tile(own, len(live))
        keep = q_ids[qi] != c_ids[ci]
        qi, ci = qi[keep], ci[keep]
        if cuts:
            h = cuts[0]
            part = (rotated_q[live, :h] @ rotated_c[own, :h].T).ravel()[keep]
            alive = part + q_rest[h][qi] * c_rest[h][ci] + slop(q_norm[qi], c_norm[ci]) >= floors[qi]
            qi, ci, part = qi[alive], ci[alive], part[alive]
            for g in cuts[1:]:
                part = part + np.einsum("ij,ij->i", rotated_q[qi, h:g], rotated_c[ci, h:g])
                alive = part + q_rest[g][qi] * c_rest[g][ci] + slop(q_norm[qi], c_norm[ci]) >= floors[qi]
                qi, ci, part, h = qi[alive], ci[alive], part[alive], g
        exact = np.einsum("ij,ij->i", q[qi], c[ci])
        rows, vecs, scores = np.r_[rows, qi], np.r_[vecs, c_ids[ci]], np.r_[scores, exact]
        ranked = np.lexsort((vecs, -scores, rows))
        rows, vecs, scores = rows[ranked], vecs[ranked], scores[ranked]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == k - 1
        floors[rows[last]] = np.maximum(floors[rows[last]], scores[last])
        keep = place < k
        rows, vecs, scores = rows[keep], vecs[keep], scores[keep]
    return rows, vecs, scores


def _matched(pairs_q: DataFrame, pairs_c: DataFrame, rotation, k: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            q, c = _matrix(left.column("q_v")), _matrix(right.column("c_v"))
            q_ids, c_ids = left.column("q_id").to_numpy(), right.column("c_id").to_numpy()
            floors = left.column("floor").to_numpy()
            rows, vecs, scores = best((q_ids, q, floors), (c_ids, c), rotation.value[q.shape[1]], k)
        else:
            q_ids = rows = vecs = scores = np.empty(0, np.int64)
        return pa.table({"query_id": q_ids[rows], "vec_id": vecs, "score": scores})

    # New names on either side: both may come from the same tables.
    left = pairs_q.toDF("q_dim", "q_q_block", "q_at", "q_id", "q_v", "floor")
    right = pairs_c.toDF("c_dim", "c_q_block", "c_at", "c_id", "c_v")
    return (
        left.groupBy("q_dim", "q_q_block", "q_at").cogroup(right.groupBy("c_dim", "c_q_block", "c_at")).applyInArrow(run, FOUND)
    )


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query (vec_id divisible by `every`)."""
    spark = vectors.sparkSession
    ship(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = integers(vectors, scale).repartitionByRange(parts, "dim", F.desc("norm"), "vec_id")
    ranged = ranged.sortWithinPartitions("dim", F.desc("norm"), "vec_id").withColumn("_at", F.monotonically_increasing_id())
    block = f"(shiftright(_at, 33) << 20) + (_at & 8589934591L) div {block_rows}"
    stored = written(ranged.withColumn("block", F.expr(block)).drop("_at"), "vectors")
    rotation = spark.sparkContext.broadcast(rotations(stored))
    queries = (
        stored.where(F.col("vec_id") % every == 0)
        .select("vec_id", "dim", "v", "norm", F.expr("block div 16").alias("q_block"))
        .distinct()
    )
    blocks = stored.groupBy("dim", "block").agg(F.max("norm").alias("longest"))
    first = blocks.groupBy("dim").agg(F.max_by("block", "longest").alias("block"))
    seed_q = queries.join(first, "dim").withColumn("floor", F.lit(-(2**62)))
    q_blocks = queries.select("dim", "q_block").distinct()
    seed_c = stored.join(q_blocks.join(first, "dim"), ["dim", "block"])
    columns = ["dim", "q_block", "block", "vec_id", "v"]
    seeds = _top(_matched(seed_q.select(*columns, "floor"), seed_c.select(*columns), rotation, k), k)
    floors = seeds.groupBy("query_id").agg(F.expr(f"case when count(*) = {k} then min(score) end").alias("floor"))
    asked = written(
        queries.join(floors, queries["vec_id"] == floors["query_id"], "left").select(
            "vec_id", "dim", "v", "norm", "q_block", F.coalesce("floor", F.lit(-(2**62))).alias("floor")
        ),
        "asked",
    )
    # The shortest length that can still reach some query's floor in a block of queries.
    needed = asked.groupBy("dim", "q_block").agg(
        F.min(F.expr("case when norm > 0 and floor > 0 then (floor - 1) / norm * 0.999999D else 0D end")).alias("needed")
    )
    pairs = needed.join(blocks, "dim").where("longest >= needed").select("dim", "q_block", "block")
    pairs_q = asked.join(pairs, ["dim", "q_block"]).select(*columns, "floor")
    pairs_c = stored.join(pairs, ["dim", "block"]).select(*columns)
    return _top(_matched(pairs_q, pairs_c, rotation, k), k).select("query_id", "rank", "vec_id", "score")
