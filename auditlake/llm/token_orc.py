"""Token-id output in ORC: one row a document, in ascending doc_id order over all files.

ORC's integer run-length encoding holds the ids; every file has row indexes and a Bloom filter on doc_id, so
that readers split by stripe and skip stripes and row groups that can't hold a wanted document.

Defined cases: a null or empty text is the end id alone; rows of equal doc_id (or null ids, which come first)
each keep a row, ordered by text; an empty table writes no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import fresh_path, only
from .tokens import encoder, shipped

STORED = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, stripe_mb: int = 16, partitions: int | None = None
) -> None:
    """Encodes every whole text and writes the ORC files. part numbers the files' ranges in ascending order."""
    spark = docs.sparkSession
    ship(spark)
    spec = shipped(spark.sparkContext, tokenizer)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, start = encoder(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                piece = batch.slice(low, 512)
                found = [code.stored(t, end_id) for t in piece.column(1).to_pylist()]
                sizes = np.array([len(x) // 4 for x in found], np.int64)
                ends = np.r_[0, np.cumsum(sizes)]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).cast(pa.int64()),
                        pa.array(np.full(len(sizes), part), pa.int32()),
                        pa.array(start + ends[:-1], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"))),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    count = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = only(docs, "doc_id", "text").repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encoded, STORED)
        .write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Filters on doc_id prune files, stripes and row groups."""
    stored = spark.read.schema(STORED).orc(path)
    # One row a file range: its size is the number of partitions written.
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select(
        F.col("part").alias("_part"),
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_before"),
    )
    return stored.join(F.broadcast(before), F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def digests(found: DataFrame) -> DataFrame:
    """Replaces ids by their count and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            cuts = list(zip(ends[:-1], ends[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("start"),
                    pa.array([int(b - a) for a, b in cuts], pa.int64()),
                    pa.array([zlib.crc32(flat[a:b]) for a, b in cuts], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return found.select("doc_id", "start", "ids").mapInArrow(
        digest, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs to the shared folder, and returns the digests of what the files hold."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-ids")
    write_ids(docs, path, tokenizer, end_id)
    return digests(read_ids(spark, path))
