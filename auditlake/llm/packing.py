"""Packing token ids into sequences by minimum bin slack.

Each document is encoded once; whole windows are cut off its front, and what is left has 1 to `window` ids. How
many pieces there are of each length is a table of at most `window` rows, on which the plan is made: fix the
longest length left, find by a bitset subset-sum the multiset of lengths that fills the rest of the window
best, trace back its counts, and use it as often as the stock allows. When no multiset comes within `slack` of
the window, the remaining pieces run on from one sequence into the next, cut at its end. A piece finds its
place from its length and its rank among pieces of that length, by arithmetic.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives
no rows; a null doc_id stays null; extra columns are ignored. Only the last sequence and those within `slack`
of the window are padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import marked, only, written
from .tokens import encoder, forget, shipped

PIECE = "part int, key long, doc_id long, start long, length int, doc_tokens long, local_rank long, crc long, ids binary"
PLACED = "part int, key long, doc_id long, start long, length long, doc_tokens long, crc long, sequence_id long, offset long, skip int"


@dataclass
class Plan:
    """keys: length << 40 | first rank, ascending; the other arrays go with them. The rest of a length runs on in the stream."""

    window: int
    keys: np.ndarray
    last: np.ndarray  # ranks end before it
    each: np.ndarray  # pieces of this length in a sequence
    sequence: np.ndarray
    offset: np.ndarray
    first_stream: int = 0  # sequence_id
    stream: dict[int, tuple[int, int]] = field(default_factory=dict)  # length -> first rank, first position


def best_fill(stock: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset out of stock whose sum is the largest up to room; ties go to longer lengths first.

    Bit s of the integer `reach` says that a sum s can be made. Counts are added in powers of two, each step is
    kept, and the steps are traced back from the best sum. The search ends as soon as the room can be filled.
    """
    reach, steps, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for n in lengths:
        if n > room:
            continue
        left, chunk = min(stock[n], room // n), 1
        while left:
            take = min(chunk, left)
            left -= take
            chunk <<= 1
            more = (reach | reach << (n * take)) & mask
            if more != reach:
                steps.append((reach, n, take))
                reach = more
            if reach & full:
                left = 0
        if reach & full:
            break
    total, counts = reach.bit_length() - 1, {}
    for before, n, take in reversed(steps):
        if not before >> total & 1:
            counts[n] = counts.get(n, 0) + take
            total -= n * take
    return counts


def plan(stock: dict[int, int], window: int, slack: int) -> Plan:
    """The driver's part: its work and size follow the number of lengths, not of pieces."""
    stock = {int(k): int(v) for k, v in stock.items() if v}
    used = dict.fromkeys(stock, 0)
    rows, sequence = [], 0
    lengths = sorted(stock, reverse=True)
    for longest in list(lengths):
        while stock[longest]:
            stock[longest] -= 1
            fill = best_fill(stock, [n for n in lengths if stock[n]], window - longest)
            stock[longest] += 1
            if window - longest - sum(n * c for n, c in fill.items()) > slack:
                break
            fill[longest] = fill.get(longest, 0) + 1
            times, at = min(stock[n] // c for n, c in fill.items()), 0
            for n in sorted(fill, reverse=True):
                rows.append((n, used[n], used[n] + times * fill[n], fill[n], sequence, at))
                used[n] += times * fill[n]
                stock[n] -= times * fill[n]
                at += n * fill[n]
            sequence += times
    rows.sort()
    column = lambda k: np.array([r[k] for r in rows], dtype=np.int64)
    position, stream = 0, {}
    for n in lengths:
        stream[n] = (used[n], position)
        position += n * stock[n]
    return Plan(window, (column(0) << 40) | column(1), column(2), column(3), column(4), column(5), sequence, stream)


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """Windows and remainders with their ids. local_rank counts the pieces of a length in a partition."""
    ship(docs.sparkSession)
    spec = shipped(docs.sparkSession.sparkContext, tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, key, ranks = encoder(spec.value), TaskContext.get().partitionId(), 0, {}
        kind = "<u2" if code.size <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                rows = []
                some = batch.slice(low, 512)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = code.ids(text, end_id)
                    for start in range(0, len(ids), window):
                        own = ids[start : start + window]
                        n = len(own)
                        rows.append((part, key, doc_id, start, n, len(ids), ranks.get(n, 0), zlib.crc32(own.tobytes()), own.astype(kind).tobytes()))
                        ranks[n] = ranks.get(n, 0) + 1
                        key += 1
                yield _batch(rows, PIECE)

    return only(docs, "doc_id", "text").mapInArrow(cut, PIECE)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), _ARROW[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names]
    )


def place(found: Plan, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with length and rank -> rows with sequence and offset; a piece cut at the end of a sequence gives two."""
    n, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
    at = np.searchsorted(found.keys, n << 40 | rank, side="right") - 1
    near = np.maximum(at, 0)
    if len(found.keys):
        first = found.keys[near]
        fits = (at >= 0) & (first >> 40 == n) & (rank < found.last[near])
        within = rank - (first & ((1 << 40) - 1))
        sequence = found.sequence[near] + within // found.each[near]
        offset = found.offset[near] + within % found.each[near] * n
    else:
        fits, sequence, offset = np.zeros(len(n), bool), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    size, skip = n.copy(), np.zeros(len(n), np.int32)
    lengths, inverse = np.unique(n, return_inverse=True)
    base = np.array([found.stream[int(x)] for x in lengths], dtype=np.int64).reshape(-1, 2)
    position = base[inverse, 1] + (rank - base[inverse, 0]) * n
    sequence = np.where(fits, sequence, found.first_stream + position // found.window)
    offset = np.where(fits, offset, position % found.window)
    over = np.where(fits, 0, np.maximum(0, offset + n - found.window))
    size -= over
    rows = np.concatenate([np.arange(len(n)), np.flatnonzero(over)])
    extra = np.arange(len(rows)) >= len(n)
    take = pa.array(rows)
    start = batch.column("start").to_numpy()[rows] + np.where(extra, size[rows], 0)
    out = [
        batch.column("part").take(take),
        batch.column("key").take(take),
        batch.column("doc_id").take(take),
        pa.array(start, pa.int64()),
        pa.array(np.where(extra, over[rows], size[rows]), pa.int64()),
        batch.column("doc_tokens").take(take),
        pa.array(batch.column("crc").to_numpy()[rows], pa.int64(), mask=over[rows] > 0),
        pa.array(sequence[rows] + extra, pa.int64()),
        pa.array(np.where(extra, 0, offset[rows]), pa.int64()),
        pa.array(np.where(extra, size[rows], skip[rows]).astype(np.int32), pa.int32()),
    ]
    yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in PLACED.split(", ")])


@dataclass
class Packed:
    placed: DataFrame  # part, key, doc_id, start, length, doc_tokens, crc, sequence_id, offset, skip
    pieces: DataFrame  # part, key, ids, ...: the ids of a placed row are pieces' ids from skip on


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, slack: int = 4) -> Packed:
    stored = written(pieces(docs, tokenizer, window, end_id), "pieces")
    counts = stored.groupBy("length", "part").agg(F.count("*").alias("n"))
    # At most `window` rows reach the driver.
    stock = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = plan(stock, window, slack)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    base = counts.select(F.col("length").alias("_length"), F.col("part").alias("_part"), before.alias("_before"))
    ranked = (
        stored.drop("ids")
        .join(base, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part")))
        .withColumn("rank", F.col("_before") + F.col("local_rank"))
        .select("part", "key", "doc_id", "start", "length", "doc_tokens", "crc", "rank")
    )

    def placing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            yield from place(shared.value, batch)

    return Packed(ranked.mapInArrow(placing, PLACED), stored)


def digests(packed: Packed) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    columns = ["doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    placed = written(packed.placed, "placed")
    cut = placed.where("crc is null").select(F.col("part").alias("_part"), F.col("key").alias("_key"), *placed.columns)
    # Few pieces are cut: only theirs, and those that a sketch takes for theirs, bring their ids along.
    own = packed.pieces.select("part", "key", "ids", F.col("length").alias("whole")).where(marked(cut, "xxhash64(part, key)"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{len(r['ids']) // r['whole']}")[r["skip"] : r["skip"] + r["length"]]
                rows.append((r["doc_id"], r["start"], r["length"], zlib.crc32(ids.astype("<u4").tobytes()), r["doc_tokens"], r["sequence_id"], r["offset"]))
            yield _batch(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

    joined = cut.drop("part", "key").join(own, (F.col("_part") == own["part"]) & (F.col("_key") == own["key"]))
    mended = joined.select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "skip", "ids", "whole"
    ).mapInArrow(
        summed,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
    return placed.where("crc is not null").select(*columns).unionByName(mended)
