"""Repeated passages by collinear chaining.

Texts become words (A-Z read as a-z). Of every `w` neighbouring k-word windows the one of the smallest hash is a
seed, so that equal passages of w + k - 1 words share one, whatever surrounds them. A seed that several documents
hold is joined with its first place, by doc_id and position; so a place gives one row, however common it is. So is every
two neighbouring seeds at their distance: where a passage's seeds come earlier in other documents, one by one, the pairs
across them lead to the document that holds them together, and their pieces overlap by a seed. Windows of min_words
words whose seeds are all shared, but which no passage found so far holds, are looked up whole, so that no passage that
is equal word for word depends on who holds its seeds first. In each
later document, matches with one earlier document are chained in order, each adding k and paying a cost for the
words it skips on either side; a Fenwick tree over the earlier document's positions finds the best chain to go on
from. Chains are aligned word by word: between seeds by edit distance, outwards along the diagonal until
mismatches outweigh matches. What is left long and alike enough is a passage; those that overlap by k words are one.
Documents of equal word sequences are one from the start: the later ones are passages as a whole.

Defined cases: a null, empty or wordless text has no passages; texts of fewer than k words match only as whole
copies, of at least min_words; repeats inside one document aren't looked for; a row without doc_id, or with one that isn't a whole number, takes no part;
rows of one doc_id are taken in the order of their texts' prints, and the first one's words stand for the id's
passages; an empty table gives no rows; extra columns are ignored. No seed is too common to be followed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import marked, only, written
from .shingles import windows, word_hashes


@dataclass(frozen=True)
class Passages:
    k: int = 7
    w: int = 20
    min_words: int = 50
    gap_cost: float = 0.05  # a word skipped on either side; k / (2 * gap_cost) words end a chain
    margin: int = 64  # words looked at beyond a chain's ends
    drop: int = 8  # an extension ends this far below its best score; a match adds 1, a mismatch takes 2
    min_identity: float = 0.8


def seeds(words: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the minimizers of a text's k-word windows; ties go to the first."""
    n = len(words) - k + 1
    if n < 1:
        return words[:0], np.empty(0, np.int64)
    h = windows(words, k)
    # The hash's upper bits over the position, which it ends in: the least of a window by doubling.
    bits = np.uint64(n.bit_length())
    least = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    size = 1
    while size < min(w, n):
        step = min(size, min(w, n) - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]]  # ascending
    return h[at], at


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, kind))


def seeded(docs: DataFrame, p: Passages) -> DataFrame:
    """doc_id, print (of the words), n (words), hashes and positions of the seeds."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                prints, sizes, hashes, places = [], [], [], []
                for text in some.column(1).to_pylist():
                    words = word_hashes(text)
                    prints.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                    sizes.append(len(words))
                    h, at = seeds(words, p.k, p.w)
                    hashes.append(h.view(np.int64))
                    places.append(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), _lists(hashes, pa.int64()), _lists(places, pa.int32())],
                    names=["doc_id", "print", "n", "hashes", "places"],
                )

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id long, print binary, n int, hashes array<long>, places array<int>").where("n > 0")


def chained(x: np.ndarray, y: np.ndarray, k: int, cost: float) -> list[np.ndarray]:
    """Index arrays of the best disjoint chains of matches (x, y), x ascending; ties go to the earlier match."""
    order = np.lexsort((-y, x))
    ranks = np.searchsorted(np.unique(y), y) + 1
    size = int(ranks.max()) if len(y) else 0
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, before = np.zeros(len(x)), np.full(len(x), -1)
    for i in order:
        i = int(i)
        r, best = int(ranks[i]) - 1, (-1e18, -1)
        while r > 0:
            if tree[r][0] > best[0]:
                best = tree[r]
            r -= r & -r
        gain = best[0] - cost * (x[i] + y[i])
        score[i] = k + max(0.0, gain)
        if gain > 0:
            before[i] = best[1]
        entry, r = (score[i] + cost * (x[i] + y[i]), i), int(ranks[i])
        while r <= size:
            if entry[0] > tree[r][0]:
                tree[r] = entry
            r += r & -r
    used, out = np.zeros(len(x), bool), []
    for i in np.lexsort((np.arange(len(x)), -score)):
        chain, at = [], int(i)
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(at)
            at = int(before[at])
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def _whole_documents(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The columns of batches, which are sorted by the first one, cut between two values of it."""
    held: list[list[np.ndarray]] = []  # the last document's rows, which may go on in the next batch
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        if not len(cols[0]):
            continue
        cut = int(np.flatnonzero(np.r_[True, np.diff(cols[0]) != 0])[-1])
        if held and held[-1][0][-1] != cols[0][0]:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        if cut:
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols], strict=True)]
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def chains(anchors: DataFrame, p: Passages) -> DataFrame:
    """Rows (doc, src, pos, src_pos), dealt by doc and sorted -> chains with their positions on either side.

    A passage of min_words has two seeds; matches without another one of any source that near are left out.
    """

    def of(doc: np.ndarray, src: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole documents."""
        same = np.diff(doc) == 0
        other = np.r_[True, ~same | (np.diff(src) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)]  # a seed and its pairs give equal rows
        doc, src, x, y = doc[other], src[other], x[other].astype(np.int64), y[other].astype(np.int64)
        near = (np.diff(x) <= p.min_words) & (np.diff(doc) == 0)
        keep = np.r_[near, False] | np.r_[False, near]
        doc, src, x, y = doc[keep], src[keep], x[keep], y[keep]
        if not len(doc):
            return
        order = np.lexsort((src, doc))
        doc, src, x, y = doc[order], src[order], x[order], y[order]
        first = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(src) != 0)])
        sizes = np.diff(np.r_[first, len(doc)])
        # Matches on one diagonal, each less than a match's worth of cost after the last, are one chain, the best there is.
        step = np.diff(x)
        apart = np.r_[False, (step != np.diff(y)) | (step < 1) | (2 * p.gap_cost * step > p.k - 0.01)]
        apart[first] = False
        straight = np.add.reduceat(apart.astype(np.int64), first) == 0
        rows = np.repeat(straight, sizes)
        yield flush(doc[first[straight]], src[first[straight]], sizes[straight], x[rows], y[rows])
        some: list = []
        for a, n in zip(first[~straight], sizes[~straight], strict=True):
            for c in chained(x[a : a + n], y[a : a + n], p.k, p.gap_cost):
                some.append((doc[a], src[a], len(c), x[a : a + n][c], y[a : a + n][c]))
        if some:
            docs, srcs, lengths, xs, ys = zip(*some, strict=True)
            yield flush(np.array(docs), np.array(srcs), np.array(lengths), np.concatenate(xs), np.concatenate(ys))

    def flush(doc: np.ndarray, src: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (x, y)]
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(src, pa.int64()), *lists], names=["doc", "src", "xs", "ys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_documents(batches, ("doc", "src", "pos", "src_pos")):
            yield from of(*cols)

    dealt = anchors.repartition("doc").sortWithinPartitions("doc", "pos", "src", "src_pos")
    return dealt.mapInArrow(run, "doc long, src long, xs array<int>, ys array<int>")


def _extension(a: np.ndarray, b: np.ndarray, drop: int) -> tuple[int, int]:
    """Words to go on along the diagonal, and the matches among them."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    equal = a[:n] == b[:n]
    score = np.cumsum(np.where(equal, 1, -2))
    low = np.maximum.accumulate(np.maximum(score, 0)) - score > drop
    end = int(low.argmax()) if low.any() else n
    if not end:
        return 0, 0
    best = int(score[:end].argmax())
    if score[best] <= 0:
        return 0, 0
    return best + 1, int(equal[: best + 1].sum())


def _matched(a: np.ndarray, b: np.ndarray) -> int:
    """Words on the best alignment of two short stretches."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    row = np.zeros(len(b) + 1, np.int64)
    for v in a:
        hit = np.where(b == v, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], hit))
    return int(row[-1])


def aligned(x: list[int], y: list[int], a: np.ndarray, b: np.ndarray, a0: int, b0: int, p: Passages):
    """Ends of the passage on either side and its matched words, or nothing if too little is alike. a, b: words from a0, b0 on."""
    matches, ex, ey = 0, x[0], y[0]
    for i, j in zip(x, y, strict=True):
        if i >= ex and j >= ey:
            matches += _matched(a[ex - a0 : i - a0], b[ey - b0 : j - b0]) + p.k
        else:  # overlaps the seed before it
            matches += min(i + p.k - ex, j + p.k - ey) if min(i + p.k - ex, j + p.k - ey) > 0 else 0
        ex, ey = max(ex, i + p.k), max(ey, j + p.k)
    left, found = _extension(a[: x[0] - a0][::-1], b[: y[0] - b0][::-1], p.drop)
    right, more = _extension(a[ex - a0 :], b[ey - b0 :], p.drop)
    matches += found + more
    start, end, src_start, src_end = x[0] - left, ex + right, y[0] - left, ey + right
    if matches < p.min_identity * max(end - start, src_end - src_start):
        return None
    return start, end, src_start, src_end, matches


def _extensions(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, n: np.ndarray, way: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """_extension() for many stretches of at most n words from at_a and at_b on, forwards or backwards."""
    step = np.arange(int(n.max(initial=0)))
    if not len(step):
        return np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    valid = step < n[:, None]
    equal = valid & (a[np.where(valid, at_a[:, None] + way * step, 0)] == b[np.where(valid, at_b[:, None] + way * step, 0)])
    score = np.cumsum(np.where(equal, 1, -2), axis=1, dtype=np.int32)
    low = valid & (np.maximum.accumulate(np.maximum(score, 0), axis=1) - score > drop)
    end = np.where(low.any(axis=1), low.argmax(axis=1), n)
    score[step >= end[:, None]] = -(1 << 30)
    best = score.argmax(axis=1)
    most = score[np.arange(len(n)), best].astype(np.int64)
    found = np.where(most > 0, best + 1, 0)
    return found, np.where(most > 0, (most + 2 * found) // 3, 0)  # a match adds 1, a mismatch takes 2


def _aligned_rows(batch: pa.RecordBatch, p: Passages) -> pa.RecordBatch:
    """aligned() for a batch of chains: at once where a chain's words are the same on either side, one by one elsewhere."""
    doc, src, a0, b0 = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "src", "a0", "b0"))
    parts = [(x.values.to_numpy(), x.offsets.to_numpy().astype(np.int64)) for x in (batch.column(c) for c in ("xs", "ys", "a", "b"))]
    (xs, ends), (ys, ends_y), (a, ends_a), (b, ends_b) = parts
    x0, y0, x1, y1 = xs[ends[:-1]].astype(np.int64), ys[ends_y[:-1]].astype(np.int64), xs[ends[1:] - 1].astype(np.int64), ys[ends_y[1:] - 1].astype(np.int64)
    size = x1 + p.k - x0
    at_a, at_b = ends_a[:-1] + x0 - a0, ends_b[:-1] + y0 - b0
    # chains on one diagonal
    off = xs[ends[0] : ends[-1]].astype(np.int64) - ys[ends_y[0] : ends_y[-1]]
    same = np.add.reduceat((off != np.repeat(x0 - y0, np.diff(ends))).astype(np.int64), ends[:-1] - ends[0]) == 0
    short = np.flatnonzero(same & (size <= 256))
    if len(short):
        starts = np.r_[0, np.cumsum(size[short])]
        within = np.arange(starts[-1]) - np.repeat(starts[:-1], size[short])
        differ = a[np.repeat(at_a[short], size[short]) + within] != b[np.repeat(at_b[short], size[short]) + within]
        same[short] = np.add.reduceat(differ.astype(np.int64), starts[:-1]) == 0
    for k in np.flatnonzero(same & (size > 256)):
        same[k] = np.array_equal(a[at_a[k] : at_a[k] + size[k]], b[at_b[k] : at_b[k] + size[k]])
    some = np.flatnonzero(same)
    room = np.minimum(x0 - a0, y0 - b0)[some]
    left, found = _extensions(a, b, at_a[some] - 1, at_b[some] - 1, room, -1, p.drop)
    after_a, after_b = (at_a + size)[some], (at_b + size)[some]
    right, more = _extensions(a, b, after_a, after_b, np.minimum(ends_a[1:][some] - after_a, ends_b[1:][some] - after_b), 1, p.drop)
    matches, length = size[some] + found + more, size[some] + left + right
    columns = [doc[some], x0[some] - left, x0[some] - left + length, src[some], y0[some] - left, y0[some] - left + length, matches]
    columns = [c[matches >= p.min_identity * length] for c in columns]
    rest = []
    for k in np.flatnonzero(~same):
        got = aligned(xs[ends[k] : ends[k + 1]].tolist(), ys[ends_y[k] : ends_y[k + 1]].tolist(), a[ends_a[k] : ends_a[k + 1]], b[ends_b[k] : ends_b[k + 1]], int(a0[k]), int(b0[k]), p)
        if got:
            rest.append((doc[k], got[0], got[1], src[k], got[2], got[3], got[4]))
    if rest:
        columns = [np.r_[c, np.array(r, np.int64)] for c, r in zip(columns, zip(*rest, strict=True), strict=True)]
    return _rows(columns, ALIGNED)


ALIGNED = "doc long, start int, end int, src long, src_start int, src_end int, matches int"


def _rows(columns: list, schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def alignments(found: DataFrame, words: DataFrame, p: Passages) -> DataFrame:
    """Chains with only the stretches of words around them -> aligned passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                yield _aligned_rows(batch.slice(low, 2048), p)

    cut = lambda at, ends: F.expr(
        f"slice(words, {at} + 1, element_at({ends}, -1) + {p.k + p.margin} - {at})"
    )
    first = lambda ends: F.expr(f"greatest({ends}[0] - {p.margin}, 0)")
    src = words.select(F.col("doc").alias("src"), "words")
    one = found.withColumn("b0", first("ys")).join(src, "src").withColumn("b", cut("b0", "ys")).drop("words")
    both = one.withColumn("a0", first("xs")).join(words, "doc").withColumn("a", cut("a0", "xs")).drop("words")
    return both.select("doc", "src", "xs", "ys", "a0", "b0", "a", "b").mapInArrow(run, ALIGNED)


def merged(found: DataFrame, p: Passages) -> DataFrame:
    """Passages of a document that overlap by k words as one, with the longest one's source; only long ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, start, end, src, src_start, src_end, _ in _whole_documents(batches, tuple(x.split()[0] for x in ALIGNED.split(", "))):
            # the furthest end so far in a document: documents are told apart by the upper bits
            rank = np.cumsum(np.r_[0, np.diff(doc) != 0]) << 32
            far = np.maximum.accumulate(rank + end)
            new = np.r_[True, (rank + start)[1:] > far[:-1] - p.k]
            first = np.flatnonzero(new | np.r_[True, np.diff(rank) != 0])
            last = np.r_[first[1:], len(doc)] - 1
            length = (far[last] - rank[last]) - start[first]
            out = []
            for a, z, n in zip(*(v[length >= p.min_words].tolist() for v in (first, last + 1, length)), strict=True):
                best = min(range(a, z), key=lambda r: (start[r] - end[r], src[r], src_start[r]))
                out.append((doc[a], start[a], start[a] + n, n, src[best], src_start[best], src_end[best], len(np.unique(src[a:z]))))
            yield _rows(list(zip(*out, strict=True)) if out else [[]] * 8, MERGED)

    dealt = found.repartition("doc").sortWithinPartitions("doc", "start", "end", "src", "src_start")
    return dealt.mapInArrow(run, MERGED)


MERGED = "doc_id long, start int, end int, n_words int, source_id long, source_start int, source_end int, n_sources int"


def repeated(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """Per passage that an earlier document holds: doc_id, its words [start, end), the source and its words, and the number of sources it was pieced together from."""
    own = written(seeded(docs, p), "seeds")
    firsts = own.groupBy("print").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"))
    firsts = written(firsts, "firsts")
    copies = own.select("doc_id", "print").join(firsts, "print").where(f"doc_id <> first and n >= {p.min_words}")
    copies = copies.select(
        "doc_id",
        F.lit(0).alias("start"),
        F.col("n").alias("end"),
        F.col("n").alias("n_words"),
        F.col("first").alias("source_id"),
        F.lit(0).alias("source_start"),
        F.col("n").alias("source_end"),
        F.lit(1).alias("n_sources"),
    ).distinct()
    # one row an id: of several texts under it, that of the least print
    texts = firsts.groupBy(F.col("first").alias("doc")).agg(F.min("print").alias("print"))
    chosen = own.join(texts, (own["doc_id"] == texts["doc"]) & (own["print"] == texts["print"]), "left_semi").dropDuplicates(["doc_id"])
    span = "places[i + 1] - places[i]"
    one = "transform(hashes, (h, i) -> struct(h as hash, places[i] as pos, 0 as span))"
    two = f"transform(slice(hashes, 1, greatest(size(hashes) - 1, 0)), (h, i) -> struct(xxhash64(h, hashes[i + 1], {span}) as hash, places[i] as pos, {span} as span))"
    flat = chosen.select(F.col("doc_id").alias("doc"), F.expr(f"explode(concat({one}, {two}))").alias("s"))
    flat = written(flat.select("s.hash", "doc", "s.pos", "s.span"), "flat")
    place = F.struct("doc", "pos")
    shared = flat.groupBy("hash").agg(F.min(place).alias("f"), F.max("doc").alias("last")).where("last > f.doc")
    shared = shared.select("hash", F.col("f.doc").alias("src"), F.col("f.pos").alias("src_pos"))
    held = flat.join(shared, "hash").where("doc <> src").select("doc", "src", "pos", "src_pos", "span")
    held = written(held, "anchors")
    anchors = held.select("doc", "src", "pos", "src_pos", F.expr("explode(if(span = 0, array(0), array(0, span)))").alias("off"))
    anchors = anchors.select("doc", "src", F.expr("pos + off").alias("pos"), F.expr("src_pos + off").alias("src_pos"))
    found = written(chains(anchors, p), "chains")
    near = written(_aligned(docs, found, texts, p), "aligned")
    once = written(merged(near, p), "merged")
    hashes = _open_seeds(own, held, once, texts, p)
    # Chains inside a passage of the first round add nothing to it.
    inside = once.select(F.col("doc_id").alias("_doc"), "start", "end")
    within = (F.col("doc") == F.col("_doc")) & F.expr(f"start <= xs[0] and element_at(xs, -1) + {p.k} <= end")
    whole = written(_whole_windows(docs, flat, hashes, texts, p).join(inside, within, "left_anti"), "whole")
    more = written(_aligned(docs, whole, texts, p), "aligned")
    again = written(more.select("doc").distinct(), "again")
    rest = once.join(again, once["doc_id"] == again["doc"], "left_anti")
    anew = merged(near.join(again, "doc", "left_semi").unionByName(more), p)
    return rest.unionByName(anew).unionByName(copies)


def _aligned(docs: DataFrame, found: DataFrame, texts: DataFrame, p: Passages) -> DataFrame:
    """The written chains as aligned passages, over the words of the documents that they name."""
    wanted = found.select("doc").unionByName(found.select(F.col("src").alias("doc"))).distinct()
    words = _words(docs, written(wanted.join(texts, "doc"), "wanted"), p)
    return alignments(found, words, p)


def open_starts(n: int, h: np.ndarray, at: np.ndarray, shared: np.ndarray, spans: list[tuple[int, int]], p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the min_words windows of a text of n words that no span holds and whose seeds are all shared, and the first seed of each.

    h, at: all seeds of the text; shared: whether an earlier document holds them. Whoever holds a window holds the
    seeds that its words alone decide, so that a window with one that isn't shared is in no earlier document.
    """
    count = n - p.min_words + 1
    if count < 1 or not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = n - p.k + 1
    bits = np.uint64(grams.bit_length())
    upper = h.view(np.uint64) >> bits
    # A seed stands for the windows of w k-word windows from low to high: from where it comes in, if it is smaller than the one before, else from where that one drops out.
    low = np.r_[0, np.where(upper[1:] < upper[:-1], at[1:] - p.w + 1, at[:-1] + 1)]
    high = np.r_[low[1:] - 1, max(0, grams - p.w)]
    own = max(1, p.min_words - p.k - p.w + 2)  # windows of w k-word windows inside one of min_words words
    change = np.zeros(count + 1, np.int64)
    for first, last in ((low[~shared] - own + 1, high[~shared]), (np.array([s for s, _ in spans], np.int64), np.array([e for _, e in spans], np.int64) - p.min_words)):
        some = (last >= first) & (first < count) & (last >= 0)
        np.add.at(change, np.maximum(first[some], 0), 1)
        np.add.at(change, np.minimum(last[some] + 1, count), -1)
    starts = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return starts, np.searchsorted(low, starts, "right") - 1


def _open_seeds(own: DataFrame, held: DataFrame, once: DataFrame, texts: DataFrame, p: Passages) -> DataFrame:
    """The hashes (hash) of seeds around which windows have to be looked up: those of open_starts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty(0, np.int64)]
            lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(x) for x in ("hashes", "places", "shared"))]
            for k, (n, spans) in enumerate(zip(batch.column("n").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                h, at, shared = (flat[ends[k] : ends[k + 1]] for flat, ends in lists)
                at = at.astype(np.int64)
                out.append(h[np.unique(open_starts(n, h, at, np.isin(at, shared), [(x["start"], x["end"]) for x in spans or ()], p)[1])])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)), pa.int64())], names=["hash"])

    shared = held.where("span = 0").groupBy("doc").agg(F.collect_set("pos").alias("shared"))
    spans = once.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    seeds_of = own.where(f"n >= {p.min_words}").select(F.col("doc_id").alias("doc"), "print", "n", "hashes", "places")
    rows = shared.join(spans, "doc", "left").join(texts, "doc").join(seeds_of, ["doc", "print"]).select("n", "hashes", "places", "shared", "spans")
    return written(rows.mapInArrow(run, "hash long").distinct(), "open")


def _whole_windows(docs: DataFrame, flat: DataFrame, hashes: DataFrame, texts: DataFrame, p: Passages, passes: int = 4) -> DataFrame:
    """Chains (doc, src, xs, ys) of windows of min_words words that an earlier document holds word for word, whatever holds their seeds first.

    Such a window has a seed among its first w, which both documents have at the same place in it. So the windows around
    the seeds of the written hashes are looked up by their own hash. One share of the windows at a time bounds the exchange.
    """
    ship(docs.sparkSession)
    size, back = p.min_words, min(p.w - 1, p.min_words - p.k)
    single = flat.where("span = 0").where(marked(hashes, "hash")).select("hash", "doc", "pos")
    places = single.join(hashes, "hash", "left_semi").groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    places = written(places.join(texts, "doc"), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                ids, keys, starts = [], [], []
                for doc, text, own, at in zip(*(some.column(c).to_pylist() for c in ("doc", "text", "print", "places")), strict=True):
                    words = word_hashes(text)
                    if len(words) < size or hashlib.blake2b(words.tobytes(), digest_size=16).digest() != own:
                        continue
                    mark = np.zeros(len(words) - size + 1, bool)
                    for k in at:
                        mark[max(0, k - back) : k + 1] = True
                    at = np.flatnonzero(mark)
                    ids.append(np.full(len(at), doc, np.int64))
                    keys.append(windows(words, size)[at].view(np.int64))
                    starts.append(at.astype(np.int32))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, starts)], names=["key", "doc", "at"])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").try_cast("long").alias("doc"), "text").where("doc is not null and text is not null")
    rows = rows.where(marked(places, "doc")).join(places, "doc").select("doc", "text", "print", "places")
    every = written(rows.mapInArrow(run, "key long, doc long, at int"), "windows")
    out = None
    for k in range(passes):
        part = every.where(f"pmod(key, {passes}) = {k}")
        first = part.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("f"), F.max("doc").alias("last")).where("last > f.doc")
        hit = part.join(first.select("key", F.col("f.doc").alias("src"), F.col("f.at").alias("src_at")), "key").where("doc <> src")
        hit = written(hit.select("doc", "src", "at", "src_at"), "hits")
        out = hit if out is None else out.unionByName(hit)
    # neighbouring windows of one source and distance are one chain
    by = Window.partitionBy("doc", "src", "apart").orderBy("at")
    runs = out.distinct().withColumn("apart", F.expr("at - src_at")).withColumn("run", F.col("at") - F.row_number().over(by))
    runs = runs.groupBy("doc", "src", "apart", "run").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    ends = f"array(low, high + {size - p.k})"
    return runs.select("doc", "src", F.expr(ends).alias("xs"), F.expr(f"transform({ends}, x -> cast(x - apart as int))").alias("ys"))


def _words(docs: DataFrame, wanted: DataFrame, p: Passages) -> DataFrame:
    """doc, words (32-bit hashes) of the wanted (doc, print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                all_words = [word_hashes(t) for t in some.column(1).to_pylist()]
                prints = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in all_words]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(prints, pa.binary()), _lists([(x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in all_words], pa.int32())],
                    names=["doc", "own", "words"],
                )

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").try_cast("long").alias("doc"), "text")
    rows = rows.where("doc is not null and text is not null").where(marked(wanted, "doc"))
    found = rows.mapInArrow(run, "doc long, own binary, words array<int>")
    exact = found.join(wanted.toDF("_doc", "_print"), (F.col("doc") == F.col("_doc")) & (F.col("own") == F.col("_print")))
    return written(exact.select("doc", "words").dropDuplicates(["doc"]), "words")


def trimmed(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """doc_id, text of every document without its repeated passages; white space around the rest stays as it is."""
    import re

    spans = repeated(docs, p).groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = only(docs, "doc_id", "text").join(spans, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "spans")
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text and own:
                    at = [m.span() for m in word.finditer(text)]
                    for s in reversed(own):
                        if s["end"] <= len(at):
                            text = text[: at[s["start"]][0]] + text[at[s["end"] - 1][1] :]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return joined.mapInArrow(run, "doc_id long, text string")
