"""Near duplicates by a chosen-path set similarity join.

Documents with equal shingle sets are one node from here on. Each of `trees` independent trees branches the
nodes by their minwise token; a pair at the threshold shares a first branch of some tree with probability
1 - (1 - threshold) ** trees. In each branch the member of the smallest id is compared with every other on the
full sets, and the links found are joined into components. A branch that lies in one component is settled. In any
other, members of the leader's component only need comparing further if a member outside lies close enough, by the
triangle inequality of the Jaccard distance. What is left is compared exhaustively across components where it is
small, by sketches and then on the full sets inside a task, and branches again by `branches` more minwise tokens where
it isn't (a pair survives a level with probability 1 - (1 - threshold) ** branches in each tree, while pairs under
1 / branches thin out). Past `depth` levels a branch is compared exhaustively, as pairs of blocks of bounded size. So
a large branch of near copies costs a star and is settled; none is gathered in a task, capped or sampled.

Before sets are fetched, two bits of each of `width` minwise tokens must agree for enough tokens: a pair at the
threshold fails that with probability under `miss`.

Defined cases: a null, empty or wordless text has an empty set, linked with nothing; fewer than k words are one
shingle; repeated rows and equal texts share a component; rows of one doc_id with different texts join their
components; a row without doc_id, or with one that isn't a whole number, takes no part, has a null component and is
kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, marked, only, released, scratch, without, written
from .components import connected
from .shingles import shingle_set


@dataclass(frozen=True)
class Join:
    k: int = 5
    percent: int = 75  # Jaccard threshold
    trees: int = 14
    branches: int = 3
    depth: int = 6
    small: int = 4096  # members of a branch that are compared exhaustively
    block_rows: int = 8192  # of a branch in one task, and shingles of their sets
    block_shingles: int = 1 << 21
    width: int = 64
    miss: float = 1e-5  # of a pair at the threshold, by the sketches

    def most_apart(self) -> int:
        """Tokens whose two sketch bits may differ; each differs with 0.75 * (1 - similarity)."""
        p, n, total = 0.75 * (1 - self.percent / 100), self.sketched(), 0.0
        for m in range(n + 1):
            total += comb(n, m) * p**m * (1 - p) ** (n - m)
            if 1 - total < self.miss:
                return m
        return n

    def sketched(self) -> int:
        return min(self.width, 64)


def _salts(width: int) -> np.ndarray:
    return np.random.default_rng(20_011).integers(1, 2**63, size=width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, j: Join) -> DataFrame:
    """doc_id, n, print (of the set), mins (minwise tokens); one pass over the whole texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _salts(j.width)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                sizes, prints = [], []
                mins = np.full((some.num_rows, j.width), 2**32 - 1, np.uint32)
                for row, text in enumerate(some.column(1).to_pylist()):
                    own = shingle_set(text, j.k)
                    sizes.append(len(own))
                    prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    for at in range(0, len(own), 256):
                        least = (own[at : at + 256, None] * salts).min(axis=0) >> np.uint64(32)
                        np.minimum(mins[row], least.astype(np.uint32), out=mins[row])
                ends = pa.array(np.arange(len(sizes) + 1) * j.width, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.ListArray.from_arrays(ends, pa.array(mins.view(np.int32).ravel(), pa.int32())),
                        *(pa.array(_bits(mins, k), pa.int64()) for k in (0, 1)),
                    ],
                    names=["doc_id", "n", "print", "mins", "bits_0", "bits_1"],
                )

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, print binary, mins array<int>, bits_0 long, bits_1 long")


def _bits(mins: np.ndarray, k: int) -> np.ndarray:
    """Bit k of the first 64 minwise tokens of each row, as one integer a row."""
    bits = (mins[:, :64] >> np.uint32(k)).astype(np.uint8) & 1
    wide = np.zeros((len(mins), 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.int64).ravel()


def sets_of(docs: DataFrame, wanted: DataFrame, j: Join) -> DataFrame:
    """id, own (array of shingle hashes) for the wanted (id, print, doc).

    A bitmap keeps most other documents from being cut into shingles; the join after it is exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                found = [shingle_set(t, j.k) for t in some.column(1).to_pylist()]
                prints = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found]
                ends = np.cumsum([0, *map(len, found)])
                flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=["doc_id", "own_print", "own"],
                )

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").where("doc_id is not null")
    found = rows.where(marked(wanted.select(F.col("doc").alias("doc_id")))).mapInArrow(run, "doc_id long, own_print binary, own array<long>")
    joined = found.join(wanted, (F.col("doc_id") == F.col("doc")) & (F.col("own_print") == F.col("print")))
    # Repeated rows count once; the join has dealt the rows out by these columns already.
    return written(joined.groupBy("doc", "print", "id").agg(F.first("own").alias("own")).select("id", "own"), "sets")


def near_pairs(pairs: DataFrame, reps: DataFrame, j: Join) -> DataFrame:
    """(a, b) -> set sizes, tokens apart, and whether the full sets have to be compared."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits_0").alias("a0"), F.col("bits_1").alias("a1"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits_0").alias("b0"), F.col("bits_1").alias("b1"))
    near = pairs.join(left, "a").join(right, "b").withColumn("apart", F.expr("bit_count((a0 ^ b0) | (a1 ^ b1))")).drop("a0", "a1", "b0", "b1")
    return near.withColumn("close", F.expr(f"apart <= {j.most_apart()} and 100 * least(na, nb) >= {j.percent} * greatest(na, nb)"))


def compared(near: DataFrame, sets: DataFrame, j: Join) -> DataFrame:
    """(a, b) -> linked, by the full sets, and the distance: from `low` to `high`, which differ where no sets were compared."""
    sa = sets.select(F.col("id").alias("a"), F.col("own").alias("own_a"))
    sb = sets.select(F.col("id").alias("b"), F.col("own").alias("own_b"))
    both = near.where("close").join(sa, "a").join(sb, "b")
    exact = both.select("a", "b", "na", "nb", F.expr("size(array_intersect(own_a, own_b))").alias("common"))
    exact = exact.withColumn("low", F.expr("1D - common / (na + nb - common)"))
    exact = exact.select("a", "b", F.expr(f"100 * common >= {j.percent} * (na + nb - common)").alias("linked"), "low", F.col("low").alias("high"))
    # by sizes, or by sketches: at this distance so many tokens apart are a matter of 4.3 standard deviations at least
    bound = f"greatest(1D - least(na, nb) / greatest(na, nb), (apart / {j.sketched()}D - {4.3 * 0.5 / j.sketched() ** 0.5}D) / 0.75D, 0D)"
    return exact.unionByName(near.where("not close").select("a", "b", F.lit(False).alias("linked"), F.expr(bound).alias("low"), F.lit(1.0).alias("high")))


def _near(i: int, label, n, bits, blocks, j: "Join") -> np.ndarray:
    """The members before i, of other groups (and blocks), whose sketches and sizes are close to i's; nearest first."""
    other = label[:i] != label[i]
    if blocks is not None:
        other &= blocks[:i] != blocks[i]
    apart = np.bitwise_count((bits[0][:i] ^ bits[0][i]) | (bits[1][:i] ^ bits[1][i]))
    other &= (apart <= j.most_apart()) & (100 * np.minimum(n[:i], n[i]) >= j.percent * np.maximum(n[:i], n[i]))
    some = np.flatnonzero(other)
    return some[np.argsort(apart[some], kind="stable")]


def _links(ids, label, n, bits, blocks, own: pa.ListArray, j: "Join") -> list[tuple[int, int]]:
    """Verified links of a small branch, at most one between any two groups as they grow; arguments in ascending order of ids."""
    flat, ends = own.flatten().to_numpy(), own.offsets.to_numpy()
    ends = ends - ends[0]
    codes = np.unique(flat, return_inverse=True)[1]
    held = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int32)
    out: list[tuple[int, int]] = []
    for i in range(1, len(ids)):
        some = _near(i, label, n, bits, blocks, j)
        if not len(some):
            continue
        held[codes[ends[i] : ends[i + 1]]] = 1
        for part in (some[:8], some[8:]):  # the nearest first: mostly their links leave nothing else to compare
            part = part[label[part] != label[i]]
            if len(part):
                found = np.concatenate([codes[ends[k] : ends[k + 1]] for k in part])
                common = np.add.reduceat(held[found], np.r_[0, np.cumsum(ends[part[:-1] + 1] - ends[part[:-1]])])
                for k in part[100 * common >= j.percent * (n[part] + n[i] - common)]:
                    if label[k] != label[i]:
                        out.append((int(ids[k]), int(ids[i])))
                        label[label == label[k]] = label[i]
        held[codes[ends[i] : ends[i + 1]]] = 0
    return out


DEALT = "key long, x int, y int, id long, group long, n long, bits_0 long, bits_1 long, block int"


def _columns(table: pa.Table):
    """ids, labels of the groups, sizes, sketches, blocks (none inside one block)."""
    ids, groups, n = (table.column(c).to_numpy() for c in ("id", "group", "n"))
    bits = [table.column(c).to_numpy().view(np.uint64) for c in ("bits_0", "bits_1")]
    blocks = table.column("block").to_numpy() if table.num_rows and table.column("x")[0] != table.column("y")[0] else None
    return ids, np.unique(groups, return_inverse=True)[1], n, bits, blocks


def suspects(members: DataFrame, nodes: DataFrame, j: Join) -> DataFrame:
    """Members (key, id, group) of small branches that the sketch of a member of another group is close to.

    A task holds at most about two blocks of `block_rows` members and `block_shingles` shingles; a branch of more is dealt
    out as all pairs (x, y) of its blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, label, n, bits, blocks = _columns(table)
        close = np.zeros(len(ids), bool)
        for i in range(1, len(ids)):
            some = _near(i, label, n, bits, blocks, j)
            close[some] = True
            close[i] |= len(some) > 0
        return table.filter(pa.array(close))

    rows = members.select("key", "id", "group").join(nodes, "id")
    sums = rows.groupBy("key").agg(F.count("*").alias("_size"), F.sum("n").alias("_n"))
    sums = sums.select(F.col("key").alias("_key"), F.expr(f"cast(greatest(ceil(_size / {j.block_rows}), ceil(_n / {j.block_shingles})) as int)").alias("blocks"))
    dealt = rows.join(sums, F.col("key") == F.col("_key")).withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    dealt = dealt.withColumn("_other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumn("x", F.least("block", "_other")).withColumn("y", F.greatest("block", "_other"))
    return written(dealt.select(*[x.split()[0] for x in DEALT.split(", ")]).groupBy("key", "x", "y").applyInArrow(run, DEALT), "suspects")


def exhaustive(found: DataFrame, sets: DataFrame, j: Join) -> DataFrame:
    """Verified links (a, b) across the groups of suspects()."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        own = table.column("own")
        own = own.chunk(0) if own.num_chunks else pa.array([], own.type)
        pairs = _links(*_columns(table), own, j)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    whole = found.join(sets.where(marked(found, "id")), "id").select(*found.columns, "own")
    return written(whole.groupBy("key", "x", "y").applyInArrow(run, "a long, b long").distinct(), "links")


def linked(docs: DataFrame, reps: DataFrame, bound: DataFrame, j: Join) -> DataFrame:
    """(id, component) of the representatives that have a link: verified ones, enough of them for all components, and bound (a, b)."""
    spark = docs.sparkSession
    limit = 1 - j.percent / 100
    nodes = reps.select("id", "n", "bits_0", "bits_1")
    tree = F.posexplode(F.slice("mins", 1, j.trees)).alias("tree", "token")
    level = reps.select("id", tree).select("id", F.xxhash64(F.lit(0), "tree", "token").alias("key"), F.col("id").alias("group"))
    edges, depth, groups = bound, 0, None
    sets = spark.createDataFrame([], "id long, own array<long>")
    old = []
    while True:
        # Branches whose members are in one component already have nothing left to find.
        sums = level.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("leader"), F.min("group").alias("g0"), F.max("group").alias("g1"))
        members = written(level.join(sums.where("g0 < g1").select("key", "size", "leader"), "key"), "members")
        discard(spark, *old)
        if members.isEmpty():
            discard(spark, members)
            return connected(edges) if groups is None else groups
        last = depth > j.depth
        few = members if last else members.where(f"size <= {j.small}") if depth else members.limit(0)
        every = (members.limit(0) if last else members.where(f"size > {j.small}") if depth else members).where("id > leader")
        near = written(near_pairs(every.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), nodes, j), "near")
        # Sets are fetched for the members of close pairs only, and once.
        close = suspects(few, nodes, j) if depth else None
        either = near.where("close").select(F.explode(F.array("a", "b")).alias("id"))
        either = either if close is None else either.unionByName(close.select("id"))
        wanted = either.distinct().join(sets.select("id"), "id", "left_anti").join(reps, "id").select("id", "print", "doc")
        wanted = written(wanted, "wanted")
        if not wanted.isEmpty():
            sets = sets.unionByName(sets_of(docs, wanted, j))
        seen = written(compared(near, sets, j), "compared")
        edges = edges.unionByName(seen.where("linked").select("a", "b"))
        if close is not None:
            edges = edges.unionByName(exhaustive(close, sets, j))
            discard(spark, close)
        discard(spark, near, wanted)
        groups = connected(edges)
        # From here on the components stand for all edges so far: the next round starts from their stars.
        edges = groups.select(F.col("component").alias("a"), F.col("id").alias("b")).where("a <> b")
        own, of = groups.toDF("id", "own_group"), groups.toDF("leader", "head_group")
        left = every.drop("group").join(own, "id", "left").join(of, "leader", "left")
        left = left.withColumn("inside", F.expr("coalesce(own_group, id) = coalesce(head_group, leader)"))
        left = left.join(seen.select(F.col("a").alias("leader"), F.col("b").alias("id"), "low", "high"), ["leader", "id"])
        # Members of the leader's component that no member outside can link with are done.
        nearest = left.where("not inside").groupBy("key").agg(F.min("low").alias("nearest"))
        left = left.join(nearest, "key").where(f"not inside or high >= nearest - {limit} - 1e-9").select("key", "id", "size")
        depth += 1
        wide = left.where(f"size > {j.small}").select("key", "id")
        if depth <= j.depth:
            branch = F.explode(F.array(*[F.lit(i) for i in range(j.branches)])).alias("branch")
            token = F.expr(f"mins[cast(pmod(xxhash64(key, branch), {j.width}) as int)]")
            wide = wide.select("key", "id", branch).join(reps.select("id", "mins"), "id").select(F.xxhash64("key", "branch", token).alias("key"), "id")
        left = left.where(f"size <= {j.small}").select("key", "id").unionByName(wide).join(groups, "id", "left")
        released(spark)
        level, old = left.select("id", "key", F.coalesce("component", "id").alias("group")), [members]


def classes(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    found = written(signatures(docs, j), "signatures")
    whole = found.where("n > 0 and doc_id is not null")
    same = [F.first(c).alias(c) for c in ("n", "mins", "bits_0", "bits_1")]
    reps = whole.groupBy("print").agg(F.min("doc_id").alias("doc"), *same)
    reps = written(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    # Texts under one doc_id are joined through it.
    nodes = whole.select("doc_id", "print").join(reps.select("print", "id"), "print")
    own = nodes.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("doc_id", "a")
    bound = nodes.join(own, "doc_id").select("a", F.col("id").alias("b")).where("a <> b").distinct()
    groups = linked(docs, reps, written(bound.select("a", "b"), "bound"), j).withColumnRenamed("component", "group")
    grouped = written(reps.join(groups, "id", "left").select("print", "doc", F.coalesce("group", "id").alias("group")), "groups")
    first = grouped.groupBy("group").agg(F.min("doc").alias("component_id"))
    per_print = grouped.join(first, "group").select("print", "component_id")
    out = found.join(per_print, "print", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """One document of each component, with all its columns; repeated rows of a kept doc_id all stay."""
    with scratch(docs.sparkSession) as own:
        gone = written(classes(docs, j).where("not kept").select("doc_id").distinct(), "gone")
        own.remove(gone)
    return without(docs, gone)
