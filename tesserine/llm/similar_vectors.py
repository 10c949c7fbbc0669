"""The k most similar vectors of every vector: a permutation index with inverted pivot files.

Every vector is represented by its `prefix` nearest pivots in order. Each of them is a key of an inverted file whose
entries carry the vector's permutation; vectors that share a pivot meet in its file. There candidates are ranked by
the footrule distance of their permutations, the best ones are reranked by their exact cosine, and per vector the best
k over its files are kept. Every vector is indexed and every vector is a query.

* Pivots are a sample of the vectors, max(8 sqrt(n), n / 64) of them, so that the files of a large collection hold a
  constant number of vectors. Pivots stand on shelves of similar ones; a vector is compared with the pivots of its
  nearest shelves alone, so finding its permutation costs about the square root of the number of pivots.
* What travels is the vector, in 16 bits a component, once for every room that holds one of its pivots, not once for
  every pivot. Rooms are clusters of pivots with about `room` vectors in their files; a room's task opens all of them.
* Pivots are sent to every task, so their bytes are bounded (`pivot_bytes`). Beyond that bound files grow; a file of more
  than `cell` vectors is worked off by pairs of blocks, so that all its members still meet. Rooms are cut where their
  files hold too many vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.words import mix
from tesserine.sources.durable import keep

#: The pivots of all widths together take so many bytes at most where they are sent to every task.
PIVOT_BYTES = 64 << 20
PREFIX = 6
#: Files of more vectors are parted.
CELL = 8_192
#: About so many vectors meet in a room.
ROOM = 65_536
#: Components of unit vectors travel as whole multiples of 1 / _SCALE; cosines are good to about 1e-5.
_SCALE = 32_767.0
#: Of the shelves nearest to a vector so many are searched for its pivots.
NEAR_SHELVES = 24
_BLOCK = 1_024
#: Groups of copies that are sent to every task (20 bytes each); more are joined by shuffle.
_FEW_GROUPS = 500_000


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(id, dims, vector) of the usable ones: not null, as long as dims says, all values finite, not all zero.

    vectors: (id, dims, vector array<float>). A repeated row counts once; if an id has several vectors, the smallest
    (dims, vector) counts."""
    v = F.col("vector")
    good = (
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) == F.col("dims")) & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select("id", "dims", "vector").where(good)
    return rows.groupBy("id").agg(F.min(F.struct("dims", "vector")).alias("_v")).select("id", "_v.dims", "_v.vector")


def _matrix(column) -> np.ndarray:
    """The rows of a list column of equal lengths, each of unit length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    peak = np.abs(flat).max(axis=1, keepdims=True)  # keeps tiny and huge values apart from underflow and overflow
    flat = flat / peak
    return (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


def _footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Closeness of all pairs of permutation prefixes: the footrule distance is a constant minus twice this. A pivot at
    place i weighs prefix - i, and pairs gain the smaller weight of every pivot they share."""
    n = a.shape[1]
    out = np.zeros((len(a), len(b)), np.uint8 if n < 22 else np.uint16)
    for i in range(n):
        for j in range(n):
            out += (a[:, i, None] == b[None, :, j]).view(np.uint8) * out.dtype.type(n - max(i, j))
    return out


def _best(ids: np.ndarray, unit: np.ndarray, perm: np.ndarray, k: int, rerank: int):
    """Per row of a file its k most similar others: (row, other, cosine), in blocks. The cosine counts for the `rerank`
    others of the least footrule distance, and for all that tie with the last of them."""
    n = len(ids)
    local = np.unique(perm, return_inverse=True)[1].reshape(perm.shape)
    local = local.astype(np.uint8 if local.max(initial=0) < 256 else np.uint16 if local.max() < 65536 else np.int32)
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        rows, others, values = [], [], []
        close = _footrule(local[lo:hi], local)
        close[np.arange(hi - lo), np.arange(lo, hi)] = 0
        cut = np.partition(close, n - rerank, axis=1)[:, n - rerank] if rerank < n - 1 else np.zeros(hi - lo, close.dtype)
        for a in range(0, n, _BLOCK * 4):
            b = min(n, a + _BLOCK * 4)
            cosine = unit[lo:hi] @ unit[a:b].T
            cosine[close[:, a:b] < cut[:, None]] = -np.inf
            same = np.arange(max(lo, a), min(hi, b))
            cosine[same - lo, same - a] = -np.inf
            take = min(k, b - a)
            top = np.argpartition(-cosine, take - 1, axis=1)[:, :take]
            rows.append(np.repeat(np.arange(lo, hi), take))
            others.append((top + a).ravel())
            values.append(np.take_along_axis(cosine, top, 1).ravel())
        row, other, value = np.concatenate(rows), np.concatenate(others), np.concatenate(values)
        fine = value > -np.inf
        yield row[fine], other[fine], value[fine]


def _kept(ids: np.ndarray, row: np.ndarray, other: np.ndarray, value: np.ndarray, k: int):
    """Of links between rows the best k of each row, each other row once: ids, ids of the others, cosines."""
    order = np.lexsort((ids[other], -value, row))
    row, other, value = row[order], other[order], value[order]
    pair = row.astype(np.int64) * len(ids) + other
    first = np.zeros(len(pair), bool)
    first[np.unique(pair, return_index=True)[1]] = True
    row, other, value = row[first], other[first], value[first]
    starts = np.searchsorted(row, row)
    best = np.arange(len(row)) - starts < k
    return ids[row[best]], ids[other[best]], value[best].astype(np.float32)


class Pivots:
    """The pivots of one width, in the order of their shelves."""

    def __init__(self, vectors: np.ndarray, seed: int):
        want = max(1, round(math.sqrt(len(vectors))))
        heads = vectors[np.random.default_rng(seed).permutation(len(vectors))[:want]]
        shelf = np.concatenate([(vectors[a : a + 4096] @ heads.T).argmax(axis=1) for a in range(0, len(vectors), 4096)]) if len(vectors) else np.zeros(0, np.int64)
        order = np.argsort(shelf, kind="stable")
        self.vectors, self.heads = np.ascontiguousarray(vectors[order]), heads
        self.starts = np.searchsorted(shelf[order], np.arange(want + 1))

    def permutations(self, unit: np.ndarray, prefix: int) -> np.ndarray:
        """The `prefix` nearest pivots of each row, nearest first: those of its NEAR_SHELVES nearest shelves, and of as
        many further ones as it takes to find so many."""
        n, width = len(unit), min(prefix, len(self.vectors))
        near = unit @ self.heads.T
        size = np.diff(self.starts)
        shelves = min(NEAR_SHELVES, len(size))
        by_rank = np.argsort(-near, axis=1)
        held = np.cumsum(size[by_rank], axis=1)
        reach = np.maximum((held < width).sum(axis=1) + 1, shelves)
        best = np.full((n, width), -np.inf, np.float32)
        who = np.zeros((n, width), np.int32)
        wanted = np.zeros((n, len(size)), bool)
        np.put_along_axis(wanted, by_rank, np.arange(len(size))[None, :] < reach[:, None], 1)
        for s in np.flatnonzero(size):
            rows = np.flatnonzero(wanted[:, s])
            if len(rows):
                lo, hi = self.starts[s], self.starts[s + 1]
                value = np.concatenate([best[rows], unit[rows] @ self.vectors[lo:hi].T], axis=1)
                names = np.concatenate([who[rows], np.broadcast_to(np.arange(lo, hi, dtype=np.int32), (len(rows), hi - lo))], axis=1)
                top = np.argpartition(-value, width - 1, axis=1)[:, :width]
                best[rows], who[rows] = np.take_along_axis(value, top, 1), np.take_along_axis(names, top, 1)
        order = np.lexsort((who, -best), axis=1)
        return np.take_along_axis(who, order, 1)


def _copies(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows that are indexed (id, dims, vector), and the links of the rest. Of equal vectors the k + 1 with the smallest ids are indexed;
    every further copy has the first k of them as its most similar ones. Only those few leave a map task."""
    w = Window.partitionBy("dims", "same").orderBy("id")
    first = rows.select("id", "dims", "same").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    first = keep(first, "vector-copies")
    full = first.where(F.col("_r") == k + 1).select("dims", "same", F.col("id").alias("_last"))
    leaders = first.where(F.col("_r") <= k).join(full, ["dims", "same"]).select("dims", "same", F.col("id").alias("other"), "_last")
    rest = rows.select("id", "dims", "same").join(leaders, ["dims", "same"]).where("id > _last")
    # Groups of so many copies are few as a rule; then they are sent to the vectors, which stay where they are.
    few = full.count() <= _FEW_GROUPS
    indexed = rows.join(F.broadcast(full) if few else full, ["dims", "same"], "left").where("_last is null or id <= _last")
    return indexed.select("id", "dims", "vector"), rest.select("id", "other", F.lit(1.0).cast("float").alias("cosine"))


def _pivot_tables(rows: DataFrame, prefix: int, pivot_bytes: int, seed: int) -> dict[int, Pivots]:
    """The pivots of every width, so many that all of them together stay below pivot_bytes, but `prefix` at least."""
    counts = {r["dims"]: r["n"] for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    wish = {d: max(prefix, math.ceil(8 * math.sqrt(n)), n // 64) for d, n in counts.items()}
    cut = min(1.0, pivot_bytes / max(1, sum(4 * d * w for d, w in wish.items())))
    out = {}
    for dims, n in wish.items():  # few: one round per number of dimensions
        once = rows.where(F.col("dims") == dims).groupBy("same").agg(F.min("id").alias("id"))
        names = once.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max(prefix, int(n * cut))).select("id")
        picked = rows.where(F.col("dims") == dims).join(F.broadcast(names), "id", "left_semi").orderBy("id").select("vector")
        out[dims] = Pivots(_matrix(picked.toArrow().column("vector").combine_chunks()), seed)
    return out


def _rooms(pivots: Pivots, counts: np.ndarray, room: int, seed: int) -> np.ndarray:
    """The room of each pivot: clusters of pivots (some rounds of k-means), cut where their files hold more than four
    times `room` entries, as a vector stands in several files of a room."""
    want = min(len(counts), max(1, -(-int(counts.sum()) // (2 * room))))
    centres = pivots.vectors[np.random.default_rng(seed).permutation(len(counts))[:want]]
    near = np.zeros(len(counts), np.int64)
    for _ in range(6 if want > 1 else 0):
        near = np.concatenate([(pivots.vectors[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(counts), 4096)])
        order = np.argsort(near, kind="stable")
        heads = np.flatnonzero(np.diff(near[order], prepend=-1))
        centres[near[order][heads]] = np.add.reduceat(pivots.vectors[order], heads, axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
    order = np.argsort(near, kind="stable")
    out, number, held, last = np.zeros(len(counts), np.int64), -1, 0, -1
    for p, r in zip(order.tolist(), near[order].tolist()):
        if r != last or held and held + counts[p] > 4 * room:
            number, held, last = number + 1, 0, r
        out[p], held = number, held + counts[p]
    return out


def similar_vectors(
    vectors: DataFrame, k: int = 5, prefix: int = PREFIX, rerank: int = 128, pivot_bytes: int = PIVOT_BYTES, cell: int = CELL, room: int = ROOM, seed: int = 7,
) -> DataFrame:
    """(id, other, cosine, rank): for every usable vector its k most similar usable vectors of the same dims.

    vectors: (id, dims, vector); see usable_vectors. Approximate: the true neighbours are found with a recall above
    0.9 (measured in tests/llm). Ties go to the smaller id; copies have cosine 1; a vector with fewer than k others
    of its dims gets them all if they share a pivot. Empty input gives an empty result."""
    spark = vectors.sparkSession
    rows = keep(usable_vectors(vectors).withColumn("same", F.xxhash64("vector")), "vectors")
    indexed, copies = _copies(rows, k)
    pivots = spark.sparkContext.broadcast(_pivot_tables(rows, prefix, pivot_bytes, seed))

    def permuted(batches):
        for b in batches:
            dims = b.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for lo in range(0, len(at), _BLOCK):
                    take = pa.array(at[lo : lo + _BLOCK])
                    unit = _matrix(b.column(2).take(take))
                    yield d, b.column(0).take(take).to_numpy(), unit, pivots.value[d].permutations(unit, prefix)

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for d, _, _, perm in permuted(batches):
            sums[d] = sums.get(d, 0) + np.bincount(perm.ravel(), minlength=len(pivots.value[d].vectors))
        for d, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["dims", "pivot", "n"])

    held = {d: np.zeros(len(p.vectors), np.int64) for d, p in pivots.value.items()}
    for r in indexed.mapInArrow(count, "dims int, pivot int, n bigint").groupBy("dims", "pivot").agg(F.sum("n").alias("n")).collect():  # one row a pivot
        held[r["dims"]][r["pivot"]] = r["n"]
    plan = spark.sparkContext.broadcast({d: (_rooms(p, np.where(held[d] > cell, 0, held[d]), room, seed), -(-held[d] // max(1, cell // 2))) for d, p in pivots.value.items()})

    def place(batches):
        """(place, pivot, id, dims, unit, perm): a row for every room of a vector (pivot -1), and for every pair of blocks
        with its own block in it of each large file (of that pivot)."""
        for d, ids, unit, perm in permuted(batches):
            room_of, blocks = plan.value[d]
            large = held[d][perm] > cell
            rooms = np.where(large, -1, room_of[perm])
            first = ~large
            for i in range(1, perm.shape[1]):
                first[:, i] &= ~(rooms[:, i, None] == rooms[:, :i]).any(axis=1)
            row, col = np.nonzero(first)
            spots = [(row, rooms[row, col], np.full(len(row), -1))]
            own = mix(ids.view(np.uint64) + np.uint64(seed))
            for i, j in zip(*np.nonzero(large)):
                p, n = int(perm[i, j]), int(blocks[perm[i, j]])
                mine = int(own[i] % np.uint64(n))
                pair = np.array([min(x, mine) * n + max(x, mine) for x in range(n) if x != mine or n == 1], np.int64)
                spots.append((np.full(len(pair), i), pair, np.full(len(pair), p)))
            row, spot, pivot = (np.concatenate(x) for x in zip(*spots))
            short = np.rint(unit * _SCALE).astype("<i2")
            offsets = pa.array(np.arange(0, len(row) * perm.shape[1] + 1, perm.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(spot), pa.array(pivot.astype(np.int32)), pa.array(ids[row]), pa.array(np.full(len(row), d, np.int32)),
                 pa.array([short[i].tobytes() for i in row], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(perm[row].ravel()))],
                ["place", "pivot", "id", "dims", "unit", "perm"])

    def link(batches):
        def close(parts):
            (_, pivot, d), (ids, unit, perm) = key, (np.concatenate(x) for x in zip(*parts))
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            if pivot >= 0:
                files = [np.arange(len(ids))]
            else:
                wanted = plan.value[d][0][perm] == key[0]
                wanted &= held[d][perm] <= cell
                row, col = np.nonzero(wanted)
                names = perm[row, col]
                order = np.argsort(names, kind="stable")
                files = np.split(row[order], np.flatnonzero(np.diff(names[order])) + 1)
            links = [[at[x] for x in (a, b)] + [c] for at in files if len(at) > 1 for a, b, c in _best(ids[at], unit[at], perm[at], k, rerank)]
            if links:
                a, b, c = _kept(ids, *(np.concatenate(x) for x in zip(*links)), k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["id", "other", "cosine"])

        parts, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            marks = np.stack([b.column(i).to_numpy().astype(np.int64) for i in (0, 1, 3)])
            edges = np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1
            ids = b.column(2).to_numpy()
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                now = tuple(marks[:, lo].tolist())
                if now != key:
                    if parts:
                        yield from close(parts)
                    parts, key = [], now
                part = b.slice(lo, hi - lo)
                unit = np.frombuffer(b"".join(part.column(4).to_pylist()), "<i2").reshape(hi - lo, -1).astype(np.float32)
                parts.append((ids[lo:hi], unit, part.column(5).flatten().to_numpy().reshape(hi - lo, -1)))
        if parts:
            yield from close(parts)

    placed = indexed.mapInArrow(place, "place bigint, pivot int, id bigint, dims int, unit binary, perm array<int>")
    sorted_places = placed.repartition("place", "pivot", "dims").sortWithinPartitions("dims", "pivot", "place")
    links = sorted_places.mapInArrow(link, "id bigint, other bigint, cosine float").unionByName(copies).repartition("id")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    once = links.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
