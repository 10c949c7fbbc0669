"""Near-duplicate records: an exact set-similarity join by the generalised pigeonhole principle.

A text is a bit vector over all runs of `words` consecutive words ("shingles"); two texts are alike if the Jaccard
similarity of their sets reaches `threshold`. For |x| <= |y| that bounds the bits of x missing in y by
tau(x) = floor((1-t)/(1+t) |x|), and the bits of y missing in x by floor((1-t) |y|).

* Correlated bits: bits that the very same texts hold (all shingles of a sentence that was copied around, say) form one
  partition. Every bit travels to the task of its hash range, where all its holders meet; they are counted exactly, and
  the sum of their hashes signs the bit, so that equal signatures mean equal holders. A text then gets back, for each of
  its bits that another text holds as well, the number and the signature of the holders.
* Unequal thresholds: by the generalised pigeonhole principle thresholds t_g >= -1 with sum(t_g + 1) >= tau + 1 lose
  nothing: in some partition y lacks at most t_g bits of x. As y has all bits of a partition or none, t_g is either -1
  (not probed) or the partition's size less 1, and one probe stands for the whole partition. `allocate` chooses by
  dynamic programming the partitions that bring the least number of candidates. Bits that no other text holds come
  first and cost nothing: a text with more than tau of them has no partner, and probes nothing.
* Only the indexed side needs a bound: with `_SLACK` bits more than tau + 1 to choose from, in one global order of
  partitions, a probed partition of x begins within the first |y|-o+tau+slack+1 bits of a y that is alike; partitions
  behind that are not indexed.
* Candidates that share a partition are first held against a 256-bit parity code of their sets, whose Hamming distance
  never exceeds that of the sets, then verified on the whole sets.

Nothing of this has a size of its own that the data could outgrow: counts are exact, blocks of texts and ranges of bits
are of bounded size, and there are more of them where there are more texts. In the counts a text that is copied into
several blocks counts once for each of them; that moves costs only. Set hashes have 64 bits, those of bits have 48 while
candidates are sought (a clash adds a candidate) and 64 when they are verified. Copies (equal sets) are joined as one
and expanded only where a result asks for pairs.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.words import hash_words, mix, signed, text_batches
from tesserine.sources.durable import keep

#: Bits that one range should hold, and how many bits beyond tau + 1 a text may choose its probes from: tau / _SLACK.
_RANGE_BITS = 1 << 21
#: Bits that so many sets of a block hold travel as one entry.
_COMMON_SETS = 32
_SLACK = 2
CODE_WORDS = 4


def distinct_runs(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of n words of each text, sorted within the text, and their starts by text."""
    runs, starts = words.runs(n)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return runs[fresh], np.searchsorted(owner[fresh], np.arange(len(starts)))


def set_keys(runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash per set, equal for equal sets."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(runs), dtype=np.uint64)])
    return mix(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64))


#: The dynamic programme counts in so many steps at most; sizes are rounded down and the need up, which loses nothing.
_STEPS = 256


def allocate(sizes: np.ndarray, costs: np.ndarray, units: int) -> np.ndarray:
    """Which partitions to probe so that they hold `units` bits at least, at the least sum of costs: the thresholds are
    size - 1 for a chosen partition and -1 for the others. Dynamic programming over the partitions, of equal cost in the
    given order. All of them if they hold less than `units`."""
    if units <= 0:
        return np.zeros(len(sizes), bool)
    if sizes.sum() <= units:
        return np.ones(len(sizes), bool)
    scale = -(-units // _STEPS)
    part, need = sizes // scale, -(-units // scale)
    if scale > 1:  # rounding may cost more than taking the cheapest bits does
        order = np.argsort(costs / sizes, kind="stable")
        cheap = np.zeros(len(sizes), bool)
        cheap[order[: np.searchsorted(np.cumsum(sizes[order]), units) + 1]] = True
        if part.sum() < need:
            return cheap
    best = np.full(need + 1, np.inf)
    best[0] = 0.0
    taken = np.zeros((len(part), need + 1), bool)
    for g, (n, c) in enumerate(zip(part.tolist(), costs.tolist())):
        if n:
            offer = np.concatenate([np.full(min(n, need + 1), best[0]), best[: max(need + 1 - n, 0)]]) + c
            offer[0] = best[0]
            np.less(offer, best, out=taken[g])
            best = np.minimum(offer, best)
    left, out = need, np.zeros(len(part), bool)
    for g in range(len(part) - 1, -1, -1):
        if left and taken[g, left]:
            out[g] = True
            left = max(0, left - int(part[g]))
    return cheap if scale > 1 and costs[cheap].sum() < costs[out].sum() else out


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of numbers, byte by byte, so that those which are mostly zero compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    return zlib.compress(b"".join(_planes(x, width) for x, width in columns), 1)


def _unpack(raw: bytes, n: int, *widths: int) -> list[np.ndarray]:
    data, out, at = np.frombuffer(zlib.decompress(raw), np.uint8), [], 0
    for width in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = data[at : at + n * width].reshape(width, n).T
        out.append(full.view("<u8").reshape(-1))
        at += n * width
    return out


def _sets(batch, texts, words: int, min_words: int):
    w = hash_words(texts)
    runs, starts = distinct_runs(w, words)
    size = np.diff(starts)
    return runs, starts, size, set_keys(runs, starts), (w.counts >= min_words) & (size > 0)


def parity_codes(runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per set CODE_WORDS numbers of 64 bits: bit b is the parity of the shingles of hash class b. Every shingle that
    two sets do not share flips one bit, so the codes differ in no more bits than the sets do."""
    n, width = len(starts) - 1, 64 * CODE_WORDS
    owner = np.repeat(np.arange(n), np.diff(starts))
    odd = np.bincount(owner * width + (runs % np.uint64(width)).astype(np.int64), minlength=n * width).reshape(n, width) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view("<i8").reshape(n, CODE_WORDS)


def memberships(records: DataFrame, words: int, min_words: int) -> DataFrame:
    """(id, set_key, size, code0, ...) of every record that is long enough; records: (id, text)."""
    names = [f"code{i}" for i in range(CODE_WORDS)]

    def keys(batches):
        for batch, part in text_batches(batches):
            runs, starts, size, key, use = _sets(batch, part, words, min_words)
            at = np.flatnonzero(use)
            codes = parity_codes(runs, starts)[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(signed(key)[at]), pa.array(size[at].astype(np.int32)), *(pa.array(c.copy()) for c in codes.T)],
                ["id", "set_key", "size", *names])

    return records.select("id", "text").mapInArrow(keys, "id bigint, set_key bigint, size int, " + ", ".join(f"{n} bigint" for n in names))


def _expected_bits(texts: DataFrame) -> int:
    """About how many bits there are, from the length of the texts: some 7 characters a shingle."""
    return (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // 7


def _holders(block: int, owner: np.ndarray) -> np.ndarray:
    """A hash of each set of a block, by its number there."""
    return mix(mix(np.array([block + 1], np.uint64)) + owner.astype(np.uint64))


_ROW = "range int, block bigint, kind int, n int, payload binary"
#: Kinds of rows: bits of single sets, bits that many sets of the block hold, and, for the block itself, its sets, how many
#: sets hold each of its common bits, and which.
_SINGLE, _COMMON, _SETS, _COUNTS, _OWNERS = range(5)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["range", "block", "kind", "n", "payload"])


def _posted(records: DataFrame, words: int, min_words: int, ranges: int) -> DataFrame:
    """The bits of blocks of texts, by ranges of bits: (bit, number of the set in its block), and for a bit that _COMMON_SETS
    sets of the block hold one entry with their number and the sum of their hashes, so that a bit of very many texts makes
    an entry a block. What only the block itself needs afterwards rides along with some range."""

    def post(batches):
        task = TaskContext.get().partitionId()
        for number, (batch, texts) in enumerate(text_batches(batches)):
            runs, _, size, key, use = _sets(batch, texts, words, min_words)
            at = np.flatnonzero(use)
            at = np.sort(at[np.unique(key[at], return_index=True)[1]])  # of equal sets of a block the first
            if not len(at):
                continue
            use = np.zeros(len(size), bool)
            use[at] = True
            held = np.repeat(use, size)
            codes, owner = runs[held] >> np.uint64(16), np.repeat(np.arange(len(at)), size[at])
            order = np.argsort(codes, kind="stable")
            codes, owner = codes[order], owner[order]
            fresh = np.ones(len(codes), bool)
            fresh[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
            codes, owner = codes[fresh], owner[fresh]
            block = (task << 32) | number
            distinct = np.bincount(owner, minlength=len(at))
            own = (block % ranges, block)
            rows = [(*own, _SETS, len(at), _pack((key[at], 8), (size[at], 4), (distinct, 4)))]
            heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            count = np.diff(np.append(heads, len(codes)))
            hot = count >= _COMMON_SETS
            if hot.any():
                many = np.repeat(hot, count)
                sums = np.add.reduceat(_holders(block, owner), heads)[hot]
                rows.append((*own, _COUNTS, int(hot.sum()), _pack((count[hot], 4))))
                rows.append((*own, _OWNERS, int(many.sum()), _pack((owner[many], 4))))
                common, count = codes[heads[hot]], count[hot]
                for r, a, z in _by_range(common, ranges):
                    rows.append((r, block, _COMMON, z - a, _pack((np.diff(common[a:z], prepend=np.uint64(0)), 6), (count[a:z], 4), (sums[a:z], 8), (np.arange(a, z), 4))))
                codes, owner = codes[~many], owner[~many]
            for r, a, z in _by_range(codes, ranges):
                rows.append((r, block, _SINGLE, z - a, _pack((np.diff(codes[a:z], prepend=np.uint64(0)), 6), (owner[a:z], 4))))
            yield _rows(rows)

    return records.select("text").mapInArrow(post, _ROW)


def _by_range(codes: np.ndarray, ranges: int):
    """(range, begin, end) of the stretches of sorted codes that fall into one range."""
    where = ((codes >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]]).tolist()
    return [(int(where[a]), a, z) for a, z in zip(edges, edges[1:])] if len(codes) else []


def _held_by_others(batches):
    """For the rows of _posted of one range: the bits that several sets hold, as (set number, level and signature of the
    holders, number of such bits) or, for common ones, (number of the bit, level, signature). Other rows pass through."""
    blocks, kinds, codes, named, counts, sums = [], [], [], [], [], []
    for b in batches:
        for r, block, kind, n, payload in zip(*(c.to_pylist() for c in b.columns)):
            if kind == _SINGLE:
                deltas, name = _unpack(payload, n, 6, 4)
                count, total = np.ones(n, np.int64), _holders(block, name)
            elif kind == _COMMON:
                deltas, count, total, name = _unpack(payload, n, 6, 4, 8, 4)
            else:
                yield _rows([(r, block, kind, n, payload)])
                continue
            for held, x in ((blocks, block), (kinds, kind), (codes, np.cumsum(deltas, dtype=np.uint64)), (named, name.astype(np.int64)), (counts, count.astype(np.int64)), (sums, total)):
                held.append(x)
    if not blocks:
        return
    sizes = np.array([len(c) for c in codes])
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
    times = np.diff(np.append(heads, len(code)))
    count = np.add.reduceat(np.concatenate(counts)[order], heads)
    sign, level = np.empty(len(code), np.uint64), np.empty(len(code), np.int64)
    sign[order] = np.repeat(np.add.reduceat(np.concatenate(sums)[order], heads), times)
    level[order] = np.repeat(np.floor(4 * np.log2(count)).astype(np.int64), times)
    for block, kind, name, lo, hi in zip(blocks, kinds, named, np.cumsum(sizes) - sizes, np.cumsum(sizes)):
        at = lo + np.flatnonzero(level[lo:hi])
        if not len(at):
            continue
        name = name[at - lo]
        if kind == _COMMON:
            yield _rows([(0, block, kind, len(at), _pack((name, 4), (level[at], 1), (sign[at], 8)))])
        else:
            o, v, s, n = _collapsed(name, level[at], sign[at], np.ones(len(at), np.int64))
            yield _rows([(0, block, kind, len(o), _pack((o, 4), (v, 1), (s, 8), (n, 4)))])


def _collapsed(owner, level, sign, n):
    """Rows of equal (owner, level, sign) as one with the sum of n, sorted by them."""
    order = np.lexsort((sign, level, owner))
    owner, level, sign, n = owner[order], level[order], sign[order], n[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (level[1:] != level[:-1]) | (sign[1:] != sign[:-1])
    heads = np.flatnonzero(fresh)
    return owner[heads], level[heads], sign[heads], np.add.reduceat(n, heads) if len(heads) else n


def size_bounds(t: Fraction, largest: int) -> np.ndarray:
    """Lower ends of classes of sizes, such that a size up to 1/t times another lies in the same class or the next."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(bounds[-1] * t.denominator // t.numerator + 1)
    return np.array(bounds)


def choose_probes(owner, level, sign, n, size, distinct, t: Fraction):
    """Per partition of each set whether it is indexed and whether it is probed. owner .. n: as from _collapsed; size,
    distinct: bits of each set, before and after cutting their hashes."""
    starts = np.searchsorted(owner, np.arange(len(size) + 1))
    of_probe = (1 - t) / (1 + t)
    tau = size * of_probe.numerator // of_probe.denominator
    alone = distinct - np.bincount(owner, n, len(size)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(n)])
    before = total[:-1] - total[starts[owner]] + alone[owner]
    share = float(t / (1 + t))
    reach = lambda x: size - share * (x + size) + (1 + 1 / _SLACK) * float(of_probe) * x + 1
    bound = np.floor(np.maximum(reach(size * float(t)), reach(size)) + 1e-6).astype(np.int64)
    lost = size * (1 - t).numerator // (1 - t).denominator
    indexed = (before < bound[owner]) & (alone <= lost)[owner]
    window = before < (tau + 1 + tau // _SLACK)[owner]
    probed = np.zeros(len(owner), bool)
    need = tau + 1 - alone
    for i in np.flatnonzero((need > 0) & (np.diff(starts) > 0)).tolist():
        a, z = starts[i], starts[i + 1]
        if n[a] >= need[i]:  # the cheapest partition alone will do
            probed[a] = True
            continue
        z = a + int(np.count_nonzero(window[a:z]))
        probed[a:z] = allocate(n[a:z], 2.0 ** (level[a:z] / 4), int(need[i]))
    return indexed | probed, probed


def probes(records: DataFrame, words: int, threshold: Fraction, min_words: int) -> DataFrame:
    """(sign, class, set_key, size, probe): the partitions under which each set is indexed, and which of them it probes.
    class: the class of its size."""
    spark = records.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_expected_bits(records) // _RANGE_BITS))
    posted = _posted(records, words, min_words, ranges).repartitionById(ranges, F.col("range"))
    shared = posted.mapInArrow(_held_by_others, _ROW)

    def decide(block):
        get = lambda kind, *widths: [_unpack(p, n, *widths) for k, n, p in block if k == kind]
        ((key, size, distinct),) = get(_SETS, 8, 4, 4)
        size, distinct = size.astype(np.int64), distinct.astype(np.int64)
        parts = get(_SINGLE, 4, 1, 8, 4)
        if common := get(_COMMON, 4, 1, 8):
            name, v, s = (np.concatenate(x) for x in zip(*common))
            ((counts,),), ((owners,),) = get(_COUNTS, 4), get(_OWNERS, 4)
            counts, name = counts.astype(np.int64), name.astype(np.int64)
            starts, times = np.concatenate([[0], np.cumsum(counts)]), counts[name]
            mine = np.repeat(starts[name] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            parts.append([owners[mine], np.repeat(v, times), np.repeat(s, times), np.ones(len(mine), np.uint64)])
        if not parts:
            return
        o, v, s, n = (np.concatenate(x) for x in zip(*parts))
        o, v, s, n = _collapsed(o.astype(np.int64), v.astype(np.int64), s, n.astype(np.int64))
        indexed, probed = choose_probes(o, v, s, n, size, distinct, threshold)
        at = np.flatnonzero(indexed)
        owner = o[at]
        classes = np.searchsorted(size_bounds(threshold, int(size.max())), size, "right").astype(np.int32) if threshold < 1 else size.astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(s)[at]), pa.array(classes[owner]), pa.array(signed(key)[owner]), pa.array(size[owner].astype(np.int32)), pa.array(probed[at])],
            ["sign", "class", "set_key", "size", "probe"])

    def choose(batches):
        held, key = [], None
        for b in batches:
            for block, *row in zip(*(c.to_pylist() for c in b.columns)):
                if block != key:
                    if held:
                        yield from decide(held)
                    held, key = [], block
                held.append(row)
        if held:
            yield from decide(held)

    kind = "sign bigint, class int, set_key bigint, size int, probe boolean"
    return shared.select("block", "kind", "n", "payload").repartition("block").sortWithinPartitions("block").mapInArrow(choose, kind)


def candidate_pairs(records: DataFrame, words: int, threshold: Fraction, min_words: int) -> DataFrame:
    """(set_a, set_b) of unequal sets that share a probed partition; a superset of the alike pairs. Sets meet by
    partition and class of size, so that a partition that very many sets hold is split."""
    met = keep(probes(records, words, threshold, min_words), "probes").distinct()
    both = F.explode(F.array(F.col("class"), F.col("class") + 1) if threshold < 1 else F.array("class")).alias("class")
    x = met.where("probe").select("sign", both, F.col("set_key").alias("set_a"), F.col("size").alias("size_a"))
    y = met.select("sign", "class", F.col("set_key").alias("set_b"), F.col("size").alias("size_b"))
    near = (
        (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("set_a") < F.col("set_b")))
    ) & (F.col("size_b") * threshold.numerator <= F.col("size_a") * threshold.denominator)
    return x.join(y, ["sign", "class"]).where(near).select("set_a", "set_b").distinct()


def similar_sets(
    records: DataFrame, words: int = 5, threshold: str | Fraction = "0.8", min_words: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Exact links between different texts, and which record has which text.

    records: (id, text). Returns links (set_a, set_b, jaccard), each pair of sets once, and members (id, set_key,
    size), each record once. Records with a null or empty text or of fewer than min_words words take no part; a
    repeated row counts once. If an id comes with several texts, it is a member of several sets.
    """
    t = Fraction(threshold)
    if not 0 < t <= 1:
        raise ValueError(f"threshold must lie in (0, 1]: {threshold}")
    records = records.select("id", "text").where("id is not null and text is not null")
    members = keep(memberships(records, words, min_words).distinct(), "set-members")
    codes = [f"code{i}" for i in range(CODE_WORDS)]
    once = members.groupBy("set_key").agg(F.min("id").alias("id"), F.first("size").alias("size"), *(F.first(c).alias(c) for c in codes))
    a, b = (once.select(*(F.col(c).alias(f"{c}_{s}") for c in once.columns)).withColumnRenamed(f"set_key_{s}", f"set_{s}") for s in "ab")
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in codes), F.lit(0))
    allowed = (F.col("size_a") + F.col("size_b")) * (t.denominator - t.numerator)
    pairs = candidate_pairs(records, words, t, min_words).join(a, "set_a").join(b, "set_b").where(apart * (t.denominator + t.numerator) <= allowed)
    pairs = keep(pairs.select("set_a", "set_b", "id_a", "id_b"), "set-pairs")
    wanted = records.join(pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).distinct(), "id", "left_semi")

    def whole(batches):
        for batch, part in text_batches(batches):
            runs, starts, size, key, use = _sets(batch, part, words, min_words)
            own = signed(key)
            rows = [(int(own[i]), runs[starts[i] : starts[i + 1]].tobytes()) for i in np.flatnonzero(use)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["set_key", "bits"])

    sets = keep(wanted.mapInArrow(whole, "set_key bigint, bits binary").dropDuplicates(["set_key"]), "sets")

    def verify(batches):
        for b in batches:
            found, value = [], []
            for i, (p, q) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                either = len(p) + len(q) - both
                if both * t.denominator >= either * t.numerator:
                    found.append(i)
                    value.append(both / either)
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(value, pa.float64())], ["set_a", "set_b", "jaccard"])

    a, b = (sets.select(F.col("set_key").alias(f"set_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab")
    both = pairs.select("set_a", "set_b").join(a, "set_a").join(b, "set_b").select("set_a", "set_b", "bits_a", "bits_b")
    return both.mapInArrow(verify, "set_a bigint, set_b bigint, jaccard double"), members


def near_duplicate_pairs(records: DataFrame, words: int = 5, threshold: str | Fraction = "0.8", min_words: int = 1) -> DataFrame:
    """(id_a, id_b, jaccard), id_a < id_b, for every pair of alike records, copies included.

    This form expands groups of copies into pairs; near_duplicate_classes does not. See similar_sets for the rules."""
    links, members = similar_sets(records, words, threshold, min_words)
    a = members.select(F.col("set_key").alias("set_a"), F.col("id").alias("id_1"))
    b = members.select(F.col("set_key").alias("set_b"), F.col("id").alias("id_2"))
    across = links.join(a, "set_a").join(b, "set_b").where("id_1 <> id_2").select(
        F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"), "jaccard")
    within = a.withColumnRenamed("set_a", "set_b").join(b, "set_b").where("id_1 < id_2").select(
        F.col("id_1").alias("id_a"), F.col("id_2").alias("id_b"), F.lit(1.0).alias("jaccard"))
    return across.unionByName(within).groupBy("id_a", "id_b").agg(F.max("jaccard").alias("jaccard"))


def _components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(set_key, class_key) of all linked sets: the smallest key of the connected component.

    Alternating large-star and small-star steps; each is one shuffle by node with map-side minima, no adjacency list is
    ever collected, and the number of rounds grows with the logarithm of the component's size. Every round is written
    to the shared folder, so lineage stays short and a lost executor costs one round."""
    edges = keep(links.select(F.greatest("set_a", "set_b").alias("u"), F.least("set_a", "set_b").alias("v")), "edges")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        small = keep(small, "edges")
        changed = small.exceptAll(edges).limit(1).count() + edges.exceptAll(small).limit(1).count()
        edges = small
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("class_key")).withColumnRenamed("u", "set_key")


def near_duplicate_classes(records: DataFrame, words: int = 5, threshold: str | Fraction = "0.8", min_words: int = 1) -> DataFrame:
    """(id, class_id, links, copies), one row per record and text that takes part: the class is the smallest id of all
    records connected by links between alike texts; links: the alike other texts; copies: the records of the same text.

    Groups of copies are never expanded. See similar_sets for the rules."""
    links, members = similar_sets(records, words, threshold, min_words)
    links = keep(links, "links")
    component = _components(links)
    ends = links.select(F.col("set_a").alias("set_key")).union(links.select("set_b"))
    degree = ends.groupBy("set_key").agg(F.count("*").alias("links"))
    sets = members.groupBy("set_key").agg(F.count("*").alias("copies"), F.min("id").alias("_first"))
    sets = sets.join(component, "set_key", "left").join(degree, "set_key", "left").withColumn("class_key", F.coalesce("class_key", "set_key"))
    named = sets.groupBy("class_key").agg(F.min("_first").alias("class_id"))
    return members.join(sets.join(named, "class_key"), "set_key").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "copies")
