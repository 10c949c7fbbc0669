"""A trigram index over texts, and the trigrams that a regular expression cannot match without.

The index is partitioned by document, as search engines do: each block of texts gets its own postings, so no posting list
grows hot. It comes in two forms. `TrigramIndex` holds the postings of some trigrams over one block in memory, where texts
are read once and forgotten. `store_index` writes the postings of all trigrams to a folder, by ranges of trigrams;
`candidates` answers any number of later queries from it and reads no text.
"""

from __future__ import annotations

from re import _constants as c  # the parse tree of the standard library's regular expressions
from re import _parser

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.words import text_batches

#: A query: True (no restriction), a trigram, ("and", queries) or ("or", queries).
Query = bool | str | tuple

_EXPAND = 64


def _and(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list[Query]) -> Query:
    if not parts or any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(texts: list[str]) -> Query:
    return _or([_and([t[i : i + 3] for i in range(len(t) - 2)]) for t in texts])


def _fold(code: int) -> str:
    return chr(code).lower()


def _exact(op, arg) -> list[str] | None:
    """All strings that a node matches, if they are few and plain, in lower case."""
    if op is c.LITERAL:
        return [_fold(arg)] if arg < 128 else None
    if op is c.IN and all(o is c.LITERAL and a < 128 for o, a in arg) and len(arg) <= 8:
        return sorted({_fold(a) for _, a in arg})
    if op is c.SUBPATTERN:
        return _exact_all(arg[3])
    if op is c.BRANCH:
        options = [_exact_all(x) for x in arg[1]]
        return None if any(o is None for o in options) else [s for o in options for s in o]
    if op is c.AT or op in (c.ASSERT, c.ASSERT_NOT):
        return [""]
    if op is c.MAX_REPEAT and arg[:2] == (0, 1):
        inner = _exact_all(arg[2])
        return None if inner is None else ["", *inner]
    return None


def _exact_all(nodes) -> list[str] | None:
    out = [""]
    for op, arg in nodes:
        more = _exact(op, arg)
        if more is None or len(out) * len(more) > _EXPAND:
            return None
        out = [a + b for a in out for b in more]
    return out


def _walk(nodes) -> Query:
    parts: list[Query] = []
    run = [""]
    for op, arg in nodes:
        more = _exact(op, arg)
        if more is not None and len(run) * len(more) <= _EXPAND:
            run = [a + b for a in run for b in more]
            continue
        parts.append(_grams(run))
        run = [""]
        if more is not None:
            run = more
        elif op is c.SUBPATTERN:
            parts.append(_walk(arg[3]))
        elif op is c.BRANCH:
            parts.append(_or([_walk(x) for x in arg[1]]))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] > 0:
            parts.append(_walk(arg[2]))
    parts.append(_grams(run))
    return _and(parts)


def required_trigrams(pattern: str, flags: int = 0) -> Query:
    """Which trigrams, in lower case, every text must hold that the pattern matches. ASCII patterns only."""
    return _walk(_parser.parse(pattern, flags))


def grams_of(query: Query) -> set[str]:
    if isinstance(query, bool):
        return set()
    return {query} if isinstance(query, str) else set().union(*map(grams_of, query[1]))


class TrigramIndex:
    """Postings of the given trigrams over a batch of texts; ASCII letters count as lower case."""

    def __init__(self, grams: list[str]):
        self.grams = sorted(grams)
        self.number = {g: i for i, g in enumerate(self.grams)}
        codes = np.array([g[0] << 16 | g[1] << 8 | g[2] for g in (x.encode() for x in self.grams)], np.uint32)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.hint = np.zeros(1 << 16, bool)
        self.hint[self._short(self.codes)] = True

    @staticmethod
    def _short(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(0x9E3779B1)) >> np.uint32(16)

    def postings(self, texts: list[str | None]) -> np.ndarray:
        """Array (texts, trigrams): which text holds which trigram."""
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        b = np.frombuffer(b"".join(data).lower(), np.uint8).astype(np.uint32)
        out = np.zeros((len(texts), len(self.grams)), bool)
        if len(b) < 3 or not len(self.codes):
            return out
        codes = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        at = np.flatnonzero(self.hint[self._short(codes)])
        place = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        real = self.codes[place] == codes[at]
        at, place = at[real], place[real]
        owner = np.searchsorted(ends, at, "right")
        inside = at + 2 < ends[owner]  # not across two texts
        out[owner[inside], self.order[place[inside]]] = True
        return out

    def matching(self, query: Query, postings: np.ndarray) -> np.ndarray:
        """Which texts satisfy the query: intersections and unions of posting lists."""
        if isinstance(query, bool):
            return np.full(len(postings), query)
        if isinstance(query, str):
            return postings[:, self.number[query]]
        parts = [self.matching(q, postings) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


#: The stored postings lie in so many folders by ranges of trigrams, and each range in so many files at least.
RANGES, FILES = 16, 4
_IDS = -1


def _bytes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in a row, ASCII letters in lower case, and where each text ends."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(data).lower(), np.uint8).astype(np.uint64), np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))


def _range_of(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).astype(np.int64) % RANGES


def store_index(texts: DataFrame, folder: str) -> None:
    """Write the index of texts (id bigint, text) to a folder: rows (block, range, payload), where the payload holds the
    (trigram, text) pairs of one range, or, for range -1, the ids of the block's texts."""

    def build(batches):
        task = TaskContext.get().partitionId()
        for number, (batch, part) in enumerate(text_batches(batches)):
            b, ends = _bytes_of(part)
            rows = [(_IDS, zlib.compress(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), 1))]
            if len(b) >= 3:
                at = np.arange(len(b) - 2)
                owner = np.searchsorted(ends, at, "right")
                pairs = np.unique(((b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) << np.uint64(32) | owner.astype(np.uint64))[at + 2 < ends[owner]])
                where = _range_of(pairs >> np.uint64(32))
                for r in np.unique(where).tolist():
                    rows.append((r, zlib.compress(np.ascontiguousarray(np.diff(pairs[where == r], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)))
            block = (task << 32) | number
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r for r, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["block", "range", "payload"])

    made = texts.where("id is not null").select("id", "text").mapInArrow(build, "block bigint, range int, payload binary")
    made.repartition("range", F.col("block") % FILES).write.partitionBy("range").parquet(folder)


def candidates(spark: SparkSession, folder: str, queries: dict[str, Query]) -> DataFrame:
    """(id, names) of the texts that satisfy any of the queries, by the stored index alone: only the folders of the
    queries' trigrams are read, and of these only their postings travel."""
    grams = sorted(set().union(*map(grams_of, queries.values())))
    codes = np.array([g[0] << 16 | g[1] << 8 | g[2] for g in (x.encode() for x in grams)], np.uint64)
    wanted = [_IDS, *np.unique(_range_of(codes)).tolist()]
    number = {g: i for i, g in enumerate(grams)}

    def pick(batches):
        for batch in batches:
            rows = []
            for block, r, payload in zip(*(c.to_pylist() for c in batch.columns)):
                data = zlib.decompress(payload)
                if r != _IDS:
                    pairs = np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)
                    data = pairs[np.isin(pairs >> np.uint64(32), codes)].tobytes()
                rows.append((block, r, zlib.compress(data, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))], ["block", "range", "payload"])

    def answer(rows):
        ids = np.frombuffer(zlib.decompress(next(p for r, p in rows if r == _IDS)), "<i8")
        held = np.zeros((len(ids), len(grams)), bool)
        for r, p in rows:
            if r != _IDS:
                pairs = np.frombuffer(zlib.decompress(p), "<u8")
                held[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(codes_sorted, pairs >> np.uint64(32))] = True
        held = held[:, back]
        index = TrigramIndex.__new__(TrigramIndex)
        index.number = number
        hits = {k: index.matching(q, held) for k, q in queries.items()}
        at = np.flatnonzero(np.logical_or.reduce(list(hits.values()))) if hits else []
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([[k for k, h in hits.items() if h[i]] for i in at], pa.list_(pa.string()))], ["id", "names"])

    order = np.argsort(codes)
    codes_sorted, back = codes[order], np.argsort(order)

    def match(batches):
        held, key = [], None
        for batch in batches:
            for block, r, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if block != key:
                    if held:
                        yield from answer(held)
                    held, key = [], block
                held.append((r, payload))
        if held:
            yield from answer(held)

    stored = spark.read.schema("block bigint, payload binary, range int").parquet(folder).where(F.col("range").isin(wanted)).select("block", "range", "payload")
    picked = stored.mapInArrow(pick, "block bigint, range int, payload binary")
    return picked.repartition("block").sortWithinPartitions("block").mapInArrow(match, "id bigint, names array<string>")
