"""Evaluation texts in training documents, literal or re-parameterised.

Words of items and documents are canonicalised: numbers, units and names become typed placeholders. Windows of
`window` canonical words are hashed and hash-joined; a joined window is then checked for slot consistency: equal
values on one side must stand where equal values stand on the other. A window whose words are all equal is a literal
leak, one that is only consistent is a re-parameterised one. What a word becomes depends on its lower-case form
alone, so literal leaks can never be lost by canonicalisation.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.words import Words, hash_words, mix, signed, text_batches

#: Units of measure that stand for one another.
UNITS = """b bit bits byte bytes cent cm cpus day days gb gib ghz hour hours hz kb kg khz kib km m mb mhz mib min minute
minutes mm ms month months ns percent pixels px s sec second seconds tb tib us week weeks year years""".split()
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (11, 12, 13))
#: Words of a window that must stay as they are for it to be matched as a template.
MIN_PLAIN = 5
#: Items are hashed into every task if they have at most so many windows; more are joined by shuffle, with the same rows.
BROADCAST_WINDOWS = 2_000_000
#: The plain vocabulary goes to every task as hashes of 8 bytes; more words than this are refused (128 MB).
MAX_VOCABULARY = 16_000_000
#: Matches that are judged at once.
_MATCHES = 1 << 18
FIELDS = "doc_id bigint, item_id bigint, literal_windows int, changed_windows int"


def plain_words(text: str) -> set[str]:
    """The words that a text has in plain lower case, digits and units aside."""
    return {w for w in _split(text) if w.islower() and "_" not in w and not any(map(str.isdigit, w))} - set(UNITS)


class Canon:
    """Which words stay as they are: the vocabulary, hashes of those that at least two items hold in plain lower case."""

    def __init__(self, vocabulary: np.ndarray):
        self.plain, self.units = np.sort(vocabulary), np.sort(_hashes(UNITS))

    @staticmethod
    def of(item_texts: list[list[str]]) -> Canon:
        held = Counter(w for texts in item_texts for w in set().union(*map(plain_words, texts)))
        return Canon(_hashes(sorted(w for w, n in held.items() if n >= 2)))

    def apply(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Canonical hashes of all words, and which of them are slots."""
        if not len(w.hashes):
            return w.hashes, np.zeros(0, bool)
        digit = (w.chars >= 48) & (w.chars <= 57)
        sums = np.concatenate([[0], np.cumsum(digit)])
        number = sums[w.first + w.size] - sums[w.first] == w.size
        unit, plain = _member(w.hashes, self.units), _member(w.hashes, self.plain)
        slot = number | unit | ~plain
        return np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(plain, w.hashes, _NAME))), slot


def _split(text: str) -> list[str]:
    return "".join(c if c == "_" or c.isalnum() else " " for c in text).split()


def _hashes(words: list[str]) -> np.ndarray:
    return hash_words([" ".join(words)]).hashes


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def consistent(doc: np.ndarray, item: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether, row by row, equal slot values stand in equal places; arrays of shape (rows, window)."""
    good = np.ones(len(doc), bool)
    for i in range(doc.shape[1]):
        for j in range(i):
            good &= ((doc[:, i] == doc[:, j]) == (item[:, i] == item[:, j])) | ~(slot[:, i] & slot[:, j])
    return good


def _windows(w: Words, canon: Canon, n: int, min_plain: int):
    """Template hash, and number of the first word, of every window of n words."""
    codes, slot = canon.apply(w)
    templates, starts = Words(codes, w.starts, w.first, w.size, w.chars).runs(n)
    first = np.repeat(w.starts[:-1] - starts[:-1], np.diff(starts)) + np.arange(len(templates))
    if len(templates):
        plain = np.concatenate([[0], np.cumsum(~slot)])
        bare = plain[first + n] - plain[first] < min_plain
        templates = np.where(bare, mix(w.runs(n)[0]), templates)
    return templates, starts, first, slot


class ItemIndex:
    """The windows of all items, sorted by template hash."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, min_plain: int = MIN_PLAIN):
        self.window, self.min_plain, self.canon = window, min_plain, Canon.of([t for _, t in items])
        texts = [x for _, part in items for x in part]
        owner = np.array([i for i, part in items for _ in part], np.int64)
        w = hash_words(texts)
        templates, starts, first, slot = _windows(w, self.canon, window, min_plain)
        order = np.argsort(templates, kind="stable")
        self.templates, self.items = templates[order], np.repeat(owner, np.diff(starts))[order]
        self.words, self.slots = (x[first[order][:, None] + np.arange(window)] if len(order) else np.zeros((0, window), x.dtype) for x in (w.hashes, slot))

    def match(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item, literal) of every window of the texts that is a literal or consistent match."""
        templates, starts, first, _ = _windows(w, self.canon, self.window, self.min_plain)
        low, high = np.searchsorted(self.templates, templates, "left"), np.searchsorted(self.templates, templates, "right")
        at = np.flatnonzero(high > low)
        total = np.cumsum((high - low)[at])
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        for some in np.split(at, np.searchsorted(total, np.arange(_MATCHES, total[-1], _MATCHES), "right")) if len(at) else []:
            times = (high - low)[some]
            for shift in range(0, int(times.max(initial=0)), _MATCHES):  # of a window that very many items hold, a part at a time
                n = np.clip(times - shift, 0, _MATCHES)
                mine = np.repeat(low[some] + shift, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                owner = np.repeat((np.searchsorted(starts, some, "right") - 1), n)
                words = w.hashes[np.repeat(first[some], n)[:, None] + np.arange(self.window)]
                out.append(_judge(words, self.words[mine], self.slots[mine], owner, self.items[mine]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _judge(doc, item, slot, owner, items):
    literal = (doc == item).all(axis=1)
    good = literal | consistent(doc, item, slot)
    return owner[good], items[good], literal[good]


def _count(owner, items, literal):
    """Rows (owner, item, literal windows, other windows)."""
    pairs, at = np.unique(np.stack([owner, items]), axis=1, return_inverse=True)
    at = at.reshape(-1)
    n = pairs.shape[1]
    return pairs[0], pairs[1], np.bincount(at, literal, n).astype(np.int32), np.bincount(at, ~literal, n).astype(np.int32)


def find_leaks(documents: DataFrame, items: DataFrame, window: int = 12, min_plain: int = MIN_PLAIN, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, literal_windows, changed_windows): how many windows of the document match the item.

    documents: (doc_id, text); items: (item_id, text), several rows per item for its several texts. Only pairs with a
    match come out, each once if the doc_ids are unique. Null ids and null or short texts match nothing; items may
    share texts, then all of them are reported. Documents are never shuffled while the items are few enough."""
    items = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    documents = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    bound = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]  # a text has fewer windows than characters
    if bound // 2 > broadcast_windows:
        return _find_by_shuffle(documents, items, window, min_plain)
    texts: dict[int, list[str]] = {}
    for r in items.orderBy("item_id", "text").collect():
        texts.setdefault(r["item_id"], []).append(r["text"])
    index = documents.sparkSession.sparkContext.broadcast(ItemIndex(list(texts.items()), window, min_plain))

    def scan(batches):
        for batch, part in text_batches(batches):
            owner, item, literal, changed = _count(*index.value.match(hash_words(part)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(item), pa.array(literal), pa.array(changed)], ["doc_id", "item_id", "literal_windows", "changed_windows"])

    return documents.mapInArrow(scan, FIELDS)


def _vocabulary(items: DataFrame) -> np.ndarray:
    """Hashes of the plain words of at least two items, told by the same tokeniser as everywhere."""

    def words(batches):
        for batch, part in text_batches(batches):
            held = [sorted(plain_words(t or "")) for t in part]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(signed(_hashes([w for h in held for w in h])))], ["item_id", "word"])

    shared = items.mapInArrow(words, "item_id bigint, word bigint").distinct().groupBy("word").agg(F.count("*").alias("n")).where("n >= 2").select("word")
    found = shared.limit(MAX_VOCABULARY + 1).toArrow().column("word").to_numpy()
    if len(found) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} plain words in the items")
    return found.view(np.uint64)


def _find_by_shuffle(documents: DataFrame, items: DataFrame, window: int, min_plain: int) -> DataFrame:
    """find_leaks for item sets too large to send to every task: both sides' windows meet by template hash."""
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(Canon(_vocabulary(items)))

    def explode(batches):
        for batch, part in text_batches(batches):
            w = hash_words(part)
            templates, starts, first, slot = _windows(w, shared.value, window, min_plain)
            for a in range(0, len(templates), 100_000):
                f = first[a : a + 100_000, None] + np.arange(window)
                owner = np.searchsorted(starts, np.arange(a, a + len(f)), "right") - 1
                blobs = [[r.tobytes() for r in x[f]] for x in (w.hashes, slot)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(signed(templates[a : a + len(f)])), *(pa.array(x, pa.binary()) for x in blobs)], ["id", "template", "words", "slots"])

    kind = "id bigint, template bigint, words binary, slots binary"
    mine = documents.mapInArrow(explode, kind).select("id", "template", F.col("words").alias("mine"))
    theirs = items.mapInArrow(explode, kind).distinct().withColumnRenamed("id", "item_id")

    def judge(batches):
        for b in batches:
            get = lambda i, t: np.frombuffer(b"".join(b.column(i).to_pylist()), t).reshape(-1, window)
            o, i, lit = _judge(get(2, np.uint64), get(3, np.uint64), get(4, bool), *(b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(i, pa.int64()), pa.array(lit)], ["doc_id", "item_id", "literal"])

    pairs = mine.join(theirs, "template").select("id", "item_id", "mine", "words", "slots")
    return pairs.mapInArrow(judge, "doc_id bigint, item_id bigint, literal boolean").groupBy("doc_id", "item_id").agg(
        F.count_if("literal").cast("int").alias("literal_windows"), F.count_if(~F.col("literal")).cast("int").alias("changed_windows"))
