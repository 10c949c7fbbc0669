"""Words of many texts as 64-bit hashes, whole batches at a time.

Words are the maximal runs of letters, digits and `_` of the lower-cased text. Everything below works on arrays of
code points, so its cost per character is a few nanoseconds and no Python object is made for a word.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Characters that one call to hash works on; longer batches are cut between texts, a longer text is a piece of its own.
PIECE_CHARS = 1 << 20


@lru_cache(maxsize=1)
def _word_class() -> np.ndarray:
    """For each code point, whether it belongs to a word."""
    return np.fromiter((c == 95 or chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.full(1 << 12, _ODD, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """hashes: one per word, all texts in a row; starts: of text i the words are starts[i]:starts[i+1]; first, size:
    code points of each word in `chars`, the lower-cased code points of all texts in a row."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, first: np.ndarray, size: np.ndarray, chars: np.ndarray):
        self.hashes, self.starts, self.first, self.size, self.chars = hashes, starts, first, size, chars

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def word(self, i: int) -> str:
        return self.chars[self.first[i] : self.first[i] + self.size[i]].tobytes().decode("utf-32-le", "surrogatepass")

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n consecutive words within a text, and the starts of the texts in them."""
        h, total = self.hashes, len(self.hashes)
        per_text = np.maximum(self.counts - (n - 1), 0)
        starts = np.concatenate([[0], np.cumsum(per_text)])
        if total < n or not starts[-1]:
            return np.zeros(0, np.uint64), starts
        run = h[: total - n + 1].copy()
        for k in range(1, n):
            run = mix(run * _ODD + h[k : total - n + 1 + k])
        within = np.repeat(self.starts[:-1] - starts[:-1], per_text) + np.arange(starts[-1])
        return run[within], starts


def hash_words(texts: list[str | None]) -> Words:
    """The words of a piece of texts; null counts as empty."""
    lowered = [(t or "").lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    inside = _word_class()[chars] if len(chars) else np.zeros(0, bool)
    begins = inside.copy()
    if len(chars):
        begins[1:] &= ~inside[:-1]
        cut = bounds[:-1][lengths > 0]
        begins[cut] = inside[cut]  # a word never reaches from one text into the next
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), none, none, chars)
    heads = np.flatnonzero(begins[at])
    first = at[heads]
    size = np.diff(np.append(heads, len(at)))
    powers = _powers()
    offset = np.arange(len(at)) - np.repeat(heads, size)
    if size.max() > len(powers):  # very long words: positions beyond the table are folded in by another factor
        factor = powers[offset % len(powers)] * mix((offset // len(powers)).astype(np.uint64) + np.uint64(1))
    else:
        factor = powers[offset]
    hashes = mix(np.add.reduceat(mix(chars[at].astype(np.uint64) + np.uint64(1)) * factor, heads) + size.astype(np.uint64))
    starts = np.searchsorted(first, bounds)
    return Words(hashes, starts, first, size, chars)


def pieces(texts: list[str | None]):
    """Slices of a list of texts, each of about PIECE_CHARS characters."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= PIECE_CHARS:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def text_batches(batches, text: str = "text"):
    """For Arrow batches: (piece of the batch, its texts as a list), in pieces of bounded size."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        for piece in pieces(texts):
            yield pa.RecordBatch.slice(batch, piece.start, piece.stop - piece.start), texts[piece]


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed numbers that Spark holds."""
    return x.view(np.int64)
