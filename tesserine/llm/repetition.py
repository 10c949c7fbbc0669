"""Repetition inside single documents, with cutoffs whose risk of a false rejection is bounded.

The measures are exact and need no shuffle: every document is measured where it is read. Cutoffs come from labelled
holdouts by exact binomial tests: within a stratum cutoffs are tested from the strictest downwards until one fails
(fixed-sequence testing), and the error level is divided among the strata (Bonferroni), so that with probability
1 - delta no stratum's chosen cutoff rejects more than the share alpha of its clean documents.

The labels of the holdout do not come from the score that is cut: the score is the share of repeated word runs, a
document is labelled by its repeated lines, sentences and paragraphs, or by labels of the caller.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.words import Words, hash_words, mix, text_batches
from tesserine.sources.durable import keep

MEASURES = "n_words bigint, n_runs bigint, distinct_runs bigint, run_share double, line_share double, sentence_share double, paragraph_share double"
REPORT = pa.schema({"stratum": pa.string(), "cutoff": pa.float64(), "certified": pa.bool_(), "clean": pa.int64(), "rejected": pa.int64(), "risk_bound": pa.float64(), "missed": pa.int64()})
#: Cutoffs that calibration may choose from.
CUTOFFS = [i / 100 for i in range(5, 100)]
#: A document is labelled repetitive if so much of it stands in repeated lines, sentences or paragraphs, and clean if at
#: most so much does; between the two it has no label.
LABEL_REPETITIVE, LABEL_CLEAN = 0.3, 0.05


def _distinct_per_text(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[fresh], minlength=len(starts) - 1)


def _segment_share(w: Words, cuts: np.ndarray) -> np.ndarray:
    """Per text the share of its words that stand in a repeat of an earlier segment; cuts: a number that changes from
    one segment to the next, per word."""
    texts = len(w.starts) - 1
    share = np.zeros(texts)
    if not len(w.hashes):
        return share
    owner = np.repeat(np.arange(texts), w.counts)
    head = np.ones(len(cuts), bool)
    head[1:] = (cuts[1:] != cuts[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(head)
    length = np.diff(np.append(heads, len(cuts)))
    place = (np.arange(len(cuts)) - np.repeat(heads, length)).astype(np.uint64)
    segment = np.add.reduceat(mix(w.hashes + mix(place + np.uint64(1))), heads)
    order = np.lexsort((np.arange(len(heads)), segment, owner[heads]))
    s, o = segment[order], owner[heads][order]
    again = np.zeros(len(s), bool)
    again[1:] = (s[1:] == s[:-1]) & (o[1:] == o[:-1])
    repeated = np.bincount(o[again], weights=length[order][again], minlength=texts)
    return repeated / np.maximum(w.counts, 1)


def _cuts(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the line, sentence and paragraph of each word."""
    c = w.chars
    newline = c == 10
    solid = ~np.isin(c, (9, 10, 13, 32))
    lines = np.cumsum(newline | (c == 13))
    stop = np.isin(c, (33, 46, 63, 0x3002))
    ends = np.zeros(len(c), bool)
    if len(c):
        ends[:-1] = stop[:-1] & ~solid[1:]
        ends[-1] = stop[-1]
    sentences = np.cumsum(ends | newline)
    seen = np.cumsum(newline)
    at = np.flatnonzero(solid)
    gap = np.zeros(len(c), np.int64)
    if len(at):
        gap[at[1:]] = np.diff(seen[at]) >= 2
    return lines[w.first], sentences[w.first], np.cumsum(gap)[w.first]


def measure_repetition(documents: DataFrame, id_column: str = "doc_id", text: str = "text", run: int = 5) -> DataFrame:
    """One row per input row: the id, MEASURES. A null or empty text has no words and shares of 0.

    run_share: 1 - distinct runs of `run` words / all of them, 0 where there is no run. The other shares: words that
    stand in repeats of an earlier line, sentence or paragraph of the same words, over all words. Whole texts are
    measured; repeated rows come out as often as they go in."""

    def measure(batches):
        for batch, part in text_batches(batches):
            w = hash_words(part)
            runs, starts = w.runs(run)
            n, d = np.diff(starts), _distinct_per_text(runs, starts)
            shares = [_segment_share(w, cut) for cut in _cuts(w)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(w.counts), pa.array(n), pa.array(d.astype(np.int64)), pa.array((n - d) / np.maximum(n, 1)), *map(pa.array, shares)],
                ["id", *(f.split()[0] for f in MEASURES.split(", "))])

    kind = documents.schema[id_column].dataType.simpleString()
    rows = documents.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(measure, f"id {kind}, {MEASURES}").withColumnRenamed("id", id_column)


def _stirling_error(n: int) -> float:
    """log n! less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * m)) / m) / m) / n


def _log_chance(k: int, n: int, p: float) -> float:
    """log P(X = k) for X ~ Binomial(n, p), by deviances: factorials of large n would cancel to few digits."""
    if k in (0, n):
        return n * (math.log(p) if k else math.log1p(-p))
    low, high = n * p, n * (1 - p)
    deviance = k * math.log1p((k - low) / low) + (n - k) * math.log1p((low - k) / high)
    return 0.5 * math.log(n / (2 * math.pi * k * (n - k))) + _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - deviance


def _falling_sum(ratio: Callable[[np.ndarray], np.ndarray], n: int, block: int = 1024) -> float:
    """1 + r(0) + r(0) r(1) + ..., of n falling ratios below 1, as far as doubles can tell the sum."""
    total, last, at = 1.0, 1.0, 0
    while at < n and last > 1e-18 * total:
        terms = last * np.cumprod(ratio(np.arange(at, min(at + block, n), dtype=float)))
        total, last, at = total + float(terms.sum()), float(terms[-1]), at + len(terms)
    return total


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), by exact summation away from the mean, over some sqrt(n) terms at most."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    q = 1 - p
    if k < n * p:
        return min(1.0, math.exp(_log_chance(k, n, p)) * _falling_sum(lambda i: (k - i) * q / ((n - k + 1 + i) * p), k))
    above = math.exp(_log_chance(k + 1, n, p)) * _falling_sum(lambda i: (n - k - 1 - i) * p / ((k + 2 + i) * q), n - k - 1)
    return max(0.0, 1 - above)


@functools.lru_cache(10_000)
def risk_bound(k: int, n: int, level: float) -> float:
    """The exact upper bound, at this level, of the chance of an event that happened k times in n."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > level else (low, mid)
    return high


def calibrate(clean: dict[str, dict[float, int]], totals: dict[str, int], cutoffs: list[float], alpha: float, delta: float) -> dict[str, tuple[float, bool]]:
    """Per stratum (cutoff, whether it is certified).

    clean[s][c]: clean holdout documents of stratum s that cutoff c would reject; totals[s]: all its clean ones.
    From the strictest cutoff down, a cutoff is accepted while P(Binomial(total, alpha) <= rejected) <= delta/strata.
    A stratum where even the strictest fails, for want of labels or because it is too noisy, gets the strictest,
    uncertified."""
    level = delta / max(1, len(totals))
    out = {}
    for s, n in totals.items():
        chosen, certified = max(cutoffs), False
        for c in sorted(cutoffs, reverse=True):
            if binomial_tail(clean.get(s, {}).get(c, 0), n, alpha) > level:
                break
            chosen, certified = c, True
        out[s] = (chosen, certified)
    return out


def stratum_of(lang: Column) -> Column:
    """The language by its primary subtag in lower case, `und` where it is unknown."""
    primary = F.lower(F.trim(F.regexp_extract(F.coalesce(lang, F.lit("")), r"^\s*([A-Za-z]+)", 1)))
    return F.when(primary == "", "und").otherwise(primary)


def segment_label() -> Column:
    """The label of a measured document by its repeated segments: true, false or none, see LABEL_REPETITIVE."""
    share = F.greatest("line_share", "sentence_share", "paragraph_share")
    return F.when(share >= LABEL_REPETITIVE, True).when(share <= LABEL_CLEAN, False)


def cutoff_report(scored: DataFrame, alpha: float = 0.01, delta: float = 0.05, cutoffs: list[float] = CUTOFFS) -> DataFrame:
    """(stratum, cutoff, certified, clean, rejected, risk_bound, missed), a row per stratum of the labelled holdout.

    scored: (stratum, score, label), label null where unlabelled; true means repetitive. The holdout is every labelled
    row. clean: its clean documents; rejected: those of them that the cutoff rejects; risk_bound: the exact bound of the
    share of clean documents that are; missed: repetitive documents of the holdout that the cutoff lets pass."""
    steps = sorted(cutoffs)
    passed = F.size(F.filter(F.array(*map(F.lit, steps)), lambda c: c <= F.col("score"))).alias("passed")
    counts = scored.where("label is not null").groupBy("stratum", "label", passed).count()
    listed = counts.groupBy("stratum").agg(F.collect_list(F.struct("label", "passed", "count")).alias("counts"))  # at most two for each step
    strata = keep(listed.where(F.exists("counts", lambda c: ~c["label"])), "strata")
    level = delta / max(1, strata.count())

    def judge(batches):
        for batch in batches:
            rows = []
            for s, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = {label: np.zeros(len(steps) + 1, np.int64) for label in (False, True)}
                for x in found:
                    at[x["label"]][x["passed"]] += x["count"]
                n, clean = int(at[False].sum()), {c: int(at[False][i + 1 :].sum()) for i, c in enumerate(steps)}
                c, certified = calibrate({s: clean}, {s: n}, steps, alpha, level)[s]
                rows.append((s, c, certified, n, clean[c], risk_bound(clean[c], n, level), int(at[True][: steps.index(c) + 1].sum())))
            yield pa.RecordBatch.from_pylist([dict(zip(REPORT.names, r)) for r in rows], REPORT)

    return strata.mapInArrow(judge, "stratum string, cutoff double, certified boolean, clean bigint, rejected bigint, risk_bound double, missed bigint")


def repetitive_documents(measured: DataFrame, report: DataFrame, strictest: float = max(CUTOFFS)) -> DataFrame:
    """The rows whose score reaches their stratum's cutoff, with `cutoff` and `certified`. A stratum without a certified
    cutoff, or without any, gets the strictest one. measured: has `stratum` and `score`."""
    table = report.where("certified").select("stratum", F.least("cutoff", F.lit(strictest)).alias("cutoff"), "certified")
    joined = measured.join(F.broadcast(table), "stratum", "left").fillna({"cutoff": strictest, "certified": False})  # hundreds of documents certify one row
    return joined.where("score >= cutoff")
