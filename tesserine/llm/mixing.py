"""Mixing sources to target weights by weighted fair queueing.

Every document, in a shuffled order of its source, gets a virtual finish time: the tokens of its source up to and with
it, divided by the source's target weight. Serving all sources in the order of that time gives each one its share at
every point. Repeats continue a source's clock, at most max_repeats uses per document. The order is cut where the
total budget is reached.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.words import text_batches
from tesserine.operators.ordered import ordered, with_running_sum
from tesserine.sources.durable import keep

#: Folder with the files of public tokenizers; the vocabulary is read there, on each machine, and never copied.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The split pattern that goes with the vocabulary (a fixed value of the public byte-level tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_SOURCES = 100_000


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a vocabulary file of ranks; one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """`documents` with n_tokens (bigint) in place of text; null and empty texts have 0."""

    def count(batches):
        encode = encoder(path).encode_ordinary
        for batch, texts in text_batches(batches):
            n = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, pa.field("n_tokens", pa.int64()), n)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name != "text" else "n_tokens bigint" for f in documents.schema)
    return documents.mapInArrow(count, fields)


def source_key(column: str) -> Column:
    """A source's name without regard to case and outer spaces."""
    return F.lower(F.trim(F.col(column)))


def _targets(targets: DataFrame) -> DataFrame:
    """One row per source with a positive weight; spellings of one source are added up. Null max_repeats means 1."""
    t = targets.select(source_key("source").alias("source"), "weight", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    return t.where("source is not null and weight > 0 and max_repeats > 0").groupBy("source").agg(
        F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


def horizon(sources: list[tuple[float, int, int, int]], budget: int) -> float:
    """A virtual time by which the budget is surely spent: sources as (weight, tokens, repeats, largest document).

    Source i has served at least min(w*v - largest, tokens*repeats) tokens by the time v; that sum, piecewise linear in
    v, is brought to the budget by bisection. Infinite if all sources together cannot fill it."""
    if sum(t * r for _, t, r, _ in sources) <= budget:
        return float("inf")
    served = lambda v: sum(min(max(w * v - big, 0), t * r) for w, t, r, big in sources)
    low, high = 0.0, max((t * r + big) / w for w, t, r, big in sources)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if served(mid) >= budget else (mid, high)
    return high


def reachable_budget(sources: list[tuple[float, int, int, int]]) -> int:
    """The largest total at which no source runs dry, so that every source with documents has its share of the weights
    of those that have any. sources: as for horizon."""
    whole = sum(w for w, *_ in sources)
    return min((int(t * r * whole / w) for w, t, r, _ in sources), default=0)


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0, tokenizer: str = f"{TOKENIZERS}/{VOCABULARY}") -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    documents: (doc_id, source, text); targets: (source, weight, max_repeats). budget: total tokens, by default as many
    as all targets can be held at (reachable_budget). Mixture: (position, doc_id, copy, source, n_tokens, finish), a row per use, in
    serving order; the longest prefix that does not exceed the budget. Report: a row per source of either table with
    target and actual shares. With a larger budget a source runs dry when its documents have been used max_repeats times;
    the others then share the rest by their weights, and the report shows the deviation. Null sources and sources without a target are not used; documents without a token
    take no part. Repeated rows are documents of their own."""
    wanted = _targets(targets)
    if wanted.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with a target")
    docs = keep(token_counts(documents.select("doc_id", "source", "text"), tokenizer).withColumn("source", source_key("source")), "token-counts")
    usable = docs.where("source is not null and n_tokens > 0 and doc_id is not null").join(F.broadcast(wanted), "source")
    order = [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id")]
    queued = with_running_sum(ordered(usable, ["source"], order, "source-queues"), ["source"], "n_tokens", "cumulative")
    queued = queued.select("doc_id", "source", "n_tokens", "weight", "max_repeats", "cumulative")
    totals = usable.groupBy("source", "weight", "max_repeats").agg(F.sum("n_tokens").alias("total"), F.max("n_tokens").alias("largest"))
    sums = totals.collect()  # at most MAX_SOURCES rows
    sources = [(r["weight"], r["total"], r["max_repeats"], r["largest"]) for r in sums]
    budget = reachable_budget(sources) if budget is None else budget
    until = horizon(sources, budget)
    spark = documents.sparkSession
    clock = spark.createDataFrame([(r["source"], r["total"]) for r in sums], "source string, source_total bigint")
    start = F.col("cumulative") / F.col("weight")
    lap = F.col("source_total") / F.col("weight")
    # In doubles, where a horizon without end stays one; as a number of uses it is at most max_repeats.
    laps = F.least(F.col("max_repeats").cast("double"), (F.lit(until) * (1 + 1e-9) - start) / lap + 1.0).cast("int")
    used = (
        queued.join(F.broadcast(clock), "source").withColumn("_laps", laps).where("_laps > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_laps"))))
        .withColumn("finish", ((F.col("copy") - 1) * F.col("source_total") + F.col("cumulative")) / F.col("weight"))
        .select("doc_id", "copy", "source", "n_tokens", "finish")
    )
    served = ordered(used, [], [F.col("finish"), F.col("source"), F.col("doc_id"), F.col("copy")], "served")
    mixture = with_running_sum(served, [], "n_tokens", "position").where(F.col("position") <= budget)
    mixture = mixture.select("position", "doc_id", "copy", "source", "n_tokens", "finish")
    return mixture, _report(docs, wanted, mixture)


def _report(docs: DataFrame, wanted: DataFrame, mixture: DataFrame) -> DataFrame:
    """(source, target_share, reachable_share, available_tokens, used_tokens, uses, max_copy, actual_share, deviation).

    reachable_share: the target among the sources that have documents; deviation: the actual share less that one."""
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("uses"), F.max("copy").alias("max_copy"))
    rows = have.where("source is not null").join(wanted, "source", "full").join(got, "source", "left")
    reach = F.when(F.col("available_tokens") > 0, F.col("weight"))
    whole = rows.agg(F.sum("weight").alias("_w"), F.sum(reach).alias("_r"), F.sum("used_tokens").alias("_t"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    share = lambda a, b: F.coalesce(a / F.col(b), F.lit(0.0))
    reached, actual = share(reach, "_r"), share(F.col("used_tokens"), "_t")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(
        "source", share(F.col("weight"), "_w").alias("target_share"), reached.alias("reachable_share"), zero("available_tokens"), zero("used_tokens"),
        zero("uses"), zero("max_copy"), actual.alias("actual_share"), (actual - reached).alias("deviation"))
