"""One ranking from several differently scaled scores.

Within each query every score is standardised robustly, (x - median) / (1.4826 * median absolute deviation), squashed
by the logistic function, so that an outlier cannot reach beyond (0, 1), and the bounded values are combined by a
weighted geometric mean over the scores that a candidate has.

Medians are exact at any size: a quantile sketch, mergeable and small, brackets the median between two values; what
stands below the bracket is counted and the few values inside it are put in order over the cluster. Whatever is known of
a query joins its candidates by (query, salt), so a hot query is spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators.ordered import ordered, with_rank, with_running_sum
from tesserine.sources.durable import keep

#: The sketch's rank error is the number of values over this; the bracket is twice as wide to either side.
ACCURACY = 10_000
SALTS = 32
#: The arms of the test tables: 1 if larger is better, -1 if smaller is.
ARMS = {"lexical": -1, "vector": 1, "anchor": 1, "usage": 1}


def candidate_scores(scored: DataFrame, arms: dict[str, int] = ARMS) -> DataFrame:
    """(query_id, chunk_rowid, s_<arm> ..., s_tier, _salt): one row per candidate, every score turned so that larger is
    better, written once. The salt parts the candidates of a query.

    Of several rows of one arm the latest scored_at counts (null is the earliest; on a tie the larger score); a null
    or NaN score, or a missing arm, is null here. tier: the largest one given. Other arms make a candidate but give it
    no score. Rows with a null query_id or chunk_rowid are left out."""
    rows = scored.where("query_id is not null and chunk_rowid is not null")
    latest = [F.max(F.when(F.col("arm") == a, F.struct("scored_at", "score"))).getField("score").alias(f"_{a}") for a in arms]
    wide = rows.groupBy("query_id", "chunk_rowid").agg(*latest, F.max("tier").cast("double").alias("s_tier"))
    wide = wide.withColumn("_salt", F.pmod(F.xxhash64("chunk_rowid"), F.lit(SALTS)).cast("int"))
    turned = [F.when(~F.isnan(f"_{a}"), F.col(f"_{a}") * sign + F.lit(0.0)).alias(f"s_{a}") for a, sign in arms.items()]
    return keep(wide.select("query_id", "chunk_rowid", *turned, "s_tier", "_salt"), "candidates")


def _salted(per_query: DataFrame) -> DataFrame:
    """A row per query and salt."""
    return per_query.select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))


def exact_medians(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(query_id, a column for each of values): the exact lower medians of the values that are not null, null where there
    are none. rows: with (query_id, _salt)."""
    names, width = list(values), 2.0 / ACCURACY
    base = rows.select("query_id", "_salt", *(v.alias(n) for n, v in values.items()))
    bracket = base.groupBy("query_id").agg(*(F.percentile_approx(n, F.array(F.lit(0.5 - width), F.lit(0.5 + width)), ACCURACY).alias(f"_b_{n}") for n in names))
    met = base.join(_salted(bracket), ["query_id", "_salt"])

    def entry(n: str) -> Column:
        """Below the bracket, in it with the value, or above."""
        x, b = F.col(n), F.col(f"_b_{n}")
        side = F.when(x < b[0], 0).when(x <= b[1], 1).otherwise(2)
        return F.when(x.isNotNull(), F.struct(F.lit(n).alias("name"), side.alias("side"), F.when(side == 1, x).alias("value")))

    entries = F.explode(F.filter(F.array(*map(entry, names)), lambda e: e.isNotNull())).alias("_e")
    counted = met.select("query_id", entries).groupBy("query_id", "_e.name", "_e.side", "_e.value").agg(F.count("*").alias("times"))
    group = ["query_id", "name"]
    ranked = with_running_sum(ordered(counted, group, [F.col("side"), F.col("value")], "medians"), group, "times", "upto")
    middle = ranked.join(ranked.groupBy(*group).agg(F.ceil(F.max("upto") / 2).alias("_place")), group).where("upto >= _place and upto - times < _place")
    return keep(middle.groupBy("query_id").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names)), "medians")


def fuse(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds `fused` in (0, 1), null for a candidate without any score. weights: by score column; candidates: as from
    candidate_scores.

    A score whose deviations have the median 0 is scaled by 1.2533 times their mean instead; if all are equal it is
    neutral (0.5). Infinite scores are squashed to the ends."""
    names = list(weights)
    mid = exact_medians(candidates, {n: F.col(n) for n in names}).withColumnsRenamed({n: f"_m_{n}" for n in names})
    with_mid = candidates.join(_salted(mid), ["query_id", "_salt"], "left")
    away = {n: F.abs(F.col(n) - F.col(f"_m_{n}")) for n in names}
    away = {n: F.when(~F.isnan(x), x) for n, x in away.items()}  # from an infinite median an infinite score is 0 away
    spread = exact_medians(with_mid, away).withColumnsRenamed({n: f"_d_{n}" for n in names})
    means = with_mid.groupBy("query_id").agg(*(F.avg(F.when(away[n] < float("inf"), away[n])).alias(f"_a_{n}") for n in names))
    full = with_mid.join(_salted(means.join(spread, "query_id", "left")), ["query_id", "_salt"])
    log, weight = F.lit(0.0), F.lit(0.0)
    for n, w in weights.items():
        scale = F.when(F.col(f"_d_{n}") > 0, 1.4826 * F.col(f"_d_{n}")).when(F.col(f"_a_{n}") > 0, 1.2533 * F.col(f"_a_{n}"))
        z = F.when(F.col(n) == F.col(f"_m_{n}"), 0.0).otherwise(F.coalesce((F.col(n) - F.col(f"_m_{n}")) / scale, F.lit(0.0)))
        # ln(logistic(z)), bounded so that no finite weight makes the mean vanish
        value = -F.log1p(F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        log = log + F.when(F.col(n).isNotNull(), w * value).otherwise(0.0)
        weight = weight + F.when(F.col(n).isNotNull(), w).otherwise(0.0)
    return full.select(*candidates.columns, F.when(weight > 0, F.round(F.exp(log / weight), 12)).alias("fused"))


def _weights(arms: dict[str, int], weights: dict[str, float] | None) -> dict[str, float]:
    return weights or {**{f"s_{a}": 1.0 for a in arms}, "s_tier": 1.0}


def ranking(scored: DataFrame, arms: dict[str, int] = ARMS, weights: dict[str, float] | None = None) -> DataFrame:
    """candidate_scores with `fused` and `rank` (1 is best) within each query; ties go to the smaller chunk_rowid,
    candidates without a score come last. An empty table gives an empty ranking."""
    fused = fuse(candidate_scores(scored, arms), _weights(arms, weights)).drop("_salt")
    rows = ordered(fused, ["query_id"], [F.col("fused").desc_nulls_last(), F.col("chunk_rowid")], "ranking")
    return with_rank(rows, ["query_id"])


def _beats(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a is better than b on more of the scores both have than the other way round; NaN is no score."""
    return (a > b).sum(axis=-1) > (a < b).sum(axis=-1)


def _champions(batches, names: list[str]):
    """For batches sorted by (query, rank): of each query the only row that may beat all others of these batches.

    The first candidate stays champion until it meets one that it does not beat; that one replaces it. A candidate
    that beats all others survives this from any start, so partitions can do it on their own and meet afterwards."""
    champion = None

    def row(c):
        return pa.RecordBatch.from_arrays([pa.array([c[0]], pa.int64()), pa.array([c[1]], pa.int64()), *(pa.array([v], pa.float64(), from_pandas=True) for v in c[2])], ["query_id", "chunk_rowid", *names])

    for b in batches:
        query, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        scores = np.stack([b.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))], axis=1)
        edges = np.flatnonzero(np.diff(query)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(query)]):
            if lo == hi:
                continue
            if champion is None or champion[0] != query[lo]:
                if champion is not None:
                    yield row(champion)
                champion, lo = (query[lo], ids[lo], scores[lo]), lo + 1
            while lo < hi:
                lost = np.flatnonzero(~_beats(champion[2], scores[lo:hi]) & (ids[lo:hi] != champion[1]))
                if not len(lost):
                    break
                lo += lost[0]
                champion, lo = (query[lo], ids[lo], scores[lo]), lo + 1
    if champion is not None:
        yield row(champion)


def winners(scored: DataFrame, arms: dict[str, int] = ARMS, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, chunk_rowid) of the candidates that beat every other candidate of their query; none where there is
    no such one, the only candidate where there is just one. Linear in the candidates: in every part of a query the
    candidates are knocked out in the order of their fused value, then the parts' champions are, and the last one is
    checked against all candidates."""
    names = [f"s_{a}" for a in arms] + ["s_tier"]
    kind = "query_id bigint, chunk_rowid bigint, " + ", ".join(f"{n} double" for n in names)
    fused = fuse(candidate_scores(scored, arms), _weights(arms, weights))
    plain = keep(fused.select("query_id", "chunk_rowid", *names, "fused", "_salt"), "fused")

    def knock_out(batches):
        yield from _champions(batches, names)

    first = [F.col("query_id"), F.col("fused").desc_nulls_last(), F.col("chunk_rowid")]
    local = plain.repartition("query_id", "_salt").sortWithinPartitions(*first).drop("fused", "_salt").mapInArrow(knock_out, kind)
    last = local.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(knock_out, kind)
    champion = last.select("query_id", F.col("chunk_rowid").alias("_c"), *(F.col(n).alias(f"_c_{n}") for n in names))
    met = plain.join(_salted(champion), ["query_id", "_salt"])
    sign = F.lit(0)
    for n in names:
        sign = sign + F.coalesce(F.when(F.col(f"_c_{n}") > F.col(n), 1).when(F.col(f"_c_{n}") < F.col(n), -1), F.lit(0))
    unbeaten = F.count_if((F.col("chunk_rowid") != F.col("_c")) & (sign <= 0)).alias("unbeaten")
    return met.groupBy("query_id", F.col("_c").alias("chunk_rowid")).agg(unbeaten).where("unbeaten = 0").select("query_id", "chunk_rowid")
