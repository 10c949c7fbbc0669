"""Retrieval quality: hit rates, reciprocal rank, nDCG, judged precision, calibration of judges.

Inputs are rows: runs (model, run_set, query_id, rank, path), keys (query_id, kind, path) of what is relevant, judgments
(query_id, path, label 0..2, at). Paths are compared without regard to case, and of several results with one path the first
counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["model", "query_id"]


def distinct_paths(runs: DataFrame) -> DataFrame:
    """(model, query_id, path, rank) with one row per path, numbered anew."""
    rows = runs.where("path is not null").groupBy(*RUN, F.lower("path").alias("path")).agg(F.min("rank").alias("_r"))
    return rows.select(*RUN, "path", F.row_number().over(Window.partitionBy(*RUN).orderBy("_r", "path")).alias("rank"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The rows of each model's latest run set."""
    last = runs.groupBy("model").agg(F.max("run_set").alias("run_set"))
    return runs.join(last, ["model", "run_set"], "left_semi")


def latest_labels(judgments: DataFrame) -> DataFrame:
    """(query_id, path, label): the last label given; on a tie the higher one."""
    rows = judgments.where("label is not null").groupBy("query_id", F.lower("path").alias("path"))
    return rows.agg(F.max(F.struct("at", "label")).getField("label").alias("label"))


def discount(rank: Column) -> Column:
    """The weight of a rank, 1-based, in discounted gain."""
    return 1.0 / F.log2(rank + 1)


def key_metrics(runs: DataFrame, keys: DataFrame, depth: int = 10) -> DataFrame:
    """(model, query_id, kind, first_rank, hit5, hit10, mrr10, ndcg10) of every model and query of the key.

    A query that a model did not answer counts as a miss. first_rank is null for a miss."""
    relevant = keys.select("query_id", F.lower("path").alias("path")).distinct()
    wanted = keys.groupBy("query_id").agg(F.max("kind").alias("kind"), F.count_distinct(F.lower("path")).alias("n_relevant"))
    found = distinct_paths(runs).where(F.col("rank") <= depth).join(relevant, ["query_id", "path"])
    per = found.groupBy(*RUN).agg(F.min("rank").alias("first_rank"), F.sum(discount(F.col("rank"))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(depth))), F.lit(0.0), lambda a, i: a + discount(i))
    rows = runs.select("model").distinct().crossJoin(wanted).join(per, RUN, "left")  # models x queries of the key: a report
    hit = lambda k: (F.coalesce(F.col("first_rank") <= k, F.lit(False))).cast("int")
    return rows.select(
        *RUN, "kind", "first_rank", hit(5).alias("hit5"), hit(10).alias("hit10"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr10"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg10"))


def judged_metrics(runs: DataFrame, judgments: DataFrame, depth: int = 10) -> DataFrame:
    """(model, query_id, p5, p10, strict_p5, coverage, graded_ndcg).

    Precision is over labelled results alone, null where none is labelled; strict counts label 2 only. Coverage is the
    labelled share of the results looked at. The graded gain of an unlabelled result is 0; the ideal is the best order of
    the query's own labels, null where none is positive."""
    labels = latest_labels(judgments)
    top = distinct_paths(runs).where(F.col("rank") <= depth).join(labels, ["query_id", "path"], "left")
    best = labels.withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("label"), "path"))).where(F.col("_i") <= depth)
    ideal = best.groupBy("query_id").agg(F.sum(F.col("label") * discount(F.col("_i"))).alias("ideal"))
    share = lambda least, k: F.avg(F.when(F.col("label").isNotNull() & (F.col("rank") <= k), (F.col("label") >= least).cast("double")))
    rows = top.groupBy(*RUN).agg(
        share(1, 5).alias("p5"), share(1, 10).alias("p10"), share(2, 5).alias("strict_p5"),
        (F.count("label") / F.least(F.count("*"), F.lit(depth))).alias("coverage"), F.sum(F.coalesce("label", F.lit(0)) * discount(F.col("rank"))).alias("_gain"))
    return rows.join(ideal, "query_id", "left").select(*RUN, "p5", "p10", "strict_p5", "coverage", F.when(F.col("ideal") > 0, F.col("_gain") / F.col("ideal")).alias("graded_ndcg"))


def macro(metrics: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Means over queries, nulls left out, rounded to 9 digits."""
    return metrics.groupBy(*by).agg(F.count("*").alias("queries"), *(F.round(F.avg(v), 9).alias(v) for v in values))


def by_kind(metrics: DataFrame, value: str = "hit10") -> DataFrame:
    """Mean value by model with a column per kind of query."""
    kinds = sorted(r["kind"] for r in metrics.select("kind").where("kind is not null").distinct().collect())  # a handful of names
    return metrics.groupBy("model").pivot("kind", kinds).agg(F.round(F.avg(value), 9))


def offenders(key: DataFrame, judged: DataFrame) -> DataFrame:
    """Queries to look at: missed, first hit beyond rank 5, or judged precision at 5 below 0.4; the worst first."""
    rows = key.join(judged.select(*RUN, "p5"), RUN, "left")
    bad = rows.where("first_rank is null or first_rank > 5 or p5 < 0.4")
    return bad.select(*RUN, "first_rank", "p5").orderBy(F.col("first_rank").desc_nulls_first(), F.col("p5").asc_nulls_last(), *RUN)


def calibration(keys: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row: key entries that were judged, judged at all relevant (>= 1), judged fully relevant (2)."""
    rows = keys.select("query_id", F.lower("path").alias("path")).distinct().join(latest_labels(judgments), ["query_id", "path"])
    return rows.agg(F.count("*").alias("judged"), F.count_if(F.col("label") >= 1).alias("relevant"), F.count_if(F.col("label") == 2).alias("full"))


def judging_pool(runs: DataFrame, judgments: DataFrame, hashes: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, path, content_hash): distinct results of any run that were not judged with their present content.

    hashes: (path, content_hash); judgments: (query_id, path, content_hash, ...)."""
    top = distinct_paths(runs).where(F.col("rank") <= depth).select("query_id", "path").distinct()
    now = hashes.select(F.lower("path").alias("path"), "content_hash").distinct()
    done = judgments.select("query_id", F.lower("path").alias("path"), "content_hash")
    return top.join(now, "path").join(done, ["query_id", "path", "content_hash"], "left_anti")
