"""Reports: what is indexed per project, latencies, coverage, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.operators.authority import UNCITED
from tesserine.operators.ordered import ordered, with_rank

#: Latency percentiles rest on so many of the latest samples.
LATENCY_WINDOW = 4096
OFFENDERS = 5


def status_counts(projects: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(project_id, files, chunks, embedded, violating_files) of every project, and where decisions (project_id, id), the
    active ones, are given, active_decisions.

    Each table is reduced to one row per project first, so the joins carry a row per project only. Repeated rows count
    once; a file counts by its path, a chunk by its id."""
    id_ = F.col("project_id")
    f = files.groupBy(id_).agg(F.count_distinct("path").alias("files"))
    c = chunks.groupBy(id_).agg(F.count_distinct("id").alias("chunks"), F.count_distinct(F.when(F.col("demotion") == UNCITED, F.col("path"))).alias("violating_files"))
    v = vectors.groupBy(id_).agg(F.count_distinct("chunk_rowid").alias("embedded"))
    rows = projects.select(F.col("id").alias("project_id")).join(f, "project_id", "left").join(c, "project_id", "left").join(v, "project_id", "left")
    names = ["files", "chunks", "embedded", "violating_files"]
    if decisions is not None:
        rows = rows.join(decisions.groupBy(id_).agg(F.count_distinct("id").alias("active_decisions")), "project_id", "left")
        names.append("active_decisions")
    return rows.select("project_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def top_offenders(chunks: DataFrame, per_project: int = OFFENDERS) -> DataFrame:
    """(project_id, path, place): the first violating paths of each project, in path order."""
    paths = chunks.where(F.col("demotion") == UNCITED).select("project_id", "path").distinct()
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("path"))
    return paths.withColumn("place", place).where(F.col("place") <= per_project)


def percent(part: Column, whole: Column) -> Column:
    """A rounded percentage, 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole).cast("int")).otherwise(0)


def fleet_totals(counts: DataFrame) -> DataFrame:
    """One row: chunks, embedded, coverage in per cent."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counts.agg(total("chunks").alias("chunks"), total("embedded").alias("embedded")).withColumn("coverage", percent(F.col("embedded"), F.col("chunks")))


def latency_percentiles(samples: DataFrame, label: str, at: str, value: str, window: int = LATENCY_WINDOW) -> DataFrame:
    """(label, n_total, n, p50, p90, p95, p99, max): nearest-rank percentiles over each label's latest samples.

    Null values are no samples. The latest are taken by (at, value), so ties have one outcome."""
    rows = samples.where(F.col(value).isNotNull()).select(F.col(label).alias("label"), F.col(at).alias("at"), F.col(value).alias("value"))
    latest = rows.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("at"), F.desc("value")))).where(F.col("_r") <= window)
    cut = [F.expr(f"percentile_disc({p}) within group (order by value)").alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)]
    totals = rows.groupBy("label").agg(F.count("*").alias("n_total"))
    return latest.groupBy("label").agg(F.count("*").alias("n"), *cut, F.max("value").alias("max")).join(totals, "label")


def client_percentiles(samples: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, mean, p50, p95, max) by the other common rule: the sample at index round(p (n - 1)) in order.

    The samples are put in order over ranges of (label, value), so a label with a third of them is no single task."""
    rows = samples.where(F.col(value).isNotNull()).select(F.col(label).alias("label"), F.col(value).alias("value"))
    numbered = with_rank(ordered(rows, ["label"], [F.col("value")], "samples"), ["label"])
    totals = numbered.groupBy("label").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    at = lambda p: F.max(F.when(F.col("rank") - 1 == F.bround(F.lit(p) * (F.col("n") - 1)), F.col("value")))
    picked = numbered.join(totals.select("label", "n"), "label").groupBy("label").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    return totals.join(picked, "label").select("label", "n", "mean", "p50", "p95", "max")


def throughput(batches: DataFrame) -> DataFrame:
    """(label, chunks, chunks_per_s, tokens_per_s, mb_per_s, p50_ms, p95_ms) of timed batches (label, chunks, tokens, bytes,
    started, ended, in seconds). p95 is the sample at index int(0.95 n)."""
    took = (F.col("ended") - F.col("started")).alias("took")
    rows = batches.select("*", took).withColumn("_i", F.row_number().over(Window.partitionBy("label").orderBy("took")) - 1)
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("label")))
    wall = F.max("ended") - F.min("started")
    rate = lambda c: F.when(wall > 0, F.sum(c) / wall)
    return rows.groupBy("label").agg(
        F.sum("chunks").alias("chunks"), rate("chunks").alias("chunks_per_s"), rate("tokens").alias("tokens_per_s"), (rate("bytes") / 1e6).alias("mb_per_s"),
        (F.median("took") * 1000).alias("p50_ms"), F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * 0.95), F.col("_n") - 1), F.col("took") * 1000)).alias("p95_ms"))


def uptake(returned: DataFrame, opened: DataFrame) -> DataFrame:
    """(session, returned, used): how many of the paths that searches returned to a session were opened there later.

    returned and opened: (session, path, at)."""
    first = returned.groupBy("session", "path").agg(F.min("at").alias("shown"))
    last = opened.groupBy("session", "path").agg(F.max("at").alias("seen"))
    rows = first.join(last, ["session", "path"], "left")
    return rows.groupBy("session").agg(F.count("*").alias("returned"), F.count_if(F.col("seen") > F.col("shown")).alias("used"))


def sample_fixture(chunks: DataFrame, n: int, clip_bytes: int) -> DataFrame:
    """Every k-th chunk in id order, n of them at most, with texts clipped to whole characters: a sampling operator for
    benchmarks. Positions come from a range sort, not from one task."""
    from tesserine.functions.text import truncate_utf8

    rows = with_rank(ordered(chunks.select("chunk_id", "project_id", "text"), [], [F.col("chunk_id")], "fixture"), [])
    step = max(1, rows.count() // max(1, n))
    picked = rows.where((F.col("rank") - 1) % step == 0).where(F.col("rank") <= step * n)
    return picked.select("chunk_id", "project_id", truncate_utf8(F.col("text"), F.lit(clip_bytes)).alias("text"))
