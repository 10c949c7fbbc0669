"""Change events as a stream: routing, coalescing, and index passes per micro-batch.

A micro-batch stands for the quiet period of an interactive watcher: its trigger interval is the debounce. Lost detail is no
error here; whatever cannot be told apart ends in a full pass of the project, so no watermark and no state is needed beyond
one batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: More paths of one project than this in a batch become a full pass.
MAX_PATHS = 4096
DEBOUNCE_SECONDS = 20
IGNORE_FILES = (".gitignore", ".indexignore")
PROJECT_FILE = ".index.toml"
EVENT_FIELDS = "project_id long, path string, kind string, override boolean"


def route(events: DataFrame) -> DataFrame:
    """(project_id, path, scope, override) of events (project_id, path, kind, override).

    scope: `reload` for the project's own settings file at its root, `full` for an ignore file anywhere or a lost-events
    mark (`rescan`; without a project it goes to all that the batch names), `path` else. Accesses and anything under .git
    come to nothing."""
    name = F.element_at(F.split("path", "/"), -1)
    git = F.exists(F.split(F.coalesce("path", F.lit("")), "/"), lambda p: F.lower(p) == ".git")
    scope = (
        F.when(F.col("kind") == "rescan", "full").when(F.col("path") == PROJECT_FILE, "reload")
        .when(name.isin(*IGNORE_FILES), "full").otherwise("path")
    )
    rows = events.where((F.col("kind") != "access") & ((F.col("kind") == "rescan") | (F.col("path").isNotNull() & ~git)))
    return rows.select("project_id", F.when(scope == "path", F.col("path")).alias("path"), scope.alias("scope"), F.coalesce("override", F.lit(False)).alias("override"))


def coalesce(routed: DataFrame, max_paths: int = MAX_PATHS) -> DataFrame:
    """(project_id, scope, paths, override), one row per project: `full` or `reload` swallow the paths, more than max_paths
    become `full`, overrides add up. Counting precedes collecting, so a list never exceeds the bound."""
    once = routed.groupBy("project_id", "path").agg(F.max(F.when(F.col("scope") == "reload", 2).when(F.col("scope") == "full", 1).otherwise(0)).alias("s"), F.max("override").alias("override"))
    sums = once.groupBy("project_id").agg(F.count("path").alias("n"), F.max("s").alias("s"), F.max("override").alias("override"))
    sums = sums.withColumn("scope", F.when(F.col("s") == 2, "reload").when((F.col("s") == 1) | (F.col("n") > max_paths), "full").otherwise("path"))
    small = once.where("path is not null").join(sums.where("scope = 'path'").select("project_id"), "project_id", "left_semi")
    lists = small.groupBy("project_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return sums.join(lists, "project_id", "left").select("project_id", "scope", "paths", "override")


def all_projects(work: DataFrame, projects: DataFrame) -> DataFrame:
    """Spreads a rescan without a project over all projects."""
    lost = work.where("project_id is null").select("scope", "paths", "override")
    everywhere = projects.select(F.col("id").alias("project_id")).join(lost.limit(1))
    named = work.where("project_id is not null").join(everywhere.select("project_id"), "project_id", "left_anti")
    return named.unionByName(everywhere.select(*work.columns))


def run_stream(events: DataFrame, handle: Callable[[SparkSession, DataFrame, int], None], checkpoint: str, once: bool = False, seconds: int = DEBOUNCE_SECONDS) -> StreamingQuery:
    """Start the stream: each micro-batch is routed, coalesced and handed to `handle(spark, work, batch id)`.

    Offsets and batch plans are written ahead in `checkpoint`; after a failure the same batch comes again with the same id,
    so a handler that publishes through the store, or a DedupSink, repeats nothing."""

    def batch(df: DataFrame, number: int) -> None:
        handle(df.sparkSession, coalesce(route(df)), number)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def keep_running(start: Callable[[], StreamingQuery], attempts: int = 0, sleep: Callable[[float], None] = time.sleep, first: float = 1.0, cap: float = 60.0) -> int:
    """Run a stream and start it again when it fails, after a wait that doubles with every failure in a row up to `cap`.

    The checkpoint brings the interrupted batch again. Ends when the stream is stopped, or raises its error after
    `attempts` failures in a row (0: never). A stream that has made a batch since its start counts as recovered. Returns the
    number of restarts."""
    restarts = failures = 0
    while True:
        query = None
        try:
            query = start()
            query.awaitTermination()
            return restarts
        except Exception:
            failures = 1 if query is not None and query.lastProgress else failures + 1
            if attempts and failures >= attempts:
                raise
            sleep(min(cap, first * 2 ** (failures - 1)))
            restarts += 1


def tool_events(lines: DataFrame) -> DataFrame:
    """(tool, seconds, at) of an event log, one JSON object per line: uses of tools that have a beginning and an end."""
    parsed = lines.select(F.from_json("value", "tool string, started double, ended double").alias("e")).select("e.*")
    return parsed.where("tool is not null and ended >= started").select("tool", (F.col("ended") - F.col("started")).alias("seconds"), F.col("started").alias("at"))
