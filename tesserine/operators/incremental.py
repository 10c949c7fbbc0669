"""Processing only new or changed records: a change log with offsets, batch plans written ahead, a deduplicating sink.

* The change log holds one entry per record version: its key, its stamp (what the content is), its time, and its offset,
  the position in its log partition. Offsets are given when an entry is appended and only rise, so a version that comes
  in late, or with the time of an older one, still stands behind everything that was read before. A partition is the
  key's hash bucket and stable between runs.
* A run reads the entries beyond the committed offsets of the partitions, and first writes the plan of its batch: which
  of them it has to handle, and how far it has read. A plan that was written but not committed belongs to a run that
  failed: it is replayed as it stands before anything else, so a failure can neither skip entries nor let late ones slip
  between.
* The sink keeps the output of a plan in a place of its own, which a replay overwrites, and of one (key, offset) only the
  latest output counts: replaying a half-written batch repeats nothing.
* What is done with each key is the state of the last commits: a compacted table and the few plans since.

Nothing is kept in the driver but the names of plans and the offsets of the log's partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.operators.ordered import ordered, with_rank
from tesserine.sources.durable import Folder, fresh_path

LOG_PARTITIONS = 64
#: Plans that may follow the compacted state before it is written anew.
COMPACT = 16


class ChangeLog(Folder):
    """A log in one folder: `segments/<n>` holds what one capture appended.

    keys: columns of the key with their types, as `project_id bigint, path string`."""

    def __init__(self, spark: SparkSession, folder: str, keys: str, partitions: int = LOG_PARTITIONS):
        super().__init__(spark, folder)
        self.keys, self.partitions = [k.split()[0] for k in keys.split(", ")], partitions
        self.schema = f"{keys}, stamp string, time bigint, log_partition int, offset bigint"

    def entries(self) -> DataFrame:
        return self.read("segments", self.names("segments"), self.schema)

    def heads(self) -> dict[int, int]:
        """The last offset of every partition that has one."""
        return {r[0]: r[1] for r in self.entries().groupBy("log_partition").agg(F.max("offset")).collect()}  # one row a partition

    def capture(self, records: DataFrame, stamp: str, time: str) -> None:
        """Append the versions of `records` that the log does not hold yet, each once, by time and stamp within a
        partition. Rows with a null in the key are left out. A capture that fails leaves no trace."""
        version = [*self.keys, "stamp", "time"]
        rows = records.where(" and ".join(f"`{k}` is not null" for k in self.keys)).select(*self.keys, F.col(stamp).alias("stamp"), F.col(time).cast("long").alias("time")).distinct()
        known, heads = self.names("segments"), self.heads()
        if known:
            held = self.entries().select(*(F.col(v).alias(f"_{v}") for v in version))
            rows = rows.join(held, [F.col(v).eqNullSafe(F.col(f"_{v}")) for v in version], "left_anti")
        placed = rows.withColumn("log_partition", F.pmod(F.xxhash64(*self.keys), F.lit(self.partitions)).cast("int"))
        order = [F.col("time"), F.col("stamp"), *map(F.col, self.keys)]
        last = F.coalesce(F.create_map(*[F.lit(x) for p, o in heads.items() for x in (p, o)])[F.col("log_partition")], F.lit(-1)) if heads else F.lit(-1)
        numbered = with_rank(ordered(placed, ["log_partition"], order, "captured"), ["log_partition"]).withColumn("offset", last + F.col("rank"))
        names = [c.split()[0] for c in self.schema.split(", ")]
        numbered.select(*names).write.parquet(f"{self.folder}/segments/{len(known):08d}")


def committed_state(handled: DataFrame, runs: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Per key the stamp that the last finished successful run dealt with: (keys, done_stamp).

    handled: what each run handled (run_id, keys, stamp); runs: (run_id, state, finished_at). Runs count by the time
    they finished, on a tie by number; runs that failed, are running or have no end do not count."""
    good = runs.where("state = 'ok' and finished_at is not null").select("run_id", "finished_at").distinct()
    return handled.select("run_id", *keys, stamp).join(good, "run_id").groupBy(*keys).agg(
        F.max(F.struct("finished_at", "run_id", F.col(stamp).alias("stamp"))).getField("stamp").alias("done_stamp"))


class BatchLog(Folder):
    """Plans and commits of the runs over one log: `plans/<id>` (entries, then how far the log was read) is written
    before any work, `commits/<id>` after it, `states/<id>` is the compacted state up to a commit."""

    def __init__(self, spark: SparkSession, folder: str, log: ChangeLog):
        super().__init__(spark, folder)
        self.log, self.keys = log, log.keys
        typed = log.schema.split(", stamp")[0]
        self.schema = f"{log.schema}, reason string"
        self._state = f"{typed}, done_stamp string, done_time bigint, done_offset bigint"

    def open_plan(self) -> str | None:
        """The plan that was written but not committed, if there is one. A plan torn in writing does not count."""
        done = set(self.names("commits"))
        return next((p for p in self.names("plans", "heads/") if p not in done), None)

    def write_plan(self, entries: DataFrame, heads: dict[int, int]) -> str:
        """Write the entries to handle and the offsets up to which the log has been read for them."""
        name = f"{len(self.names('plans', 'heads/')):08d}-{uuid.uuid4().hex[:8]}"
        entries.select(*(c.split()[0] for c in self.schema.split(", "))).write.parquet(f"{self.folder}/plans/{name}/entries")
        table = self.spark.createDataFrame(sorted(heads.items()), "log_partition int, offset bigint")
        table.coalesce(1).write.parquet(f"{self.folder}/plans/{name}/heads")
        return name

    def read_plan(self, name: str) -> DataFrame:
        """The entries to handle. A plan also holds, without a reason, those that it found settled."""
        return self.read("plans", [name], self.schema, "/entries").where("reason is not null")

    def offsets(self) -> dict[int, int]:
        """The committed offset of every partition that has one."""
        done = self.names("commits")[-1:]  # a plan has read at least as far as those before it
        return {r[0]: r[1] for r in self.read("plans", done, "log_partition int, offset bigint", "/heads").collect()}

    def commit(self, name: str) -> None:
        """Settle a plan; every COMPACT commits the state is written anew."""
        self.spark.range(1).select(F.lit(name).alias("plan")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{name}")
        done, states = self.names("commits"), self.names("states")
        if sum(d > (states[-1] if states else "") for d in done) >= COMPACT:
            self.state().write.mode("overwrite").parquet(f"{self.folder}/states/{name}")

    def adopt(self, state: DataFrame) -> None:
        """Start from what earlier runs, outside of this log, have dealt with: (keys, done_stamp)."""
        none = F.lit(None).cast("long")
        state.select(*self.keys, "done_stamp", none.alias("done_time"), none.alias("done_offset")).write.parquet(f"{self.folder}/states/00000000")

    def state(self) -> DataFrame:
        """(keys, done_stamp, done_time, done_offset): the newest version of each key that was dealt with or found settled."""
        last = self.names("states")[-1:]
        since = [c for c in self.names("commits") if not last or c > last[0]]
        plans = self.read("plans", since, self.schema, "/entries").select(
            *self.keys, F.col("stamp").alias("done_stamp"), F.col("time").alias("done_time"), F.col("offset").alias("done_offset"))
        both = self.read("states", last, self._state).unionByName(plans)
        fields = ["done_time", "done_offset", "done_stamp"]
        return both.groupBy(*self.keys).agg(F.max(F.struct(*fields)).alias("_v")).select(*self.keys, *(F.col(f"_v.{f}").alias(f) for f in ("done_stamp", "done_time", "done_offset")))


def newest(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The newest entry of each key: the largest time (null is the smallest), of equal times the one appended last.
    Combined on the map side, so the versions of a hot key do not meet in one task."""
    fields = ["time", "offset", "stamp", "log_partition"]
    return entries.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("_v")).select(*keys, *(F.col(f"_v.{f}").alias(f) for f in fields))


def pending(batches: BatchLog, incomplete: DataFrame | None = None) -> tuple[DataFrame, dict[int, int]]:
    """Entries that a run still has to handle, with a reason: `new`, `changed` or `incomplete`, without one the entries
    that are settled already; and how far the log has been read.

    Only entries beyond the committed offsets are read for `new` and `changed`. One that is older than what was dealt
    with, or has the same stamp, needs nothing. incomplete: keys whose derived data is missing although their stamp may
    be settled; for those alone the whole log is asked. Each key comes out once."""
    log, keys = batches.log, batches.keys
    heads, done = log.heads(), batches.offsets()
    entries = log.entries()
    beyond = entries
    if done:
        last = F.coalesce(F.create_map(*[F.lit(x) for p, o in done.items() for x in (p, o)])[F.col("log_partition")], F.lit(-1))
        beyond = entries.where(F.col("offset") > last)
    state = batches.state()
    late = F.col("done_time").isNotNull() & (F.coalesce("time", F.lit(-(2**63))) < F.col("done_time"))
    reason = F.when(F.col("_done").isNull(), "new").when(~late & ~F.col("stamp").eqNullSafe(F.col("done_stamp")), "changed")
    known = state.withColumn("_done", F.lit(True))
    if incomplete is None:
        todo = newest(beyond, keys).join(known, keys, "left").withColumn("reason", reason)
    else:
        bare = incomplete.select(*keys).distinct().withColumn("_bare", F.lit(True))
        # Keys that a fresh entry or missing data speaks for; of a key without a fresh entry the newest one of the log.
        fresh = newest(beyond, keys).withColumn("_fresh", F.lit(True))
        held = newest(entries.join(bare, keys, "left_semi"), keys).withColumn("_fresh", F.lit(False)) if done else None
        both = fresh if held is None else fresh.unionByName(held.join(fresh, keys, "left_anti"))
        joined = both.join(known, keys, "left").join(bare, keys, "left")
        todo = joined.withColumn("reason", F.coalesce(F.when(F.col("_fresh"), reason), F.when(F.col("_bare"), F.lit("incomplete"))))
    return todo.where(F.col("reason").isNotNull() | ~late).select(*(c.split()[0] for c in batches.schema.split(", "))), heads


class DedupSink(Folder):
    """Outputs by plan; of one (key, offset) the output of the latest plan counts, however often a batch is written."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        super().__init__(spark, folder)
        self.on = [*keys, "offset"]

    def write(self, rows: DataFrame, plan: str) -> None:
        """The whole output of a plan, in place of what an earlier attempt left."""
        rows.dropDuplicates(self.on).write.mode("overwrite").parquet(f"{self.folder}/outputs/{plan}")

    def of(self, plan: str) -> DataFrame:
        """The output of one plan."""
        return self.spark.read.parquet(f"{self.folder}/outputs/{plan}")

    def read(self) -> DataFrame | None:
        """All rows, each (key, offset) once; None while nothing was written."""
        plans = self.names("outputs")
        if not plans:
            return None
        rows = self.spark.read.parquet(*(f"{self.folder}/outputs/{p}" for p in plans))
        rows = rows.withColumn("_plan", F.element_at(F.split(F.input_file_name(), "/"), -2))
        latest = F.max(F.struct(F.col("_plan"), *(c for c in rows.columns if c not in (*self.on, "_plan")))).alias("_v")
        names = [c for c in rows.columns if c not in (*self.on, "_plan")]
        return rows.groupBy(*self.on).agg(latest).select(*self.on, *(F.col("_v").getField(n).alias(n) for n in names))


def run_batch(batches: BatchLog, sink: DedupSink, process: Callable[[DataFrame], DataFrame], incomplete: DataFrame | None = None) -> str | None:
    """One run: replay an open plan if there is one, else plan what is pending; process, write, commit.

    process maps plan entries to sink rows and must keep the keys and `offset`. If it fails, the plan stays open and
    the next call replays it. Returns the plan's name, or None if nothing was pending."""
    name = batches.open_plan()
    if name is None:
        name = batches.write_plan(*pending(batches, incomplete))
        if batches.read_plan(name).isEmpty():
            batches.commit(name)
            return None
    sink.write(process(batches.read_plan(name)), name)
    batches.commit(name)
    return name


class IndexRuns:
    """The index runs over files: their change log, their batches and their sink, in one folder."""

    KEYS = "project_id bigint, path string"

    def __init__(self, spark: SparkSession, folder: str):
        self.log = ChangeLog(spark, f"{folder}/log", self.KEYS)
        self.batches = BatchLog(spark, f"{folder}/batches", self.log)
        self.sink = DedupSink(spark, f"{folder}/sink", self.log.keys)

    def adopt(self, runs: DataFrame, run_files: DataFrame) -> None:
        """Begin where the recorded runs ended."""
        self.batches.adopt(committed_state(run_files, runs, self.log.keys, "content_hash"))

    def run(self, files: DataFrame, chunks: DataFrame, vectors: DataFrame, process: Callable[[DataFrame], DataFrame] = lambda entries: entries) -> DataFrame | None:
        """Capture the versions of files, handle what is pending, and return the run's output; None if nothing was.

        A file is pending if its newest version is not the one last handled by a successful run, if none handled it, or
        if one of its chunks has no row in vectors. Chunks of files that the log does not hold are ignored."""
        if self.batches.open_plan() is None:
            self.log.capture(files, "content_hash", "indexed_at")
        bare = chunks.select(*self.log.keys, F.col("id").alias("chunk_rowid")).join(vectors.select("chunk_rowid"), "chunk_rowid", "left_anti")
        name = run_batch(self.batches, self.sink, process, bare)
        return None if name is None else self.sink.of(name)


def pending_files(files: DataFrame, runs: DataFrame, run_files: DataFrame, chunks: DataFrame, vectors: DataFrame, folder: str | None = None) -> DataFrame:
    """What the index run after the recorded ones handled: (project_id, path, stamp, time, log_partition, offset, reason).

    Without a folder the run has one of its own, so each call begins where the recorded runs ended."""
    spark = files.sparkSession
    work = IndexRuns(spark, folder or fresh_path(spark, "index-runs"))
    work.adopt(runs, run_files)
    done = work.run(files, chunks, vectors)
    return spark.createDataFrame([], work.batches.schema) if done is None else done
