"""The store: Parquet tables under generations, published whole, with a fence against stale writers.

Layout: `data/<table>/<id>` holds files of a table, `commits/<generation>` one JSON record that names the parts of every
table, the writers' epochs, the schema version and the embedding fingerprint. Tables of a project's data are parted by
project: a pass writes new parts of its own project only, and removing a project just forgets its parts. A pass then creates
the next record; creation fails if the record exists, so of two writers of one generation one is refused, and readers see
all of a pass or nothing. Parts that did not change are shared between generations.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

#: The tables and their columns; a store starts with all of them empty.
TABLES = {
    "projects": "id long, root string, name string, project_key string, kind string, authority_profile string, authority_behavior string, created_at long",
    "files": "project_id long, path string, content_hash string, indexed_at long, source_ts long",
    "chunks": "id long, project_id long, chunk_id string, path string, anchor string, kind string, language string, byte_start int, byte_end int, line_start int, line_end int, text string, vault string, design_status string, authority_tier int, effective_tier int, demotion string",
    "chunk_vectors": "chunk_rowid long, project_id long, dims int, vector array<float>",
    "decisions": "project_id long, id string",
}
#: Those that are parted by project, and how many additions a part may have before it is written anew.
PARTED = ("files", "chunks", "chunk_vectors", "decisions")
MAX_ADDITIONS = 16


class StaleWriter(Exception):
    """A newer writer has taken over, or another one published this generation first."""


@dataclass
class Commit:
    generation: int = 0
    schema_version: int = SCHEMA_VERSION
    tables: dict[str, str | dict[str, list[str]]] = field(default_factory=dict)
    epochs: dict[str, int] = field(default_factory=dict)
    fingerprint: dict | None = None
    next_project: int = 1
    next_chunk: int = 1


class ChunkStore:
    """A store in one folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))

    # -- commits

    def generations(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/commits"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def current(self) -> Commit:
        """The latest published commit. One of another schema version counts as none: everything is derived data and is
        rebuilt from its sources."""
        for number in reversed(self.generations()):
            raw = self.spark.read.option("wholetext", True).text(f"{self.folder}/commits/{number:010d}.json").first()
            try:
                c = Commit(**json.loads(raw[0] if raw else ""))
            except ValueError:  # still being written
                continue
            return c if c.schema_version == SCHEMA_VERSION else Commit(generation=c.generation)
        return Commit()

    def table(self, name: str, commit: Commit | None = None, project: int | None = None) -> DataFrame:
        """A table, or one project's part of it."""
        c = commit or self.current()
        held = c.tables.get(name)
        if name in PARTED:
            parts = held or {}
            paths = [p for n, ps in sorted(parts.items()) if project is None or n == str(project) for p in ps]
        else:
            paths = [held] if held else []
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.folder}/data/{name}/{uuid.uuid4().hex}"
        keys = [c for c in ("project_id", "path", "id") if c in df.columns]
        rows = df.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in TABLES[name].split(", ")))
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        if name in PARTED:
            rows.withColumn("_part", F.col("project_id")).write.partitionBy("_part").parquet(path)
        else:
            rows.write.parquet(path)
        return path

    def _parts(self, path: str) -> dict[str, list[str]]:
        folders = [s.getPath() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
        return {f.getName().partition("=")[2]: [f.toString()] for f in folders if f.getName().startswith("_part=")}

    def publish(self, base: Commit, changed: dict[str, DataFrame | dict[int, DataFrame | None]], epoch: tuple[str, int] | None = None, added: dict[str, DataFrame] | None = None, **meta) -> Commit:
        """Write the changed tables and publish the generation after `base`.

        changed: a whole table, or for tables parted by project new parts by project (None: no part). added: rows that
        come to a table's parts. epoch: (project key, epoch) of the writer; refused if the store knows a later one. Files
        are sorted by project and path, so that reads of one prefix skip the rest."""
        if epoch is not None and base.epochs.get(epoch[0], 0) > epoch[1]:
            raise StaleWriter(f"epoch {epoch[1]} of {epoch[0]} is over")
        tables = dict(base.tables)
        for name, new in changed.items():
            if isinstance(new, DataFrame):
                path = self._write(name, new)
                tables[name] = self._parts(path) if name in PARTED else path
                continue
            parts = {n: ps for n, ps in tables.get(name, {}).items() if int(n) not in new}
            for df in new.values():
                parts |= self._parts(self._write(name, df)) if df is not None else {}
            tables[name] = parts
        for name, rows in (added or {}).items():
            parts = dict(tables.get(name, {}))
            for n, ps in self._parts(self._write(name, rows)).items():
                ps = [*parts.get(n, []), *ps]
                if len(ps) > MAX_ADDITIONS:
                    ps = self._parts(self._write(name, self.spark.read.schema(TABLES[name]).parquet(*ps)))[n]
                parts[n] = ps
            tables[name] = parts
        epochs = dict(base.epochs) | ({epoch[0]: epoch[1]} if epoch else {})
        new_commit = Commit(**(asdict(base) | {"generation": base.generation + 1, "tables": tables, "epochs": epochs} | meta))
        self._create(f"{self.folder}/commits/{new_commit.generation:010d}.json", json.dumps(asdict(new_commit)))
        return new_commit

    def _create(self, path: str, text: str) -> None:
        """Creates a file that must not exist: of two writers the file system lets one through. A record is a few hundred
        bytes, written in one call; a reader that comes in between sees no whole record and takes the one before."""
        try:
            out = self._fs.create(self._path(path), False)
        except Py4JJavaError as e:
            raise StaleWriter(f"{path} is taken") from e
        out.write(bytearray(text.encode()))
        out.close()

    # -- leases

    def acquire(self, project: str) -> int:
        """Take over a project's push lease: its epoch rises, and whoever held it is refused from now on."""
        c = self.current()
        epoch = c.epochs.get(project, 0) + 1
        self.publish(c, {}, (project, epoch))
        return epoch

    # -- catalogue

    def projects(self) -> DataFrame:
        return self.table("projects").orderBy("id")

    def register(self, root: str, name: str, kind: str = "repo", now: int = 0) -> int:
        """The id of the project at `root`: a known one keeps its id and key and takes the new name; a new one gets the
        next id, never one used before. A name that another root holds, whatever its case, is refused."""
        c = self.current()
        known = self.table("projects", c)
        if not known.where((F.lower("name") == name.lower()) & (F.col("root") != root)).isEmpty():
            raise ValueError(f"the name {name} is taken")
        mine = known.where(F.col("root") == root).first()
        if mine is not None:
            rows = known.withColumn("name", F.when(F.col("root") == root, name).otherwise(F.col("name"))).withColumn("kind", F.when(F.col("root") == root, kind).otherwise(F.col("kind")))
            self.publish(c, {"projects": rows})
            return mine["id"]
        key = free_key(known, name)
        row = self.spark.createDataFrame([(c.next_project, root, name, key, kind, None, None, now)], TABLES["projects"])
        self.publish(c, {"projects": known.unionByName(row)}, next_project=c.next_project + 1)
        return c.next_project

    def remove(self, project_id: int) -> None:
        """Remove a project with its chunks, vectors, files and decisions."""
        c = self.current()
        gone = {n: {project_id: None} for n in PARTED}
        self.publish(c, {**gone, "projects": self.table("projects", c).where(F.col("id") != project_id)})

    def apply_projects(self, wanted: list[dict]) -> None:
        """Make the projects those of a list (root, name, kind, and a key for new ones, if it is free): others are removed,
        known roots keep id and key."""
        rows = self.spark.createDataFrame([(w["root"], w["name"], w.get("kind", "repo"), i) for i, w in enumerate(wanted)], "root string, name string, kind string, n int")
        asked = {w["root"]: w["key"] for w in reversed(wanted) if w.get("key")}
        c = self.current()
        known = self.table("projects", c)
        repaired = repair_names(rows)
        merged = repaired.join(known.drop("name", "kind"), "root", "left").orderBy("n").collect()  # a registry, edited by hand
        out, keys, nxt = [], {r["project_key"] for r in merged if r["project_key"]}, c.next_project
        for r in merged:
            ident, key = r["id"], r["project_key"]
            if ident is None:
                ident, nxt = nxt, nxt + 1
                key = _unused(asked.get(r["root"]) or _slug(r["name"]), keys)
                keys.add(key)
            out.append((ident, r["root"], r["name"], key, r["kind"], r["authority_profile"], r["authority_behavior"], r["created_at"]))
        table = self.spark.createDataFrame(out, TABLES["projects"])
        ids = {r[0] for r in out}
        gone = {n: {int(p): None for p in c.tables.get(n, {}) if int(p) not in ids} for n in PARTED}
        self.publish(c, {**gone, "projects": table}, next_project=nxt)

    def set_profile(self, project_id: int, profile: str | None, behavior: str | None) -> bool:
        """Set a project's authority profile; whether anything changed. Nothing is written if not."""
        c = self.current()
        rows = self.table("projects", c)
        me = F.col("id") == project_id
        differs = me & ~(F.col("authority_profile").eqNullSafe(F.lit(profile)) & F.col("authority_behavior").eqNullSafe(F.lit(behavior)))
        if rows.where(differs).isEmpty():
            return False
        put = lambda n, v: F.when(me, F.lit(v)).otherwise(F.col(n))
        self.publish(c, {"projects": rows.withColumn("authority_profile", put("authority_profile", profile)).withColumn("authority_behavior", put("authority_behavior", behavior))})
        return True

    def set_source_time(self, project_id: int, path: str, source_ts: int) -> None:
        c = self.current()
        mine = self.table("files", c, project_id)
        self.publish(c, {"files": {project_id: mine.withColumn("source_ts", F.when(F.col("path") == path, F.lit(source_ts)).otherwise(F.col("source_ts")))}})

    # -- indexing

    def index(self, project_id: int, observed: DataFrame, now: int = 0, override: bool = False, scope: DataFrame | None = None, unreadable: DataFrame | None = None, epoch: tuple[str, int] | None = None, profiled: bool = False, unchanged: DataFrame | None = None, plugins: tuple = ()) -> dict[str, int]:
        """One pass over a project: observed (path, content binary) against what is stored, published as one generation.

        Files whose stamp is unchanged are not read again; chunks whose content is unchanged keep their row and vector.
        Raises RuntimeError, and changes nothing, if the mass-delete guard trips and is not overridden."""
        from tesserine.operators.chunking import chunk_files
        from tesserine.operators.indexing import classify, guard, remove_files, replace_chunks
        from tesserine.operators.ordered import ordered, with_rank
        from tesserine.sources.durable import keep

        c = self.current()
        mine, chunks = self.table("files", c, project_id), self.table("chunks", c, project_id)
        seen = observed.select(F.lit(project_id).cast("long").alias("project_id"), "path", "content", F.concat(F.lit("s1-"), F.sha2("content", 256)).alias("content_hash"))
        seen = keep(seen, "observed")  # stamps and chunks must come from one reading of the files
        listed = seen.select("project_id", "path", "content_hash")
        state = classify(listed if unchanged is None else listed.unionByName(unchanged), mine, scope, unreadable)
        state = keep(state, "index-pass")
        refused = guard(state, mine).where("refused").first()
        if refused is not None and not override:
            raise RuntimeError(f"refusing to delete {refused['deletes']} of {refused['stored']} files")
        counts = {r["state"]: r["n"] for r in state.groupBy("state").agg(F.count("*").alias("n")).collect()}
        touched = state.where("state in ('new', 'changed')").select("project_id", "path")
        gone = state.where("state = 'deleted'").select("project_id", "path")
        if not sum(counts.get(s, 0) for s in ("new", "changed", "deleted")):
            return counts
        made = chunk_files(seen.join(touched, ["project_id", "path"], "left_semi"), (project_id,) if profiled else (), plugins)
        made = keep(made, "made-chunks")
        fresh = made.join(chunks.select("project_id", "chunk_id"), ["project_id", "chunk_id"], "left_anti")
        ranked = with_rank(ordered(fresh.select("project_id", "chunk_id", "authority_tier"), [], [F.col("project_id"), F.col("chunk_id")], "new-chunks"), [])
        numbered = ranked.withColumn("id", F.col("rank") + (c.next_chunk - 1)).withColumn("effective_tier", F.col("authority_tier")).withColumn("demotion", F.lit(None).cast("string"))
        written = replace_chunks(chunks, made.join(numbered.select("project_id", "chunk_id", "id", "effective_tier", "demotion"), ["project_id", "chunk_id"], "left"), touched)
        table = remove_files(written.table, gone)
        table = keep(table, "chunk-table")
        others = mine.join(touched.union(gone), ["project_id", "path"], "left_anti")
        stamped = state.join(touched, ["project_id", "path"], "left_semi").select("project_id", "path", F.col("stamp").alias("content_hash"), F.lit(now).cast("long").alias("indexed_at"), F.lit(None).cast("long").alias("source_ts"))
        live = table.select(F.col("id").alias("chunk_rowid"))
        vectors = self.table("chunk_vectors", c, project_id).join(live, "chunk_rowid", "left_semi")
        parts = {"files": others.unionByName(stamped), "chunks": table, "chunk_vectors": vectors}
        self.publish(c, {n: {project_id: df} for n, df in parts.items()}, epoch, next_chunk=c.next_chunk + made.count())
        return counts

    def index_listing(self, project_id: int, sent: DataFrame, same: DataFrame, now: int, override: bool, epoch: tuple[str, int]) -> dict[str, int]:
        """As index, for a pushed listing: `sent` (path, content) came with it, `same` (path) are unchanged and did not."""
        stored = self.table("files", project=project_id)
        kept = stored.join(same.select("path").distinct(), "path", "left_semi").select("project_id", "path", "content_hash")
        return self.index(project_id, sent, now, override, epoch=epoch, unchanged=kept)

    # -- embeddings

    def reconcile_fingerprint(self, fingerprint: dict) -> str:
        """`kept` if the stored vectors are of this space; `adopted` if none was recorded and all widths agree; else
        `cleared`: all vectors go, because they cannot be compared with what comes."""
        c = self.current()
        if c.fingerprint == fingerprint:
            return "kept"
        widths = [r["dims"] for r in self.table("chunk_vectors", c).select("dims").distinct().limit(8).collect()]
        if c.fingerprint is None and all(w == fingerprint.get("dims") for w in widths):
            self.publish(c, {}, fingerprint=fingerprint)
            return "adopted"
        self.publish(c, {"chunk_vectors": self.spark.createDataFrame([], TABLES["chunk_vectors"])}, fingerprint=fingerprint)
        return "cleared"


def _slug(name: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")[:40].rstrip("-") or "project"


def _unused(key: str, taken: set[str]) -> str:
    n, out = 1, key
    while out in taken:
        n += 1
        out = f"{key}-{n:04x}"
    return out


def free_key(projects: DataFrame, name: str) -> str:
    """A key for a new project that no other one has."""
    key = _slug(name)
    taken = {r["project_key"] for r in projects.where(F.startswith("project_key", F.lit(key))).select("project_key").collect()}
    return _unused(key, taken)


def repair_names(rows: DataFrame) -> DataFrame:
    """A project list (root, name, kind, n) with unique roots and names: the first of a root counts, later ones of a name,
    whatever its case, are called `name (2)` and so on."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy("n"))).where("_r = 1").drop("_r")
    place = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("n"))
    return first.withColumn("_p", place).withColumn("name", F.when(F.col("_p") > 1, F.concat("name", F.lit(" ("), F.col("_p").cast("string"), F.lit(")"))).otherwise(F.col("name"))).drop("_p")
