"""The engine's calls in one object: projects, indexing, push, embedding, search, expand, status.

Every call reads the latest published generation and either publishes the next one or changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import tomllib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.text import expand_lines
from tesserine.operators import authority, indexing, search, status
from tesserine.operators.chunking import Plugin
from tesserine.operators.filters import nearest_root, request_filter, resolve_project
from tesserine.session import ship_package
from tesserine.sources.embedding import Embedder, due, embed, poison
from tesserine.sources.store import ChunkStore, Commit, StaleWriter
from tesserine.sources.walk import observe
from tesserine.streaming.changes import all_projects

SETTINGS_FILE = ".index.toml"
BEHAVIORS = ("off", "annotate", "rank")
PUSH_INTERVAL_SECONDS, LEASE_SECONDS = 10, 30


@dataclass(frozen=True)
class Settings:
    """What a project declares in its settings file; `error` says why a broken file counts as none."""

    profile: str | None = None
    behavior: str | None = None
    sources: tuple[tuple[str, str], ...] = ()
    plugins: tuple[str, ...] = ()
    error: str | None = None


def parse_settings(text: str | None) -> Settings:
    """[authority] profile, behavior; [[sources]] path, mount; [plugins] enable. Unknown keys, profiles and behaviors make
    the file broken, and a broken file leaves its project neutral."""
    if text is None:
        return Settings()
    try:
        raw = tomllib.loads(text)
        _only(raw, "authority", "sources", "plugins")
        a = raw.get("authority", {})
        _only(a, "profile", "behavior")
        profile = a.get("profile")
        behavior = a.get("behavior", "annotate") if profile else None
        if profile not in (None, authority.PROFILE) or behavior not in (None, *BEHAVIORS):
            raise ValueError("unknown profile or behavior")
        for s in raw.get("sources", []):
            _only(s, "path", "mount")
        sources = indexing.declared_mounts([(s["path"], s["mount"]) for s in raw.get("sources", [])])
        _only(raw.get("plugins", {}), "enable")
        return Settings(profile, behavior, tuple(sources), tuple(raw.get("plugins", {}).get("enable", ())))
    except (tomllib.TOMLDecodeError, ValueError, KeyError, TypeError, AttributeError) as e:
        return Settings(error=str(e) or type(e).__name__)


def _only(table: dict, *known: str) -> None:
    unknown = sorted(set(table) - set(known))
    if unknown:
        raise ValueError(f"unknown key: {unknown[0]}")


def _decision_files(rows: DataFrame) -> DataFrame:
    return rows.where(authority.is_ledger(F.col("path")) | authority.record_id(F.col("path")).isNotNull())


def _under(rows: DataFrame, paths: list[str]) -> DataFrame:
    hit = F.lit(False)
    for p in paths:
        hit = hit | indexing.covers(F.lit(p.rstrip("/")), F.col("path"))
    return rows.where(hit)


@dataclass
class PushSession:
    """A lease on a project: who may push, under which epoch, and what still has to be sent."""

    project_id: int
    key: str
    epoch: int
    expires: float
    manifest: list[tuple[str, str, int]] = field(default_factory=list)
    needed: dict[str, tuple[str, int]] = field(default_factory=dict)
    last_manifest: float = float("-inf")


class Engine:
    def __init__(self, spark: SparkSession, folder: str, plugins: tuple[Plugin, ...] = (), clock=time.time):
        ship_package(spark)
        self.spark, self.store, self.plugins, self.clock = spark, ChunkStore(spark, folder), plugins, clock
        self.sessions: dict[str, PushSession] = {}
        self._indexed: tuple[dict[str, list[str]], str] | None = None

    # -- projects

    def add(self, root: str, name: str, kind: str = "repo") -> int:
        return self.store.register(root, name, kind, int(self.clock()))

    def remove(self, project: str) -> None:
        self.store.remove(resolve_project(self.store.table("projects"), project))

    def resolve(self, path: str) -> int | None:
        """The project whose root is the nearest above a path."""
        hit = nearest_root(self.store.table("projects"), self.spark.createDataFrame([(path,)], "path string")).first()
        return hit["project_id"] if hit else None

    # -- indexing

    def index(self, project: str, paths: list[str] | None = None, override: bool = False) -> dict[str, int]:
        """Observe a project's root and declared sources, or some paths of it, and apply what changed.

        A settings file that cannot be parsed leaves the project neutral; the pass goes on."""
        row = self.store.table("projects").where(F.col("id") == resolve_project(self.store.table("projects"), project)).first()
        settings = self._settings(row["root"])
        self.store.set_profile(row["id"], settings.profile, settings.behavior)
        seen, unreadable = observe(self.spark, row["root"], paths)
        for path, mount in settings.sources:
            more, bad = observe(self.spark, os.path.join(row["root"], path))
            placed = lambda df, m=mount: df.withColumn("path", F.concat(F.lit(m + "/"), F.col("path")))
            seen, unreadable = seen.unionByName(placed(more)), unreadable.unionByName(placed(bad))
        scope = None if paths is None else self.spark.createDataFrame([(row["id"], p) for p in paths], "project_id long, scope string")
        bad = unreadable.select(F.lit(row["id"]).cast("long").alias("project_id"), "path")
        before = self.store.table("files", project=row["id"]).select("path")
        counts = self.store.index(
            row["id"], seen.select("path", "content"), int(self.clock()), override, scope, bad, profiled=settings.profile is not None and settings.behavior != "off",
            plugins=tuple(p for p in self.plugins if p.name in settings.plugins))
        if paths is None:
            self.refresh_authority(row["id"], seen, unreadable)
        elif not _decision_files(_under(before, paths).union(seen.select("path"))).isEmpty():
            self.refresh_authority(row["id"], *observe(self.spark, row["root"]))  # decisions are judged together
        return counts

    def handle_changes(self, spark: SparkSession, work: DataFrame, number: int) -> None:
        """The handler for streaming.changes.run_stream: a pass per project that the batch names. The work has one row per
        project and at most MAX_PATHS paths a row; a batch that comes again finds nothing changed."""
        known = self.store.table("projects")
        spread = all_projects(work, known)  # lost events without a project are everyone's
        for r in spread.join(known.select(F.col("id").alias("project_id")), "project_id", "left_semi").orderBy("project_id").collect():
            name = self.store.table("projects").where(F.col("id") == r["project_id"]).first()["project_key"]
            self.index(name, r["paths"], bool(r["override"]))

    def _settings(self, root: str) -> Settings:
        try:
            with open(os.path.join(root, SETTINGS_FILE), encoding="utf-8") as f:
                return parse_settings(f.read())
        except (OSError, UnicodeDecodeError):
            return Settings()

    def refresh_authority(self, project_id: int, seen: DataFrame, unreadable: DataFrame) -> bool:
        """Resolve the project's decisions from all its ledgers and records and recompute tiers; whether any changed.

        While one of them cannot be read, what was active stays active beside what the others say."""
        c = self.store.current()
        sources = seen.select(F.lit(project_id).cast("long").alias("project_id"), "path", F.col("content").cast("string").alias("text"))
        decided = authority.active_decisions(authority.resolve(authority.decision_entries(sources)))
        mine = self.store.table("decisions", c, project_id)
        if not _decision_files(unreadable).isEmpty():
            decided = decided.union(mine).distinct()
        chunks = self.store.table("chunks", c, project_id)
        tiers = authority.recompute(chunks, self.store.table("projects", c), decided)
        changed = tiers.where("changed").select("id", F.col("tier").alias("_tier"), F.col("demotion").alias("_demotion"), F.lit(True).alias("_hit"))
        out = {}
        if not authority.same_decisions(decided, mine):
            out["decisions"] = {project_id: decided}
        if not changed.isEmpty():
            put = lambda new, old: F.when(F.col("_hit"), F.col(new)).otherwise(F.col(old))
            joined = chunks.join(changed, "id", "left")
            out["chunks"] = {project_id: joined.withColumn("effective_tier", put("_tier", "effective_tier")).withColumn("demotion", put("_demotion", "demotion")).select(*chunks.columns)}
        if out:
            self.store.publish(c, out)
        return bool(out)

    # -- push

    def lease(self, project: str) -> str:
        """A push session; any earlier one of the project is refused from now on."""
        ident = resolve_project(self.store.table("projects"), project)
        key = self.store.table("projects").where(F.col("id") == ident).first()["project_key"]
        name = uuid.uuid4().hex
        old = next((s for s in self.sessions.values() if s.project_id == ident), None)
        self.sessions = {n: s for n, s in self.sessions.items() if s.project_id != ident and s.expires > self.clock()}
        self.sessions[name] = PushSession(ident, key, self.store.acquire(key), self.clock() + LEASE_SECONDS)
        if old is not None:
            self.sessions[name].last_manifest = old.last_manifest
        return name

    def _session(self, name: str) -> PushSession:
        s = self.sessions.get(name)
        if s is None or s.expires <= self.clock() or self.store.current().epochs.get(s.key) != s.epoch:
            raise StaleWriter("no such session")
        s.expires = self.clock() + LEASE_SECONDS
        return s

    def renew(self, name: str) -> None:
        self._session(name)

    def _staged(self, digest: str) -> str:
        return f"{self.store.folder}/staging/{digest}"

    def push_manifest(self, name: str, entries: list[tuple[str, str, int]], checksum: str) -> tuple[list[str], int]:
        """Announce a whole listing (path, sha256, size); returns the paths to send and how many files it would delete.

        One malformed path, or a wrong checksum, refuses the listing."""
        s = self._session(name)
        if self.clock() - s.last_manifest < PUSH_INTERVAL_SECONDS:
            raise ValueError("too soon after the last manifest")
        m = self.spark.createDataFrame([(s.project_id, *e) for e in entries], "project_id long, path string, content_hash string, size_bytes long")
        wrong = indexing.malformed(m).first()
        if wrong is not None:
            raise ValueError(f"{wrong['path']}: {wrong['reason']}")
        summed = indexing.manifest_checksum(m).first()
        if (summed["checksum"] if summed else hashlib.sha256(b"").hexdigest()) != checksum:
            raise ValueError("checksum mismatch")
        stored = self.store.table("files", project=s.project_id)
        stamped = m.withColumn("content_hash", F.concat(F.lit("s1-"), "content_hash"))
        need = {r["path"] for r in indexing.negotiate(stamped, stored).where("need").collect()}
        deletes = stored.join(m.select("project_id", "path"), ["project_id", "path"], "left_anti").count()
        held = lambda digest: self.store._fs.exists(self.store._path(self._staged(digest)))
        s.manifest, s.last_manifest = list(entries), self.clock()
        s.needed = {p: (h, n) for p, h, n in entries if p in need and not held(h)}
        return sorted(s.needed), deletes

    def push_file(self, name: str, path: str, content: bytes) -> None:
        """Send one needed file; its size and hash must be those announced."""
        s = self._session(name)
        if path not in s.needed:
            raise ValueError(f"{path} is not needed")
        digest, size = s.needed[path]
        if len(content) != size or hashlib.sha256(content).hexdigest() != digest:
            raise ValueError(f"{path} is not what was announced")
        out = self.store._fs.create(self.store._path(self._staged(digest)), True)  # named by content, never by the sender
        out.write(bytearray(content))
        out.close()
        del s.needed[path]

    def push_commit(self, name: str, override: bool = False) -> dict[str, int]:
        """Apply the announced listing; nothing may be outstanding. Unchanged files need not have been sent."""
        s = self._session(name)
        if s.needed:
            raise ValueError(f"{len(s.needed)} files are outstanding")
        listing = self.spark.createDataFrame([(p, h) for p, h, _ in s.manifest], "path string, digest string")
        stored = self.store.table("files", project=s.project_id).select("path", F.col("content_hash").alias("_h"))
        rows = listing.join(stored, "path", "left")
        same = rows.where(F.col("_h") == F.concat(F.lit("s1-"), "digest")).select("path")
        fresh = rows.join(same, "path", "left_anti").select("path", "digest")
        names = [self._staged(r["digest"]) for r in fresh.select("digest").distinct().collect()]  # of one listing, which its sender holds as well
        if names:
            sent = self.spark.read.format("binaryFile").load(names).select(F.element_at(F.split("path", "/"), -1).alias("digest"), "content")
            fresh = fresh.join(sent, "digest").select("path", "content")
        else:
            fresh = fresh.select("path", F.lit(None).cast("binary").alias("content"))
        counts = self.store.index_listing(s.project_id, fresh, same, int(self.clock()), override, (s.key, s.epoch))
        for n in names:
            self.store._fs.delete(self.store._path(n), False)
        return counts

    # -- embedding

    def embed(self, embedder: Embedder, fingerprint: dict, poisoned: DataFrame | None = None, page: int | None = 512) -> tuple[int, DataFrame]:
        """Embed one page of the backlog; returns how many vectors were stored and the poison list afterwards."""
        self.store.reconcile_fingerprint(fingerprint)
        c, now = self.store.current(), int(self.clock())
        poisoned = poisoned if poisoned is not None else self.spark.createDataFrame([], "chunk_rowid long, strikes int, retry_at long")
        todo = due(search.backlog(self.store.table("chunks", c), self.store.table("chunk_vectors", c), page=None), poisoned, now).orderBy("id")
        from tesserine.sources.durable import keep

        made = keep(embed(todo if page is None else todo.limit(page), embedder), "embedded")
        good = made.where("failed is null").drop("failed")
        stored = good.count()
        if stored:
            # The backlog has no vectors yet, so they are added; what was stored stays where it is.
            none = self.spark.createDataFrame([], good.schema)
            self.store.publish(c, {}, added={"chunk_vectors": indexing.store_vectors(none, good, self.store.table("chunks", c))})
        return stored, poison(poisoned, made.where("failed is not null"), now)

    # -- reading

    def search(self, query: str, project: str | None = None, path_prefix: str | None = None, language: str | None = None, statuses: list[str] | None = None, sources: list[str] | None = None, limit: int | None = None, query_vector: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
        """(result rows, one row with lexical_only)."""
        c = self.store.current()
        projects = self.store.table("projects", c)
        f = request_filter(resolve_project(projects, project) if project else None, path_prefix, language, statuses, sources)
        return search.search(self.store.table("chunks", c), projects, query, self.store.table("chunk_vectors", c), query_vector, f, limit, self._full_text(c))

    def _full_text(self, commit: Commit) -> search.StoredIndex | None:
        """The full-text index of a generation's chunks. The first search after a pass brings it up to date: postings of
        chunks that are gone go, those of new ones come, and all others are taken over. Only the projects whose parts
        changed are compared."""
        parts = commit.tables.get("chunks")
        if not parts:
            return None
        folder = f"{self.store.folder}/index/{hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:32]}"
        if not self.store._fs.exists(self.store._path(f"{folder}/totals/_SUCCESS")):
            chunks = self.store.table("chunks", commit)
            if self._indexed:
                old_parts, old_folder = self._indexed
                read = lambda held, other: self.spark.read.schema(chunks.schema).parquet(*paths) if (paths := [p for n, ps in held.items() for p in ps if other.get(n) != ps]) else chunks.limit(0)
                new, old = read(parts, old_parts), read(old_parts, parts)
                inserted, deleted = new.join(old.select("id"), "id", "left_anti"), old.join(new.select("id"), "id", "left_anti")
                entries = search.maintain_postings(search.read_index(self.spark, old_folder).postings.drop("bucket"), inserted, deleted)
            else:
                entries = search.postings(chunks)
            search.write_index(entries, chunks, folder)
        self._indexed = (parts, folder)
        return search.read_index(self.spark, folder)

    def expand(self, project: str, prefix: str, context: int = 20) -> tuple[str, list]:
        """A chunk by the beginning of its id, with lines around it from its file as it is now, else its stored text."""
        if len(prefix) < 8 or any(x not in "0123456789abcdef" for x in prefix.lower()):
            raise ValueError("at least 8 hex digits")
        projects = self.store.table("projects")
        ident = resolve_project(projects, project)
        kind, rows = search.lookup(self.store.table("chunks", project=ident), ident, prefix.lower())
        if kind != "found":
            return kind, [r["chunk_id"] for r in rows]
        r = rows[0]
        root = projects.where(F.col("id") == ident).first()["root"]
        try:
            with open(os.path.join(root, r["path"]), encoding="utf-8") as f:
                lines = self.spark.createDataFrame([(f.read(), r["line_start"], r["line_end"])], "text string, a int, b int")
            return kind, [lines.select(expand_lines(F.col("text"), F.col("a"), F.col("b"), context)).first()[0]]
        except (OSError, UnicodeDecodeError):
            return kind, [r["text"]]

    def files(self, project: str) -> DataFrame:
        """A project's files in path order."""
        ident = resolve_project(self.store.table("projects"), project)
        return self.store.table("files", project=ident).orderBy("path")

    def chunks(self, project: str, path: str) -> DataFrame:
        """The chunks of one file in the order in which they stand in it."""
        ident = resolve_project(self.store.table("projects"), project)
        return self.store.table("chunks", project=ident).where(F.col("path") == path).orderBy("byte_start", "id")

    def status(self) -> DataFrame:
        c = self.store.current()
        return status.status_counts(*(self.store.table(t, c) for t in ("projects", "files", "chunks", "chunk_vectors", "decisions")))
