"""Incremental indexing: observed listings against stored files, the mass-delete guard, replacing chunks and vectors.

Everything is a diff between two tables keyed by (project_id, path) or by chunk id; nothing walks a corpus in the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tesserine.functions.text import malformed_path

#: A pass that would delete more files than this, and more than half of a project's, is refused whole.
GUARD_FILES = 100
KEYS = ["project_id", "path"]


def covers(scope: Column, path: Column) -> Column:
    """Whether a scope entry covers a path: it is the path or a folder above it."""
    return (path == scope) | F.startswith(path, F.concat(scope, F.lit("/")))


def in_scope(files: DataFrame, scope: DataFrame | None, keys: list[str] = KEYS) -> DataFrame:
    """The rows that some entry of scope (project_id, scope) covers; all of them if there is no scope.

    Every folder above a path is generated and looked up, so this is a hash join."""
    if scope is None:
        return files
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = files.select(*keys, F.explode(above).alias("scope")).join(scope.select("project_id", "scope").distinct(), ["project_id", "scope"], "left_semi")
    return files.join(hit.select(*keys).distinct(), keys, "left_semi")


def containing_projects(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project_id) of every project (id, root) whose root is the path or a folder above it, by a hash join as in
    in_scope; a path may lie in several projects or in none."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # The root of the file system is the folder above every absolute path; `above` has it as an empty string.
    roots = projects.select(F.col("id").alias("project_id"), F.regexp_replace("root", "/+$", "").alias("_root"))
    return paths.select("path").distinct().withColumn("_root", F.explode(above)).join(roots, "_root").select("path", "project_id").distinct()


def classify(observed: DataFrame, stored: DataFrame, scope: DataFrame | None = None, unreadable: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """(project_id, path, stamp, state): `new`, `changed`, `unchanged`, `deleted` or `unreadable` per file.

    observed and stored: (project_id, path, content_hash), one row per file. Absence from what was observed is the only
    sign of deletion; files outside the scope, and files that could not be read, are never deleted. Many listings of a
    project are told apart by a further column in keys, which comes out as well."""
    a = observed.select(*keys, F.col("content_hash").alias("_new"), F.lit(True).alias("_a"))
    b = in_scope(stored, scope, keys).select(*keys, F.col("content_hash").alias("_old"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full")
    if unreadable is not None:
        both = both.join(unreadable.select(*keys).distinct().withColumn("_u", F.lit(True)), keys, "left")
    else:
        both = both.withColumn("_u", F.lit(None).cast("boolean"))
    state = (
        F.when(F.col("_u"), "unreadable").when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "deleted")
        .when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("changed")
    )
    return both.select(*keys, F.coalesce("_new", "_old").alias("stamp"), state.alias("state"))


def guard(classified: DataFrame, stored: DataFrame, by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """(project_id, deletes, stored, refused) per project, or what else `by` says, with stored files or deletions."""
    gone = classified.where("state = 'deleted'").groupBy(*by).agg(F.count("*").alias("deletes"))
    have = stored.select(*by, "path").distinct().groupBy(*by).agg(F.count("*").alias("stored"))
    rows = have.join(gone, list(by), "full").select(*by, F.coalesce("deletes", F.lit(0)).alias("deletes"), F.coalesce("stored", F.lit(0)).alias("stored"))
    return rows.withColumn("refused", (F.col("deletes") > GUARD_FILES) & (F.col("deletes") * 2 > F.col("stored")))


def admitted(classified: DataFrame, guarded: DataFrame, override: bool = False) -> DataFrame:
    """What may be applied: nothing of a refused project, unless overridden."""
    if override:
        return classified
    return classified.join(guarded.where("refused").select("project_id"), "project_id", "left_anti")


@dataclass(frozen=True)
class ChunkWrite:
    """The chunk table after a pass, and which of its rows are new, kept and gone."""

    table: DataFrame
    inserted: DataFrame
    kept: DataFrame
    deleted: DataFrame


def replace_chunks(stored: DataFrame, incoming: DataFrame, handled: DataFrame) -> ChunkWrite:
    """Replace the chunks of the handled files (project_id, path) by the incoming ones.

    Chunks are the same if (project_id, chunk_id) is; those keep their row, and with it their vector. Chunks of other
    files stay. Incoming chunks of a file that is not handled are an error of the caller and are refused."""
    stray = incoming.join(handled, KEYS, "left_anti").limit(1).count()
    if stray:
        raise ValueError("incoming chunks of files that are not handled")
    key = ["project_id", "chunk_id"]
    touched = stored.join(handled.select(*KEYS).distinct(), KEYS, "left_semi")
    once = incoming.dropDuplicates(key)
    kept = touched.join(once.select(*key), key, "left_semi")
    inserted = once.join(touched.select(*key), key, "left_anti")
    deleted = touched.join(once.select(*key), key, "left_anti")
    rest = stored.join(handled.select(*KEYS).distinct(), KEYS, "left_anti")
    return ChunkWrite(rest.unionByName(kept).unionByName(inserted, allowMissingColumns=True), inserted, kept, deleted)


def remove_files(table: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of other files than the ones gone (project_id, path)."""
    return table.join(gone.select(*KEYS).distinct(), KEYS, "left_anti")


def store_vectors(stored: DataFrame, incoming: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vector table with the incoming vectors (chunk_rowid, project_id, dims, vector) added or replaced.

    Vectors whose chunk has vanished in the meantime are skipped. One unusable vector rejects the whole batch."""
    from tesserine.functions.vectors import usable

    if not incoming.where(~usable(F.col("vector"))).isEmpty():
        raise ValueError("a vector of the batch is not usable")
    live = incoming.join(chunks.select(F.col("id").alias("chunk_rowid")).distinct(), "chunk_rowid", "left_semi").dropDuplicates(["chunk_rowid"])
    return stored.join(live.select("chunk_rowid"), "chunk_rowid", "left_anti").unionByName(live)


def pass_summary(classified: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of counts, or one for each value of `by`: seen, new, changed, unchanged, deleted, unreadable."""
    states = ("new", "changed", "unchanged", "deleted", "unreadable")
    seen = F.count_if(F.col("state") != "deleted").alias("seen")
    return classified.groupBy(*by).agg(seen, *(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in states))


def observed(classified: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, with the counts of the states collected on the side while they are written."""
    watch = Observation("index-pass")
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("new", "changed", "unchanged", "deleted")]
    return classified.observe(watch, *counts), watch


# --- manifests pushed by remote observers -------------------------------------------------------------------------------


def manifest_checksum(manifest: DataFrame) -> DataFrame:
    """(project_id, checksum): SHA-256 over the lines `path NUL hash NUL size` in path order, per project.

    One manifest is one listing of bounded size that its sender holds in memory as well."""
    line = F.concat_ws("\x00", "path", "content_hash", F.col("size_bytes").cast("string"))
    lines = manifest.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("_l"))
    return lines.select("project_id", F.sha2(F.array_join(F.transform("_l", lambda s: s["line"]), "\n"), 256).alias("checksum"))


def malformed(manifest: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(project_id, path, reason) of paths that refuse their whole listing."""
    return manifest.select(*keys, malformed_path(F.col("path")).alias("reason")).where("reason is not null")


def negotiate(manifest: DataFrame, stored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(project_id, path, content_hash, need): files of well-formed manifests whose content must be sent."""
    one = [k for k in keys if k != "path"]
    bad = malformed(manifest, keys).select(*one).distinct()
    good = manifest.join(bad, one, "left_anti").select(*keys, "content_hash")
    old = stored.select(*keys, F.col("content_hash").alias("_old"), F.lit(True).alias("_b"))
    need = F.col("_b").isNull() | ~F.col("content_hash").eqNullSafe(F.col("_old"))
    return good.join(old, keys, "left").select(*keys, "content_hash", need.alias("need"))


def declared_mounts(entries: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Checked (path, mount) pairs of further sources of a project: paths are relative and stay below the root, mounts are
    single names, unique whatever their case, and no path lies in another. Raises ValueError otherwise."""
    seen: set[str] = set()
    for path, mount in entries:
        if not path or path.startswith("/") or ".." in path.split("/"):
            raise ValueError(f"not a relative path: {path}")
        if not mount or "/" in mount or mount in (".", ".."):
            raise ValueError(f"not a single name: {mount}")
        if mount.lower() in seen:
            raise ValueError(f"mount named twice: {mount}")
        seen.add(mount.lower())
    paths = sorted(p.rstrip("/") + "/" for p, _ in entries)
    for a, b in zip(paths, paths[1:]):
        if b.startswith(a):
            raise ValueError(f"{b} lies in {a}")
    return entries


def logical_path(mount: str | None, relative: str) -> str:
    """Where a file of a source stands in its project: below the mount, or as it is for the root."""
    return f"{mount}/{relative}" if mount else relative


def locate(physical: str, sources: list[tuple[str, str | None]]) -> str | None:
    """The logical path of a physical one, by the source with the longest root that holds it; None outside of all."""
    best = max((s for s in sources if physical == s[0] or physical.startswith(s[0].rstrip("/") + "/")), key=lambda s: len(s[0]), default=None)
    return None if best is None else logical_path(best[1], physical[len(best[0].rstrip("/")) + 1 :])
