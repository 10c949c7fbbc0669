"""Row filters of a search, compiled once and applied to the rows before either arm ranks them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("exploration", "leaning", "decided", "deprecated")
UNCLASSIFIED = "unclassified"
SOURCES = ("repo", "session")


@dataclass(frozen=True)
class SearchFilter:
    """What rows a search considers. None means no restriction; an empty list of statuses or sources admits nothing.

    statuses may hold `unclassified` for rows without a status. project_id is resolved beforehand, see
    resolve_project."""

    project_id: int | None = None
    path_prefix: str | None = None
    language: str | None = None
    min_authority: int | None = None
    sources: tuple[str, ...] | None = None
    statuses: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        for name, given, known in (("source", self.sources, SOURCES), ("status", self.statuses, (*STATUSES, UNCLASSIFIED))):
            unknown = [x for x in given or () if x not in known]
            if unknown:
                raise ValueError(f"unknown {name}: {unknown[0]}")


def request_filter(
    project_id: int | None = None, path_prefix: str | None = None, language: str | None = None,
    statuses: list[str] | None = None, sources: list[str] | None = None,
) -> SearchFilter:
    """A filter from a request as users write it: backslashes become slashes, the language is lower-cased, and an empty
    list of statuses means none was given, while an empty list of sources stays empty."""
    return SearchFilter(
        project_id, path_prefix.replace("\\", "/") if path_prefix else None, language.lower() if language else None,
        None, None if sources is None else tuple(sources), tuple(statuses) if statuses else None)


def row_condition(f: SearchFilter) -> Column:
    """The conditions on a chunk row alone. Prefixes are compared as characters, never as patterns, and reach the scan."""
    c = F.lit(True)
    if f.project_id is not None:
        c = c & (F.col("project_id") == f.project_id)
    if f.path_prefix:
        c = c & F.startswith(F.col("path"), F.lit(f.path_prefix))
    if f.language is not None:
        c = c & (F.col("language") == f.language)
    if f.min_authority is not None:
        c = c & (F.col("effective_tier") >= f.min_authority)
    if f.statuses is not None:
        named = [s for s in f.statuses if s != UNCLASSIFIED]
        allowed = F.col("design_status").isin(named) if named else F.lit(False)
        c = c & ((F.col("design_status").isNull() | F.coalesce(allowed, F.lit(False))) if UNCLASSIFIED in f.statuses else F.coalesce(allowed, F.lit(False)))
    return c


def filter_chunks(chunks: DataFrame, f: SearchFilter, projects: DataFrame | None = None) -> DataFrame:
    """The chunk rows that pass the filter. Sources are looked up in projects (id, kind); kinds other than `session`
    read as `repo`."""
    rows = chunks.where(row_condition(f))
    if f.sources is None:
        return rows
    if not f.sources:
        return rows.where(F.lit(False))
    if projects is None:
        raise ValueError("a filter by source needs the projects")
    kind = F.when(F.col("kind") == "session", "session").otherwise("repo")
    wanted = projects.where(kind.isin(list(f.sources))).select(F.col("id").alias("project_id"))
    return rows.join(wanted, "project_id", "left_semi")


def resolve_project(projects: DataFrame, given: str) -> int:
    """The id of a project given by its key, else by its name without regard to ASCII case, else by number."""
    number = int(given) if given.isdigit() else -1
    rank = F.when(F.col("project_key") == given, 0).when(F.lower("name") == given.lower(), 1).when(F.col("id") == number, 2)
    hit = projects.select("id", rank.alias("rank")).where("rank is not null").orderBy("rank", "id").first()
    if hit is None:
        raise ValueError(f"unknown project: {given}")
    return hit["id"]


def resolve_projects(projects: DataFrame, given: DataFrame) -> DataFrame:
    """(given, project_id) of many names at once, by the rules of resolve_project; null where nothing has the name."""
    def form(rank: int, tag: str, name: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), F.lit(tag).alias("form"), name.alias("name"))

    forms = F.array(form(0, "k", F.col("project_key")), form(1, "n", F.lower("name")), form(2, "i", F.col("id").cast("string")))
    known = projects.select("id", F.explode(forms).alias("_f")).select("id", "_f.*")
    asked = given.select("given").distinct().select("given", F.explode(F.array(*(F.struct(F.lit(f).alias("form"), (F.lower("given") if f == "n" else F.col("given")).alias("name")) for f in "kni"))).alias("_a")).select("given", "_a.*")
    found = asked.join(known, ["form", "name"], "left").groupBy("given")
    return found.agg(F.min(F.when(F.col("id").isNotNull(), F.struct("rank", "id"))).getField("id").alias("project_id"))


def nearest_root(projects: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, project_id): of the projects whose root holds the path, the one with the longest root.

    Every ancestor of a path is generated and looked up by equality, so this is a hash join, not a comparison of every
    path with every root."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    steps = paths.select("path").distinct().withColumn("root", F.explode(up))
    roots = projects.select(F.rtrim("root", F.lit("/")).alias("root"), F.col("id").alias("project_id"))
    return steps.join(roots, "root").groupBy("path").agg(F.max_by("project_id", F.char_length("root")).alias("project_id"))
