"""Queries of text functions, chunks, the store's writes, listings, change events and reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.functions.vectors import normalise, usable
from tesserine.operators import chunking, evaluation, indexing, search, status
from tesserine.operators.filters import SearchFilter, filter_chunks, resolve_projects
from tesserine.plans.index_queries import _LISTINGS, _SPACE, _listings, _runs, windows_sql
from tesserine.plans.search_queries import stored_chunks
from tesserine.sources import walk
from tesserine.sources.durable import fresh_path, keep
from tesserine.sources.embedding import due, latest_health, poison
from tesserine.sources.store import ChunkStore
from tesserine.sources.tables import table
from tesserine.streaming import changes

# --- text ---------------------------------------------------------------------------------------------------------------


def symbol_names(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols as they are shown and embedded, with marks put behind them by the last digit of the chunk's id."""
    marks = F.element_at(F.array(*map(F.lit, ("", "#w1", "#d2", "#s3", ".#s0#w12", "#d1#w3", "#x1"))), (F.col("id") % 7 + 1).cast("int"))
    name = F.concat(F.get_json_object("kind", "$.symbol_path"), marks)
    return stored_chunks(spark, sf).where(name.isNotNull()).select("id", T.strip_discriminators(name).alias("bare"), T.display_symbol(name).alias("shown"))


def heading_paths(spark: SparkSession, sf: str) -> DataFrame:
    headings = F.from_json(F.get_json_object("kind", "$.heading_path"), "array<string>")
    marked = F.concat(headings, F.when(F.col("id") % 2 == 0, F.array(F.lit("#w1"))).otherwise(F.array(F.lit("#d1"))))
    return stored_chunks(spark, sf).where(headings.isNotNull()).select("id", T.display_headings(marked).alias("shown"), T.anchor_phrase(F.lit("section"), F.lit(None).cast("string"), marked).alias("phrase"))


def utf8_beginnings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.truncate_utf8(F.col("text"), F.col("doc_id") % 300).alias("beginning"))


def reference_merges(spark: SparkSession, sf: str) -> DataFrame:
    """References of the front matter before those of the body."""
    stated = F.from_json(F.get_json_object("vault", "$.decision_refs"), "array<string>")
    return stored_chunks(spark, sf).select("id", F.array_join(T.merge_refs(stated, T.decision_refs(F.col("text"))), ",").alias("refs"))


def id_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Beginnings of chunk ids of many lengths, some not hexadecimal: can they stand for a chunk?"""
    given = F.concat(F.left("chunk_id", (F.col("id") % 14).cast("int")), F.when(F.col("id") % 5 == 0, "g").when(F.col("id") % 5 == 1, "A").otherwise(""))
    return stored_chunks(spark, sf).select("id", T.is_id_prefix(given).alias("valid"))


def relative_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every file's full path seen from the roots of its own and of the next project."""
    roots = table(spark, sf, "projects").select(F.col("id").alias("project_id"), "root")
    files = table(spark, sf, "files").select("project_id", "path").distinct().join(roots, "project_id").select("project_id", F.concat_ws("/", "root", "path").alias("full"))
    seen = files.join(roots.select((F.col("project_id") - 1).alias("project_id"), "root").unionByName(roots), "project_id")
    return seen.select("full", "root", T.is_within(F.col("full"), F.col("root")).alias("within"), T.relative_to(F.col("full"), F.col("root")).alias("relative"))


def git_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("path", "^[^/]+", ".Git")
    return table(spark, sf, "files").select(F.when(F.col("indexed_at") % 2 == 0, path).otherwise(F.col("path")).alias("path")).distinct().withColumn("git", T.is_git_metadata(F.col("path")))


def vector_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """The first component of each unit vector, and its length."""
    v = table(spark, sf, "chunk_vectors").distinct().where(usable(F.col("vector"))).select("chunk_rowid", normalise(F.col("vector")).alias("u"))
    length = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return v.select("chunk_rowid", F.round(F.col("u")[0], 6).alias("first"), F.round(F.sqrt(length), 6).alias("length"))


def event_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by the day on which they began, and how long they took."""
    runs = table(spark, sf, "index_runs").select(F.to_date(F.timestamp_seconds("started_at")).cast("string").alias("day"), (F.col("finished_at") - F.col("started_at")).alias("took"))
    return runs.groupBy("day").agg(F.count("*").alias("runs"), F.sum("took").alias("seconds"))


# --- files and chunks -----------------------------------------------------------------------------------------------------


def file_languages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").select("path").distinct().select("path", chunking.language_column(F.col("path")).alias("language"))


def headings_found(spark: SparkSession, sf: str) -> DataFrame:
    """The headings of the documents read as Markdown, outside of fences."""
    return chunking.document_headings(table(spark, sf, "documents").select("doc_id", "text"))


def code_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The stored texts of code, each as a file of its own, cut anew along their declarations."""
    rows = stored_chunks(spark, sf).where(chunking.language_column(F.col("path")).isin("python", "rust", "csharp", "javascript", "typescript"))
    files = rows.select("project_id", F.concat(F.col("id").cast("string"), F.lit("/"), F.col("path")).alias("path"), F.col("text").cast("binary").alias("content"))
    return chunking.chunk_files(files).select("path", "anchor", "kind", "chunk_id", "byte_start", "byte_end", "line_start", "line_end")


def vault_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as notes of a vault, with front matter by the last digit of their ids: what status their chunks get."""
    status_of = F.element_at(F.array(*map(F.lit, ("decided", "leaning", "exploration", "deprecated", "unknown"))), (F.col("doc_id") % 5 + 1).cast("int"))
    front = F.concat(F.lit("---\ndesign_status: "), status_of, F.lit("\ndecision_refs: [D-0001, \"[[D-0002]]\"]\n---\n"))
    docs = table(spark, sf, "documents").where("text is not null").select(
        F.lit(1).cast("long").alias("project_id"), F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".md")).alias("path"), F.concat(front, "text").cast("binary").alias("content"))
    made = chunking.chunk_files(docs, (1,))
    refs = F.array_join(F.from_json(F.get_json_object("vault", "$.decision_refs"), "array<string>"), ",")
    return made.select("path", "design_status", "authority_tier", refs.alias("refs")).distinct()


def plugin_windows(spark: SparkSession, sf: str) -> DataFrame:
    """How many windows a plugin with windows of 20 lines that share 5 makes of each document."""
    docs = table(spark, sf, "documents").where("text is not null").select("project_id", F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".note")).alias("path"), F.col("text").cast("binary").alias("content"))
    made = chunking.chunk_files(docs, plugins=(chunking.Plugin("notes", ("note",), 20, 5),))
    return made.groupBy("path").agg(F.count("*").alias("windows"), F.min("line_start").alias("first_line"), F.max("line_end").alias("last_line"))


# --- filters and lookups ----------------------------------------------------------------------------------------------------


def filter_project(spark: SparkSession, sf: str) -> DataFrame:
    return filter_chunks(stored_chunks(spark, sf), SearchFilter(project_id=3, statuses=("decided", "leaning", "unclassified"))).select("id", "project_id", "path")


def resolved_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Every project named by its key, by its name in capitals, by its number and by something that nobody is called."""
    p = table(spark, sf, "projects")
    given = F.explode(F.array(F.col("project_key"), F.upper("name"), F.col("id").cast("string"), F.concat("name", F.lit("?")))).alias("given")
    return resolve_projects(p, p.select(given).distinct())


def prefix_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """What the first three digits of each chunk's id lead to in its project."""
    chunks = stored_chunks(spark, sf)
    return search.lookups(chunks, chunks.select("project_id", F.left("chunk_id", F.lit(3)).alias("prefix")).distinct(), 3)


def page_limits(spark: SparkSession, sf: str) -> DataFrame:
    """The length of the page that each number of a query stands for, as a limit given by a caller."""
    given = table(spark, sf, "scored").select(F.when(F.col("query_id") % 7 == 0, None).otherwise(F.col("query_id") % 160 - 20).cast("int").alias("given")).distinct()
    return given.select("given", T.clamped(F.col("given")).alias("limit"))


def file_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk's place in its file."""
    return search.in_file_order(stored_chunks(spark, sf)).select("id", "place")


def postings_maintained(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of an index of two thirds of the chunks after a pass that takes every fifth away and brings the others in."""
    chunks = stored_chunks(spark, sf)
    old, gone = chunks.where("id % 3 <> 0"), chunks.where("id % 5 = 0")
    index = search.maintain_postings(search.postings(old), chunks.where("id % 3 = 0 and id % 5 <> 0"), gone)
    return index.groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("weight").alias("weight"))


# --- writes -----------------------------------------------------------------------------------------------------------------


def chunks_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """What replacing the files of the even projects does to each chunk: two thirds come again, some come with a new text."""
    stored = stored_chunks(spark, sf)
    handled = stored.where("project_id % 2 = 0").select("project_id", "path").distinct()
    again = stored.where("project_id % 2 = 0 and id % 3 <> 0")
    fresh = again.where("id % 4 = 0").withColumn("chunk_id", F.sha2(F.concat("chunk_id", F.lit("new")), 256)).withColumn("id", F.lit(None).cast("long"))
    done = indexing.replace_chunks(stored, again.unionByName(fresh), handled)
    parts = [df.select("project_id", "path", "chunk_id", F.lit(n).alias("outcome")) for df, n in ((done.inserted, "inserted"), (done.kept, "kept"), (done.deleted, "deleted"))]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("project_id", "outcome").agg(F.count("*").alias("chunks"))
    return counts.unionByName(done.table.groupBy("project_id").agg(F.count("*").alias("chunks")).select("project_id", F.lit("table").alias("outcome"), "chunks"))


def files_removed(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that stay when the files whose paths have an even length go."""
    gone = table(spark, sf, "files").where("char_length(path) % 2 = 0").select("project_id", "path")
    return indexing.remove_files(stored_chunks(spark, sf), gone).select("id", "path")


def vectors_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The vector table when the vectors of every third chunk come in anew, for chunks that are gone as well."""
    v = table(spark, sf, "chunk_vectors").where(usable(F.col("vector"))).dropDuplicates(["chunk_rowid"])
    stored, incoming = v.where("chunk_rowid % 2 = 0"), v.where("chunk_rowid % 3 = 0").withColumn("dims", F.col("dims") + 1000)
    chunks = stored_chunks(spark, sf).where("id % 7 <> 0")
    return indexing.store_vectors(stored, incoming, chunks).select("chunk_rowid", "dims")


def manifest_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """The checksum of every complete listing."""
    _, observed = _listings(spark, sf)
    rows = observed.select((F.col("project_id") * 1000 + F.col("snapshot_no")).alias("project_id"), "path", "content_hash", F.char_length("path").cast("long").alias("size_bytes"))
    return indexing.manifest_checksum(rows)


def registry_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A store's projects after a registry was applied, some profiles were set, and one project was removed."""
    store = ChunkStore(spark, fresh_path(spark, "registry"))
    wanted = [r.asDict() for r in table(spark, sf, "projects").select("root", "name", "kind", "id").orderBy("id").collect()]  # a registry
    store.apply_projects(wanted[:40])
    store.apply_projects(wanted[10:])
    store.set_profile(11, "lore-v1", "rank")
    store.remove(12)
    store.register(wanted[0]["root"], wanted[0]["name"], wanted[0]["kind"])
    return store.table("projects").select("id", "root", "name", "kind", "authority_profile", "authority_behavior")


def fixture_sample(spark: SparkSession, sf: str) -> DataFrame:
    return status.sample_fixture(stored_chunks(spark, sf), 100, 80)


def _document_tree(spark: SparkSession, sf: str) -> str:
    """The documents as files of a tree, by the last digit of their ids some in ignored, hidden or foreign folders."""
    root = fresh_path(spark, "tree").removeprefix("file://").removeprefix("file:")
    digit, name = F.col("doc_id") % 10, F.col("doc_id").cast("string")
    path = (
        F.when(digit == 3, F.concat(F.lit("skip/"), name, F.lit(".txt"))).when(digit == 4, F.concat(F.lit("keep/"), name, F.lit(".log"))).when(digit == 5, F.concat(F.lit(".git/"), name))
        .when(digit == 6, F.concat(F.lit("nested/"), name, F.lit(".txt"))).when(digit == 7, F.concat(F.lit(".hidden/"), name, F.lit(".txt")))
        .otherwise(F.concat(F.lit("keep/a"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), name, F.lit(".txt"))))

    def write(batches):
        for b in batches:
            for where, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                full = os.path.join(root, where)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(text)
            yield b.select([0])

    docs = table(spark, sf, "documents").where("text is not null").select(path.alias("path"), F.col("text").cast("binary").alias("text"))
    docs.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    os.makedirs(os.path.join(root, "nested/.git"), exist_ok=True)
    with open(os.path.join(root, ".gitignore"), "w", encoding="utf-8") as f:
        f.write("skip/\n*.log\n!keep/*4.log\nkeep/*04.log\n")
    return root


def tree_files(spark: SparkSession, sf: str) -> DataFrame:
    """What a walk of the documents' tree comes to."""
    seen, _ = walk.observe(spark, _document_tree(spark, sf))
    return seen.where("path <> '.gitignore'").select("path", "size", "sha256")


def tree_scope(spark: SparkSession, sf: str) -> DataFrame:
    """The same for a few named paths, of which some are ignored or missing."""
    seen, _ = walk.observe(spark, _document_tree(spark, sf), ["keep/a1", "keep/a3/", "skip", ".hidden", "nested", "keep/14.log", "keep/4.log", "none"])
    return seen.select("path", "sha256")


def index_passes(spark: SparkSession, sf: str) -> DataFrame:
    """What two passes over a project find, and what is stored after them: between them every seventh document goes, of the
    others every fifth changes, and some come."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".txt")).alias("path"), "text")
    store = ChunkStore(spark, fresh_path(spark, "passes"))
    project = store.register("/srv/docs", "docs")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("changed "), "text")).otherwise(F.col("text"))
    passes = docs.where("doc_id % 11 <> 0"), docs.where("doc_id % 7 <> 0").withColumn("text", text)
    found = [store.index(project, df.select("path", F.col("text").cast("binary").alias("content")), number) for number, df in enumerate(passes, 1)]
    rows = [(n, state, c) for n, counts in enumerate(found, 1) for state, c in counts.items()]
    rows += [(3, f"at {r['indexed_at']}", r["count"]) for r in store.table("files").groupBy("indexed_at").count().collect()]
    return spark.createDataFrame(rows, "pass int, state string, files long")


# --- events -----------------------------------------------------------------------------------------------------------------


def _change_events(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the listings as change events: what kind by the length of the path, some of them of special files."""
    kind = F.element_at(F.array(*map(F.lit, ("modify", "create", "access", "remove", "rename"))), (F.char_length("path") % 5 + 1).cast("int"))
    n, p = F.col("project_id"), F.translate("path", "\\", "/")
    path = F.when((n % 10 == 1) & (F.col("snapshot_no") == 3), ".index.toml").when((n % 10 == 2) & (F.col("snapshot_no") == 3), F.concat(p, F.lit("/.gitignore"))).when(F.char_length(p) % 9 == 0, F.concat(F.lit(".git/"), p)).otherwise(p)
    lost = (n % 10 == 3) & (F.col("snapshot_no") == 4)
    return table(spark, sf, "file_snapshots").select("project_id", path.alias("path"), F.when(lost, "rescan").otherwise(kind).alias("kind"), (n % 7 == 0).alias("override"))


def change_routes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.route(_change_events(spark, sf)).groupBy("project_id", "scope", "override").agg(F.count_distinct("path").alias("paths"))


def change_work(spark: SparkSession, sf: str) -> DataFrame:
    """The passes that one batch of events asks for, with at most 50 paths each."""
    work = changes.coalesce(changes.route(_change_events(spark, sf)), 50)
    return work.select("project_id", "scope", F.array_join("paths", "|").alias("paths"), "override")


def rescan_spread(spark: SparkSession, sf: str) -> DataFrame:
    """The same with an event that lost even its project: everyone is looked at."""
    events = _change_events(spark, sf).where("project_id < 30")
    lost = events.limit(1).select(F.lit(None).cast("long").alias("project_id"), F.lit(None).cast("string").alias("path"), F.lit("rescan").alias("kind"), F.lit(False).alias("override"))
    return changes.all_projects(changes.coalesce(changes.route(events.unionByName(lost))), table(spark, sf, "projects")).select("project_id", "scope")


def containing_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Every project that holds a path, where every fifth root is cut to the folder above the projects."""
    projects = table(spark, sf, "projects").withColumn("root", F.when(F.col("id") % 5 == 0, F.regexp_replace("root", "/[^/]*$", "")).otherwise(F.col("root")))
    full = table(spark, sf, "files").join(table(spark, sf, "projects").select(F.col("id").alias("project_id"), "root"), "project_id").select(F.concat_ws("/", "root", "path").alias("path"))
    return indexing.containing_projects(full, projects)


def embed_due(spark: SparkSession, sf: str) -> DataFrame:
    """The backlog that may be tried again at second 100, after one round of failures at second 0 and another at 70."""
    backlog = search.backlog(table(spark, sf, "chunks"), table(spark, sf, "chunk_vectors"), page=None)
    none = spark.createDataFrame([], "chunk_rowid long, strikes int, retry_at long")
    failed = lambda rows, why: rows.select(F.col("id").alias("chunk_rowid"), F.lit(why).alias("failed"))
    first = poison(none, failed(backlog.where("id % 2 = 0"), "refused"), 0)
    second = poison(first, failed(backlog.where("id % 6 = 0"), "refused").union(failed(backlog.where("id % 5 = 0 and id % 6 <> 0"), "unusable vector")), 70)
    return due(backlog, keep(second, "poison"), 100).select("id")


def poison_list(spark: SparkSession, sf: str) -> DataFrame:
    backlog = search.backlog(table(spark, sf, "chunks"), table(spark, sf, "chunk_vectors"), page=None)
    known = backlog.where("id % 3 = 0").select(F.col("id").alias("chunk_rowid"), F.lit(1).alias("strikes"), F.lit(60).cast("long").alias("retry_at"))
    failed = backlog.where("id % 2 = 0").select(F.col("id").alias("chunk_rowid"), F.when(F.col("id") % 4 == 0, "unusable vector").otherwise("refused").alias("failed"))
    return poison(known, failed, 100)


def latest_states(spark: SparkSession, sf: str) -> DataFrame:
    """Each project's health by its latest run."""
    seen = table(spark, sf, "index_runs").select(F.col("project_id").cast("string").alias("label"), F.col("state").alias("status"), F.col("run_id").alias("ticket"))
    return latest_health(seen)


def tool_times(spark: SparkSession, sf: str) -> DataFrame:
    """Uses of tools in an event log of JSON lines, some of them broken or without an end."""
    e, n = table(spark, sf, "events"), F.col("event_id")
    line = F.to_json(F.struct(F.col("event_type").alias("tool"), n.cast("double").alias("started"), F.when(n % 3 != 0, n + F.floor("value")).cast("double").alias("ended")))
    lines = e.select(F.when(n % 11 == 0, F.concat(line, F.lit("}{"))).when(n % 13 == 0, "no event").otherwise(line).alias("value"))
    return changes.tool_events(lines.where(~F.col("value").contains("}{"))).groupBy("tool").agg(F.count("*").alias("uses"), F.sum("seconds").alias("seconds"), F.max("at").alias("last"))


# --- reports ----------------------------------------------------------------------------------------------------------------


def run_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Throughput of the finished runs by state, a handled file counting as a chunk."""
    handled = table(spark, sf, "run_files").distinct().groupBy("run_id").agg(F.count("*").alias("chunks"), F.sum(F.char_length("path")).alias("bytes"))
    runs = table(spark, sf, "index_runs").where("finished_at is not null").join(handled, "run_id")
    batches = runs.select(F.col("state").alias("label"), "chunks", (F.col("chunks") * 3).alias("tokens"), "bytes", F.col("started_at").cast("double").alias("started"), F.col("finished_at").cast("double").alias("ended"))
    out = status.throughput(batches)
    return out.select("label", "chunks", *(F.round(c, 6).alias(c) for c in ("chunks_per_s", "tokens_per_s", "mb_per_s", "p50_ms", "p95_ms")))


def session_uptake(spark: SparkSession, sf: str) -> DataFrame:
    """What users clicked on after it had been viewed, a value standing for a path."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("value").cast("int").cast("string").alias("path"), F.col("ts").alias("at"), "event_type")
    return status.uptake(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'click'").drop("event_type"))


def pooled_for_judging(spark: SparkSession, sf: str) -> DataFrame:
    """Results that wait for a judgment: those whose content has changed since, or that nobody judged."""
    runs, _, judged = _runs(spark, sf)
    runs = runs.withColumn("model", F.concat_ws("/", "model", "run_set"))  # of any run
    hashes = table(spark, sf, "scored").select(F.concat(F.lit("c/"), F.col("chunk_rowid")).alias("path"), F.sha2((F.col("chunk_rowid") % 5).cast("string"), 256).alias("content_hash")).distinct()
    done = judged.select("query_id", "path", F.sha2((F.regexp_extract("path", "[0-9]+", 0).cast("long") % 4).cast("string"), 256).alias("content_hash"))
    return evaluation.judging_pool(runs, done, hashes)


QUERIES = {
    f.__name__: f
    for f in (
        symbol_names, heading_paths, utf8_beginnings, reference_merges, id_prefixes, relative_paths, git_paths, vector_lengths, event_dates, file_languages,
        headings_found, code_chunks, vault_chunks, plugin_windows, filter_project, resolved_projects, prefix_lookups, page_limits, file_order, postings_maintained,
        chunks_replaced, files_removed, vectors_stored, manifest_checksums, registry_steps, fixture_sample, change_routes, change_work, rescan_spread,
        containing_roots, tree_files, tree_scope, index_passes, embed_due, poison_list, latest_states, tool_times, run_throughput, session_uptake, pooled_for_judging,
    )
}

_C = "c as (select distinct * from chunks)"
_REFS = "list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9_-]+'), lambda x: regexp_full_match(x, 'D-[0-9]{4}([^A-Za-z0-9_].*)?')), lambda x: left(x, 6))"
_ONCE = "list_filter(list_transform(r, lambda x, i: case when list_position(r, x) = i then x end), lambda x: x is not null)"
_GOOD = "vector is not null and len(vector) > 0 and not list_bool_or(list_transform(vector, lambda x: isnan(x) or isinf(x))) and sqrt(list_sum(list_transform(vector, lambda x: x::double * x::double))) > 1.1920929e-7"
_BACKLOG = "b as (select distinct id from chunks where id not in (select chunk_rowid from chunk_vectors))"
_EVENTS = r"""
e as (select project_id, snapshot_no, replace(path, chr(92), '/') as p, ['modify', 'create', 'access', 'remove', 'rename'][length(path) % 5 + 1] as k from file_snapshots),
events as (select project_id, project_id % 7 = 0 as override, case when project_id % 10 = 1 and snapshot_no = 3 then '.index.toml' when project_id % 10 = 2 and snapshot_no = 3 then p || '/.gitignore'
  when length(p) % 9 = 0 then '.git/' || p else p end as path, case when project_id % 10 = 3 and snapshot_no = 4 then 'rescan' else k end as kind from e),
routed as (select project_id, override, case when kind = 'rescan' then 'full' when path = '.index.toml' then 'reload' when path = '.gitignore' or ends_with(path, '/.gitignore') then 'full' else 'path' end as scope, path
  from events where kind <> 'access' and (kind = 'rescan' or not contains('/' || lower(path) || '/', '/.git/')))"""
_RANKED = """s as (select distinct query_id, chunk_rowid, arm, score, tier, scored_at from scored where score is not null and not isnan(score) and arm is not null),
best as (select arm, query_id, chunk_rowid, max(case when arm = 'lexical' then -score else score end) as s from s group by 1, 2, 3),
runs as (select query_id, chunk_rowid, least(row_number() over (partition by arm, query_id order by s desc, chunk_rowid), row_number() over (partition by arm, query_id order by s, chunk_rowid)) as rank from best)"""

SQL = {
    "symbol_names": rf"""with {_C}, n as (select id, json_extract_string(kind, '$.symbol_path') || ['', '#w1', '#d2', '#s3', '.#s0#w12', '#d1#w3', '#x1'][id % 7 + 1] as name from c)
select id, regexp_replace(name, '(\.*#[wds][0-9]+)+$', '') as bare, regexp_replace(name, '(\.*#[ws][0-9]+)+$', '') as shown from n where name is not null""",
    "heading_paths": f"""with {_C}, h as (select id, from_json(json_extract(kind, '$.heading_path'), '["VARCHAR"]') as h from c)
select id, array_to_string(h || (case when id % 2 = 0 then [] else ['#d1'] end), ' > ') as shown, array_to_string(h, ' > ') as phrase from h where h is not null""",
    "utf8_beginnings": """with d as (select doc_id, text, doc_id % 300 as n from documents),
o as (select doc_id, text, n, list_transform(range(1, least(length(text), n)::bigint + 1), lambda i: strlen(left(text, i::bigint))) as ends from d)
select doc_id, left(text, len(list_filter(ends, lambda x: x <= n))) as beginning from o""",
    "reference_merges": f"""with {_C}, m as (select id, coalesce(from_json(json_extract(vault, '$.decision_refs'), '["VARCHAR"]'), []) || {_REFS} as r from c)
select id, array_to_string({_ONCE}, ',') as refs from m""",
    "id_prefixes": f"""with {_C} select id, regexp_full_match(lower(left(chunk_id, (id % 14)::int) || case when id % 5 = 0 then 'g' when id % 5 = 1 then 'A' else '' end), '[0-9a-f]{{8,}}') as valid from c""",
    "relative_paths": """with f as (select distinct project_id, path from files), w as (select p.id, p.root || '/' || f.path as "full" from f join projects p on p.id = f.project_id),
r as (select id as project_id, root from projects union all select id - 1, root from projects)
select "full", root, starts_with("full", root || '/') as within, case when starts_with("full", root || '/') then substr("full", length(root) + 2) end as relative from w join r on r.project_id = w.id""",
    "git_paths": """select distinct case when indexed_at % 2 = 0 then regexp_replace(path, '^[^/]+', '.Git') else path end as path, indexed_at % 2 = 0 as git from files""",
    "vector_lengths": f"""with v as (select distinct chunk_rowid, vector from chunk_vectors where {_GOOD}),
n as (select chunk_rowid, vector, sqrt(list_sum(list_transform(vector, lambda x: x::double * x::double))) as l from v)
select chunk_rowid, round(vector[1]::double / l, 6) as first, 1.0::double as length from n""",
    "event_dates": "select strftime(to_timestamp(started_at) at time zone 'UTC', '%Y-%m-%d') as day, count(*) as runs, sum(finished_at - started_at)::bigint as seconds from index_runs group by 1",
    "file_languages": r"""select distinct path, case lower(regexp_extract(path, '\.([^./]*)$', 1)) when 'cs' then 'csharp' when 'rs' then 'rust' when 'py' then 'python' when 'js' then 'javascript'
 when 'jsx' then 'javascript' when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'md' then 'markdown' end as language from files""",
    "filter_project": f"with {_C} select id, project_id, path from c where project_id = 3 and (design_status in ('decided', 'leaning') or design_status is null)",
    "resolved_projects": """with g as (select distinct unnest([project_key, upper(name), id::varchar, name || '?']) as given from projects)
select g.given, (select p.id from projects p where p.project_key = g.given or lower(p.name) = lower(g.given) or p.id::varchar = g.given
  order by case when p.project_key = g.given then 0 when lower(p.name) = lower(g.given) then 1 else 2 end, p.id limit 1) as project_id from g""",
    "prefix_lookups": f"""with {_C}, k as (select project_id, left(chunk_id, 3) as prefix, count(distinct chunk_id) as n, min(chunk_id) as first_id from c group by 1, 2)
select project_id, prefix, case when n = 1 then 'found' else 'ambiguous' end as outcome, case when n = 1 then first_id end as chunk_id, least(n, 3) as shown from k""",
    "page_limits": """with g as (select distinct (case when query_id % 7 <> 0 then query_id % 160 - 20 end)::int as given from scored)
select given, case when given is null then 10 else least(greatest(given, 0), 100) end as "limit" from g""",
    "file_order": f"with {_C} select id, row_number() over (partition by project_id, path order by byte_start, id) as place from c",
    "postings_maintained": rf"""with {_C}, t as (select id, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}_]+')) as term, 1.0 as w from c where id % 5 <> 0
  union all select id, unnest(regexp_extract_all(strip_accents(lower(coalesce(path, ''))), '[\p{{L}}\p{{N}}_]+')), 0.5 from c where id % 5 <> 0
  union all select id, unnest(regexp_extract_all(strip_accents(lower(coalesce(anchor, ''))), '[\p{{L}}\p{{N}}_]+')), 2.0 from c where id % 5 <> 0)
select term, count(distinct id) as n_chunks, sum(w)::double as weight from t group by term""",
    "chunks_replaced": f"""with {_C}, k as (select *, project_id % 2 = 0 as handled, id % 3 <> 0 as again, id % 3 <> 0 and id % 4 = 0 as fresh from c),
o as (select project_id, 'kept' as outcome, count(distinct chunk_id) as chunks from k where handled and again group by 1 union all
  select project_id, 'inserted', count(distinct chunk_id) from k where handled and fresh group by 1 union all
  select project_id, 'deleted', count(*) from k where handled and not again and (project_id, chunk_id) not in (select (project_id, chunk_id) from k where handled and again) group by 1 union all
  select project_id, 'table', count(*) filter (where not handled) + count(distinct case when handled and again then chunk_id end) + count(distinct case when handled and fresh then chunk_id end) from k group by 1)
select * from o where chunks > 0""",
    "files_removed": f"with {_C} select id, path from c where (project_id, path) not in (select (project_id, path) from files where length(path) % 2 = 0)",
    "vectors_stored": f"""with v as (select distinct chunk_rowid, dims from chunk_vectors where {_GOOD}), live as (select distinct id from chunks where id % 7 <> 0),
i as (select chunk_rowid, dims + 1000 as dims from v where chunk_rowid % 3 = 0 and chunk_rowid in (select id from live))
select chunk_rowid, dims from v where chunk_rowid % 2 = 0 and chunk_rowid not in (select chunk_rowid from i) union all select * from i""",
    "fixture_sample": f"""with {_C}, n as (select *, row_number() over (order by chunk_id) - 1 as r, greatest(1, count(*) over () // 100) as step from c)
select chunk_id, project_id, left(text, len(list_filter(list_transform(range(1, least(length(text), 80) + 1), lambda i: strlen(left(text, i::bigint))), lambda x: x <= 80))) as text
from n where r % step = 0 and r < step * 100""",
    "change_routes": f"with {_EVENTS} select project_id, scope, override, count(distinct case when scope = 'path' then path end) as paths from routed group by 1, 2, 3",
    "change_work": f"""with {_EVENTS}, sums as (select project_id, bool_or(override) as override, count(distinct case when scope = 'path' then path end) as n, bool_or(scope = 'reload') as r, bool_or(scope = 'full') as f from routed group by 1),
lists as (select project_id, string_agg(path, '|' order by path) as paths from (select distinct project_id, path from routed where scope = 'path') group by 1)
select s.project_id, case when r then 'reload' when f or n > 50 then 'full' else 'path' end as scope, case when not r and not f and n <= 50 then l.paths end as paths, override from sums s left join lists l using (project_id)""",
    "rescan_spread": "select id as project_id, 'full' as scope from projects",
    "containing_roots": r"""with r as (select id, case when id % 5 = 0 then regexp_replace(root, '/[^/]*$', '') else root end as root from projects),
f as (select distinct p.root || '/' || f.path as path from files f join projects p on p.id = f.project_id)
select f.path, r.id as project_id from f join r on f.path = r.root or starts_with(f.path, r.root || '/')""",
    "embed_due": f"with {_BACKLOG} select id from b where not (id % 6 = 0 or (id % 5 = 0 and id % 6 <> 0))",
    "poison_list": f"""with {_BACKLOG}, k as (select id, (id % 3 = 0)::int as had, case when id % 4 = 0 then 2 when id % 2 = 0 then 1 end as more from b),
p as (select id as chunk_rowid, had + coalesce(more, 0) as strikes, more from k where had = 1 or more is not null)
select chunk_rowid, strikes, case when more is null then 60 when strikes >= 2 then 100 + 720 else 100 + 60 end as retry_at from p order by retry_at desc, chunk_rowid limit 10000""",
    "latest_states": "select project_id::varchar as label, max_by(state, run_id) as status, max(run_id) as ticket from index_runs group by 1",
    "tool_times": """with e as (select event_type as tool, event_id::double as started, (case when event_id % 3 <> 0 then event_id + floor(value) end)::double as ended from events where event_id % 11 <> 0 and event_id % 13 <> 0)
select tool, count(*) as uses, sum(ended - started) as seconds, max(started) as last from e where ended >= started group by 1""",
    "run_throughput": """with h as (select run_id, count(*) as chunks, sum(length(path)) as bytes from (select distinct * from run_files) group by 1),
b as (select state as label, chunks, bytes, started_at::double as s, finished_at::double as e, finished_at::double - started_at as took from index_runs join h using (run_id) where finished_at is not null),
n as (select *, row_number() over (partition by label order by took) - 1 as i, count(*) over (partition by label) as k from b)
select label, sum(chunks)::bigint as chunks, round(sum(chunks) / (max(e) - min(s)), 6) as chunks_per_s, round(sum(chunks) * 3 / (max(e) - min(s)), 6) as tokens_per_s, round(sum(bytes) / (max(e) - min(s)) / 1e6, 6) as mb_per_s,
  round(median(took) * 1000, 6) as p50_ms, round(max(case when i = least(floor(k * 0.95), k - 1) then took * 1000 end), 6) as p95_ms from n group by label""",
    "session_uptake": """with v as (select user_id as session, trunc(value)::int as path, min(ts) as shown from events where event_type = 'view' group by 1, 2),
c as (select user_id as session, trunc(value)::int as path, max(ts) as seen from events where event_type = 'click' group by 1, 2)
select v.session, count(*) as returned, count(*) filter (where seen > shown) as used from v left join c on c.session = v.session and c.path is not distinct from v.path group by 1""",
    "pooled_for_judging": f"""with {_RANKED}, top as (select distinct query_id, chunk_rowid from runs where rank <= 10),
done as (select distinct query_id, chunk_rowid from s where tier >= 1 and chunk_rowid % 4 = chunk_rowid % 5)
select query_id, 'c/' || chunk_rowid as path, sha256((chunk_rowid % 5)::varchar) as content_hash from top anti join done using (query_id, chunk_rowid)""",
}

#: CTEs that end in headings (doc_id, n, place, level, title): the headings of the documents outside of fences.
_HEADINGS = rf"""
with recursive lines as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null),
marked as (select doc_id, n, regexp_replace(raw, '^{_SPACE}+', '') as line, regexp_extract(regexp_replace(raw, '^{_SPACE}+', ''), '^(`+|~+|#+)') as run from lines),
read as (select doc_id, n, left(run, 1) as mark, length(run) as k, substr(line, length(run) + 1) as rest, regexp_full_match(substr(line, length(run) + 1), '{_SPACE}*') as bare from marked),
walk(doc_id, n, fence, width, level, rest) as (
  select distinct doc_id, 0::bigint, '', 0::bigint, 0::bigint, '' from read
  union all
  select r.doc_id, r.n::bigint, case when w.fence <> '' then case when r.mark = w.fence and r.k >= w.width and r.bare then '' else w.fence end when r.mark in ('`', '~') and r.k >= 3 then r.mark else '' end,
    case when w.fence <> '' then w.width when r.mark in ('`', '~') then r.k else 0 end::bigint,
    case when w.fence = '' and r.mark = '#' and r.k <= 6 and (r.bare or left(r.rest, 1) in (' ', chr(9))) then r.k else 0 end::bigint, r.rest
  from walk w join read r on r.doc_id = w.doc_id and r.n = w.n + 1),
headings as (select doc_id, n, (row_number() over (partition by doc_id order by n))::int as place, level::int as level,
  regexp_replace(regexp_replace(regexp_replace(rest, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '(?:^|[ \t]+)#+$', ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') as title from walk where level > 0)
"""


SQL |= {
    "registry_steps": """with r as (select root, name, kind, row_number() over (order by id) as n from projects)
select case when n = 1 then 61 else n end as id, root, name, kind, case when n = 11 then 'lore-v1' end as authority_profile, case when n = 11 then 'rank' end as authority_behavior
from r where n = 1 or (n > 10 and n <> 12)""",
    "manifest_checksums": _LISTINGS + """select project_id * 1000 + snapshot_no as project_id,
  sha256(string_agg(concat_ws(chr(0), path, h, length(path)::varchar), chr(10) order by path)) as checksum from b group by 1""",
    "plugin_windows": windows_sql(20, 5) + """select 'd/' || doc_id || '.note' as path, count(*) as windows, min(a + length(lead) - length(replace(lead, chr(10), '')))::int as first_line,
  max(a + length(lead) - length(replace(lead, chr(10), '')) + length(body) - length(replace(body, chr(10), '')))::int as last_line from trimmed where body <> '' group by doc_id""",
    "vault_chunks": f"""select 'd/' || doc_id || '.md' as path, case doc_id % 5 when 0 then 'decided' when 1 then 'leaning' when 2 then 'exploration' when 3 then 'deprecated' end as design_status,
  case doc_id % 5 when 0 then 3 when 1 then 2 when 3 then 0 else 1 end as authority_tier, 'D-0001,D-0002' as refs from documents where not regexp_full_match(text, '{_SPACE}*')""",
    "headings_found": _HEADINGS + "select doc_id, place, level, title from headings",
}

_TREE = """t as (select doc_id, text, case doc_id % 10 when 4 then 'keep/' || doc_id || '.log' when 7 then '.hidden/' || doc_id || '.txt' else 'keep/a' || doc_id % 7 || '/' || doc_id || '.txt' end as path
  from documents where text is not null and doc_id % 10 not in (3, 5, 6) and not (doc_id % 10 = 4 and doc_id % 100 = 4 and doc_id >= 100))"""

SQL |= {
    "tree_files": f"with {_TREE} select path, strlen(text) as size, sha256(text) as sha256 from t",
    "tree_scope": f"with {_TREE} select path, sha256(text) as sha256 from t where starts_with(path, 'keep/a1/') or starts_with(path, 'keep/a3/') or starts_with(path, '.hidden/') or path in ('keep/14.log', 'keep/4.log')",
    "index_passes": """with d as (select doc_id, doc_id % 11 <> 0 as old, doc_id % 7 <> 0 as now, doc_id % 5 = 0 as other from documents where text is not null),
s as (select 1 as pass, 'new' as state from d where old union all select 2, case when not old then 'new' when not now then 'deleted' when other then 'changed' else 'unchanged' end from d where old or now
  union all select 3, case when old and not other then 'at 1' else 'at 2' end from d where now)
select pass, state, count(*) as files from s group by 1, 2""",
}

SQL["markdown_chunks"] = _HEADINGS + rf""",
d as (select doc_id, string_split(text, chr(10)) as l, strlen(text) as size from documents where text <> ''),
f as (select doc_id, l, size, len(l) - case when len(l) > 1 and l[-1] = '' then 1 else 0 end as total, list_transform(l, lambda x: strlen(x) + 1) as w from d),
e as (select doc_id, l, total, [0] || list_transform(range(1, total + 1), lambda i: least(list_sum(list_slice(w, 1, i::bigint)), size)::bigint) as e from f),
h as (select h.*, x.total, x.l, lead(n) over g as next_line, lead(level) over g as next_level from headings h join e x using (doc_id) window g as (partition by h.doc_id order by n)),
k as (select *, coalesce(next_level > level and strlen(regexp_replace(array_to_string(list_slice(l, n + 1, next_line - 1), chr(10)), '^{_SPACE}+|{_SPACE}+$', '', 'g')) < 24, false) as waits from h),
c as (select *, coalesce(max(case when not waits then place end) over (partition by doc_id order by place rows between unbounded preceding and 1 preceding), 0) + 1 as chain from k),
spans as (select c.doc_id, c.place, case when c.chain < c.place then j.n + 1 else c.n end as a, coalesce(c.next_line - 1, c.total) as b,
    (select list(t.title order by t.place) from k t where t.doc_id = c.doc_id and t.place < c.place and t.level < c.level
       and not exists (select 1 from k u where u.doc_id = c.doc_id and u.place > t.place and u.place < c.place and u.level <= t.level)) as above, c.title
  from c join c j on j.doc_id = c.doc_id and j.place = c.chain where not c.waits
  union all select x.doc_id, 0, 1, coalesce(m.n - 1, x.total), null, null from e x left join (select doc_id, min(n) as n from headings group by 1) m using (doc_id)),
texts as (select s.doc_id, s.place, s.a, x.e[s.a] as begin, case when s.place = 0 then [] else coalesce(s.above, []) || [s.title] end as path, array_to_string(list_slice(x.l, s.a, s.b), chr(10)) as t from spans s join e x using (doc_id)),
bodies as (select *, regexp_extract(t, '^{_SPACE}*') as lead, regexp_replace(t, '^{_SPACE}+|{_SPACE}+$', '', 'g') as body from texts),
whole as (select doc_id, place, path, body, begin + strlen(lead) as first, begin + strlen(lead) + strlen(body) as last, a + length(lead) - length(replace(lead, chr(10), '')) as line,
  a + length(lead) - length(replace(lead, chr(10), '')) + length(body) - length(replace(body, chr(10), '')) as until from bodies where body <> ''),
cut(doc_id, place, i, a, b) as (
  select w.doc_id, place, 0, line, greatest(line, line - 1 + len(list_filter(list_slice(x.e, line + 1, until + 1), lambda y: y - x.e[line] <= 4000))) from whole w join e x using (doc_id) where strlen(body) > 4000
  union all
  select doc_id, place, i, a, greatest(a, a - 1 + len(list_filter(list_slice(e, a + 1, until + 1), lambda y: y - e[a] <= 4000)))
  from (select c.doc_id, c.place, c.i + 1 as i, greatest(c.a + 1, c.b + 1 - 10) as a, w.until, x.e from cut c join whole w on w.doc_id = c.doc_id and w.place = c.place join e x on x.doc_id = c.doc_id where c.b < w.until)),
pieces as (select w.doc_id, w.place, c.i, w.path || ['#w' || c.i] as path, greatest(x.e[c.a], w.first) as begin,
    encode(w.body)[greatest(x.e[c.a], w.first) - w.first + 1 : least(x.e[c.b + 1], w.last) - w.first] as raw from cut c join whole w on w.doc_id = c.doc_id and w.place = c.place join e x on x.doc_id = c.doc_id),
parts as (select doc_id, place, i, path, begin, regexp_extract(decode(raw), '^{_SPACE}*') as lead, regexp_replace(decode(raw), '^{_SPACE}+|{_SPACE}+$', '', 'g') as body from pieces),
chunks_ as (select doc_id, place, -1 as i, path, body, first from whole where strlen(body) <= 4000 union all select doc_id, place, i, path, body, begin + strlen(lead) from parts where body <> ''),
numbered as (select *, row_number() over (partition by doc_id, path, body order by place, i) as twin from chunks_),
named as (select *, 'd/' || doc_id || '.md' as file, 'md:' || array_to_string(path || list_transform(range(1, twin), lambda y: '#d' || y), ' > ') as anchor from numbered)
select file as path, anchor, sha256(file || chr(0) || anchor || chr(0) || body) as chunk_id, first::int as byte_start, (first + strlen(body))::int as byte_end,
  len(list_filter(x.e, lambda y: y <= first))::int as line_start, len(list_filter(x.e, lambda y: y <= first + strlen(body) - 1))::int as line_end from named join e x using (doc_id)"""
