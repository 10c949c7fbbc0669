"""Authority: what a document claims, what its project's decisions bear out, and what ranking may use.

The tier of a row is one column expression over the row, its project and the project's active decisions; nothing is
re-chunked or re-embedded when decisions change. Decision sources are few and small beside the corpus; they are parsed line
by line on the JVM side and resolved by grouping on (project, decision).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.text import decision_refs

#: The authority profile, tiers by declared status, ceilings by path segment and source kind.
PROFILE = "lore-v1"
TIERS = {"decided": 3, "leaning": 2, "exploration": 1, "deprecated": 0}
NEUTRAL, CANON = 1, 3
UNCITED, SCRATCH, RESEARCH, SESSION = "uncited_decided", "scratch_path", "research_path", "session_source"
#: What a reader is told about a demotion.
NOTES = {
    UNCITED: "decided declared but cites no active decision",
    SCRATCH: "99_Scratch path cap",
    RESEARCH: "7_Research path cap",
    SESSION: "session source cap",
}
LABELS = {3: "decided", 2: "leaning", 1: "neutral", 0: "deprecated"}
LEDGER_PATH = r"(?:^|/)0_Canon/DECISIONS\.md$"
RECORD_PATH = r"(?:^|/)0_Canon/decisions/(D-[0-9]{4})-[^/]*\.(?:md|MD)$"


def declared_tier(status: Column) -> Column:
    """The tier of a declared status; none declared is neutral."""
    tier = F.lit(NEUTRAL)
    for s, t in TIERS.items():
        tier = F.when(status == s, t).otherwise(tier)
    return tier


def is_ledger(path: Column) -> Column:
    return path.rlike(LEDGER_PATH)


def record_id(path: Column) -> Column:
    """The decision that a record's file name claims, or null if the path is no record."""
    return F.nullif(F.regexp_extract(path, RECORD_PATH, 1), F.lit(""))


def effective(path: Column, status: Column, refs: Column, active: Column, kind: Column, profiled: Column) -> Column:
    """struct(tier, demotion) of a row. refs: the decisions its front matter cites; active: those of its project that
    stand; kind: `session` or other; profiled: whether the project takes part at all.

    Outside the profile all is neutral, sessions noted as such. Ledgers and records stand at the top. Elsewhere the
    declared tier is lowered by: a `decided` that cites no active decision (to neutral), scratch folders (to 0),
    research folders and sessions (to 1). The note names the first thing that lowered the tier to where it is, but a
    claim without a decision, being the document's own fault, always keeps the note."""
    segments = F.split(path, "/")
    declared = declared_tier(status)
    cited = F.coalesce(F.arrays_overlap(refs, active), F.lit(False))
    uncited = (status == "decided") & ~cited
    scratch, research = F.array_contains(segments, "99_Scratch"), F.array_contains(segments, "7_Research")
    session = kind == "session"
    start = F.when(uncited, NEUTRAL).otherwise(declared)
    # Folders act in the order in which they stand in the path.
    scratch_at, research_at = F.array_position(segments, F.lit("99_Scratch")), F.array_position(segments, F.lit("7_Research"))
    tier = F.least(start, F.when(scratch, 0).otherwise(CANON), F.when(research, 1).otherwise(CANON), F.when(session, 1).otherwise(CANON))
    research_first = research & (~scratch | (research_at < scratch_at)) & (start > 1)
    note = (
        F.when(uncited, UNCITED)
        .when(scratch & (start > 0), SCRATCH)
        .when(research_first, RESEARCH)
        .when(session & (F.least(start, F.when(scratch, 0).when(research, 1).otherwise(CANON)) > 1), SESSION)
    )
    neutral = F.struct(F.lit(NEUTRAL).alias("tier"), F.when(session, SESSION).alias("demotion"))
    canon = F.struct(F.lit(CANON).alias("tier"), F.lit(None).cast("string").alias("demotion"))
    judged = F.struct(tier.alias("tier"), note.alias("demotion"))
    return F.when(~F.coalesce(profiled, F.lit(False)), neutral).when(is_ledger(path) | record_id(path).isNotNull(), canon).otherwise(judged)


def label(tier: Column) -> Column:
    out = F.lit("neutral")
    for t, x in LABELS.items():
        out = F.when(tier == t, x).otherwise(out)
    return out


def note(demotion: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, text in NOTES.items():
        out = F.when(demotion == code, text).otherwise(out)
    return out


# --- decisions --------------------------------------------------------------------------------------------------------

_FIELD = r"^(?:[-*+][ \t]+)?\*{{0,2}}[ \t]*(?i:{0})\*{{0,2}}:\*{{0,2}}(.*)$"


def _field(line: Column, name: str) -> Column:
    """The value of a line like `- **Name:** value`, or null."""
    pattern = _FIELD.format(name)
    return F.when(line.rlike(pattern), F.trim(F.regexp_extract(line, pattern, 1)))


def bare_ids(value: Column) -> Column:
    """The ids of a field that is nothing but a list of ids; any other word makes it prose, which supersedes nothing."""
    words = F.filter(
        F.transform(F.split(F.trim(value), r"\s+"), lambda w: F.regexp_replace(w, r"^[\[\]*().,;]+|[\[\]*().,;]+$", "")),
        lambda w: (w != "") & (F.lower(w) != "and") & (w != "&"))
    return F.when(F.forall(words, lambda w: w.rlike("^D-[0-9]{4}$")), words).otherwise(F.array().cast("array<string>"))


def decision_entries(sources: DataFrame) -> DataFrame:
    """(project_id, path, id, mono, accepted, supersedes, violation) of ledgers and records.

    sources: (project_id, path, text) of decision files; other paths are ignored. In a ledger every `## D-NNNN` heading
    opens an entry and any `##` heading closes it; in a record the file name gives the id, its first heading must not
    name another one, and if it names the same one only the lines up to the next heading count. `mono` is true for
    ledgers. Each file is split into lines inside its own row; entries are told apart by the running number of headings."""
    rows = sources.where("path is not null and text is not null").select(
        "project_id", "path", record_id(F.col("path")).alias("_rid"), is_ledger(F.col("path")).alias("mono"),
        F.split(F.regexp_replace("text", "^﻿", ""), r"\r?\n").alias("_lines")).where("mono or _rid is not null")
    lines = rows.select("project_id", "path", "_rid", "mono", F.posexplode("_lines").alias("_n", "_line")).withColumn("_line", F.ltrim("_line"))
    order = Window.partitionBy("project_id", "path").orderBy("_n")
    heading = F.when(F.col("mono"), F.startswith("_line", F.lit("##"))).otherwise(F.startswith("_line", F.lit("#")))
    named = F.nullif(F.regexp_extract("_line", r"^#+\s*(D-[0-9]{4})(?![A-Za-z0-9_])", 1), F.lit(""))
    blocks = lines.withColumn("_h", heading).withColumn("_block", F.sum(F.col("_h").cast("int")).over(order)).withColumn("_named", F.when(F.col("_h"), named))
    status = F.when(~F.col("_h"), _field(F.col("_line"), "Status"))
    supersedes = F.when(~F.col("_h"), _field(F.col("_line"), "Supersedes"))
    by_block = blocks.groupBy("project_id", "path", "_rid", "mono", "_block").agg(
        F.max("_named").alias("_named"),
        F.max_by(F.lower(F.regexp_replace(status, r"[*. ]+$", "")), F.when(status.isNotNull(), F.col("_n"))).alias("_status"),
        F.flatten(F.collect_list(bare_ids(supersedes))).alias("supersedes"))
    ledger = by_block.where("mono and _named is not null").select("project_id", "path", F.col("_named").alias("id"), "mono", (F.coalesce(F.col("_status"), F.lit("")) == "accepted").alias("accepted"), "supersedes", F.lit(None).cast("string").alias("violation"))
    # A record is one entry: its first heading's block if that heading names its id, else the whole file.
    per_file = by_block.where("not mono").groupBy("project_id", "path", "_rid").agg(
        F.max(F.when(F.col("_block") == 1, F.col("_named"))).alias("_first"),
        F.max_by(F.when(F.col("_status").isNotNull(), F.col("_status")), F.when(F.col("_status").isNotNull(), F.col("_block"))).alias("_any"),
        F.max(F.when(F.col("_block") == 1, F.col("_status"))).alias("_own"),
        F.flatten(F.collect_list("supersedes")).alias("_all_s"),
        F.flatten(F.collect_list(F.when(F.col("_block") == 1, F.col("supersedes")))).alias("_own_s"))
    scoped = F.col("_first").isNotNull()
    wrong = scoped & (F.col("_first") != F.col("_rid"))
    record = per_file.select(
        "project_id", "path", F.col("_rid").alias("id"), F.lit(False).alias("mono"),
        (F.coalesce(F.when(scoped, F.col("_own")).otherwise(F.col("_any")), F.lit("")) == "accepted").alias("accepted"),
        F.when(scoped, F.col("_own_s")).otherwise(F.col("_all_s")).alias("supersedes"),
        F.when(wrong, F.concat(F.lit("heading names "), F.col("_first"), F.lit(", file name claims "), F.col("_rid"))).alias("violation"))
    return ledger.unionByName(record)


def resolve(entries: DataFrame) -> DataFrame:
    """Adds to decision_entries `excluded` and, where an id collides, `violation`.

    A ledger's entry beats every record of its id; records alone of one id exclude each other; ledgers of one id stand
    side by side; a record with a violation is out before ids are compared."""
    clean = F.col("violation").isNull()
    by_id = Window.partitionBy("project_id", "id")
    in_ledger = F.max((F.col("mono") & clean).cast("int")).over(by_id) == 1
    records = F.count_if(~F.col("mono") & clean).over(by_id)
    clash = F.when(~F.col("mono") & clean & in_ledger, F.lit("duplicate id: a ledger holds it")).when(
        ~F.col("mono") & clean & (records > 1), F.lit("duplicate id across records"))
    marked = entries.withColumn("_clash", clash)
    return marked.withColumn("excluded", F.col("violation").isNotNull() | F.col("_clash").isNotNull()).withColumn(
        "violation", F.coalesce("violation", "_clash")).drop("_clash")


def active_decisions(resolved: DataFrame) -> DataFrame:
    """(project_id, id) of accepted decisions that no accepted decision of the project supersedes."""
    live = resolved.where("not excluded and accepted")
    gone = live.select("project_id", F.explode("supersedes").alias("id")).distinct()
    return live.select("project_id", "id").distinct().join(gone, ["project_id", "id"], "left_anti")


def decision_totals(resolved: DataFrame) -> DataFrame:
    """(project_id, total) distinct decisions that were not excluded."""
    return resolved.where("not excluded").groupBy("project_id").agg(F.count_distinct("id").alias("total"))


def namespace_warnings(sources: DataFrame) -> DataFrame:
    """(project_id, root, first_root): authority roots beyond a project's first; they share one set of ids."""
    path = F.col("path")
    root = F.when(is_ledger(path), F.regexp_replace(path, r"/?DECISIONS\.md$", "")).when(
        record_id(path).isNotNull(), F.regexp_replace(path, r"/decisions/[^/]*$", ""))
    roots = sources.select("project_id", root.alias("root")).where("root is not null").distinct()
    firsts = roots.groupBy("project_id").agg(F.min("root").alias("first_root"))
    return roots.join(firsts, "project_id").where("root > first_root")


def recompute(chunks: DataFrame, projects: DataFrame, active: DataFrame) -> DataFrame:
    """(id, project_id, path, tier, demotion, changed) of every chunk under the given active decisions.

    changed: whether tier or demotion differ from the stored effective_tier and demotion, so that a writer touches
    only those rows. projects: (id, kind, authority_profile, authority_behavior); a behavior of `off` is no profile."""
    sets = active.groupBy("project_id").agg(F.collect_set("id").alias("_active"))
    p = projects.select(
        F.col("id").alias("project_id"), F.col("kind").alias("_kind"),
        ((F.col("authority_profile") == PROFILE) & (F.coalesce("authority_behavior", F.lit("annotate")) != "off")).alias("_on"))
    refs = F.coalesce(F.from_json(F.get_json_object("vault", "$.decision_refs"), "array<string>"), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    rows = chunks.join(p, "project_id", "left").join(sets, "project_id", "left")
    verdict = effective(F.col("path"), F.col("design_status"), refs, F.coalesce("_active", none), F.coalesce("_kind", F.lit("repo")), F.col("_on"))
    out = rows.select("id", "project_id", "path", "effective_tier", F.col("demotion").alias("_old"), verdict.alias("_v"))
    changed = ~(F.col("effective_tier").eqNullSafe(F.col("_v.tier")) & F.col("_old").eqNullSafe(F.col("_v.demotion")))
    return out.select("id", "project_id", "path", F.col("_v.tier").alias("tier"), F.col("_v.demotion").alias("demotion"), changed.alias("changed"))


def recompute_summary(recomputed: DataFrame) -> DataFrame:
    """One row: files, files_changed, chunks_changed, violations (chunks that claim `decided` without a decision)."""
    once = recomputed.dropDuplicates(["id"])
    per_file = once.groupBy("project_id", "path").agg(F.count_if("changed").alias("c"), F.count_if(F.col("demotion") == UNCITED).alias("v"))
    return per_file.agg(
        F.count("*").alias("files"), F.count_if(F.col("c") > 0).alias("files_changed"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("chunks_changed"), F.coalesce(F.sum("v"), F.lit(0)).alias("violations"))


def same_decisions(a: DataFrame, b: DataFrame) -> bool:
    """Whether two decision sets are equal."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def changed_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, gained, lost) of the projects whose decisions (project_id, id) differ between two sets."""
    a, b = (df.select("project_id", "id").distinct().withColumn(n, F.lit(True)) for df, n in ((old, "_a"), (new, "_b")))
    both = a.join(b, ["project_id", "id"], "full")
    counts = both.groupBy("project_id").agg(F.count_if(F.col("_a").isNull()).alias("gained"), F.count_if(F.col("_b").isNull()).alias("lost"))
    return counts.where("gained + lost > 0")


def cited_in_text(chunks: DataFrame) -> DataFrame:
    """(id, refs): the decisions that chunk texts mention; they carry no weight."""
    return chunks.select("id", decision_refs(F.col("text")).alias("refs")).where(F.size("refs") > 0)
