"""Queries of indexing, authority, reports and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import authority as A
from tesserine.operators import chunking, evaluation, indexing, status
from tesserine.operators.snapshots import complete_sequence, consecutive_listings, file_listing
from tesserine.plans.search_queries import stored_chunks
from tesserine.sources.store import repair_names
from tesserine.sources.tables import table

PAIR = ("project_id", "snapshot_no")
PAIR_KEYS = [*PAIR, "path"]


def _listings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """What is stored and observed in every pair of consecutive complete listings of each project."""
    sequence = complete_sequence(table(spark, sf, "manifests"), "project_id", "snapshot_no", "is_complete")
    return consecutive_listings(file_listing(table(spark, sf, "file_snapshots")), sequence)


def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    stored, observed = _listings(spark, sf)
    return indexing.classify(observed, stored, keys=PAIR_KEYS).select(*PAIR_KEYS, "state")


def scoped_diff(spark: SparkSession, sf: str) -> DataFrame:
    stored, observed = _listings(spark, sf)
    scope = table(spark, sf, "projects").select(F.col("id").alias("project_id"), F.lit("src").alias("scope"))
    return indexing.classify(indexing.in_scope(observed, scope, PAIR_KEYS), stored, scope, keys=PAIR_KEYS).select(*PAIR_KEYS, "state")


def mass_delete_guard(spark: SparkSession, sf: str) -> DataFrame:
    stored, observed = _listings(spark, sf)
    return indexing.guard(indexing.classify(observed, stored, keys=PAIR_KEYS), stored, PAIR)


def pass_summary(spark: SparkSession, sf: str) -> DataFrame:
    stored, observed = _listings(spark, sf)
    return indexing.pass_summary(indexing.classify(observed, stored, keys=PAIR_KEYS), PAIR)


def manifest_needs(spark: SparkSession, sf: str) -> DataFrame:
    stored, observed = _listings(spark, sf)
    return indexing.negotiate(observed, stored, PAIR_KEYS).where("need").select(*PAIR_KEYS)


def malformed_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The paths of the raw listings, whose senders did not all use forward slashes, with what else can be wrong with a
    path put in front of it by the number of its snapshot."""
    wrong = {1: "/", 2: "C:", 3: "a//", 4: "../", 5: ".GIT/", 6: "a/../"}
    front = F.lit("")
    for n, x in wrong.items():
        front = F.when(F.col("snapshot_no") == n, x).otherwise(front)
    path = F.when((F.col("snapshot_no") == 8) & (F.char_length("path") % 2 == 0), "").otherwise(F.concat(front, "path"))
    raw = table(spark, sf, "file_snapshots").select("project_id", path.alias("path")).distinct()
    return indexing.malformed(raw).groupBy("reason").agg(F.count("*").alias("paths"))


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return status.status_counts(*(table(spark, sf, t) for t in ("projects", "files", "chunks", "chunk_vectors")), ledger_active(spark, sf))


def top_offenders(spark: SparkSession, sf: str) -> DataFrame:
    judged = A.recompute(table(spark, sf, "chunks"), table(spark, sf, "projects"), ledger_active(spark, sf))
    return status.top_offenders(judged)


def fleet_totals(spark: SparkSession, sf: str) -> DataFrame:
    return status.fleet_totals(status_counts(spark, sf))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return status.latency_percentiles(table(spark, sf, "events"), "event_type", "ts", "value")


def client_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = status.client_percentiles(table(spark, sf, "events"), "event_type", "value")
    return rows.withColumn("mean", F.round("mean", 6))


def skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as files; by the last digit of their ids some have a NUL byte, or a byte that is no UTF-8, or are
    repeated until they are too large, or stand on one line."""
    text, digit = F.coalesce("text", F.lit("")), F.col("doc_id") % 100
    padded = F.concat(text, F.lit("padding"))
    times = (F.floor(F.lit(chunking.MAX_FILE_BYTES) / F.octet_length(padded)) + 1).cast("int")  # no more than it takes, as one file lies in memory
    mutated = (
        F.when(digit == 1, F.concat(text.substr(1, 100), F.lit("\x00"), text).cast("binary")).when(digit == 2, F.concat(text.cast("binary"), F.lit(b"\xff\xfe")))
        .when(digit == 3, F.repeat(padded, times).cast("binary")).when(digit == 4, F.repeat(F.translate(text, "\n", " "), 9).cast("binary")).otherwise(text.cast("binary")))
    kind = F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt")
    docs = table(spark, sf, "documents").select(F.lit(1).alias("project_id"), F.concat(F.lit("d/"), F.col("doc_id"), kind).alias("path"), mutated.alias("content"))
    return chunking.skipped_files(docs).select("path", "reason")


def window_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("project_id"), F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return chunking.chunk_files(docs).select("path", "anchor", "chunk_id", "byte_start", "byte_end", "line_start", "line_end")


def markdown_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("project_id"), F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".md")).alias("path"), F.col("text").cast("binary").alias("content"))
    return chunking.chunk_files(docs).select("path", "anchor", "chunk_id", "byte_start", "byte_end", "line_start", "line_end")


def _document_ledgers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document of a project as a ledger of it. Only texts with the heading of a decision can hold an entry, so the
    others are left out before lines are told apart."""
    docs = table(spark, sf, "documents").where("project_id is not null").where(F.col("text").rlike(r"##\s*D-[0-9]{4}"))
    return docs.select("project_id", F.concat(F.lit("d/"), F.col("doc_id"), F.lit("/0_Canon/DECISIONS.md")).alias("path"), "text")


def ledger_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every decision in the documents as it resolves."""
    return A.resolve(A.decision_entries(_document_ledgers(spark, sf))).select("project_id", "path", "id", "accepted", "excluded", "violation")


def ledger_active(spark: SparkSession, sf: str) -> DataFrame:
    return A.active_decisions(A.resolve(A.decision_entries(_document_ledgers(spark, sf))))


def effective_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk's tier under the active decisions of its project's documents."""
    return A.recompute(stored_chunks(spark, sf), table(spark, sf, "projects"), ledger_active(spark, sf)).select("id", "tier", "demotion")


def ledger_violations(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the decision files, where documents with odd ids are records in place of ledgers: each claims the
    first decision it names, every fifth one the decision after it."""
    docs = _document_ledgers(spark, sf).withColumn("doc_id", F.regexp_extract("path", "^d/([0-9]+)/", 1).cast("long"))
    number = F.regexp_extract("text", r"##\s*D-([0-9]{4})", 1).cast("int") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    record = F.format_string("d/%d/0_Canon/decisions/D-%04d-x.md", "doc_id", number)
    sources = docs.select("project_id", F.when(F.col("doc_id") % 2 == 1, record).otherwise(F.col("path")).alias("path"), "text")
    return A.resolve(A.decision_entries(sources)).where("violation is not null").select("project_id", "path", "violation").distinct()


def namespace_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return A.namespace_warnings(_document_ledgers(spark, sf))


def recompute_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.recompute_summary(A.recompute(stored_chunks(spark, sf), table(spark, sf, "projects"), ledger_active(spark, sf)))


def decision_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Which projects' active decisions differ between the ledgers ingested first and all of them."""
    ledgers = _document_ledgers(spark, sf)
    early = ledgers.where(F.regexp_extract("path", "^d/([0-9]+)/", 1).cast("long") % 4 != 0)
    active = lambda rows: A.active_decisions(A.resolve(A.decision_entries(rows)))
    return A.changed_decisions(active(early), active(ledgers))


def cited_refs(spark: SparkSession, sf: str) -> DataFrame:
    return A.cited_in_text(stored_chunks(spark, sf)).select("id", F.array_join("refs", ",").alias("refs"))


def repaired_names(spark: SparkSession, sf: str) -> DataFrame:
    """The registry with every second name cut to its first word, so that names clash."""
    p = table(spark, sf, "projects")
    rows = p.select("root", F.when(F.col("id") % 2 == 0, "shared").otherwise(F.col("name")).alias("name"), "kind", F.col("id").cast("int").alias("n"))
    return repair_names(rows).select("root", "name")


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scored candidates as retrieval runs: a model per arm, a path per candidate; what has a tier of 2 or more is
    relevant, and tiers 1 to 3 are labels 0 to 2."""
    s = table(spark, sf, "scored").where("score is not null and not isnan(score) and arm is not null").select("query_id", "chunk_rowid", "arm", "score", "tier").distinct()
    better = F.when(F.col("arm") == "lexical", -F.col("score")).otherwise(F.col("score"))
    best = s.groupBy("arm", "query_id", "chunk_rowid").agg(F.max(better).alias("s"), F.max("tier").alias("tier"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("arm", "query_id").orderBy(F.desc("s"), "chunk_rowid"))
    path = F.concat(F.lit("c/"), F.col("chunk_rowid")).alias("path")
    # An older run of every model had its results the wrong way round; an older label of every result was another one.
    worst = F.row_number().over(Window.partitionBy("arm", "query_id").orderBy("s", "chunk_rowid"))
    model = F.col("arm").alias("model")
    runs = best.select(model, F.lit(2).alias("run_set"), "query_id", rank.alias("rank"), path).unionByName(best.select(model, F.lit(1).alias("run_set"), "query_id", worst.alias("rank"), path))
    cand = s.where("tier is not null").select("query_id", path, "tier").distinct()
    keys = cand.where("tier >= 2").select("query_id", F.when(F.col("query_id") % 2 == 0, "symbol").otherwise("semantic").alias("kind"), "path")
    label = F.explode(F.array(F.struct((F.col("tier") - 1).alias("label"), F.lit(20).alias("at")), F.struct((3 - F.col("tier")).alias("label"), F.lit(10).alias("at")))).alias("_l")
    judged = cand.where("tier >= 1").select("query_id", "path", label).select("query_id", "path", "_l.label", "_l.at")
    return runs, keys, judged


def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    runs, keys, _ = _runs(spark, sf)
    per_query = evaluation.key_metrics(evaluation.latest_runs(runs), keys)
    return evaluation.macro(per_query, ["model"], ["hit5", "hit10", "mrr10", "ndcg10"])


def precision_judged(spark: SparkSession, sf: str) -> DataFrame:
    runs, _, judged = _runs(spark, sf)
    return evaluation.macro(evaluation.judged_metrics(evaluation.latest_runs(runs), judged), ["model"], ["p5", "p10", "strict_p5", "coverage", "graded_ndcg"])


def hit_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    runs, keys, _ = _runs(spark, sf)
    return evaluation.by_kind(evaluation.key_metrics(evaluation.latest_runs(runs), keys))


def judge_calibration(spark: SparkSession, sf: str) -> DataFrame:
    _, keys, judged = _runs(spark, sf)
    return evaluation.calibration(keys, judged)


def worst_offenders(spark: SparkSession, sf: str) -> DataFrame:
    runs, keys, judged = _runs(spark, sf)
    last = evaluation.latest_runs(runs)
    return evaluation.offenders(evaluation.key_metrics(last, keys), evaluation.judged_metrics(last, judged))


QUERIES = {
    f.__name__: f
    for f in (
        manifest_diff, scoped_diff, mass_delete_guard, pass_summary, manifest_needs, malformed_paths, status_counts, top_offenders, fleet_totals,
        latency_percentiles, client_percentiles, skip_reasons, window_chunks, markdown_chunks, effective_tiers, ledger_active, ledger_violations,
        ledger_decisions, namespace_warnings, recompute_counts, decision_changes, cited_refs, repaired_names, ir_metrics, precision_judged, hit_by_kind, judge_calibration, worst_offenders,
    )
}

_RUNS = """
with s as (select distinct query_id, chunk_rowid, arm, score, tier from scored where score is not null and not isnan(score) and arm is not null),
best as (select arm, query_id, chunk_rowid, max(case when arm = 'lexical' then -score else score end) as s from s group by 1, 2, 3),
runs as (select arm as model, query_id, 'c/' || chunk_rowid as path, row_number() over (partition by arm, query_id order by s desc, chunk_rowid) as rank from best),
cand as (select distinct query_id, 'c/' || chunk_rowid as path, tier from s where tier is not null),
keys as (select query_id, case when query_id % 2 = 0 then 'symbol' else 'semantic' end as kind, path from cand where tier >= 2),
labels as (select query_id, path, max(tier - 1) as label from cand where tier >= 1 group by 1, 2),
wanted as (select query_id, max(kind) as kind, count(distinct path) as n from keys group by 1),
found as (select r.model, r.query_id, min(rank) as first_rank, sum(1.0 / log2(rank + 1)) as dcg from runs r join keys k using (query_id, path) where rank <= 10 group by 1, 2),
per_query as (select m.model, w.query_id, w.kind, f.first_rank, coalesce((f.first_rank <= 5)::int, 0) as hit5, coalesce((f.first_rank <= 10)::int, 0) as hit10,
   coalesce(1.0 / f.first_rank, 0) as mrr10, coalesce(f.dcg / list_sum(list_transform(range(1, least(w.n, 10) + 1), lambda i: 1.0 / log2(i + 1))), 0) as ndcg10
   from (select distinct model from runs) m cross join wanted w left join found f on f.model = m.model and f.query_id = w.query_id),
top as (select r.*, l.label from runs r left join labels l using (query_id, path) where r.rank <= 10),
ideal as (select query_id, sum(label / log2(i + 1)) as ideal from (select query_id, label, row_number() over (partition by query_id order by label desc, path) as i from labels) where i <= 10 group by 1),
judged as (select t.model, t.query_id, avg(case when label is not null and rank <= 5 then (label >= 1)::int end) as p5, avg(case when label is not null then (label >= 1)::int end) as p10,
   avg(case when label is not null and rank <= 5 then (label >= 2)::int end) as strict_p5, count(label) / least(count(*), 10) as coverage,
   case when max(i.ideal) > 0 then sum(coalesce(label, 0) / log2(rank + 1)) / max(i.ideal) end as graded_ndcg
   from top t left join ideal i using (query_id) group by 1, 2)
"""

_CLIENT = "max(case when i = round_even(p * (n - 1), 0) then value end)"

SQL = {
    "malformed_paths": r"""with p as (select distinct project_id, case when snapshot_no = 8 and length(path) % 2 = 0 then '' else
 case snapshot_no when 1 then '/' when 2 then 'C:' when 3 then 'a//' when 4 then '../' when 5 then '.GIT/' when 6 then 'a/../' else '' end || path end as path from file_snapshots),
r as (select case when path is null or path = '' then 'empty' when contains(path, chr(92)) then 'backslash' when starts_with(path, '/') then 'absolute'
 when regexp_matches(path, '^[A-Za-z]:') then 'drive letter' when contains('/' || path || '/', '//') then 'empty component'
 when contains('/' || path || '/', '/../') then 'parent component' when contains('/' || lower(path) || '/', '/.git/') then 'git metadata' end as reason from p)
select reason, count(*) as paths from r where reason is not null group by reason""",
    "fleet_totals": """with t as (select (select count(distinct id) from chunks where project_id in (select id from projects)) as chunks,
(select count(distinct chunk_rowid) from chunk_vectors where project_id in (select id from projects)) as embedded)
select chunks, embedded, case when chunks > 0 then round(embedded * 100.0 / chunks)::int else 0 end as coverage from t""",
    "latency_percentiles": """with r as (select event_type as label, value, row_number() over (partition by event_type order by ts desc, value desc) as r, count(*) over (partition by event_type) as n_total
 from events where value is not null)
select label, any_value(n_total) as n_total, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.9) as p90, quantile_disc(value, 0.95) as p95,
 quantile_disc(value, 0.99) as p99, max(value) as max from r where r <= 4096 group by label""",
    "client_percentiles": f"""with r as (select event_type as label, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
select label, count(*) as n, round(avg(value), 6) as mean, {_CLIENT.replace("p *", "0.5 *")} as p50, {_CLIENT.replace("p *", "0.95 *")} as p95, max(value) as max from r group by label""",
    "skip_reasons": """with d as (select doc_id, coalesce(text, '') as text, 'd/' || doc_id || case when doc_id % 3 = 0 then '.md' else '.txt' end as path, doc_id % 100 as digit from documents),
t as (select *, case digit when 4 then repeat(replace(text, chr(10), ' '), 9) else text end as body from d)
select path, case when digit = 3 then 'too large' when digit = 1 or contains(left(body, 8192), chr(0)) then 'binary' when digit = 2 then 'invalid utf-8'
 when doc_id % 3 <> 0 and list_bool_or(list_transform(string_split(body, chr(10)), lambda l: strlen(l) > 4096)) then 'machine text' end as reason from t where reason is not null""",
    "repaired_names": """with r as (select root, case when id % 2 = 0 then 'shared' else name end as name, id from projects),
n as (select *, row_number() over (partition by lower(name) order by id) as p from r)
select root, case when p > 1 then name || ' (' || p || ')' else name end as name from n""",
    "ir_metrics": _RUNS + "select model, count(*) as queries, round(avg(hit5), 9) as hit5, round(avg(hit10), 9) as hit10, round(avg(mrr10), 9) as mrr10, round(avg(ndcg10), 9) as ndcg10 from per_query group by model",
    "precision_judged": _RUNS + "select model, count(*) as queries, round(avg(p5), 9) as p5, round(avg(p10), 9) as p10, round(avg(strict_p5), 9) as strict_p5, round(avg(coverage), 9) as coverage, round(avg(graded_ndcg), 9) as graded_ndcg from judged group by model",
    "hit_by_kind": _RUNS + "select model, round(avg(case when kind = 'semantic' then hit10 end), 9) as semantic, round(avg(case when kind = 'symbol' then hit10 end), 9) as symbol from per_query group by model",
    "judge_calibration": _RUNS + "select count(*) as judged, count(*) filter (where label >= 1) as relevant, count(*) filter (where label = 2) as \"full\" from keys join labels using (query_id, path)",
    "worst_offenders": _RUNS + "select q.model, q.query_id, q.first_rank::int as first_rank, j.p5 from per_query q left join judged j using (model, query_id) where first_rank is null or first_rank > 5 or p5 < 0.4",
}

_DECISIONS = r"""
with lines as (select project_id, doc_id, generate_subscripts(l, 1) as n, ltrim(unnest(l), ' ') as line
               from (select project_id, doc_id, string_split(replace(ltrim(text, chr(65279)), chr(13) || chr(10), chr(10)), chr(10)) as l from documents where project_id is not null and text is not null)),
blocks as (select *, starts_with(line, '##') as heading, sum(starts_with(line, '##')::int) over (partition by project_id, doc_id order by n) as block,
           '^(?:[-*+][ \t]+)?\*{0,2}[ \t]*(?i:STATUS)\*{0,2}:\*{0,2}(.*)$' as st, '^(?:[-*+][ \t]+)?\*{0,2}[ \t]*(?i:SUPERSEDES)\*{0,2}:\*{0,2}(.*)$' as su from lines),
marked as (select *, case when heading then nullif(regexp_extract(line, '^#+\s*(D-[0-9]{4})(?:[^A-Za-z0-9_]|$)', 1), '') end as named,
           case when not heading and regexp_matches(line, st) then lower(regexp_replace(trim(regexp_extract(line, st, 1), ' '), '[*. ]+$', '')) end as status,
           case when not heading and regexp_matches(line, su) then list_filter(list_transform(regexp_split_to_array(trim(regexp_extract(line, su, 1)), '\s+'),
             lambda w: regexp_replace(w, '^[\[\]*().,;]+|[\[\]*().,;]+$', '', 'g')), lambda w: w <> '' and lower(w) <> 'and' and w <> '&') end as words from blocks),
entries as (select project_id, doc_id, block, max(named) as id, coalesce(arg_max(status, n) filter (where status is not null), '') = 'accepted' as accepted,
            flatten(list(words) filter (where len(list_filter(words, lambda w: not regexp_full_match(w, 'D-[0-9]{4}'))) = 0)) as supersedes
            from marked group by 1, 2, 3 having max(named) is not null),
active as (select distinct project_id, id from entries where accepted except select project_id, unnest(supersedes) from entries where accepted)
"""

#: CTEs that end in tiers (id, project_id, path, tier, demotion, effective_tier, old).
_TIERS = _DECISIONS + r""",
c as (select distinct * from chunks),
v as (select *, coalesce(from_json(json_extract(vault, '$.decision_refs'), '["VARCHAR"]'), []) as refs from c),
p as (select id as project_id, kind as pkind, authority_profile = 'lore-v1' and coalesce(authority_behavior, 'annotate') <> 'off' as is_on from projects),
k as (select v.*, p.pkind, coalesce(p.is_on, false) as is_on, exists (select 1 from active a where a.project_id = v.project_id and list_contains(v.refs, a.id)) as cited,
  string_split(path, '/') as seg, case design_status when 'decided' then 3 when 'leaning' then 2 when 'deprecated' then 0 else 1 end as declared from v left join p using (project_id)),
s as (select *, case when design_status = 'decided' and not cited then 1 else declared end as start, list_contains(seg, '99_Scratch') as scratch, list_contains(seg, '7_Research') as research from k),
tiers as (select id, project_id, path, effective_tier, demotion as old, case when not is_on then 1 when regexp_matches(path, '(^|/)0_Canon/DECISIONS\.md$') or regexp_matches(path, '(^|/)0_Canon/decisions/D-[0-9]{4}-[^/]*\.(md|MD)$') then 3
  else least(start, case when scratch then 0 else 3 end, case when research then 1 else 3 end, case when pkind = 'session' then 1 else 3 end) end as tier,
 case when not is_on then case when pkind = 'session' then 'session_source' end
  when regexp_matches(path, '(^|/)0_Canon/DECISIONS\.md$') or regexp_matches(path, '(^|/)0_Canon/decisions/D-[0-9]{4}-[^/]*\.(md|MD)$') then null
  when design_status = 'decided' and not cited then 'uncited_decided' when scratch and start > 0 then 'scratch_path' when research and start > 1 then 'research_path'
  when pkind = 'session' and start > 1 then 'session_source' end as demotion from s)
"""

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"



def windows_sql(lines: int = 80, overlap: int = 10) -> str:
    """CTEs that end in trimmed (doc_id, i, a, begin, lead, body): the line windows of the documents."""
    return rf"""with recursive docs as (select doc_id, text, string_split(text, chr(10)) as l from documents where text <> '' and strlen(text) <= 2097152 and not contains(left(text, 8192), chr(0))),
files as (select doc_id, l, len(l) - case when len(l) > 1 and l[-1] = '' then 1 else 0 end as n, strlen(text) as size, list_transform(l, lambda x: strlen(x) + 1) as w
  from docs where list_max(list_transform(l, lambda x: strlen(x))) <= 4096),
ends as (select doc_id, l, n, list_transform(range(1, n + 1), lambda i: least(list_sum(list_slice(w, 1, i::bigint)), size)::bigint) as e from files),
cut(doc_id, i, a, b) as (
  select doc_id, 0, 1::bigint, greatest(1, len(list_filter(list_slice(e, 1, least(n, {lines})), lambda x: x <= 8000)))::bigint from ends
  union all
  select doc_id, i, a, greatest(a, a - 1 + len(list_filter(list_slice(e, a, least(n, a + {lines} - 1)), lambda x: x - case when a > 1 then e[a - 1] else 0 end <= 8000)))::bigint
  from (select c.doc_id, c.i + 1 as i, greatest(c.a + 1, c.b + 1 - {overlap}) as a, x.e, x.n from cut c join ends x using (doc_id) where c.b < x.n)),
spans as (select doc_id, i, a, case when a > 1 then e[a - 1] else 0 end as begin, array_to_string(list_slice(l, a, b), chr(10)) as t from cut join ends using (doc_id)),
trimmed as (select *, regexp_extract(t, '^{_SPACE}*') as lead, regexp_replace(regexp_replace(t, '^{_SPACE}+', ''), '{_SPACE}+$', '') as body from spans)
"""


SQL |= {
    "window_chunks": windows_sql() + """select 'd/' || doc_id || '.txt' as path, 'win:' || i as anchor, sha256('d/' || doc_id || '.txt' || chr(0) || 'win:' || i || chr(0) || body) as chunk_id,
  (begin + strlen(lead))::int as byte_start, (begin + strlen(lead) + strlen(body))::int as byte_end, (a + length(lead) - length(replace(lead, chr(10), '')))::int as line_start,
  (a + length(lead) - length(replace(lead, chr(10), '')) + length(body) - length(replace(body, chr(10), '')))::int as line_end from trimmed where body <> ''""",
    "ledger_decisions": _DECISIONS + "select project_id, 'd/' || doc_id || '/0_Canon/DECISIONS.md' as path, id, accepted, false as excluded, null::varchar as violation from entries",
    "ledger_active": _DECISIONS + "select project_id, id from active",
    "effective_tiers": _TIERS + "select id, tier, demotion from tiers",
    "top_offenders": _TIERS + """, bad as (select distinct project_id, path from tiers where demotion = 'uncited_decided')
select project_id, path, (row_number() over (partition by project_id order by path))::int as place from bad qualify place <= 5""",
    "recompute_counts": _TIERS + """, f as (select project_id, path, count(*) filter (where tier is distinct from effective_tier or demotion is distinct from old) as c,
  count(*) filter (where demotion = 'uncited_decided') as v from tiers group by 1, 2)
select count(*) as files, count(*) filter (where c > 0) as files_changed, coalesce(sum(c), 0)::bigint as chunks_changed, coalesce(sum(v), 0)::bigint as violations from f""",
    "status_counts": _DECISIONS + """, f as (select project_id, count(distinct path) as n from files group by 1),
k as (select project_id, count(distinct id) as n, count(distinct case when demotion = 'uncited_decided' then path end) as bad from chunks group by 1),
v as (select project_id, count(distinct chunk_rowid) as n from chunk_vectors group by 1), d as (select project_id, count(distinct id) as n from active group by 1)
select p.id as project_id, coalesce(f.n, 0) as files, coalesce(k.n, 0) as chunks, coalesce(v.n, 0) as embedded, coalesce(k.bad, 0) as violating_files, coalesce(d.n, 0) as active_decisions
from projects p left join f on f.project_id = p.id left join k on k.project_id = p.id left join v on v.project_id = p.id left join d on d.project_id = p.id""",
    "namespace_warnings": _DECISIONS + """, roots as (select distinct project_id, 'd/' || doc_id || '/0_Canon' as root from documents where project_id is not null and regexp_matches(text, '##\\s*D-[0-9]{4}'))
select project_id, root, min(root) over (partition by project_id) as first_root from roots qualify root > first_root""",
    "decision_changes": _DECISIONS + """, early as (select * from entries where doc_id % 4 <> 0),
old as (select distinct project_id, id from early where accepted except select project_id, unnest(supersedes) from early where accepted),
both_sets as (select coalesce(o.project_id, a.project_id) as project_id, o.id as was_id, a.id as now_id from old o full join active a on o.project_id = a.project_id and o.id = a.id)
select project_id, count(*) filter (where was_id is null) as gained, count(*) filter (where now_id is null) as lost from both_sets group by 1 having gained + lost > 0""",
    "ledger_violations": _DECISIONS + """, recs as (select project_id, doc_id, printf('D-%04d', regexp_extract(text, '##\\s*D-([0-9]{4})', 1)::int + case when doc_id % 5 = 0 then 1 else 0 end) as rid
  from documents where project_id is not null and doc_id % 2 = 1 and regexp_matches(text, '##\\s*D-[0-9]{4}')),
firsts as (select project_id, doc_id, arg_min(nullif(regexp_extract(line, '^#+\\s*(D-[0-9]{4})(?:[^A-Za-z0-9_]|$)', 1), ''), n) as f
  from (select project_id, doc_id, n, line, row_number() over (partition by project_id, doc_id order by n) as k from lines where starts_with(line, '#')) where k = 1 group by 1, 2),
judged as (select r.*, case when f.f is not null and f.f <> r.rid then 'heading names ' || f.f || ', file name claims ' || r.rid end as v from recs r left join firsts f using (project_id, doc_id)),
held as (select distinct project_id, id from entries where doc_id % 2 = 0),
clean as (select project_id, rid, count(*) as n from judged where v is null group by 1, 2)
select j.project_id, 'd/' || doc_id || '/0_Canon/decisions/' || j.rid || '-x.md' as path,
  coalesce(v, case when h.id is not null then 'duplicate id: a ledger holds it' else 'duplicate id across records' end) as violation
from judged j left join held h on h.project_id = j.project_id and h.id = j.rid left join clean c on c.project_id = j.project_id and c.rid = j.rid
where v is not null or h.id is not null or c.n > 1""",
    "cited_refs": r"""with c as (select distinct id, text from chunks), w as (select id, regexp_extract_all(text, '[A-Za-z0-9_-]+') as w from c),
r as (select id, list_filter(w, lambda x: regexp_full_match(x, 'D-[0-9]{4}([^A-Za-z0-9_].*)?')) as r from w),
o as (select id, list_transform(r, lambda x: left(x, 6)) as r from r where len(r) > 0)
select id, array_to_string(list_filter(list_transform(r, lambda x, i: case when list_position(r, x) = i then x end), lambda x: x is not null), ',') as refs from o""",
}

_LISTINGS = """
with listing as (select project_id, snapshot_no, replace(path, chr(92), '/') as path, nullif(arg_max(coalesce(lower(content_hash), ''), (received_at, coalesce(lower(content_hash), ''))), '') as h
                 from file_snapshots where project_id is not null and snapshot_no is not null and path is not null group by 1, 2, 3),
sequence as (select project_id, snapshot_no, row_number() over (partition by project_id order by snapshot_no) as seq, lead(snapshot_no) over (partition by project_id order by snapshot_no) as nxt
             from (select distinct project_id, snapshot_no from manifests where is_complete and project_id is not null and snapshot_no is not null)),
runs as (select *, seq - row_number() over (partition by project_id, path order by seq) as run from listing join sequence using (project_id, snapshot_no)),
whole as (select project_id, snapshot_no, path, seq, nxt, last_value(h ignore nulls) over (partition by project_id, path, run order by seq rows between unbounded preceding and current row) as h from runs),
a as (select project_id, nxt as snapshot_no, path, h from whole where nxt is not null),
b as (select project_id, snapshot_no, path, h from whole where seq > 1),
diff as (select project_id, snapshot_no, path, case when a.path is null then 'new' when b.path is null then 'deleted' when a.h is not distinct from b.h then 'unchanged' else 'changed' end as state
         from a full join b using (project_id, snapshot_no, path)),
guarded as (select project_id, snapshot_no, coalesce(deletes, 0) as deletes, coalesce(stored, 0) as stored
            from (select project_id, snapshot_no, count(*) as stored from a group by 1, 2) full join (select project_id, snapshot_no, count(*) as deletes from diff where state = 'deleted' group by 1, 2) using (project_id, snapshot_no)),
bad as (select distinct project_id, snapshot_no from b where path = '' or starts_with(path, '/') or regexp_matches(path, '^[A-Za-z]:') or contains('/' || path || '/', '//')
        or contains('/' || path || '/', '/../') or contains('/' || lower(path) || '/', '/.git/'))
"""

SQL |= {
    "manifest_diff": _LISTINGS + "select project_id, snapshot_no, path, state from diff",
    "scoped_diff": _LISTINGS + "select project_id, snapshot_no, path, state from diff where (path = 'src' or starts_with(path, 'src/')) and project_id in (select id from projects)",
    "mass_delete_guard": _LISTINGS + "select *, deletes > 100 and deletes * 2 > stored as refused from guarded",
    "pass_summary": _LISTINGS + """select project_id, snapshot_no, count(*) filter (where state <> 'deleted') as seen, count(*) filter (where state = 'new') as n_new,
count(*) filter (where state = 'changed') as n_changed, count(*) filter (where state = 'unchanged') as n_unchanged,
count(*) filter (where state = 'deleted') as n_deleted, 0::bigint as n_unreadable from diff group by 1, 2""",
    "manifest_needs": _LISTINGS + "select project_id, snapshot_no, path from diff anti join bad using (project_id, snapshot_no) where state in ('new', 'changed')",
}
