"""The queries of the training-data operators over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import generated_files, leakage, mixing, near_duplicates, rank_fusion, repetition, secrets, similar_vectors, trigrams
from tesserine.sources.durable import fresh_path, keep
from tesserine.sources.tables import table

#: TESTDATA.md's definition of alike chunks.
P2_WORDS, P2_THRESHOLD, P2_MIN_WORDS = 3, "0.6", 20
P3_K = 5
P8_WINDOW = 12
P10_RUN, P10_MIN_WORDS, P10_SHARE = 5, 20, 0.3


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = generated_files.not_handwritten(table(spark, sf, "files"), table(spark, sf, "chunks"))
    return found.select("project_id", "path")


def p1_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return generated_files.not_handwritten(table(spark, sf, "files"), table(spark, sf, "chunks"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(table(spark, sf, "chunks"), P2_WORDS, P2_THRESHOLD, P2_MIN_WORDS)
    return pairs.select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    classes = near_duplicates.near_duplicate_classes(table(spark, sf, "chunks"), P2_WORDS, P2_THRESHOLD, P2_MIN_WORDS)
    return classes.select(F.col("id").alias("chunk_id"), "class_id", "links", "copies")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_vectors").select(F.col("chunk_rowid").alias("id"), "dims", "vector")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    links = similar_vectors.similar_vectors(_vectors(spark, sf), P3_K)
    return links.select(F.least("id", "other").alias("chunk_rowid_a"), F.greatest("id", "other").alias("chunk_rowid_b")).distinct()


def p3_search(spark: SparkSession, sf: str) -> DataFrame:
    links = similar_vectors.similar_vectors(_vectors(spark, sf), P3_K).where("id % 100 = 0")
    return links.select(F.col("id").alias("chunk_rowid"), F.col("other").alias("neighbour"), "rank", "cosine")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf, "chunks").select("id", "text"))
    return found.select(F.col("id").alias("chunk_rowid"), "line_no").distinct()


def p4_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """p4_found through a stored index of the chunk table."""
    chunks = table(spark, sf, "chunks").select("id", "text").dropDuplicates(["id"])
    folder = fresh_path(spark, "trigrams")
    trigrams.store_index(chunks, folder)
    return secrets.find_secrets_indexed(chunks, folder).select(F.col("id").alias("chunk_rowid"), "line_no").distinct()


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    clean = secrets.redact_secrets(table(spark, sf, "chunks").select("id", "text"))
    return clean.where("n_secrets > 0").select(F.col("id").alias("chunk_rowid"), "text", "n_secrets").distinct()


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return rank_fusion.winners(table(spark, sf, "scored"))


def p6_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return rank_fusion.ranking(table(spark, sf, "scored")).select("query_id", "chunk_rowid", "rank", F.round("fused", 9).alias("fused"))


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "eval_items")
    texts = items.select("item_id", F.explode(F.array("query_text", "passage")).alias("text"))
    return leakage.find_leaks(table(spark, sf, "documents"), texts, P8_WINDOW)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_leaks(spark, sf).where("literal_windows > 0").select("doc_id", "item_id").distinct()


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p9_targets(spark: SparkSession, sf: str) -> DataFrame:
    """What p9_shares measures the shares against."""
    share = [F.round(c, 9).alias(c) for c in ("target_share", "reachable_share")]
    return p9_shares(spark, sf).select("source", *share, (F.col("available_tokens") > 0).alias("available"))


def _scored_repetition(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its measures, stratum, score and label."""
    docs = table(spark, sf, "documents")
    measures = repetition.measure_repetition(docs.select("doc_id", "text"), run=P10_RUN)
    strata = docs.select("doc_id", repetition.stratum_of(F.col("lang")).alias("stratum")).dropDuplicates(["doc_id"])
    rows = measures.join(strata, "doc_id", "left").select("*", F.col("run_share").alias("score"))
    return keep(rows.withColumn("label", F.when(F.col("n_words") >= P10_MIN_WORDS, repetition.segment_label())), "repetition")


def p10_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.cutoff_report(_scored_repetition(spark, sf))


def p10_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that the certified cutoffs reject, by whatever cutoff came out."""
    scored = _scored_repetition(spark, sf)
    rejected = repetition.repetitive_documents(scored.where(F.col("n_words") >= P10_MIN_WORDS), repetition.cutoff_report(scored))
    return rejected.select("doc_id", "stratum", F.round("score", 9).alias("score"), "cutoff", "certified").distinct()


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rounded = [F.round(c, 9).alias(c) for c in ("run_share", "line_share", "sentence_share", "paragraph_share")]
    return repetition.measure_repetition(docs, run=P10_RUN).select("doc_id", "n_words", "n_runs", "distinct_runs", *rounded)


def _repetitive() -> Column:
    """The definition, in whole numbers: at least three tenths of the runs are repeats."""
    return (F.col("n_words") >= P10_MIN_WORDS) & ((F.col("n_runs") - F.col("distinct_runs")) * 10 >= F.col("n_runs") * 3)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by the certified cutoffs, none stricter than the definition, which is then checked exactly."""
    scored = _scored_repetition(spark, sf)
    candidates = repetition.repetitive_documents(scored, repetition.cutoff_report(scored), strictest=P10_SHARE)
    return candidates.where(_repetitive()).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_kinds, p2_found, p2_classes, p3_found, p3_search, p4_found, p4_indexed, p4_redacted, p6_found, p6_ranking,
        p8_found, p8_leaks, p9_mix, p9_shares, p9_targets, p10_found, p10_shares, p10_cutoffs, p10_rejected,
    )
}

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"

#: CTEs that end in wide (query_id, chunk_rowid, scores a to d and tier e), larger being better.
_WIDE = """latest as (select query_id, chunk_rowid, arm, max_by(coalesce(score, 'nan'::double), scored_at) as s, max(tier) as tier from scored group by 1, 2, 3),
wide as (select query_id, chunk_rowid,
    max(case when arm = 'lexical' and not isnan(s) then -s end) as a, max(case when arm = 'vector' and not isnan(s) then s end) as b,
    max(case when arm = 'anchor' and not isnan(s) then s end) as c, max(case when arm = 'usage' and not isnan(s) then s end) as d, max(tier) as e
  from latest group by 1, 2)"""

#: CTEs from sets (id, s) to pairs (a, b, sizes n and m, both_have) of those that share an element and are near in size.
_ALIKE = """bits as (select id, len(s) as n, unnest(s) as b from sets),
shared as (select b from bits group by b having count(*) > 1),
pairs as (select x.id as a, y.id as b, x.n as n, y.n as m, count(*) as both_have
          from (select * from bits semi join shared using (b)) x join (select * from bits semi join shared using (b)) y
          on x.b = y.b and x.id < y.id and x.n * 10 >= y.n * 6 and y.n * 10 >= x.n * 6 group by all)"""

#: Queries without an entry cannot be said in SQL, or not fast enough on whole tables; tests/llm hold them against
#: brute force.
SQL: dict[str, str] = {
    "p2_found": rf"""
with texts as (select id, {_WORDS} as w from (select distinct id, text from chunks)),
sets as (select id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from texts where len(w) >= 20),
{_ALIKE}
select distinct a as chunk_a, b as chunk_b from pairs where both_have * 10 >= (n + m - both_have) * 6""",
    "p2_classes": rf"""
with recursive texts as (select id as chunk, {_WORDS} as w from (select distinct id, text from chunks)),
members as (select chunk, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as s from texts where len(w) >= 20),
keyed as (select distinct chunk, md5(array_to_string(s, '|')) as id from members),
sets as (select distinct md5(array_to_string(s, '|')) as id, s from members),
{_ALIKE},
links as (select a, b from pairs where both_have * 10 >= (n + m - both_have) * 6 union select b, a from pairs where both_have * 10 >= (n + m - both_have) * 6),
reached(id, other) as (select id, id from sets union select r.id, l.b from reached r join links l on l.a = r.other),
classes as (select r.id, min(k.chunk) as class_id from reached r join keyed k on k.id = r.other group by 1),
degrees as (select a as id, count(*) as links from links group by 1),
copies as (select id, count(*) as copies from keyed group by 1)
select chunk as chunk_id, class_id, coalesce(links, 0) as links, copies from keyed join classes using (id) join copies using (id) left join degrees using (id)""",
    "p6_found": f"""
with {_WIDE},
duels as (select x.query_id, x.chunk_rowid,
    coalesce(sign(x.a - y.a), 0) + coalesce(sign(x.b - y.b), 0) + coalesce(sign(x.c - y.c), 0) + coalesce(sign(x.d - y.d), 0) + coalesce(sign(x.e - y.e), 0) as lead
  from wide x join wide y on x.query_id = y.query_id and x.chunk_rowid <> y.chunk_rowid)
select query_id, chunk_rowid from wide anti join (select query_id, chunk_rowid from duels where lead <= 0) using (query_id, chunk_rowid)""",
    "p6_ranking": f"""
with {_WIDE},
mid as (select query_id, {", ".join(f"quantile_disc({c}, 0.5) as m{c}" for c in "abcde")} from wide group by 1),
away as (select w.*, {", ".join(f"m{c}, case when not isnan({c} - m{c}) then abs({c} - m{c}) end as w{c}" for c in "abcde")} from wide w join mid using (query_id)),
spread as (select query_id, {", ".join(f"quantile_disc(w{c}, 0.5) as d{c}, avg(w{c}) filter (where not isinf(w{c})) as v{c}" for c in "abcde")} from away group by 1),
z as (select query_id, chunk_rowid, {", ".join(f"case when {c} = m{c} then 0 when {c} is not null then coalesce(({c} - m{c}) / case when d{c} > 0 then 1.4826 * d{c} when v{c} > 0 then 1.2533 * v{c} end, 0) end as {c}" for c in "abcde")}
  from away join spread using (query_id)),
f as (select query_id, chunk_rowid, round(exp(({" + ".join(f"coalesce(-ln(1 + exp(-greatest(-30, least(30, {c})))), 0)" for c in "abcde")})
  / nullif({" + ".join(f"({c} is not null)::int" for c in "abcde")}, 0)), 12) as fused from z)
select query_id, chunk_rowid, row_number() over (partition by query_id order by fused desc nulls last, chunk_rowid) as rank, round(fused, 9) as fused from f""",
    "p8_found": rf"""
with item_words as (select item_id, {_WORDS} as w from (select item_id, query_text as text from eval_items union all select item_id, passage from eval_items)),
item_windows as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' '))) as x from item_words),
doc_words as (select doc_id, {_WORDS} as w from documents),
doc_windows as (select doc_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' '))) as x from doc_words)
select distinct doc_id, item_id from doc_windows join item_windows using (x)""",
    "p8_leaks": rf"""
with items as (select distinct item_id, text from (select item_id, query_text as text from eval_items union all select item_id, passage from eval_items) where text is not null and item_id is not null),
units as (select unnest(string_split('{" ".join(leakage.UNITS)}', ' ')) as w),
plain as (select w from (select item_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) as w from items)
  where w = lower(w) and w <> upper(w) and not regexp_matches(w, '[\p{{N}}_]') and w not in (select w from units) group by w having count(distinct item_id) >= 2),
texts as (select 'd' as side, doc_id as id, 0 as part, lower(text) as text from documents where text is not null union all
  select 'i', item_id, row_number() over (), lower(text) from items),
words as (select side, id, part, unnest(w) as w, generate_subscripts(w, 1) as n from (select *, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') as w from texts)),
kinds as (select x.*, case when regexp_full_match(x.w, '[0-9]+') then chr(1) when u.w is not null then chr(2) when p.w is not null then x.w else chr(3) end as k, p.w is null or u.w is not null or regexp_full_match(x.w, '[0-9]+') as slot
  from words x left join units u on u.w = x.w left join plain p on p.w = x.w),
lists as (select side, id, part, list(w order by n) as w, list(k order by n) as k, list(slot order by n) as s from kinds group by 1, 2, 3 having count(*) >= 12),
windows as (select side, id, part, unnest(list_transform(range(1, len(w) - 10), lambda i: {{'w': w[i:i + 11], 'k': k[i:i + 11], 's': s[i:i + 11]}})) as x from lists),
keyed as (select side, id, x.w as w, x.s as s, case when len(list_filter(x.s, lambda y: not y)) >= 5 then 'T ' || array_to_string(x.k, ' ') else 'L ' || array_to_string(x.w, ' ') end as key from windows),
met as (select d.id as doc_id, i.id as item_id, d.w = i.w as literal,
    list_filter(list_transform(i.s, lambda y, j: case when y then d.w[j] || ' ' || i.w[j] end), lambda y: y is not null) as both_, list_filter(list_transform(i.s, lambda y, j: case when y then d.w[j] end), lambda y: y is not null) as a,
    list_filter(list_transform(i.s, lambda y, j: case when y then i.w[j] end), lambda y: y is not null) as b
  from keyed d join keyed i on d.side = 'd' and i.side = 'i' and d.key = i.key)
select doc_id, item_id, count(*) filter (where literal) as literal_windows, count(*) filter (where not literal) as changed_windows
from met where literal or (len(list_distinct(both_)) = len(list_distinct(a)) and len(list_distinct(both_)) = len(list_distinct(b))) group by 1, 2""",
    "p9_targets": """
with t as (select lower(trim(source)) as source, sum(weight) as w from mix_targets where source is not null and weight > 0 and coalesce(max_repeats, 1) > 0 group by 1),
d as (select lower(trim(source)) as source, max(text is not null and text <> '') as has from documents where source is not null group by 1),
j as (select coalesce(t.source, d.source) as source, t.w, coalesce(d.has, false) as available from t full join d on d.source = t.source)
select source, round(coalesce(w / (select sum(w) from j), 0), 9) as target_share, round(coalesce(case when available then w end / (select sum(w) from j where available), 0), 9) as reachable_share, available from j""",
    "p10_shares": rf"""
with w as (select doc_id, {_WORDS} as w from documents),
r as (select doc_id, w, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) as r from w),
cut as (select doc_id, 'line' as k, unnest(regexp_split_to_array(coalesce(text, ''), '[\n\r]')) as text from documents
  union all select doc_id, 'sentence', unnest(regexp_split_to_array(coalesce(text, ''), '[.!?。](?:[\t\r\n ]|$)|\n')) from documents
  union all select doc_id, 'paragraph', unnest(regexp_split_to_array(coalesce(text, ''), '[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*')) from documents),
segments as (select doc_id, k, {_WORDS} as w from cut),
repeats as (select doc_id, k, sum((c - 1) * len(w)) as n from (select doc_id, k, w, count(*) as c from segments where len(w) > 0 group by all) group by 1, 2),
shares as (select doc_id, max(case when k = 'line' then n end) as l, max(case when k = 'sentence' then n end) as s, max(case when k = 'paragraph' then n end) as p from repeats group by 1)
select doc_id, len(w) as n_words, len(r) as n_runs, len(list_distinct(r)) as distinct_runs, round((len(r) - len(list_distinct(r))) / greatest(len(r), 1), 9) as run_share,
  round(coalesce(l, 0) / greatest(len(w), 1), 9) as line_share, round(coalesce(s, 0) / greatest(len(w), 1), 9) as sentence_share,
  round(coalesce(p, 0) / greatest(len(w), 1), 9) as paragraph_share
from r left join shares using (doc_id)""",
    "p10_found": rf"""
with w as (select doc_id, {_WORDS} as w from documents),
r as (select doc_id, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) as r from w where len(w) >= 20)
select distinct doc_id from r where (len(r) - len(list_distinct(r))) * 10 >= len(r) * 3""",
}
