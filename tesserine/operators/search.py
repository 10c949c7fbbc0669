"""The hybrid search: BM25 and exact cosine over the same filtered rows, reciprocal rank fusion, authority, collapse.

Chunk rows are (id, project_id, chunk_id, path, anchor, kind, language, text, design_status, effective_tier, ...), see
tesserine.sources.store. Scores are rounded to 9 digits before they rank, so that the order does not depend on the order in which
a cluster adds numbers up; ties go to the smaller id.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.functions.text import Term, clamp_limit, excerpt, query_terms, tokens, truncated
from tesserine.functions.vectors import MIN_NORM
from tesserine.operators.filters import SearchFilter, filter_chunks

#: Okapi BM25 as published, with the weight of an occurrence by the column it stands in.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
WEIGHTS = {"text": 1.0, "path": 0.5, "anchor": 2.0}
#: Rows that each arm hands to the fusion.
DEPTH = 1000
RRF_K = 60
#: What the effective tier multiplies a score by, where the project ranks by authority.
AUTHORITY = {3: 1.07, 2: 1.02, 1: 1.0, 0: 0.95}
DIGITS = 9


def postings(chunks: DataFrame) -> DataFrame:
    """The full-text index: (id, project_id, term, weight, length) per chunk and distinct token. weight adds up the
    column weights of the token's occurrences; length counts all tokens of the chunk. Partial counts are made before the shuffle, whose
    grouping keys hold the chunk's id."""

    def weighed(column: str, w: float) -> Column:
        return F.transform(tokens(F.col(column)), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    parts = [weighed(c, w) for c, w in WEIGHTS.items()]
    rows = chunks.select("id", "project_id", F.concat(*parts).alias("_t")).where(F.size("_t") > 0)
    entry = F.explode("_t").alias("_e")
    flat = rows.select("id", "project_id", F.size("_t").alias("length"), entry).select("id", "project_id", "length", "_e.term", "_e.w")
    return flat.groupBy("id", "project_id", "term").agg(F.sum("w").alias("weight"), F.max("length").alias("length"))


def maintain_postings(index: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after a pass: entries of deleted chunks (id) go, those of inserted chunks come; all others are not
    computed again."""
    return index.join(deleted.select("id").distinct(), "id", "left_anti").unionByName(postings(inserted))


#: Postings lie in so many folders by the first two letters of their term, so a term, or a prefix of two letters, is read
#: from one of them. Within a folder they are spread over as many files as the session has shuffle partitions for it, and sorted by term.
BUCKETS = 64


_POSTINGS = "id long, project_id long, term string, weight double, length int, bucket int"


@dataclass(frozen=True)
class StoredIndex:
    """A full-text index in a folder of shared storage: postings, and one row about all chunks (n, mean length)."""

    postings: DataFrame
    totals: DataFrame


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(BUCKETS)).cast("int")


def write_index(entries: DataFrame, chunks: DataFrame, folder: str) -> None:
    """Store postings, as from `postings` or `maintain_postings`, of chunks (one row per id)."""
    spark = chunks.sparkSession
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    placed = entries.withColumn("bucket", _bucket(F.col("term"))).withColumn("_s", F.pmod("id", F.lit(spread)))
    placed.repartition("bucket", "_s").sortWithinPartitions("bucket", "term").drop("_s").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    stored = spark.read.schema(_POSTINGS).parquet(f"{folder}/postings")
    tokens_of = stored.groupBy("id").agg(F.max("length").alias("length")).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("_l"))
    totals = chunks.agg(F.count("*").alias("n")).crossJoin(tokens_of)  # one row each
    totals.select("n", (F.col("_l") / F.greatest("n", F.lit(1))).alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")


def read_index(spark: SparkSession, folder: str) -> StoredIndex:
    return StoredIndex(spark.read.schema(_POSTINGS).parquet(f"{folder}/postings"), spark.read.schema("n long, mean double").parquet(f"{folder}/totals"))


def _stored_hits(index: StoredIndex, terms: list[Term]) -> DataFrame:
    """As _term_hits, for the chunks that hold any term, from the folders of the terms alone."""
    def test(t: Term) -> Column:
        return F.startswith("term", F.lit(t.text)) if t.prefix else F.col("term") == t.text

    any_term = F.lit(False)
    for t in terms:
        near = F.lit(True) if t.prefix and len(t.text) < 2 else F.col("bucket") == _bucket(F.lit(t.text))
        any_term = any_term | (near & test(t))
    which = F.array_compact(F.array(*(F.when(test(t), F.lit(i)) for i, t in enumerate(terms))))
    per_term = index.postings.where(any_term).select("id", "project_id", "length", "weight", F.explode(which).alias("q"))
    summed = per_term.groupBy("id", "project_id", "length", "q").agg(F.sum("weight").alias("weight"))
    return summed.groupBy("id", "project_id", "length").agg(F.array_sort(F.collect_list(F.struct("q", "weight"))).alias("hits"))  # at most MAX_TERMS


def _term_hits(chunks: DataFrame, terms: list[Term]) -> DataFrame:
    """(id, project_id, length, hits): per chunk an array of (q, weight), the weight of the occurrences of query term
    number q, for the terms it holds.

    For one query this scans the rows and counts inside each row: one row per chunk, and no shuffle."""
    lists = {c: tokens(F.col(c)) for c in WEIGHTS}
    base = chunks.select("id", "project_id", *(v.alias(f"_{c}") for c, v in lists.items()))
    length = sum((F.size(f"_{c}") for c in WEIGHTS), F.lit(0))

    def occurrences(term: Term) -> Column:
        def test(t: Column) -> Column:
            return F.startswith(t, F.lit(term.text)) if term.prefix else t == term.text

        return sum((F.size(F.filter(f"_{c}", test)) * w for c, w in WEIGHTS.items()), F.lit(0.0))

    found = F.array(*(F.struct(F.lit(i).alias("q"), occurrences(t).alias("weight")) for i, t in enumerate(terms)))
    return base.select("id", "project_id", length.alias("length"), found.alias("_f")).select(
        "id", "project_id", "length", F.filter("_f", lambda s: s["weight"] > 0).alias("hits"))


def lexical(chunks: DataFrame, query: str, f: SearchFilter = SearchFilter(), projects: DataFrame | None = None, depth: int = DEPTH, index: StoredIndex | None = None) -> DataFrame:
    """The lexical arm: (id, score, rank), best first, at most `depth` rows. With a stored index no text is read.

    A chunk must hold every term in some column; only if no filtered chunk does, and there are at least two terms,
    chunks with any term count. Numbers of chunks, of chunks with a term, and the mean length are those of all chunks,
    whatever the filter. Repeated terms count each time. No terms, no rows; null columns are empty."""
    terms = query_terms(query)
    if not terms:
        return chunks.sparkSession.createDataFrame([], "id long, score double, rank int")
    hits = _stored_hits(index, terms) if index else _term_hits(chunks, terms)

    def holders(i: int) -> Column:
        return F.count_if(F.exists("hits", lambda s: s["q"] == i)).alias(f"n{i}")

    counts = [holders(i) for i in range(len(terms))]
    if index:
        stats = hits.agg(*counts).crossJoin(F.broadcast(index.totals))  # one row each
    else:
        stats = hits.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *counts)
    idf = [F.ln((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)) for i in range(len(terms))]
    stats = stats.select("mean", F.array(*(F.when(x > 0, x).otherwise(MIN_IDF) for x in idf)).alias("idf"))
    rows = filter_chunks(chunks, f, projects).select("id", "project_id").distinct() if f != SearchFilter() else None
    matched = hits.where(F.size("hits") > 0)
    if rows is not None:
        matched = matched.join(rows, ["id", "project_id"], "left_semi")

    def part(s: Column) -> Column:
        w = s["weight"]
        return F.element_at("idf", s["q"] + 1) * w * (K1 + 1) / (w + K1 * (1 - B + B * F.col("length") / F.col("mean")))

    score = F.round(F.aggregate("hits", F.lit(0.0), lambda a, s: a + part(s)), DIGITS)
    full = (F.size("hits") == len(terms)).alias("full")
    scored = matched.crossJoin(F.broadcast(stats)).select("id", score.alias("score"), full)  # stats is one row
    # Full matches come first, so if there is any, the best rows hold one; the rest of the decision needs those rows alone.
    top = scored.orderBy(F.desc("full"), F.desc("score"), "id").limit(depth)
    decided = top.withColumn("any_full", F.max("full").over(Window.partitionBy(F.lit(1))))
    return _ranked(decided.where("full or not any_full").select("id", "score"), depth)


def _ranked(scored: DataFrame, depth: int) -> DataFrame:
    """The best rows by score, then id, numbered. The limit comes first, so only `depth` rows reach the numbering."""
    top = scored.orderBy(F.desc("score"), "id").limit(depth)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def vector(chunks: DataFrame, vectors: DataFrame, query: list[float], f: SearchFilter = SearchFilter(), projects: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """The vector arm: (id, score, rank) by exact cosine, at most `depth` rows.

    vectors: (chunk_rowid, vector); unusable ones, and those of another length than the query's, take no part. An
    unusable query gives no rows. The filter is applied before anything is scored."""
    q = np.array(query, float)
    if not len(q) or not np.isfinite(q).all() or np.linalg.norm(q) <= MIN_NORM:
        return chunks.sparkSession.createDataFrame([], "id long, score double, rank int")
    q = q / np.linalg.norm(q)

    def score(batches):
        # Higher-order functions are interpreted element by element; a batch of vectors is one matrix product here.
        for b in batches:
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q))
            with np.errstate(all="ignore"):
                length = np.sqrt(np.einsum("ij,ij->i", m, m))
                good = np.isfinite(m).all(axis=1) & (length > MIN_NORM)
            at = np.flatnonzero(good)
            cosine = np.round(m[at] @ q / length[at], DIGITS)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(cosine)], ["id", "score"])

    rows = filter_chunks(chunks, f, projects).select("id")
    stored = vectors.select(F.col("chunk_rowid").alias("id"), "vector").where(F.col("vector").isNotNull() & (F.size("vector") == len(query)))
    scored = stored.join(rows, "id", "left_semi").mapInArrow(score, "id long, score double")
    return _ranked(scored.groupBy("id").agg(F.max("score").alias("score")), depth)


def fuse(*arms: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: (id, rrf), the sum of 1 / (60 + rank) over the arms that found the row."""
    rows = arms[0].select("id", "rank")
    for a in arms[1:]:
        rows = rows.unionByName(a.select("id", "rank"))
    return rows.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"))


def authority_weight(tier: Column, behavior: Column) -> Column:
    """The factor of a row: by its effective tier in projects whose behavior is `rank`, 1 elsewhere."""
    w = F.lit(1.0)
    for t, x in AUTHORITY.items():
        w = F.when(tier == t, x).otherwise(w)
    return F.when(behavior == "rank", w).otherwise(1.0)


def window_family(kind: Column) -> Column:
    """The number of the split span that a chunk is a window of, from its kind's JSON; null for whole chunks and for
    windows of plain text, which are different content each."""
    return F.get_json_object(kind, "$.window.family").cast("int")


def collapse(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Of the windows of one span (project, path, family) the first in the given order; other rows stay."""
    family = window_family(F.col("kind"))
    place = F.row_number().over(Window.partitionBy("project_id", "path", family).orderBy(*order))
    return rows.withColumn("_p", F.when(family.isNull(), 1).otherwise(place)).where("_p = 1").drop("_p")


def rank_rows(fused: DataFrame, chunks: DataFrame, projects: DataFrame, limit: int | None = None, collapse_windows: bool = True) -> DataFrame:
    """The page: fused rows weighted by authority, best first, ties by chunk id, windows collapsed, limited, with rank.

    At most twice DEPTH fused rows are sent to where the chunks are read; only what they hit goes on, so repeated rows are
    told apart among those alone, and texts are read for the page only."""
    behavior = projects.select(F.col("id").alias("project_id"), F.col("authority_behavior").alias("behavior"))
    narrow = [c for c in chunks.columns if c not in ("text", "vault")]
    once = chunks.select(*narrow).join(F.broadcast(fused), "id").dropDuplicates(["id"]).join(behavior, "project_id", "left")
    scored = once.withColumn("score", F.round(F.col("rrf") * authority_weight(F.col("effective_tier"), F.col("behavior")), 12))
    order = [F.desc("score"), F.col("chunk_id")]
    page = collapse(scored, order) if collapse_windows else scored
    page = page.orderBy(*order).limit(clamp_limit(limit))
    page = page.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    # Texts are read for the page alone, which is at most MAX_LIMIT rows.
    held = page.collect()
    texts = chunks.select("id", *(c for c in chunks.columns if c not in narrow)).where(F.col("id").isin([r["id"] for r in held])).dropDuplicates(["id"])
    return texts.join(F.broadcast(chunks.sparkSession.createDataFrame(held, page.schema)), "id")


def result_rows(page: DataFrame) -> DataFrame:
    """Ranked rows as a search answers them: provenance, score, excerpt; authority only where the project shows it."""
    shown = F.col("behavior").isin("annotate", "rank")
    return page.select(
        "rank", "project_id", "chunk_id", "path", "language", "line_start", "line_end", "score",
        F.get_json_object("kind", "$.symbol_path").alias("symbol"),
        F.array_join(F.from_json(F.get_json_object("kind", "$.heading_path"), "array<string>"), " > ").alias("heading"),
        excerpt(F.col("text")).alias("excerpt"), truncated(F.col("text")).alias("truncated"),
        F.when(shown, F.col("effective_tier")).alias("authority"), F.when(shown, F.col("demotion")).alias("authority_note"),
        F.when(shown, F.col("design_status")).alias("status"))


def search(
    chunks: DataFrame, projects: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None,
    f: SearchFilter = SearchFilter(), limit: int | None = None, index: StoredIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A whole search: (result rows, one row with `lexical_only` and `at_depth`).

    Without vectors or a query vector, or if the vector arm finds nothing or fails, the answer rests on the lexical arm
    alone and says so; that never fails a search. Both arms go DEPTH deep once, where an interactive engine would deepen
    them step by step; the page is that of the deepest step. at_depth: an arm was cut there, so rows beyond it could have
    scored as well. An arm is at most DEPTH rows of id, score and rank; they are held by the driver."""
    spark = chunks.sparkSession
    words = _held(lexical(chunks, query, f, projects, DEPTH, index))
    arms, full = [words], len(words) >= DEPTH
    if vectors is not None and query_vector:
        try:
            arms.append(_held(vector(chunks, vectors, query_vector, f, projects, DEPTH)))
            full = full or len(arms[1]) >= DEPTH
        except Exception as e:  # noqa: BLE001 whatever became of it, words still answer
            logging.getLogger(__name__).warning("vector arm failed: %s", e)
    kind = "id long, score double, rank int"
    fused = fuse(*(spark.createDataFrame(a, kind) for a in arms))
    flags = spark.createDataFrame([(len(arms) < 2 or not arms[1], full)], "lexical_only boolean, at_depth boolean")
    return result_rows(rank_rows(fused, chunks, projects, limit)).coalesce(1).sortWithinPartitions("rank"), flags  # one page


def _held(arm: DataFrame) -> list[tuple]:
    return [tuple(r) for r in arm.collect()]


def lookup(chunks: DataFrame, project_id: int, prefix: str, cap: int = 10) -> tuple[str, list]:
    """A chunk by the beginning of its id: ("found", [row]), ("unknown", []) or ("ambiguous", rows, at most cap)."""
    hits = chunks.where((F.col("project_id") == project_id) & F.startswith("chunk_id", F.lit(prefix))).dropDuplicates(["chunk_id"])
    rows = hits.orderBy("chunk_id").limit(max(cap, 2)).collect()
    return ("unknown", []) if not rows else ("found", rows) if len(rows) == 1 else ("ambiguous", rows[:cap])


def lookups(chunks: DataFrame, wanted: DataFrame, cap: int = 10) -> DataFrame:
    """(project_id, prefix, outcome, chunk_id, shown) of many lookups (project_id, prefix) of prefixes of one length at
    once: `found` with the chunk, `ambiguous` with how many of the matches would be shown, or `unknown`."""
    size = F.char_length("prefix")
    lengths = [r[0] for r in wanted.select(size).distinct().limit(65).collect()]
    keys = F.explode(F.array(*(F.left("chunk_id", F.lit(n)) for n in lengths))) if lengths else F.lit(None).cast("string")
    ids = chunks.select("project_id", "chunk_id").distinct().withColumn("prefix", keys)
    rows = wanted.distinct().join(ids, ["project_id", "prefix"], "left").groupBy("project_id", "prefix").agg(F.count("chunk_id").alias("n"), F.min("chunk_id").alias("chunk_id"))
    outcome = F.when(F.col("n") == 0, "unknown").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return rows.select("project_id", "prefix", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("chunk_id")).alias("chunk_id"), F.least("n", F.lit(cap)).alias("shown"))


def in_file_order(chunks: DataFrame) -> DataFrame:
    """chunks with `place`, their position in their file."""
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy("project_id", "path").orderBy("byte_start", "id")))


def backlog(chunks: DataFrame, vectors: DataFrame, after: int = -1, page: int | None = 512) -> DataFrame:
    """Chunks without a stored vector, by id, beyond the cursor; one page, or all of them."""
    rows = chunks.where(F.col("id") > after).join(vectors.select(F.col("chunk_rowid").alias("id")), "id", "left_anti")
    rows = rows.dropDuplicates(["id"]).orderBy("id")
    return rows if page is None else rows.limit(page)


def widths(vectors: DataFrame, limit: int = 8) -> DataFrame:
    """The distinct vector widths, smallest first."""
    return vectors.select("dims").distinct().orderBy("dims").limit(limit)
