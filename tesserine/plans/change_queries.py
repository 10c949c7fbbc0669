"""Queries of the general data operators: snapshot changes and incremental processing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators.incremental import pending_files
from tesserine.operators.snapshots import SnapshotStore, complete_sequence, file_changes, file_column_changes, file_listing
from tesserine.sources.durable import fresh_path, keep
from tesserine.sources.tables import table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return file_changes(table(spark, sf, "file_snapshots"), table(spark, sf, "manifests"))


def p5_columns(spark: SparkSession, sf: str) -> DataFrame:
    out = file_column_changes(table(spark, sf, "file_snapshots"), table(spark, sf, "manifests"))
    return out.withColumn("changed_columns", F.array_join("changed_columns", ","))


def p5_delivered(spark: SparkSession, sf: str) -> DataFrame:
    """The changes of p5_found from complete listings that are delivered one after the other to a store."""
    sequence = complete_sequence(table(spark, sf, "manifests"), "project_id", "snapshot_no", "is_complete").select("project_id", "snapshot_no")
    listing = keep(file_listing(table(spark, sf, "file_snapshots")).join(sequence, ["project_id", "snapshot_no"]), "complete-listings")
    store = SnapshotStore(spark, fresh_path(spark, "snapshots"), "project_id bigint, path string", "content_hash string")
    numbers = [r[0] for r in sequence.select("snapshot_no").distinct().orderBy("snapshot_no").collect()]  # of snapshots
    out = [keep(store.deliver(listing.where(F.col("snapshot_no") == n), sequence.where(F.col("snapshot_no") == n)), "changes").withColumn("snapshot_no", F.lit(n)) for n in numbers]
    return reduce(DataFrame.unionByName, out).select("project_id", "path", "snapshot_no", "change_type")


def p7_pending(spark: SparkSession, sf: str) -> DataFrame:
    names = ("files", "index_runs", "run_files", "chunks", "chunk_vectors")
    return pending_files(*(table(spark, sf, n) for n in names)).select("project_id", "path", "stamp", F.col("time").alias("indexed_at"), "reason")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_pending(spark, sf).select("project_id", "path")


QUERIES = {f.__name__: f for f in (p5_found, p5_columns, p5_delivered, p7_found, p7_pending)}

_PENDING = """
with newest as (select project_id, path, max_by(content_hash, indexed_at) as stamp, max(indexed_at) as indexed_at from files group by 1, 2),
done as (select r.project_id, r.path, max_by(r.content_hash, i.finished_at) as done_stamp
         from run_files r join index_runs i using (run_id) where i.state = 'ok' group by 1, 2),
bare as (select distinct project_id, path, true as missing from chunks where id not in (select chunk_rowid from chunk_vectors)),
judged as (select n.project_id, n.path, n.stamp, n.indexed_at,
           case when d.done_stamp is null then 'new' when d.done_stamp <> n.stamp then 'changed' when b.missing then 'incomplete' end as reason
           from newest n left join done d using (project_id, path) left join bare b using (project_id, path))
"""

SQL = {
    "p5_found": """
with latest as (select project_id, snapshot_no, replace(path, chr(92), '/') as path, arg_max(coalesce(lower(content_hash), ''), received_at) as h
                from file_snapshots group by 1, 2, 3),
seqs as (select project_id, snapshot_no, row_number() over (partition by project_id order by snapshot_no) as k from manifests where is_complete),
rows_ as (select l.project_id, l.path, l.snapshot_no, s.k, nullif(l.h, '') as h from latest l join seqs s using (project_id, snapshot_no)),
runs as (select *, k - row_number() over (partition by project_id, path order by k) as run from rows_),
filled as (select *, last_value(h ignore nulls) over (partition by project_id, path, run order by k) as c from runs),
here as (select f.project_id, f.path, f.snapshot_no,
         case when p.path is null then 'added' when f.c is distinct from p.c and f.c is not null then 'changed' end as change_type
         from filled f left join filled p on p.project_id = f.project_id and p.path = f.path and p.k = f.k - 1 where f.k > 1),
gone as (select f.project_id, f.path, s.snapshot_no, 'removed' as change_type
         from filled f join seqs s on s.project_id = f.project_id and s.k = f.k + 1
         left join filled n on n.project_id = f.project_id and n.path = f.path and n.k = f.k + 1 where n.path is null)
select project_id, path, snapshot_no, change_type from here where change_type is not null union all select * from gone""",
    "p7_pending": _PENDING + "select * from judged where reason is not null",
    "p7_found": _PENDING + "select project_id, path from judged where reason is not null",
}

SQL["p5_delivered"] = SQL["p5_found"]
SQL["p5_columns"] = """
with latest as (select project_id, snapshot_no, replace(path, chr(92), '/') as path, arg_max(lower(content_hash), r) as h, arg_max(size_bytes, r) as z
  from (select *, (received_at, coalesce(lower(content_hash), ''), coalesce(size_bytes, -1)) as r from file_snapshots) group by 1, 2, 3),
picked as (select l.project_id, l.snapshot_no, l.path, max((f.received_at, coalesce(lower(f.content_hash), ''), coalesce(f.size_bytes, -1))) as m
  from latest l join file_snapshots f on f.project_id = l.project_id and f.snapshot_no = l.snapshot_no and replace(f.path, chr(92), '/') = l.path group by 1, 2, 3),
seqs as (select project_id, snapshot_no, row_number() over (partition by project_id order by snapshot_no) as k from manifests where is_complete),
rows_ as (select p.project_id, p.path, p.snapshot_no, s.k, nullif(m[2], '') as h, nullif(m[3], -1) as z from picked p join seqs s using (project_id, snapshot_no)),
runs as (select *, k - row_number() over (partition by project_id, path order by k) as run from rows_),
filled as (select *, last_value(h ignore nulls) over w as c, last_value(z ignore nulls) over w as d from runs window w as (partition by project_id, path, run order by k)),
here as (select f.project_id, f.path, f.snapshot_no, case when p.path is null then 'added' when (f.c is distinct from p.c and f.c is not null) or (f.d is distinct from p.d and f.d is not null) then 'changed' end as change_type,
  case when p.path is null then '' else array_to_string(list_filter([case when f.c is distinct from p.c and f.c is not null then 'content_hash' end, case when f.d is distinct from p.d and f.d is not null then 'size_bytes' end], lambda x: x is not null), ',') end as changed_columns
  from filled f left join filled p on p.project_id = f.project_id and p.path = f.path and p.k = f.k - 1 where f.k > 1),
gone as (select f.project_id, f.path, s.snapshot_no, 'removed' as change_type, '' as changed_columns from filled f join seqs s on s.project_id = f.project_id and s.k = f.k + 1
  left join filled n on n.project_id = f.project_id and n.path = f.path and n.k = f.k + 1 where n.path is null)
select project_id, path, snapshot_no, change_type, changed_columns from here where change_type is not null union all select * from gone"""
