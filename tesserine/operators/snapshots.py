"""What changed between full snapshots: a merge over range-partitioned, key-sorted listings.

All snapshots of one key land in one range. Inside a range the rows are sorted by key and snapshot, so one
forward pass that looks at a row and at its neighbours (the two pointers of a merge of consecutive snapshots)
types every change. Spark runs that pass as window functions that reuse the range exchange and its sort: no
second shuffle, no buffer larger than the snapshots of one key, and hot projects are spread over many ranges
because the range key is (group, key), not the group.

Where snapshots are delivered one at a time, `SnapshotStore` keeps the last complete listing of every group,
range-partitioned and sorted; a delivery is merged with that one alone, whatever the length of the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.sources.durable import Folder, keep

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def latest_listing(rows: DataFrame, keys: list[str], content: str | list[str], received: str) -> DataFrame:
    """One row per key: the last received one. Combined on the map side, so a key with very many rows costs one
    row per task. Equal `received`: the larger content wins, null being the smallest; null `received` is oldest.
    Rows with a null in a key are left out: they name nothing that could be compared."""
    columns = [content] if isinstance(content, str) else content
    present = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    last = present.groupBy(*keys).agg(F.max(F.struct(F.col(received), *map(F.col, columns))).alias("_v"))
    return last.select(*keys, *(F.col("_v").getField(c).alias(c) for c in columns))


def complete_sequence(manifests: DataFrame, group: str, number: str, complete: str) -> DataFrame:
    """The complete snapshots of each group, numbered 1, 2, ... in their order, with the group's last number.
    Incomplete ones, and ones whose completeness is null, are skipped, so that the next complete snapshot is
    compared with the one before them."""
    whole = manifests.where(F.col(complete)).select(group, number).dropna().distinct()
    order = Window.partitionBy(group).orderBy(number)
    return whole.select(
        group,
        number,
        F.row_number().over(order).alias("_seq"),
        F.count("*").over(Window.partitionBy(group)).alias("_last"),
        F.lead(number).over(order).alias("_next"),
    )


def snapshot_changes(
    listing: DataFrame, sequence: DataFrame, group: str = "project_id", key: str = "path",
    number: str = "snapshot_no", content: str | list[str] = "content_hash",
) -> DataFrame:
    """Changes between each complete snapshot and the group's preceding complete one.

    listing: one row per (group, number, key), as from latest_listing. sequence: as from complete_sequence.
    Returns (group, key, number, change_type) and, where content is a list of columns, changed_columns: those that
    differ, empty for what was added or removed. Rules: a group's first complete snapshot yields nothing; a null
    content means "present, with the content of the preceding complete snapshot", and stays unknown where the key
    was absent there; from unknown to a known content counts as changed, from anything to unknown does not.
    Empty tables give an empty result; further columns of the inputs are ignored.
    """
    columns = [content] if isinstance(content, str) else content
    rows = listing.select(group, number, key, *columns).join(sequence, [group, number])
    ranged = rows.repartitionByRange(group, key).sortWithinPartitions(group, key, "_seq")
    merge = Window.partitionBy(group, key).orderBy("_seq")

    def so_far(column: Column) -> Column:
        return F.max(column).over(merge.rowsBetween(Window.unboundedPreceding, 0))

    paired = ranged.select(
        "*", F.lag("_seq").over(merge).alias("_before"), F.lead("_seq").over(merge).alias("_after"))
    # A run is a stretch of consecutive snapshots that hold the key; its content is the last one given in it.
    given = [so_far(F.when(F.col(c).isNotNull(), F.struct(F.col("_seq").alias("at"), F.col(c).alias("as")))).alias(f"_given_{c}") for c in columns]
    runs = paired.select(
        "*", so_far(F.when(F.col("_before").isNull() | (F.col("_before") < F.col("_seq") - 1), F.col("_seq"))).alias("_run"), *given)
    runs = runs.select("*", *(F.when(F.col(f"_given_{c}.at") >= F.col("_run"), F.col(f"_given_{c}.as")).alias(f"_now_{c}") for c in columns))
    old = runs.select("*", *(F.lag(f"_now_{c}").over(merge).alias(f"_old_{c}") for c in columns))
    stays = F.col("_run") < F.col("_seq")
    differs = {c: stays & F.col(f"_now_{c}").isNotNull() & ~F.col(f"_now_{c}").eqNullSafe(F.col(f"_old_{c}")) for c in columns}
    changed = F.array_compact(F.array(*(F.when(d, F.lit(c)) for c, d in differs.items())))
    typed = old.select(
        group, key, number, "_next", changed.alias("_changed"),
        F.when((F.col("_run") == F.col("_seq")) & (F.col("_seq") > 1), F.lit(ADDED)).when(F.size(changed) > 0, F.lit(CHANGED)).alias("_here"),
        F.when((F.col("_seq") < F.col("_last")) & (F.col("_after").isNull() | (F.col("_after") > F.col("_seq") + 1)), F.lit(REMOVED))
        .alias("_gone"),
    )
    none = F.array().cast("array<string>")
    events = F.array(
        F.struct(F.col(number).alias("n"), F.col("_here").alias("change_type"), F.col("_changed").alias("changed_columns")),
        F.struct(F.col("_next").alias("n"), F.col("_gone").alias("change_type"), none.alias("changed_columns")),
    )
    out = (
        typed.where(F.col("_here").isNotNull() | F.col("_gone").isNotNull())
        .select(group, key, F.explode(events).alias("_e"))
        .where(F.col("_e.change_type").isNotNull())
        .select(group, key, F.col("_e.n").alias(number), F.col("_e.change_type").alias("change_type"), F.col("_e.changed_columns").alias("changed_columns"))
    )
    return out.drop("changed_columns") if isinstance(content, str) else out


class SnapshotStore(Folder):
    """The last complete listing of every group in one folder: `listings/<n>`, range-partitioned and sorted by key.

    keys: the group and the key with their types, as `project_id bigint, path string`; columns: what is compared."""

    def __init__(self, spark: SparkSession, folder: str, keys: str, columns: str):
        super().__init__(spark, folder)
        self.schema = f"{keys}, {columns}"
        self.keys, self.columns = ([c.split()[0] for c in x.split(", ")] for x in (keys, columns))

    def latest(self) -> DataFrame:
        return self.read("listings", self.names("listings")[-1:], self.schema)

    def deliver(self, listing: DataFrame, groups: DataFrame | None = None) -> DataFrame:
        """Merge complete listings, one row per key, with the last ones of their groups, store them in their place, and
        return the changes (keys, change_type, changed_columns).

        groups: those that are delivered, as a listing may be empty; by default those that have rows. Groups that are not
        in the delivery stay as they are; a group's first listing yields no changes. A null means the content of the
        listing before. A delivery that fails leaves the store as it was."""
        group, listing = self.keys[0], listing.select(*self.keys, *self.columns)
        delivered = (listing if groups is None else groups).select(group).distinct()
        number, kind = len(self.names("listings")), self.schema.split(", ")[0]
        before, seen = self.latest(), self.read("groups", self.names("groups")[:number][-1:], kind)
        old = before.join(delivered, group, "left_semi").select(*self.keys, *(F.col(c).alias(f"_{c}") for c in self.columns), F.lit(True).alias("_b"))
        seen.union(delivered).distinct().write.mode("overwrite").parquet(f"{self.folder}/groups/{number:08d}")
        known = seen.withColumn("_k", F.lit(True))
        both = keep(listing.withColumn("_a", F.lit(True)).join(old, self.keys, "full"), "merged")
        filled = both.where("_a").select(*self.keys, *(F.coalesce(c, f"_{c}").alias(c) for c in self.columns))
        rest = before.join(delivered, group, "left_anti")
        filled.unionByName(rest).repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.folder}/listings/{number:08d}")
        changed = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in self.columns)))
        changed = F.when(F.col("_a") & F.col("_b"), changed).otherwise(F.array().cast("array<string>"))
        kind = F.when(F.col("_b").isNull(), ADDED).when(F.col("_a").isNull(), REMOVED).when(F.size("changed_columns") > 0, CHANGED)
        typed = both.join(known, group).select(*self.keys, "_a", "_b", changed.alias("changed_columns")).withColumn("change_type", kind)
        return typed.where("change_type is not null").select(*self.keys, "change_type", "changed_columns")


def consecutive_listings(listing: DataFrame, sequence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is stored and what is observed, (project_id, snapshot_no, path, content_hash), in every complete snapshot but
    a project's first: the rows of the preceding complete one under the number of the one compared, and its own rows.

    A null content has the content of the preceding complete snapshots as far as they hold the key without a gap."""
    rows = listing.join(sequence, ["project_id", "snapshot_no"])
    key = Window.partitionBy("project_id", "path").orderBy("_seq")
    runs = rows.withColumn("_run", F.col("_seq") - F.row_number().over(key))
    run = Window.partitionBy("project_id", "path", "_run").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = keep(runs.withColumn("content_hash", F.last("content_hash", ignorenulls=True).over(run)), "listings")
    stored = whole.where("_next is not null").select("project_id", F.col("_next").alias("snapshot_no"), "path", "content_hash")
    return stored, whole.where("_seq > 1").select("project_id", "snapshot_no", "path", "content_hash")


def file_listing(snapshots: DataFrame, further: tuple[str, ...] = ()) -> DataFrame:
    """file_snapshots with `/` for the other path separator and hashes in lower case, one row per key."""
    rows = snapshots.select(
        "project_id", "snapshot_no", F.translate("path", "\\", "/").alias("path"),
        F.lower("content_hash").alias("content_hash"), "received_at", *further,
    )
    return latest_listing(rows, ["project_id", "snapshot_no", "path"], ["content_hash", *further], "received_at")


def file_changes(snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """(project_id, path, snapshot_no, change_type) between consecutive complete listings of each project."""
    sequence = complete_sequence(manifests, "project_id", "snapshot_no", "is_complete")
    return snapshot_changes(file_listing(snapshots), sequence)


def file_column_changes(snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """As file_changes, for content and size, with the columns that differ."""
    sequence = complete_sequence(manifests, "project_id", "snapshot_no", "is_complete")
    return snapshot_changes(file_listing(snapshots, ("size_bytes",)), sequence, content=["content_hash", "size_bytes"])
