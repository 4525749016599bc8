"""Changes of tables in buckets: what :mod:`specloom.operators.updates` does, rewriting touched buckets only.

What a change hits is found first, by a scan of the condition's columns; only ids or bucket numbers pass the driver, no
more than there are buckets. The counts a caller of a collection expects come from the rows as they are written.
"""

from collections.abc import Mapping
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from specloom.operators.rows import BASE_COLUMNS
from specloom.operators.updates import assign, first_rows, last_item
from specloom.session import stage
from specloom.sources.buckets import BucketTable


class Change(NamedTuple):
    """What a change did. Without anything to change, no version is written."""

    modified: int = 0
    inserted: int = 0
    deleted: int = 0
    buckets: tuple[int, ...] = ()


def _first_id(rows: DataFrame, cond: Column):
    """(id,) of the first row that matches, or None."""
    found = rows.where(cond).agg(F.min(F.struct("created_at", "id")).alias("m")).first().m
    return None if found is None else (found.id,)


def _apply(table: BucketTable, version: int, touched: list[int], hit: Column, values: Mapping | None, now: datetime | None) -> Change:
    """Assign values to the rows that ``hit`` holds for, or remove them, and write their buckets."""
    rows = table.read(below=version, buckets=touched).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    hits, buckets = {"hits": F.count_if("_hit")}, tuple(sorted(touched))
    if values is None:
        return Change(deleted=table.write(rows, version, touched, hits, keep=~F.col("_hit"))["hits"], buckets=buckets)
    seen = table.write(assign(rows, F.col("_hit"), values, now), version, touched, hits)
    return Change(modified=seen["hits"], buckets=buckets)


def _first(table: BucketTable, version: int, cond: Column, values: Mapping | None, now: datetime | None, rows: DataFrame | None = None) -> Change:
    found = _first_id(table.read(below=version) if rows is None else rows, cond)
    if found is None:
        return Change()
    same = F.col("id").eqNullSafe(F.lit(found[0]))
    return _apply(table, version, [table.bucket_of(found[0])], same, values, now)


def update_one(table: BucketTable, version: int, cond: Column, values: Mapping, now: datetime) -> Change:
    """Assign ``values`` on the first match by (created_at, id): one bucket is written."""
    return _first(table, version, cond, values, now)


def update_by_id(table: BucketTable, version: int, row_id: str, values: Mapping, now: datetime) -> Change:
    """As :func:`update_one`, reading one bucket only."""
    return _first(table, version, F.col("id") == row_id, values, now, table.by_id(row_id, below=version))


def update_many(table: BucketTable, version: int, cond: Column, values: Mapping, now: datetime) -> Change:
    """Assign ``values`` on every match; buckets without one stay as they are."""
    touched = [r.b for r in table.read(below=version).where(cond).select(table.bucket().alias("b")).distinct().collect()]
    return _apply(table, version, touched, cond, values, now) if touched else Change()


def soft_delete(table: BucketTable, version: int, cond: Column, now: datetime) -> Change:
    return update_many(table, version, cond, {"deleted_at": now}, now)


def delete_one(table: BucketTable, version: int, cond: Column) -> Change:
    """Remove the first match; none is no error."""
    return _first(table, version, cond, None, None)


def delete_by_id(table: BucketTable, version: int, row_id: str) -> Change:
    return _first(table, version, F.col("id") == row_id, None, None, table.by_id(row_id, below=version))


def upsert(
    table: BucketTable, version: int, items: DataFrame, key: list[str], now: datetime, new_id: Column, order: str | None = None
) -> Change:
    """Update the first row of each item's key, or insert the item: :func:`specloom.operators.updates.upsert` by buckets.

    Keys are looked up in a scan of their columns; the rest is read and written for touched buckets alone.
    """
    items = last_item(items, key, order)
    hits = first_rows(table.read(below=version), items, key)
    placed = items.join(hits, key, "left").withColumn("_known", F.col("_id").isNotNull())
    placed = placed.withColumn("id", F.when(F.col("_known"), F.col("_id")).otherwise(new_id)).drop("_id")
    return _upsert(table, version, placed, now, key)


def upsert_by_id(table: BucketTable, version: int, items: DataFrame, now: datetime, order: str | None = None) -> Change:
    """Update rows with the items' ids, or insert the items; only the items' buckets are read."""
    return _upsert(table, version, last_item(items, ["id"], order).withColumn("_known", F.lit(True)), now, [])


def _upsert(table: BucketTable, version: int, items: DataFrame, now: datetime, only_inserted: list[str]) -> Change:
    """Items (id, columns, _known): assigned to the row of their id if they are known, else inserted.

    Columns ``only_inserted`` are not assigned to a row that is there, as they are its key.
    """
    items = stage(items, "items")
    touched = [r.b for r in items.select(table.bucket().alias("b")).distinct().collect()]
    if not touched:
        return Change()
    assigned = [c for c in items.columns if c not in BASE_COLUMNS and c != "_known"]
    new = items.select("id", "_known", F.struct(*assigned, F.lit(1).alias("_")).alias("_new"))
    old = table.read(below=version, buckets=touched).withColumn("_old", F.lit(True))
    # An id that a key's new item shares with another row is a row of its own.
    joined = old.join(new.where("_known"), "id", "full_outer").unionByName(
        new.where("NOT _known"), allowMissingColumns=True
    )
    hit = F.col("_new").isNotNull()
    fresh = hit & F.col("_old").isNull()
    joined = joined.withColumns({"_hit": hit, "_fresh": F.coalesce(fresh, F.lit(False))})
    values = {c: F.col(f"_new.{c}") for c in assigned if c not in only_inserted}
    rows = assign(joined, F.col("_hit"), values, now)
    rows = rows.withColumns({c: F.when(F.col("_fresh"), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in only_inserted})
    rows = rows.withColumn("created_at", F.when(F.col("_fresh"), F.lit(now)).otherwise(F.col("created_at")))
    counts = {"modified": F.count_if(F.col("_hit") & ~F.col("_fresh")), "inserted": F.count_if("_fresh")}
    seen = table.write(rows, version, touched, counts)
    return Change(seen["modified"], seen["inserted"], 0, tuple(sorted(touched)))
