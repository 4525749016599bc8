"""Row changes as DataFrame rewrites: the result is the next snapshot of the table.

Every change stamps ``updated_at`` and leaves ``id`` and ``created_at`` alone. Changes to
one row touch the first match by (created_at, id).
"""

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from specloom.operators.rows import BASE_COLUMNS

_FIRST = "struct(created_at, id)"


def stamp_new(items: DataFrame, now: datetime) -> DataFrame:
    """Stamp rows to insert; a row that already has ``created_at`` keeps both its stamps."""
    fresh = F.col("created_at").isNull()
    return items.withColumns(
        {c: F.when(fresh, F.lit(now)).otherwise(F.col(c)) for c in ("created_at", "updated_at")}
    )


def _with_first(df: DataFrame, cond: Column) -> DataFrame:
    """Add ``_hit``: true on the first row that matches. That row's id is a one-row side."""
    first = (
        df.where(cond)
        .agg(F.min(F.struct("created_at", "id")).alias("m"))
        .select(F.col("m.id").alias("id"), F.lit(True).alias("_hit"))
    )
    return df.join(F.broadcast(first), "id", "left").withColumn(
        "_hit", F.coalesce("_hit", F.lit(False))
    )


def assign(df: DataFrame, hit: Column, values: Mapping, now: datetime, base=("id", "created_at")) -> DataFrame:
    """Values on the rows that ``hit`` holds for, and their stamp; columns ``base`` stay."""
    new = {name: value for name, value in values.items() if name not in base}
    new["updated_at"] = now
    return df.withColumns(
        {
            name: F.when(
                hit, (value if isinstance(value, Column) else F.lit(value)).cast(df.schema[name].dataType)
            ).otherwise(F.col(name))
            for name, value in new.items()
        }
    )


def update_one(df: DataFrame, cond: Column, values: Mapping, now: datetime) -> DataFrame:
    """Assign ``values`` on the first match. A column subset makes a partial update."""
    return assign(_with_first(df, cond), F.col("_hit"), values, now).select(*df.columns)


def update_by_id(df: DataFrame, row_id: str, values: Mapping, now: datetime) -> DataFrame:
    return update_one(df, F.col("id") == row_id, values, now)


def update_many(df: DataFrame, cond: Column, values: Mapping, now: datetime) -> DataFrame:
    """Assign ``values`` on every match: one projection, no shuffle."""
    return assign(df, F.coalesce(cond, F.lit(False)), values, now)


def modified_count(df: DataFrame, cond: Column, one: bool) -> DataFrame:
    """How many rows a change modifies: the matches, at most one if only the first is meant."""
    matched = df.where(cond).agg(F.count("*").alias("n"))
    return matched.select((F.least("n", F.lit(1)) if one else F.col("n")).alias("modified"))


def delete_one(df: DataFrame, cond: Column) -> DataFrame:
    """Remove the first match; none is no error."""
    return _with_first(df, cond).where(~F.col("_hit")).select(*df.columns)


def delete_by_id(df: DataFrame, row_id: str) -> DataFrame:
    return delete_one(df, F.col("id") == row_id)


def soft_delete(df: DataFrame, cond: Column, now: datetime) -> DataFrame:
    """Mark every match deleted."""
    return update_many(df, cond, {"deleted_at": now}, now)


def soft_delete_by_id(df: DataFrame, row_id: str, now: datetime) -> DataFrame:
    return update_by_id(df, row_id, {"deleted_at": now}, now)


def last_item(items: DataFrame, key: list[str], order: str | None) -> DataFrame:
    """One item per key: applying items in turn leaves the last one's values."""
    if order is None:
        return items
    rest = [c for c in items.columns if c not in (*key, order)]
    return (
        items.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), order).alias("_v"))
        .select(*key, "_v.*")
    )


def first_rows(df: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """The id of the first row per item key. Rows without an item drop out before any is sorted."""
    firsts = df.join(items.select(*key), key, "left_semi").groupBy(*key).agg(F.min(F.expr(_FIRST)).alias("m"))
    return firsts.select(*key, F.col("m.id").alias("_id"))


def upsert(
    df: DataFrame,
    items: DataFrame,
    key: list[str],
    now: datetime,
    new_id: Column,
    order: str | None = None,
) -> DataFrame:
    """Update the first row of each item's key, or insert the item.

    ``items`` has ``key`` and the columns to assign; with ``order`` several items of a key
    apply in that order, without it keys must be unique. All assigned columns overwrite,
    nulls too. An inserted row gets ``new_id`` (over the key columns) and ``created_at``.
    """
    items = last_item(items, key, order)
    assigned = [c for c in items.columns if c not in key and c not in BASE_COLUMNS]
    hits = first_rows(df, items, key)
    changes = items.join(hits, key, "left")
    by_row = changes.where(F.col("_id").isNotNull()).select(
        F.col("_id").alias("id"),
        F.struct(*assigned, F.lit(1).alias("_")).alias("_new"),
    )
    updated = df.join(by_row, "id", "left").withColumn("_hit", F.col("_new").isNotNull())
    updated = assign(
        updated, F.col("_hit"), {c: F.col(f"_new.{c}") for c in assigned}, now
    ).select(*df.columns)
    inserted = changes.where(F.col("_id").isNull()).withColumns(
        {"id": new_id, "created_at": F.lit(now), "updated_at": F.lit(now)}
    )
    return updated.unionByName(
        inserted.select(*[c for c in df.columns if c in inserted.columns]), allowMissingColumns=True
    )


def upsert_by_id(
    df: DataFrame, items: DataFrame, now: datetime, order: str | None = None
) -> DataFrame:
    """Upsert keyed by ``id``: a full outer join, as ids are unique."""
    items = last_item(items, ["id"], order)
    assigned = [c for c in items.columns if c not in BASE_COLUMNS]
    new = items.select("id", F.struct(*assigned, F.lit(1).alias("_")).alias("_new"))
    old = df.withColumn("_old", F.lit(True))
    joined = old.join(new, "id", "full_outer")
    hit = F.col("_new").isNotNull()
    result = assign(joined, hit, {c: F.col(f"_new.{c}") for c in assigned}, now)
    return result.withColumn(
        "created_at", F.when(F.col("_old").isNull(), F.lit(now)).otherwise(F.col("created_at"))
    ).select(*df.columns)


def upsert_counts(df: DataFrame, items: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """(matched, inserted) rows of an upsert."""
    items = last_item(items, key, order)
    known = df.select(*key).distinct().withColumn("_known", F.lit(1))
    hit = F.col("_known").isNotNull()
    return items.join(known, key, "left").agg(
        F.count(F.when(hit, 1)).alias("matched"), F.count(F.when(~hit, 1)).alias("inserted")
    )
