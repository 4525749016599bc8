"""Which APIs need a new structure, and which samples are in their window."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

GATES = ("fixed", "legacy")
UNREAD = "unread"


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def created_between(start: Column | datetime | None = None, end: Column | datetime | None = None) -> Column:
    """Time range on ``created_at``, both ends included; an absent end is open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("created_at") >= start)
    if end is not None:
        cond = cond & (F.col("created_at") <= end)
    return cond


def newest_samples(samples: DataFrame) -> DataFrame:
    """(api_id, newest) over live samples; reads two columns and hashes on a fixed-width maximum."""
    return live(samples).groupBy("api_id").agg(F.max("created_at").alias("newest"))


def rollup_samples(samples: DataFrame, side: str) -> DataFrame:
    """(side, api_id, oldest, newest, n) of live samples by their stamps: one small row per API, written at ingest."""
    return live(samples).groupBy("api_id").agg(
        F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.count("*").alias("n")
    ).select(F.lit(side).alias("side"), "api_id", "oldest", "newest", "n")


def newest_in_rollups(rollups: DataFrame, side: str) -> DataFrame:
    """(api_id, newest) as :func:`newest_samples` gives it, from rollups of batches; no sample is read."""
    return rollups.where(F.col("side") == side).groupBy("api_id").agg(F.max("newest").alias("newest"))


def due_apis(apis: DataFrame, samples: DataFrame, gate: str = "fixed") -> DataFrame:
    """:func:`due_by_newest`, the newest stamps taken from the samples themselves."""
    return due_by_newest(apis, newest_samples(samples), gate)


def due_by_newest(apis: DataFrame, newest_stamps: DataFrame, gate: str = "fixed") -> DataFrame:
    """(api_id, cursor) of live APIs to rebuild; an API without samples never is. ``newest_stamps``: (api_id, newest).

    'fixed' rebuilds when there is something at or after the cursor. 'legacy' does the
    opposite once a cursor is set, which freezes a structure after its first build. 'unread'
    is for samples no build has read yet: any of them counts, and cursors do not.
    """
    if gate == UNREAD:
        touched = live(apis).join(newest_stamps.select(F.col("api_id").alias("id")), "id", "left_semi")
        return touched.select(F.col("id").alias("api_id"), F.lit(None).cast("timestamp").alias("cursor"))
    if gate not in GATES:
        raise ValueError(f"gate must be one of {(*GATES, UNREAD)}")
    cursors = live(apis).select(
        F.col("id").alias("api_id"), F.col("latest_build_structure").alias("cursor")
    )
    newest, cursor = F.col("newest"), F.col("cursor")
    wanted = newest >= cursor if gate == "fixed" else cursor >= newest
    return (
        cursors.join(newest_stamps, "api_id")
        .where(cursor.isNull() | wanted)
        .select("api_id", "cursor")
    )


def window_samples(samples: DataFrame, due: DataFrame) -> DataFrame:
    """Live samples of due APIs from the cursor on.

    ``due`` has one short row per API; Spark broadcasts it when its measured size allows,
    else the join shuffles and adaptive execution splits hot APIs.
    """
    in_window = F.col("cursor").isNull() | (F.col("created_at") >= F.col("cursor"))
    return live(samples).join(due, "api_id").where(in_window).drop("cursor")


def advance_cursor(apis: DataFrame, built: DataFrame, now: datetime) -> DataFrame:
    """Set ``latest_build_structure`` of the APIs whose ids are in ``built`` (column api_id)."""
    hit = built.select(F.col("api_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    moved = F.coalesce("_hit", F.lit(False))
    return (
        apis.join(hit, "id", "left")
        .withColumns(
            {
                c: F.when(moved, F.lit(now)).otherwise(F.col(c))
                for c in ("latest_build_structure", "updated_at")
            }
        )
        .select(*apis.columns)
    )


def unmatched_ids(apis: DataFrame, built: DataFrame) -> DataFrame:
    """Ids asked for that the catalog does not have; moving their cursor is an error."""
    return built.select(F.col("api_id").alias("id")).distinct().join(apis, "id", "left_anti")
