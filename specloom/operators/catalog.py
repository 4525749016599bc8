"""API catalog and samples taken from accepted records."""

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from specloom.operators.records import accepted
from specloom.schemas import conform


def sightings(records: DataFrame) -> DataFrame:
    """(api_id, path, host, method, first_seen): when each path was first met under a host and method.

    Keeps only a timestamp per group, so it hashes and combines before the shuffle whatever
    the share of one path.
    """
    return (
        accepted(records)
        .groupBy("api_id", "path", "host", "method")
        .agg(F.min("event_at").alias("first_seen"))
    )


def first_sightings(seen: DataFrame) -> DataFrame:
    """The first sighting per path; those of one instant are ordered by host and method.

    Sightings of several batches may come together in any order: the first of their firsts
    is the first of all.
    """
    first = F.min(F.struct("first_seen", "host", "method"))
    return (
        seen.groupBy("api_id", "path")
        .agg(first.alias("_first"))
        .select("api_id", "path", "_first.host", "_first.method", "_first.first_seen")
    )


def discover_apis(records: DataFrame) -> DataFrame:
    """One row per path template, with host and method of its first record."""
    return first_sightings(sightings(records)).drop("first_seen")


def with_first_sighting(apis: DataFrame, first: DataFrame) -> DataFrame:
    """Live rows of the catalog with host and method of their path's first sighting, whenever it turned up."""
    seen = first.select(F.col("api_id").alias("id"), F.struct("host", "method").alias("_first"))
    known = F.col("_first").isNotNull() & F.col("deleted_at").isNull()
    named = {c: F.when(known, F.col(f"_first.{c}")).otherwise(F.col(c)) for c in ("host", "method")}
    return apis.join(seen, "id", "left").withColumns(named).select(*apis.columns)


def new_apis(discovered: DataFrame, apis: DataFrame, now: datetime) -> DataFrame:
    """Discovered APIs the catalog has no live row for, as catalog rows."""
    known = apis.where(F.col("deleted_at").isNull()).select(F.col("id").alias("api_id"))
    fresh = discovered.join(known, "api_id", "left_anti")
    return conform(
        fresh.select(
            F.col("api_id").alias("id"),
            F.lit(now).alias("created_at"),
            F.lit(now).alias("updated_at"),
            F.lit("").alias("title"),
            "host",
            "path",
            "method",
            F.lit("").alias("description"),
        ),
        "apis",
    )


def _stamped(records: DataFrame, now: datetime) -> DataFrame:
    return accepted(records).withColumns(
        {"created_at": F.lit(now), "updated_at": F.lit(now)}
    )


def request_samples(records: DataFrame, now: datetime) -> DataFrame:
    """One request sample per accepted record."""
    return conform(_stamped(records, now), "sample_requests")


def response_samples(records: DataFrame, now: datetime) -> DataFrame:
    """A response sample per accepted record with a response body; an empty body counts."""
    with_body = _stamped(records, now).where(F.col("response_body").isNotNull())
    return conform(with_body.withColumn("body", F.col("response_body")), "sample_responses")
