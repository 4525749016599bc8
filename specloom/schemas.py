"""Schemas of the tables the engine keeps."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BASE = "id STRING, created_at TIMESTAMP, updated_at TIMESTAMP, deleted_at TIMESTAMP"
PARAMETERS = (
    "ARRAY<STRUCT<name: STRING, type: STRING, value: STRING, `in`: STRING, required: BOOLEAN>>"
)

TABLES = {
    "apis": f"{BASE}, title STRING, host STRING, path STRING, method STRING, "
    "description STRING, latest_build_structure TIMESTAMP",
    "sample_requests": f"{BASE}, api_id STRING, parameters {PARAMETERS}, body STRING, "
    "event_at TIMESTAMP",
    "sample_responses": f"{BASE}, api_id STRING, http_status_code BIGINT, body STRING, "
    "event_at TIMESTAMP",
    "request_structures": f"{BASE}, api_id STRING, parameters {PARAMETERS}, body_schema STRING, "
    "has_body BOOLEAN",
    "response_structures": f"{BASE}, api_id STRING, body_schema STRING, has_body BOOLEAN",
    "types": f"{BASE}, name STRING, properties STRING",
    # Rendered documents, the version that rendered each, and what it was rendered from.
    "documents": "api_id STRING, path STRING, method STRING, document STRING, version BIGINT, mark STRING",
    "consumed": "batch BIGINT",
    # What an ingest notes of its samples, and where and when it met each path; both are small.
    "sample_rollups": "side STRING, api_id STRING, oldest TIMESTAMP, newest TIMESTAMP, n BIGINT",
    "sightings": "api_id STRING, path STRING, host STRING, method STRING, first_seen TIMESTAMP",
    # State of builds by event time: per key the sample that decides its schema, per path its first sighting.
    "folds": "side STRING, api_id STRING, key STRING, event_at TIMESTAMP, id STRING, schema STRING",
    "first_seen": "api_id STRING, path STRING, host STRING, method STRING, first_seen TIMESTAMP",
    "quarantine": "file STRING, line STRING, stage STRING, reason STRING",
}


def table_schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], table_schema(name))


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select a table's columns in order; absent ones become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schema(name).fields
        ]
    )
