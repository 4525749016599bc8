"""Ingest job: log lines to catalog, samples and quarantine."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from specloom.operators.catalog import (
    first_sightings, new_apis, request_samples, response_samples, sightings,
)
from specloom.operators.gate import rollup_samples
from specloom.operators.records import parse_records, quarantined
from specloom.session import configure, stage
from specloom.sources.archive import archive_folders, parsing_tasks, read_folder, read_lines, spread
from specloom.sources.tables import Warehouse


def ingest_lines(
    lines: DataFrame,
    warehouse: Warehouse,
    now: datetime,
    batch: int,
    max_line_bytes: int | None = None,
) -> DataFrame:
    """Ingest one batch of lines and return its parsed records.

    Lines are decompressed and parsed once, into a staged table that all outputs read. All
    writes carry the batch number, so a repeated batch replaces itself.
    """
    records = stage(parse_records(lines, now, max_line_bytes=max_line_bytes), "records")
    day = now.date()
    warehouse.append("sightings", sightings(records), batch, day)
    apis = warehouse.read_snapshot("apis", below=_step(batch))
    added = new_apis(first_sightings(warehouse.read_appended("sightings", [batch])), apis, now)
    warehouse.write_snapshot("apis", apis.unionByName(added), _step(batch))
    warehouse.append("quarantine", quarantined(records), 2 * batch, day)
    append_samples(warehouse, request_samples(records, now), response_samples(records, now), batch, now)
    return records


def append_samples(
    warehouse: Warehouse, requests: DataFrame, responses: DataFrame, batch: int, now: datetime
) -> None:
    """Write the samples of a batch, and the rollup of their stamps that gates read instead of them."""
    day = now.date()
    warehouse.append("sample_requests", requests, batch, day)
    rollups = rollup_samples(warehouse.read_appended("sample_requests", [batch]), "request").unionByName(
        rollup_samples(responses, "response")
    )
    warehouse.append("sample_rollups", rollups, batch, day)
    # Responses come last: a build takes up the batches that have them.
    warehouse.append("sample_responses", responses, batch, day)


def _step(batch: int) -> int:
    """Snapshot number of an ingest; the build that follows it takes the next one."""
    return 2 * batch


def ingest_archive(
    spark: SparkSession,
    root: str,
    start: datetime,
    end: datetime,
    warehouse: Warehouse,
    now: datetime,
    batch: int,
    partitions: int | None = None,
) -> DataFrame:
    """Ingest the hour folders of a time range; no folder or file is a success without rows.

    Lines are spread before they are parsed where the files' sizes ask for it, or over ``partitions`` tasks if given.
    """
    configure(spark)
    folders = archive_folders(spark, root, start, end)
    lines = spread(read_lines(spark, folders), partitions or parsing_tasks(spark, folders))
    return ingest_lines(lines, warehouse, now, batch)


def ingest_folder(
    spark: SparkSession, folder: str, warehouse: Warehouse, now: datetime, batch: int
) -> DataFrame:
    """Ingest the compressed files of one folder."""
    configure(spark)
    return ingest_lines(read_folder(spark, folder), warehouse, now, batch)
