"""Incremental ingest and build over a growing log archive."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from specloom.plans.build import run_build
from specloom.plans.documents import refresh_documents
from specloom.plans.ingest import ingest_lines
from specloom.session import configure
from specloom.sources.archive import gz_lines, spread
from specloom.sources.tables import Warehouse


def log_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Lines of new ``*.gz`` files anywhere below ``root``, however old they are."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("maxFileAge", "36500d")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return gz_lines(spark, reader, root)


def run_incremental(
    spark: SparkSession,
    root: str,
    warehouse: Warehouse,
    checkpoint: str,
    started: datetime,
    max_files: int | None = None,
    precedence: str = "newest",
    merge: str = "shallow",
    documents: bool = False,
) -> None:
    """Ingest and build everything that is new, then stop.

    Each micro-batch adds its samples and refreshes the structures of the APIs it touches;
    the stream's checkpoint remembers the files. Stamps derive from the batch number, so a
    repeated batch rewrites the same rows: ingest at second 2n, build at second 2n+1 after
    ``started``. In a later batch a key's new value beats the stored one, unless
    ``precedence`` is 'oldest', or 'event', with which it does not matter how files fall into
    batches. With ``documents`` those of the touched APIs are rendered into the snapshot.
    """
    configure(spark)

    def process(lines: DataFrame, batch_id: int) -> None:
        batch = batch_id + 1
        # A file is one task's: lines of fewer files than cores are moved before they are parsed.
        cores = spark.sparkContext.defaultParallelism
        lines = spread(lines, cores if lines.rdd.getNumPartitions() < cores else None)
        ingest_lines(lines, warehouse, started + timedelta(seconds=2 * batch), batch)
        built_at = started + timedelta(seconds=2 * batch + 1)
        run_build(warehouse, built_at, 2 * batch + 1, precedence=precedence, merge=merge)
        if documents:
            refresh_documents(warehouse, 2 * batch + 1)

    query = (
        log_stream(spark, root, max_files)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(process)
        .start()
    )
    query.awaitTermination()
