"""Tables of the engine on Parquet: appended batches, and snapshots for changing tables.

Appended tables (samples, quarantine) hold one folder per day and ingest batch, so that repeating a batch replaces it and
a time range is read by its days. Changing tables (catalog, structures) are rewritten into a new snapshot folder; readers
take the newest complete one.
"""

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from specloom.operators.updates import stamp_new
from specloom.schemas import conform, empty_table, table_schema

_DONE = "_SUCCESS"


class Warehouse:
    """Paths of the tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _complete(self, table: str, pattern: str) -> list[str]:
        """Folders of a table that match and are complete, found by one listing; paths below the table's."""
        done = self._path(table, pattern, _DONE)
        fs = done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        depth = pattern.count("/") + 1
        return ["/".join(str(s.getPath()).split("/")[-depth - 1 : -1]) for s in fs.globStatus(done) or []]

    def append(self, table: str, df: DataFrame, batch: int, day: date) -> None:
        """Write a batch of an appended table; the same batch again replaces it. ``day`` is that of its stamps."""
        for folder in self._complete(table, f"date=*/batch={batch}"):
            if folder != f"date={day}/batch={batch}":
                raise ValueError(f"batch {batch} of {table} lies at {folder}")
        conform(df, table).write.mode("overwrite").parquet(f"{self.root}/{table}/date={day}/batch={batch}")

    def insert(self, table: str, df: DataFrame, batch: int, now: datetime) -> None:
        """Append rows after stamping them."""
        self.append(table, stamp_new(conform(df, table), now), batch, now.date())

    def batches(self, table: str) -> list[int]:
        """Numbers of the complete batches of an appended table, ascending."""
        return sorted(int(f.rpartition("=")[2]) for f in self._complete(table, "date=*/batch=*"))

    def read_appended(
        self, table: str, batches: list[int] | None = None, since: date | None = None, until: date | None = None
    ) -> DataFrame:
        """Complete batches of an appended table: all, those named, or those of some days (both ends included).

        Folders of other batches and days are not read: the scan knows ``date`` and ``batch`` as partitions.
        """
        done = self._complete(table, "date=*/batch=*")
        wanted = [f for f in done if batches is None or int(f.rpartition("=")[2]) in set(batches)]
        if not wanted:
            return empty_table(self.spark, table)
        base = f"{self.root}/{table}"
        days = sorted({f.partition("/")[0] for f in wanted})
        rows = (
            self.spark.read.schema(table_schema(table).add("date", "date").add("batch", "integer"))
            .option("basePath", base)
            .parquet(*([f"{base}/{f}" for f in wanted] if batches is not None else [f"{base}/{d}" for d in days]))
        )
        if batches is None:
            # What a writer has left unfinished is not complete, and so not listed.
            rows = rows.where(F.col("batch").isin([int(f.rpartition("=")[2]) for f in done]))
        if since is not None:
            rows = rows.where(F.col("date") >= F.lit(since))
        if until is not None:
            rows = rows.where(F.col("date") <= F.lit(until))
        return rows.drop("date", "batch")

    def versions(self, table: str) -> list[int]:
        return sorted(int(f.rpartition("=")[2]) for f in self._complete(table, "v=*"))

    def read_snapshot(self, table: str, below: int | None = None) -> DataFrame:
        """The newest snapshot, or the newest one with a number below ``below``."""
        found = [v for v in self.versions(table) if below is None or v < below]
        if not found:
            return empty_table(self.spark, table)
        return self.spark.read.schema(table_schema(table)).parquet(
            f"{self.root}/{table}/v={found[-1]}"
        )

    def write_snapshot(self, table: str, df: DataFrame, version: int) -> None:
        conform(df, table).write.mode("overwrite").parquet(f"{self.root}/{table}/v={version}")
