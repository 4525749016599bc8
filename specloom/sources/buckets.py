"""Tables in buckets by a hash of the id, of which a change rewrites only those it touches.

A version writes the buckets it changes, and a manifest that names for every bucket the version that holds it. The
manifest is written last: until then readers see the version before, and a job that dies is repeated in full. Within a
bucket rows are sorted by id, with page indexes and bloom filters, so a read by id opens one bucket and skips in it.
"""

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

_DONE = "_SUCCESS"
# Rows of a page, the least that a read by id takes up.
PAGE_ROWS = 4096


class BucketTable:
    """A table below ``path``; ``buckets`` is fixed when it is first written."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 64):
        if "bucket" in schema.fieldNames():
            raise ValueError("the column 'bucket' names the folders of the table")
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def bucket(self, row_id: Column | None = None) -> Column:
        """The bucket of an id."""
        return F.pmod(F.xxhash64(F.col("id") if row_id is None else row_id), F.lit(self.buckets)).cast("int")

    def bucket_of(self, row_id: str) -> int:
        return self.spark.range(1).select(self.bucket(F.lit(row_id).cast(self.schema["id"].dataType))).first()[0]

    def _list(self, pattern: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [str(s.getPath()) for s in fs.globStatus(path) or []]

    def versions(self) -> list[int]:
        return sorted(int(p.split("v=")[-1].split("/")[0]) for p in self._list(f"manifest/v=*/{_DONE}"))

    def manifest(self, below: int | None = None) -> dict[int, int]:
        """The version that holds each bucket with rows: one short row per bucket."""
        found = [v for v in self.versions() if below is None or v < below]
        if not found:
            return {}
        rows = self.spark.read.schema("bucket int, version long, buckets int").parquet(f"{self.path}/manifest/v={found[-1]}")
        held = rows.collect()
        if any(r.buckets != self.buckets for r in held):
            raise ValueError(f"the table has {held[0].buckets} buckets")
        return {r.bucket: r.version for r in held if r.bucket >= 0}

    def read(self, below: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, as the newest version below ``below`` has it."""
        held = self.manifest(below)
        wanted = {b: v for b, v in held.items() if buckets is None or b in set(buckets)}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(wanted.items())]
        return self.spark.read.schema(self.schema).parquet(*folders)

    def by_id(self, row_id: str, below: int | None = None) -> DataFrame:
        """The rows with an id: one bucket is opened, and only the row groups that may hold the id."""
        return self.read(below, [self.bucket_of(row_id)]).where(F.col("id") == row_id)

    def write(
        self,
        rows: DataFrame,
        version: int,
        touched: list[int] | None = None,
        counts: dict[str, Column] | None = None,
        keep: Column | None = None,
    ) -> dict[str, int]:
        """Write the touched buckets, or the whole table, as a version; ``rows`` are all their rows.

        ``counts`` are aggregates over ``rows``, columns beyond the table's included; they are observed while the rows are
        written, in the last stage, where a task that is run again counts once. Rows without ``keep`` are counted and left
        out.
        """
        before = {} if touched is None else self.manifest(below=version)
        laid = (
            rows.withColumn("bucket", self.bucket())
            # Adaptive execution makes files of like size of this, however large a bucket is.
            .hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", "id")
        )
        seen = Observation()
        laid = laid.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in (counts or {}).items()])
        (
            (laid if keep is None else laid.where(keep))
            .select(*self.schema.fieldNames(), "bucket")
            .write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#id", "true")
            .option("parquet.page.row.count.limit", str(PAGE_ROWS))
            .partitionBy("bucket")
            .parquet(f"{self.path}/data/v={version}")
        )
        new = {int(p.rpartition("=")[2]): version for p in self._list(f"data/v={version}/bucket=*")}
        kept = {b: v for b, v in before.items() if touched is not None and b not in set(touched)}
        # A table without rows still has a manifest, with a row that names no bucket.
        rows_ = [(b, v, self.buckets) for b, v in sorted({**kept, **new}.items())] or [(-1, version, self.buckets)]
        manifest = self.spark.createDataFrame(rows_, "bucket int, version long, buckets int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        return {name: n or 0 for name, n in seen.get.items()}
