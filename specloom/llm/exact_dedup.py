"""Exact deduplication by a stream with keyed state on disk.

Each document's normalised text is reduced to a digest. A streaming aggregation keeps, per digest and without expiry, how
many rows had it and the row to keep: its id, and where its content lies (file and place in it). The state lives in
RocksDB on the executors' disks and in the checkpoint folder, so a later call on the same folder goes on where the last
one ended. Rows whose digest was met twice are hits; for those, and only those, the full texts are fetched by file and
place and compared, with those of earlier calls too.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from specloom.llm.names import unused
from specloom.session import scratch_path, stage

#: Settings of the state while the stream runs.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A partition's store is closed when its batch is done, so memory follows the running tasks, not the partitions.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}
#: Bytes of keys that one micro-batch takes in at most.
BATCH_BYTES = 64 << 30


def lower_ascii(text: Column) -> Column:
    """The text with A-Z lowered and nothing else changed; null is empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower())


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def retain(spark: SparkSession, keys_path: str, state_path: str) -> DataFrame:
    """Take in key files not yet seen, and return the state: (digest, keep, n) for every digest ever met."""
    schema = spark.read.parquet(keys_path).schema
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        # Files of any age count; the state knows no watermark, so nothing expires.
        keys = spark.readStream.schema(schema).option("maxFileAge", "36500d").option("maxBytesPerTrigger", BATCH_BYTES)
        met = keys.parquet(keys_path).groupBy("digest").agg(
            F.max(F.struct("id", "row", "place")).alias("keep"), F.count("*").alias("n")
        )
        run = (
            met.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_path)
            .trigger(availableNow=True).start()
        )
        run.awaitTermination()
        if run.exception() is not None:
            raise run.exception()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return state_of(spark, state_path)


def state_of(spark: SparkSession, state_path: str) -> DataFrame:
    """(digest, keep, n) of every digest that a stream has met."""
    state = spark.read.format("statestore").load(state_path)
    value = [f.name for f in state.schema["value"].dataType.fields]
    return state.select(
        F.col("key.digest").alias("digest"), F.col("value")[value[0]].alias("keep"), F.col("value")[value[1]].alias("n")
    )


class Met:
    """What a folder has met: ``keys`` (one row per document), ``state`` (the stream's), ``checked`` (calls whose hits were
    compared) and ``clashes`` (digests that stand for several texts).

    A document is the row of a Parquet file: its identifier is the file and the place in it, which also is the locator its
    text is fetched by. So the files have to stay as long as the folder is used.
    """

    def __init__(
        self, spark: SparkSession, folder: str, id_column: str, text_column: str,
        normalise: Callable[[Column], Column] = lower_ascii, digest: Callable[[Column], Column] = sha256,
    ):
        self.spark, self.folder = spark, folder
        self.id_column, self.text_column, self.normalise, self.digest = id_column, text_column, normalise, digest
        self.call, self.paths, self.state = None, [], None

    def _read(self, table: str) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(str(path)) if there else None

    def _last(self, table: DataFrame | None) -> int:
        return 0 if table is None else table.agg(F.max("call")).first()[0] or 0

    def _rows(self, paths: list[str]) -> DataFrame:
        """(id, text, row, place) of all documents in the files."""
        table = self.spark.read.parquet(*paths)
        return table.select(F.col(self.id_column).alias("id"), F.col(self.text_column).alias("text"), *locator(table))

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (digest, id, row, place, call) with ``text``: of earlier calls, only files with such rows are read."""
        parts = []
        if self.paths:
            parts.append((wanted.where(F.col("call") == self.call), self.paths))
        if self.call != 1:
            older = wanted.where(F.col("call") != self.call) if self.paths else wanted
            files = [unquote(r.place) for r in older.select("place").distinct().collect()]
            if files:
                parts.append((older, files))
        found = [w.join(self._rows(files).select("place", "row", "text"), ["place", "row"]) for w, files in parts]
        return reduce(DataFrame.unionByName, found).withColumn("text", self.normalise(F.col("text")))

    def take_in(self, paths: list[str]) -> DataFrame:
        """Take in the documents of some files; (digest, id, row, place) of all of them, also those met before."""
        earlier = self._read("keys")
        self.call, self.paths = 1 + self._last(earlier), paths
        own = self._rows(paths).select(self.digest(self.normalise(F.col("text"))).alias("digest"), "id", "row", "place")
        new = own
        if earlier is not None:
            own = stage(own, "keys")
            new = own.join(earlier.select("place", "row"), ["place", "row"], "left_anti")
        new = new.withColumn("call", F.lit(self.call).cast("long"))
        new.write.mode("append").parquet(f"{self.folder}/keys")
        self.state = stage(retain(self.spark, f"{self.folder}/keys", f"{self.folder}/state"), "state")
        keys = self._read("keys")
        self._check(keys)
        return own if earlier is not None else keys.drop("call")

    def _check(self, keys: DataFrame) -> None:
        """Compare full texts of the hits among rows not compared yet, each digest's with one compared before."""
        checked = self._last(self._read("checked"))
        suspects = keys.where(F.col("call") > checked).join(self.state.where("n > 1").select("digest"), "digest")
        if checked:
            suspects = stage(suspects, "suspects")
            known = keys.where(F.col("call") <= checked).join(suspects.select("digest"), "digest", "left_semi")
            one = known.groupBy("digest").agg(F.min(F.struct("id", "row", "place", "call")).alias("one")).select("digest", "one.*")
            suspects = suspects.unionByName(one)
        # Copies of a text leave a task once.
        classes = self._texts(suspects).groupBy("digest", "text").agg(F.count("*").alias("n"))
        clashes = classes.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
        clashes.write.mode("append").parquet(f"{self.folder}/clashes")
        done = self.spark.range(1).select(F.lit(self.call).cast("long").alias("call"))
        done.write.mode("append").parquet(f"{self.folder}/checked")

    def marks(self, own: DataFrame) -> DataFrame:
        """(id, keep_id, group_size, kept, digest, row, place) of the rows ``own``, judged over all rows ever met."""
        state = state_of(self.spark, f"{self.folder}/state") if self.state is None else self.state
        columns = [
            "id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
            ((F.col("keep.row") == F.col("row")) & (F.col("keep.place") == F.col("place"))).alias("kept"), "digest", "row", "place",
        ]
        result = own.join(state, "digest").select(*columns)
        clashes = self._read("clashes").distinct()
        if clashes.isEmpty():
            return result
        # Digests that stand for several texts: grouped by the texts themselves, over all rows ever met.
        rows = stage(self._texts(self._read("keys").join(clashes, "digest")), "clashing")
        groups = rows.groupBy("digest", "text").agg(F.max(F.struct("id", "row", "place")).alias("keep"), F.count("*").alias("n"))
        by_text = rows.join(groups, ["digest", "text"]).select(*columns)
        by_text = by_text.join(own.select("place", "row"), ["place", "row"], "left_semi")
        return result.join(clashes, "digest", "left_anti").unionByName(by_text)


def locator(table: DataFrame, row: str = "row", place: str = "place") -> list[Column]:
    """File and place in it of each row of a table that was read from Parquet files."""
    file = table.metadataColumn("_metadata")
    return [file["row_index"].alias(row), file["file_path"].alias(place)]


def mark_files(
    spark: SparkSession,
    paths: list[str],
    id_column: str = "doc_id",
    text_column: str = "text",
    normalise: Callable[[Column], Column] = lower_ascii,
    digest: Callable[[Column], Column] = sha256,
    folder: str | None = None,
) -> DataFrame:
    """(id, keep_id, group_size, kept, digest): one row for each row of the Parquet files.

    Rows with equal normalised texts form a group, of which the row with the largest id stays; null ids are smallest. Of
    rows that agree in id and text one stays. A null text is empty. Other columns are ignored; no rows give no rows.

    With ``folder`` the groups are those of all rows that any call on this folder took in, and the rows given back are those
    of ``paths``; :func:`marks_so_far` gives those of all calls. Files that an earlier call took in, also one that failed
    halfway, count once. One call at a time may use a folder, and the columns and functions must be the same in all.
    """
    met = Met(spark, folder or scratch_path(spark, "met"), id_column, text_column, normalise, digest)
    return met.marks(met.take_in(paths)).drop("row", "place").withColumnRenamed("id", id_column)


def marks_so_far(
    spark: SparkSession,
    folder: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    normalise: Callable[[Column], Column] = lower_ascii,
) -> DataFrame:
    """The same columns for every row that calls on a folder have taken in: one row of each group is kept."""
    met = Met(spark, folder, id_column, text_column, normalise)
    return met.marks(met._read("keys").drop("call")).drop("row", "place").withColumnRenamed("id", id_column)


def mark_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    normalise: Callable[[Column], Column] = lower_ascii,
    digest: Callable[[Column], Column] = sha256,
    folder: str | None = None,
) -> DataFrame:
    """:func:`mark_files` for any frame: its ids and texts are written first, beside the state where that lasts.

    All rows of a frame are new ones, also where an earlier call was given the same.
    """
    spark = docs.sparkSession
    path = f"{folder}/content/{uuid.uuid4().hex}" if folder else scratch_path(spark, "content")
    docs.select(id_column, F.col(text_column).cast("string").alias(text_column)).write.parquet(path)
    return mark_files(spark, [path], id_column, text_column, normalise, digest, folder)


def own_path(docs: DataFrame) -> str | None:
    """The Parquet file or folder that ``docs`` is, unchanged; none if it is anything else."""
    files = {unquote(f) for f in docs.inputFiles()}
    for roots in (files, {f.rpartition("/")[0] for f in files}):
        if len(roots) == 1:
            path = next(iter(roots))
            # A table may have been read by its path alone; frames read by two spellings of a path are not the same.
            for spelling in (path, re.sub("^[a-z0-9]+://[^/]*", "", path)):
                try:
                    read = docs.sparkSession.read.schema(docs.schema).parquet(spelling)
                except AnalysisException:  # no such path on the default file system
                    continue
                if docs.sameSemantics(read):
                    return spelling
    return None


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`mark_duplicates` keeps, with all their columns; of rows that agree in id and text
    one stays, whatever its other columns. A frame that is no Parquet table as it stands is written first."""
    spark = docs.sparkSession
    path = own_path(docs)
    if path is None:
        path = scratch_path(spark, "content")
        docs.write.parquet(path)
    met = Met(spark, scratch_path(spark, "met"), id_column, text_column)
    kept = met.marks(met.take_in([path])).where("kept")
    row, place = unused("_row", docs.columns), unused("_place", docs.columns)
    table = spark.read.schema(docs.schema).parquet(path)
    rows = table.select("*", *locator(table, row, place))
    return rows.join(kept.select(F.col("row").alias(row), F.col("place").alias(place)), [place, row], "left_semi").drop(row, place)
