"""Session settings the engine relies on, and staging of intermediate results."""

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# Bytes of rows that go to a Python worker at once, where the session has Spark's default; one row may be larger.
_DEFAULT_BATCH_BYTES, BATCH_BYTES = ("67108864", "67108864b"), 16 << 20

_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options that decide results (not performance) on a session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A repeated JSON key keeps its last value, as does a repeated member of an array's objects.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the configured one, or the context's checkpoint folder.

    A local session without either is given a temporary folder, as its one process needs to share nothing.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="specloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/specloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application has staged; results that read it must be done."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and continue from the written table.

    Cuts the lineage, survives lost executors and lets several outputs share one
    expensive pass.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, past which a filter is not pushed down.

    A filter on a derived column is otherwise moved below all projections with their
    expressions inlined, so that long chains are evaluated many times over.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever it lies on the driver, and bound what they are handed at once."""
    if spark.conf.get(_BATCH_BYTES) in _DEFAULT_BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="specloom-"), "specloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
