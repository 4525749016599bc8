"""Scans of an hourly log archive and of a local folder of compressed logs.

Compressed files are read by Spark, so that an I/O error fails the task and is retried, and unpacked piece by piece in the
task, whatever their size. A damaged file gives its readable lines and one row that says so; nothing is left out in silence.
"""

import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime
from itertools import chain, groupby
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamReader

from specloom.session import configure, ship_package

SERVICE = "proxy"
#: ``position`` is a line's place in its file; a row with ``damage`` stands for a file and has no line.
LINES = "file STRING, value STRING, position BIGINT, damage STRING"
#: Compressed files without the ending ``.gz`` come as one row below this size, else as rows that are put in order.
WHOLE_FILE_BYTES = 1 << 30
#: Compressed files up to this size are not worth moving their lines.
LARGE_FILE_BYTES = 32 << 20
#: Compressed bytes whose lines one task parses, where lines are moved.
TASK_BYTES = 8 << 20
_GZIP_MAGIC = b"\x1f\x8b"
_PIECE = 1 << 20


def hour_paths(df: DataFrame, start: Column, end: Column, service: str = SERVICE) -> DataFrame:
    """Column ``folder``: one hour folder per step of an hour from start while not after end."""
    hours = F.when(start <= end, F.sequence(start, end, F.expr("INTERVAL 1 HOUR")))
    return df.select(F.explode(hours).alias("_hour")).select(
        F.concat(
            F.lit(f"logs/{service}/"), F.date_format("_hour", "yyyy-MM-dd/HH"), F.lit("/")
        ).alias("folder")
    )


def existing_folders(spark: SparkSession, root: str, folders: list[str]) -> list[str]:
    """Those of the folders that exist under ``root``, as full paths. Lists each parent once."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    children: dict[str, set[str]] = {}
    found = []
    for folder in folders:
        parent, name = f"{root.rstrip('/')}/{folder.rstrip('/')}".rsplit("/", 1)
        if parent not in children:
            path = hadoop.Path(parent)
            fs = path.getFileSystem(conf)
            listed = fs.listStatus(path) if fs.exists(path) else []
            children[parent] = {s.getPath().getName() for s in listed}
        if name in children[parent]:
            found.append(f"{parent}/{name}")
    return found


def unpacked(files: DataFrame, skip_foreign: bool = False) -> DataFrame:
    """Lines of files (path, content), in order; ``skip_foreign`` passes over content that does not begin like gzip."""
    return _lines(files.select("path", "content"), _whole_files, skip_foreign)


def _lines(rows: DataFrame, files_of, skip_foreign: bool = False) -> DataFrame:
    spark = configure(rows.sparkSession)
    ship_package(spark)
    lines = rows.mapInArrow(_unpack(files_of, skip_foreign), "file STRING, value BINARY, position BIGINT, damage STRING")
    return lines.withColumn("value", F.col("value").cast("string"))


def gz_lines(spark: SparkSession, reader: DataFrameReader | DataStreamReader, paths: str | list[str]) -> DataFrame:
    """Lines (see ``LINES``) of the ``*.gz`` files that a reader, of a stream or not, finds.

    Hadoop's pass-through codec takes the place of the one for ``.gz``. So the text reader streams a file's own bytes, cut
    at newlines, in one task, and no file has to fit in a row.
    """
    hadoop = spark._jvm.org.apache.hadoop
    codec = hadoop.io.compress.PassthroughCodec
    # Shaded builds of Hadoop name the option otherwise.
    options = {"io.compression.codecs": codec.CLASSNAME, codec.OPT_EXTENSION: ".gz"}
    conf = hadoop.conf.Configuration(spark.sparkContext._jsc.hadoopConfiguration())
    for key, value in options.items():
        conf.set(key, value)
    used = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(hadoop.fs.Path("x.gz")).getClass().getName()
    if used != codec.CLASSNAME:
        raise RuntimeError(f"files named *.gz would be unpacked by {used}")
    rows = reader.options(**options).option("pathGlobFilter", "*.gz").option("lineSep", "\n").format("text").load(paths)
    return _lines(_raw(rows, "_metadata.file_path", "_metadata.file_size"), _raw_files)


def _raw(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.col("value").cast("binary").alias("content"))


def read_lines(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """Lines (see ``LINES``) of the ``*.gz`` files below the paths; a line ends at a newline only.

    A gzip file cannot be split, so it is one task; ``spread`` the lines if files are few.
    """
    if not paths:
        return spark.createDataFrame([], LINES)
    return gz_lines(spark, spark.read.option("recursiveFileLookup", str(recursive).lower()), paths)


def read_archive(
    spark: SparkSession, root: str, start: datetime, end: datetime, service: str = SERVICE
) -> DataFrame:
    """Lines of the hour folders from start to end. No folder or no file gives no lines.

    The folder list is as long as the time range has hours; only it passes the driver.
    """
    return read_lines(spark, archive_folders(spark, root, start, end, service))


def archive_folders(
    spark: SparkSession, root: str, start: datetime, end: datetime, service: str = SERVICE
) -> list[str]:
    """The hour folders from start to end that exist."""
    hours = hour_paths(spark.range(1), F.lit(start), F.lit(end), service)
    return existing_folders(spark, root, [r.folder for r in hours.toLocalIterator()])


def spread(lines: DataFrame, partitions: int | None) -> DataFrame:
    """Distribute lines of few large files over tasks before the costly parsing."""
    return lines if partitions is None else lines.repartition(partitions)


def parsing_tasks(spark: SparkSession, paths: list[str]) -> int | None:
    """Tasks to spread the lines of the ``*.gz`` files below the paths over; none where files make tasks of like size.

    Only sizes are read. Lines are worth moving where a file of some size holds more than a core's even share of all bytes:
    its task would be parsing long after the others.
    """
    if not paths:
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(paths)
    size = files.select("length").agg(F.max("length").alias("largest"), F.sum("length").alias("whole")).first()
    share = (size.whole or 0) / max(1, spark.sparkContext.defaultParallelism)
    if (size.largest or 0) <= max(LARGE_FILE_BYTES, share):
        return None
    return max(spark.sparkContext.defaultParallelism, -(-size.whole // TASK_BYTES))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the gzip files lying directly in a folder, recognised by content, not by name.

    Files of another name that do not begin like gzip are skipped.
    """
    named = F.col("path").endswith(".gz")
    other = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).where(~named)
    found = unpacked(other.where(F.col("length") < WHOLE_FILE_BYTES), skip_foreign=True)
    lines = read_lines(spark, [folder], recursive=False).unionByName(found)
    large = [r.path for r in other.where(F.col("length") >= WHOLE_FILE_BYTES).select("path").toLocalIterator()]
    large = [path for path in large if _begins_like_gzip(spark, path)]
    return lines.unionByName(_large_lines(spark, large)) if large else lines


def _begins_like_gzip(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return all(file.read() == byte for byte in _GZIP_MAGIC)
    finally:
        file.close()


def _large_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of gzip files of other names: Spark splits these, so their bytes are put in order again first."""
    ship_package(spark)
    globs = [re.sub(r"([\\*?\[\]{}])", r"\\\1", path) for path in paths]
    rows = spark.read.option("lineSep", "\n").text(globs)
    rows = _raw(rows, "_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start")
    runs = rows.mapInArrow(_join_rows, "file_path STRING, file_size BIGINT, file_block_start BIGINT, content BINARY")
    ordered = runs.withColumn("at", F.monotonically_increasing_id()).repartition(len(paths), "file_path")
    ordered = ordered.sortWithinPartitions("file_path", "file_block_start", "at")
    return _lines(ordered.select("file_path", "file_size", "content"), _raw_files)


def _join_rows(batches):
    """Rows (path, size, start of block, bytes), with the bytes of consecutive rows of one block joined by newlines."""
    import pyarrow as pa

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in (0, 2))))
        at = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        joined = [b"\n".join(batch.column(3)[a:b].to_pylist()) for a, b in zip(at, [*at[1:], len(keys)])]
        first = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*first.columns[:3], pa.array(joined, pa.binary())], batch.schema.names)


def _sliced(content: bytes) -> Iterator[bytes]:
    return (content[at : at + _PIECE] for at in range(0, len(content), _PIECE))


def _whole_files(batches) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(path, parts of its bytes) for each row (path, content)."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            yield path.as_py(), _sliced(content.as_py() or b"")


def _raw_files(batches) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(path, parts of its bytes) from rows (path, size, content) that are files cut at newlines, each in order."""
    import pyarrow.compute as pc

    def runs():
        for batch in batches:
            found, lo = pc.run_end_encode(batch.column(0)), 0
            for path, hi in zip(found.values.to_pylist(), found.run_ends.to_pylist()):
                yield path, batch.column(1)[lo].as_py(), b"\n".join(batch.column(2)[lo:hi].to_pylist())
                lo = hi

    def parts(rows):
        total, size, gzip = 0, 0, False
        for number, (path, size, content) in enumerate(rows):
            if number:
                content = b"\n" + content
            else:
                gzip = content.startswith(_GZIP_MAGIC)
            total += len(content)
            yield from _sliced(content)
        # Whether the last line had a newline, only the size tells.
        if total == size - 1:
            yield b"\n"
        elif gzip and total < size:
            raise OSError(f"{path}: {total} bytes of {size} were read")

    for path, rows in groupby(runs(), lambda run: run[0]):
        yield unquote(path), parts(rows)


def _pieces(parts: Iterable[bytes]):
    """Unpacked pieces of a gzip file of one or more members, given in parts; damage ends them with an error."""
    parts, data = iter(parts), b""
    while True:
        padding = False
        while not data.lstrip(b"\0"):
            padding = padding or bool(data)
            data = next(parts, None)
            if data is None:
                return
        if padding:
            data = b"\0" + data
        member = zlib.decompressobj(31)
        while not member.eof:
            if not data:
                data = next(parts, None)
                if data is None:
                    raise EOFError("it ends early")
                continue
            before = member.copy()
            try:
                piece = member.decompress(data, _PIECE)
            except zlib.error:
                yield from _up_to_damage(before, data)
                raise
            yield piece
            data = member.unconsumed_tail
        data = member.unused_data


def _up_to_damage(member, data: bytes):
    """What a member gives before its damage: unpacked in ever smaller steps, the last of one byte."""
    for step in (4096, 64, 1):
        while data:
            before = member.copy()
            try:
                yield member.decompress(data, step)
            except zlib.error:
                member = before
                break
            data = member.unconsumed_tail


def _unpack(files_of, skip_foreign: bool):
    def unpack(batches):
        import pyarrow as pa

        def rows(path, lines, first, damage=None):
            n = len(lines) + (damage is not None)
            values = [*lines, None][:n] if damage is not None else lines
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * n, pa.string()), pa.array(values, pa.binary()),
                    pa.array([*range(first, first + len(lines)), None][:n], pa.int64()),
                    pa.array([None] * len(lines) + [damage] * (n - len(lines)), pa.string()),
                ],
                ["file", "value", "position", "damage"],
            )

        for path, parts in files_of(batches):
            begin = next(parts, b"")
            if not begin or skip_foreign and not begin.startswith(_GZIP_MAGIC):
                continue
            # The start of a line that goes on in the next piece is kept in parts: lines may be very long.
            open_, position, damage = [], 0, None
            try:
                for piece in _pieces(chain([begin], parts)):
                    *lines, rest = piece.split(b"\n")
                    if lines:
                        lines[0] = b"".join([*open_, lines[0]])
                        open_ = []
                        yield rows(path, lines, position)
                        position += len(lines)
                    open_.append(rest)
            except (EOFError, zlib.error) as error:
                damage = f"file is damaged: {error}"
            last = b"".join(open_)
            if last or damage:
                yield rows(path, [last] if last else [], position, damage)

    return unpack
