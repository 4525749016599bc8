"""Token ids of a corpus in files, in order of the documents, and their reading.

A file holds the documents of one range of ids; its rows are segments of consecutive whole documents. Parquet is the
container, so files are committed as any Spark output; a segment's columns are

* ``shard``, ``segment``: the file and the place in it; ascending (shard, segment) is ascending document id,
* ``ids``, ``lengths``: the documents and their numbers of tokens, the end id included, and ``n_ids``, their sum,
* ``words``: Simple-8b words, little-endian 64-bit; ``first_word``: for each block of ``block_ids`` ids the word at which
  it starts, little-endian 32-bit; ``escapes``: values over 60 bits, little-endian 64-bit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from specloom.llm import simple8b
from specloom.llm.byte_bpe import encoder
from specloom.llm.names import unused
from specloom.session import ship_package

#: Ids after which a segment ends; a longer document makes a longer segment.
SEGMENT_IDS = 1 << 19
#: Bytes of text whose ids one file holds, where the number of files is not given; a task sorts as many.
FILE_BYTES = 16 << 20


def _segment_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("segment", T.IntegerType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("n_ids", T.LongType()),
            T.StructField("block_ids", T.IntegerType()),
            T.StructField("words", T.BinaryType()),
            T.StructField("first_word", T.BinaryType()),
            T.StructField("escapes", T.BinaryType()),
        ]
    )


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, files: int | None = None, id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode every text of ``docs``, append ``end_id`` to each, and write the ids in ascending order of the ids.

    One shuffle deals documents out by ranges of their id; each task encodes its range in order and writes one file. The
    number of files follows from the bytes of all texts, unless it is given. A null or empty text is the end id alone. Null
    ids come first; rows with equal ids follow each other by a hash of their texts, over as many ranges as they fill.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_column), F.col(text_column).cast("string").alias(unused("text", [id_column])))
    text = F.col(rows.columns[1])
    if files is None:
        files = max(1, -(-(rows.agg(F.sum(F.octet_length(text))).first()[0] or 0) // FILE_BYTES))
    tie = F.xxhash64(text)
    schema = _segment_schema(docs.schema[id_column].dataType)

    def segments(batches):
        bpe, shard, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        keys, lengths, parts, held = [], [], [], 0

        def flush():
            words, first, escapes = simple8b.encode(np.concatenate(parts))
            row = {
                "shard": shard, "segment": number, "ids": keys, "lengths": lengths, "n_ids": held,
                "block_ids": simple8b.BLOCK_IDS, "words": words.astype("<u8").tobytes(),
                "first_word": first.astype("<u4").tobytes(), "escapes": escapes.astype("<u8").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                kind = batch.schema.field(0).type
                arrow = pa.schema(
                    [
                        ("shard", pa.int32()), ("segment", pa.int32()), ("ids", pa.list_(kind)), ("lengths", pa.list_(pa.int64())),
                        ("n_ids", pa.int64()), ("block_ids", pa.int32()), ("words", pa.binary()), ("first_word", pa.binary()),
                        ("escapes", pa.binary()),
                    ]
                )
            names, at = batch.column(0).to_pylist(), 0
            for ids, edge in bpe.encode(batch.column(1)):
                # The end id goes in behind each text.
                parts.append(np.insert(ids, edge[1:], end_id))
                size = (np.diff(edge) + 1).tolist()
                keys += names[at : at + len(size)]
                lengths += size
                held += sum(size)
                at += len(size)
                if held >= SEGMENT_IDS:
                    yield flush()
                    number += 1
                    keys, lengths, parts, held = [], [], [], 0
        if keys:
            yield flush()

    (
        rows.repartitionByRange(files, id_column, tie)
        .sortWithinPartitions(id_column, tie)
        .mapInArrow(segments, schema)
        .write.parquet(path)
    )


def read_documents(spark: SparkSession, path: str, id_column: str = "doc_id", checksum: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids or ids_crc32) of each document in the files; start: ids of all documents before it.

    ``ids`` is a binary of little-endian 32-bit ids, or with ``checksum`` their CRC-32 takes its place. Only numbers of
    ids per segment are summed up across files.
    """
    ship_package(spark)
    stored = spark.read.parquet(path)
    kind = stored.schema["ids"].dataType.elementType
    value = T.StructField("ids_crc32", T.LongType()) if checksum else T.StructField("ids", T.BinaryType())
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField(id_column, kind),
            T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), value,
        ]
    )

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shard, segment, n, block = (row.column(k)[0].as_py() for k in (0, 1, 4, 5))
                words, first, escapes = (
                    np.frombuffer(row.column(k)[0].as_py(), t) for k, t in ((6, "<u8"), (7, "<u4"), (8, "<u8"))
                )
                ids = simple8b.decode(words, first.astype(np.int64), escapes, n, block).astype("<u4")
                size = np.array(row.column(3)[0].as_py(), np.int64)
                end = np.cumsum(size)
                parts = [ids[a:b].tobytes() for a, b in zip((end - size).tolist(), end.tolist())]
                count = len(size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * count, pa.int32()), pa.array([segment] * count, pa.int32()),
                        row.column(2).flatten(), pa.array(end - size), pa.array(size),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()) if checksum else pa.array(parts, pa.binary()),
                    ],
                    schema.fieldNames(),
                )

    found = stored.mapInArrow(documents, schema)
    inner = stored.select("shard", "segment", "n_ids").withColumn(
        "inner", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    )
    # One row per file goes through a single task.
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    totals = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    starts = inner.join(totals, "shard").select("shard", "segment", (F.col("base") + F.col("inner")).alias("base"))
    return found.join(starts, ["shard", "segment"]).select(
        id_column, (F.col("base") + F.col("before")).alias("start"), "n_tokens", value.name
    )
