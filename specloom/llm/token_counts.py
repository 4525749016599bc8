"""Token counts of whole texts, without keeping the ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from specloom.llm.byte_bpe import encoder
from specloom.llm.words import text_buffers
from specloom.session import ship_package


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row of ``docs``.

    Arrow batches are worked on in slabs of like size in bytes, however many rows they hold; a text beyond a slab is cut
    where no word goes over the cut, so counts of the parts add up. Only lengths leave the task. A null or empty text has
    0 bytes and 0 tokens; repeated rows are counted each for itself, null ids are kept, other columns are ignored.
    """
    ship_package(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def count(batches):
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            _, bounds = text_buffers(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bounds[1:] - bounds[:-1]), pa.array(bpe.count(texts))], schema.fieldNames()
            )

    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(count, schema)
