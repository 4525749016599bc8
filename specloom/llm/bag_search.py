"""Ranked lexical search that scores each bag of item words once.

Of a document's terms only those of the item vocabulary count for scores. Documents with the same frequencies of these and
the same weight of length form a class: they are found by a hash and kept apart by the frequencies themselves. A class
holds the ids of its first documents, in ascending order and no more than a result can show; a class that holds a great
part of all documents leaves each task as so many rows. Classes are scored once for all items, in blocks of classes
times blocks of items; tasks keep the best classes of each item, whose documents are ranked in the end.

Scores are sums of whole numbers. Products of blocks are taken in doubles where all sums stay below 2**53, which keeps
them exact, else in 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from specloom.llm.plain_words import LETTERS_AND_DIGITS, texts_of, word_pieces
from specloom.session import ship_package, stage

TOP = 20
#: Item text and distinct items that one pass over the classes takes up; more items take more passes.
ITEM_BYTES, ITEM_ROWS = 1 << 20, 1 << 13
#: Classes and distinct item terms that are multiplied at once.
BLOCK_CLASSES, BLOCK_TERMS = 512, 1024
#: Fixed values of the score.
SCALE, SATURATION, LENGTH_PERCENT = 1_000_000_000, 12, 25


def _words(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return [w for piece in word_pieces(raw, LETTERS_AND_DIGITS) for w in piece]


def bags(docs: DataFrame, vocabulary: list[bytes], id_column: str, text_column: str) -> DataFrame:
    """(id, n, terms, tfs) of each row: its number of terms, and numbers and frequencies of those of the vocabulary."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType), T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType())),
        ]
    )
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        arrow, number = to_arrow_schema(schema), {word: i for i, word in enumerate(known.value)}
        width = max(1, len(number))
        for batch in batches:
            sizes, keys = [], [np.empty(0, np.int64)]
            for row, text in enumerate(texts_of(batch.column(1))):
                n = 0
                for words in word_pieces(text, LETTERS_AND_DIGITS):
                    found = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                    keys.append(found[found >= 0] + row * width)
                    n += len(words)
                sizes.append(n)
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            edges = pa.array(np.searchsorted(key, np.arange(len(sizes) + 1) * width), pa.int32())
            columns = [
                batch.column(0), pa.array(sizes, pa.int64()),
                *(pa.ListArray.from_arrays(edges, pa.array(c, pa.int32())) for c in (key % width, tf)),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(count, schema)


def bag_classes(counted: DataFrame, n_docs: int, n_terms: int, top: int = TOP) -> DataFrame:
    """(terms, tfs, m, members) of each class of :func:`bags` with a term: m and the first ids, nulls last."""
    m = F.expr(f"{100 - LENGTH_PERCENT}L + ({LENGTH_PERCENT}L * n * {n_docs}L) div {n_terms}L")
    bag = ["hash", "terms", "tfs", "m"]
    rows = counted.where(F.size("terms") > 0).select("id", "terms", "tfs", m.alias("m"))
    rows = rows.withColumn("hash", F.xxhash64("terms", "tfs", "m"))
    place = F.row_number().over(Window.partitionBy(*bag).orderBy(F.col("id").asc_nulls_last()))
    member = F.struct(F.col("id").isNull().alias("none"), "id")
    return (
        rows.withColumn("place", place)
        .where(F.col("place") <= top)
        .groupBy(*bag)
        .agg(F.sort_array(F.collect_list(member)).alias("members"))
        .select("terms", "tfs", "m", F.col("members.id").alias("members"))
    )


class ItemBlock:
    """Some items: their terms and, for each term and item, weight times occurrences."""

    def __init__(self, numbers: list[int], terms: list[dict[int, int]], weights: np.ndarray, width: int):
        self.numbers = np.array(numbers)
        self.column = np.full(width, -1, np.int64)
        distinct = sorted({t for found in terms for t in found})
        self.column[distinct] = np.arange(len(distinct))
        values = np.zeros((len(distinct), len(terms)), np.int64)
        for j, found in enumerate(terms):
            for term, times in found.items():
                values[self.column[term], j] = weights[term] * times
        # A term's part in a score is below a million times its weight.
        small = int(values.sum(0).max(initial=0)) < 2**53 // 1_000_000
        self.values = values.astype(np.float64) if small else values

    def scores(self, row: np.ndarray, term: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        column = self.column[term]
        mine = column >= 0
        dense = np.zeros((n, len(self.values)), self.values.dtype)
        dense[row[mine], column[mine]] = part[mine]
        return (dense @ self.values).astype(np.int64)


def item_blocks(terms: list[dict[int, int]], weights: np.ndarray) -> list[ItemBlock]:
    """Items in blocks that share about ``BLOCK_TERMS`` distinct terms, one item at least."""
    blocks, held, seen = [], [], set()
    for i, found in enumerate(terms):
        if held and len(seen | found.keys()) > BLOCK_TERMS:
            blocks.append(held)
            held, seen = [], set()
        held.append(i)
        seen |= found.keys()
    blocks += [held] if held else []
    return [ItemBlock(numbers, [terms[i] for i in numbers], weights, len(weights)) for numbers in blocks]


class Best:
    """The best classes of each item: by score, then by first id, nulls last."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.found: list[list[tuple]] = [[] for _ in range(n_items)]
        # The least score that may still be among the best.
        self.floor = np.ones(n_items, np.int64)

    def add(self, numbers: np.ndarray, scores: np.ndarray, members: list[list]) -> None:
        floor = self.floor[numbers]
        if len(scores) > self.top:
            floor = np.maximum(floor, np.partition(scores, -self.top, axis=0)[-self.top])
        rows, items = np.nonzero(scores >= floor)
        for row, item, score in zip(rows.tolist(), numbers[items].tolist(), scores[rows, items].tolist()):
            first = members[row][0]
            self.found[item].append((-score, first is None, 0 if first is None else first, members[row]))
            if len(self.found[item]) >= 8 * self.top:
                self.cut(item)
        for item in set(numbers[items].tolist()):
            self.cut(item)

    def cut(self, item: int) -> None:
        self.found[item] = sorted(self.found[item], key=lambda f: f[:3])[: self.top]
        if len(self.found[item]) == self.top:
            self.floor[item] = max(1, -self.found[item][-1][0])


def score_classes(
    classes: DataFrame, items: list[tuple], terms: list[dict[int, int]], weights: np.ndarray, item_type: T.DataType, top: int
) -> DataFrame:
    """(number, item_id, copies, score, members): from each task, the best classes of every item (id, copies)."""
    schema = T.StructType(
        [
            T.StructField("number", T.IntegerType()), T.StructField("item_id", item_type),
            T.StructField("copies", T.IntegerType()), T.StructField("score", T.LongType()), classes.schema["members"],
        ]
    )
    held = classes.sparkSession.sparkContext.broadcast((items, terms, weights))

    def score(batches):
        known, found, weights = held.value
        blocks, best = item_blocks(found, weights), Best(len(known), top)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_CLASSES):
                batch = whole.slice(at, BLOCK_CLASSES)
                n, lists = batch.num_rows, batch.column("terms")
                row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
                term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                part = SCALE * tf // (1000 * tf + SATURATION * batch.column("m").to_numpy()[row])
                members = batch.column("members").to_pylist()
                for block in blocks:
                    best.add(block.numbers, block.scores(row, term, part, n), members)
        rows = [(i, *known[i], -f[0], f[3]) for i, kept in enumerate(best.found) for f in kept]
        arrow = to_arrow_schema(schema)
        columns = zip(*rows) if rows else [[]] * len(arrow)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return classes.mapInArrow(score, schema)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """(item id, rank, id, score): the ``top`` rows of ``docs`` that score highest above 0 for each row of ``items``.

    Terms are runs of ASCII letters, lower-cased, digits and characters beyond ASCII. With N documents that have a term,
    L terms in all, n in a document, df documents with a term and tf times of it in one, a document's m is
    75 + (25 * n * N) div L, and its score the sum over the item's terms, with repeats, of
    floor(1000 * ln((2N + 2) / (2df + 1))) * (10**9 * tf div (1000 * tf + 12 * m)).

    Equal scores rank by ascending id, null ids last. Rows without a term (null or empty texts among them) count for
    nothing and are never found; repeated rows are documents each, and repeated items are ranked each for itself. Other
    columns are ignored, empty tables give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    item_type, id_type = items.schema[item_id_column].dataType, docs.schema[id_column].dataType
    if not isinstance(id_type, T.AtomicType):
        raise ValueError("ids must be of a type that has an order")
    text = F.col(item_text_column).cast("string")
    known = items.select(F.col(item_id_column).alias("id"), text.alias("text")).where(F.length("text") > 0)
    # Repeated items are ranked once, however many there are; their copies are put back into the result.
    known = known.groupBy("id", "text").agg(F.count("*").cast("int").alias("copies"))
    size = known.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    parts = max((size.bytes or 0) // ITEM_BYTES, size.rows // ITEM_ROWS) + 1
    ranked = []
    for part in range(parts):
        mine = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect()
        found = [((r.id, r.copies), Counter(_words(r.text))) for r in mine]
        ranked.append(_ranked(spark, docs, [f for f in found if f[1]], top, id_column, text_column, item_type))
    whole = reduce(DataFrame.unionByName, ranked)
    return whole.select(F.col("item_id").alias(item_id_column), "rank", F.col("id").alias(id_column), "score")


def _ranked(
    spark: SparkSession, docs: DataFrame, items: list[tuple], top: int, id_column: str, text_column: str, item_type: T.DataType
) -> DataFrame:
    vocabulary = sorted({word for _, words in items for word in words})
    number = {word: i for i, word in enumerate(vocabulary)}
    counted = stage(bags(docs, vocabulary, id_column, text_column), "bags")
    sums = counted.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not items or not sums.docs:
        id_type = docs.schema[id_column].dataType
        nothing = [("item_id", item_type), ("rank", T.IntegerType()), ("id", id_type), ("score", T.LongType())]
        return spark.createDataFrame([], T.StructType([T.StructField(*f) for f in nothing]))
    # One row per term of the item vocabulary.
    df = np.zeros(len(vocabulary), np.int64)
    for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[row.term] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * sums.docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    terms = [{number[word]: times for word, times in words.items()} for _, words in items]
    classes = bag_classes(counted, sums.docs, sums.terms, top)
    scored = score_classes(classes, [item for item, _ in items], terms, weights, item_type, top)
    best = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return (
        scored.select("number", "item_id", "copies", "score", F.explode("members").alias("id"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select("item_id", "rank", "id", "score", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        .drop("col")
    )
