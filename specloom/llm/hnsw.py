"""Approximate nearest neighbours by cosine: one navigable small-world graph per shard, results of all shards merged.

Equal vectors are one entry, so copies neither crowd a graph nor a result. Entries are dealt out to shards of bounded size
by a hash of the vector; each shard builds its graph in one task and is stored as one row of flat arrays. Queries travel
in blocks to every shard: a task opens the shard's graph once and the blocks go past it one by one, all queries of a block
a step at a time. Where blocks are many, a shard is sent to several tasks.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from specloom.session import ship_package, stage

#: Entries of a shard, about; of larger tables there are ``SHARDS`` larger ones, until a shard's vectors take up SHARD_BYTES.
SHARD_ENTRIES = 4096
SHARDS = 64
SHARD_BYTES = 64 << 20
#: Queries that go through a graph together, and how many such blocks one task takes.
QUERY_BLOCK = 512
TASK_BLOCKS = 64
#: Links of an entry above the ground level; twice as many on it.
LINKS = 16
#: Entries kept in view while building and while searching.
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
#: Entries inserted at a time, at most half as many as the graph holds.
INSERT_BATCH = 256
EXPAND = 4
SALTS = 64
#: Tasks of a stage at most; beyond that, a task takes several shards, one after the other.
MOST_TASKS = 20_000

INDEX = "dim int, shard int, n int, vectors binary, members array<array<bigint>>, nodes binary, links binary, levels array<int>"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec, dim) of rows with an id and a vector that is not null, empty or zero, of finite components."""
    vec = F.col(vector_column).cast("array<double>")
    finite: Column = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_column).cast("long").alias("id"), vec.alias("vec"))
        .where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
        .where(F.exists("vec", lambda x: x != 0))
        .withColumn("dim", F.size("vec"))
    )


class Graph:
    """Unit vectors with links on levels; level 0 holds all entries, ``nodes[l]`` those of level l."""

    def __init__(self, unit: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.unit, self.nodes, self.links = unit, nodes, links

    def _beam(self, level: int, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest found of each query, nearest first (-1: none), from the entries ``start`` on.

        Each step opens the nearest entries in view not opened yet, until none is left.
        """
        count, links = len(queries), self.links[level]
        seen = np.zeros((count, len(self.unit)), bool)
        rows = np.arange(count)
        near = np.full((count, width), -2.0, np.float32)
        view = np.full((count, width), -1, np.int64)
        view[:, 0] = start
        near[:, 0] = np.einsum("ij,ij->i", self.unit[start], queries)
        opened = view < 0
        seen[rows, start] = True
        active = rows
        while len(active):
            score = np.where(opened[active], -3.0, near[active])
            pick = np.argpartition(-score, min(EXPAND, width - 1), axis=1)[:, :EXPAND] if width > EXPAND else np.argsort(-score, axis=1)[:, :EXPAND]
            valid = np.take_along_axis(score, pick, 1) > -3.0
            go = valid.any(1)
            active, pick, valid = active[go], pick[go], valid[go]
            if not len(active):
                break
            opened[active[:, None], pick] = True
            heads = np.where(valid, view[active[:, None], pick], 0)
            found = np.where(valid[:, :, None], links[heads], -1).reshape(len(active), -1)
            fresh = found >= 0
            target = np.where(fresh, found, 0)
            fresh &= ~seen[active[:, None], target]
            # An entry reached twice in one step counts once.
            order = np.argsort(np.where(fresh, target, -1), axis=1, kind="stable")
            target, fresh = np.take_along_axis(target, order, 1), np.take_along_axis(fresh, order, 1)
            fresh[:, 1:] &= ~(fresh[:, :-1] & (target[:, 1:] == target[:, :-1]))
            r, c = np.nonzero(fresh)
            seen[active[r], target[r, c]] = True
            dots = np.full(target.shape, -2.0, np.float32)
            dots[r, c] = np.einsum("ij,ij->i", self.unit[target[r, c]], queries[active[r]])
            all_near = np.concatenate([near[active], dots], axis=1)
            all_view = np.concatenate([view[active], np.where(fresh, target, -1)], axis=1)
            all_open = np.concatenate([opened[active], ~fresh], axis=1)
            best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            near[active] = np.take_along_axis(all_near, best, 1)
            view[active] = np.take_along_axis(all_view, best, 1)
            opened[active] = np.take_along_axis(all_open, best, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(view, order, 1), np.take_along_axis(near, order, 1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines near each unit query, nearest first: down the levels, then widely on the ground."""
        entry = np.full(len(queries), self.nodes[-1][0])
        for level in range(len(self.nodes) - 1, 0, -1):
            entry = self._beam(level, queries, entry, 1 + EXPAND)[0][:, 0]
        return self._beam(0, queries, entry, width)


def _choose(unit: np.ndarray, around: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none) up to ``most`` that are nearer to the row than to each other.

    Places left over go to the nearest of the rest.
    """
    count, width = around.shape
    vectors = unit[np.maximum(around, 0)]
    between = np.einsum("rid,rjd->rij", vectors, vectors)
    taken = np.zeros((count, width), bool)
    number = np.zeros(count, np.int64)
    for j in range(width):
        closer = (taken & (between[:, j, :] > near[:, j, None])).any(1)
        ok = (around[:, j] >= 0) & ~closer & (number < most)
        taken[:, j] = ok
        number += ok
    rank = np.where(taken, 0, width) + np.arange(width) + np.where(around < 0, 2 * width, 0)
    order = np.argsort(rank, axis=1)[:, :most]
    return np.take_along_axis(around, order, 1)


def _connect(unit: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Link new entries with those chosen, both ways; an entry with too many links keeps the best spread ones."""
    most = links.shape[1]
    links[new, : chosen.shape[1]] = chosen
    back, to = np.repeat(new, chosen.shape[1]), chosen.ravel()
    back, to = back[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    back, to = back[order], to[order]
    heads, first, count = np.unique(to, return_index=True, return_counts=True)
    for lo in range(0, len(heads), 128):
        part = slice(lo, lo + 128)
        extra = np.full((len(heads[part]), int(count[part].max())), -1)
        for i, (a, n) in enumerate(zip(first[part].tolist(), count[part].tolist())):
            extra[i, :n] = back[a : a + n]
        around = np.concatenate([links[heads[part]], extra], axis=1)
        near = np.einsum("rid,rd->ri", unit[np.maximum(around, 0)], unit[heads[part]])
        order = np.argsort(np.where(around < 0, 9.0, -near), axis=1, kind="stable")[:, : 3 * most]
        around, near = np.take_along_axis(around, order, 1), np.take_along_axis(near, order, 1)
        links[heads[part]] = _choose(unit, around, near, most)


def build(unit: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> Graph:
    """The graph of some unit vectors; how high an entry stands follows from its place alone."""
    n = len(unit)
    draw = np.random.RandomState(n).random_sample(n)
    height = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(np.int64), 12)
    # The highest entry comes first, so each level always has an entrance.
    order = np.arange(n)
    top = int(np.argmax(height))
    order[0], order[top] = top, 0
    graph = Graph(
        unit,
        [np.array([top])] * (height[top] + 1),
        [np.full((n, links * (2 if level == 0 else 1)), -1, np.int64) for level in range(height[top] + 1)],
    )
    at = 1
    while at < n:
        new = order[at : at + min(INSERT_BATCH, max(1, at // 2))]
        entry = np.full(len(new), top)
        for level in range(len(graph.links) - 1, -1, -1):
            here = height[new] >= level
            view, near = graph._beam(level, unit[new], entry, width if here.any() else 1 + EXPAND)
            entry = view[:, 0]
            if here.any():
                mine = new[here]
                # Entries of the same batch are candidates too, those inserted before only.
                own = unit[mine] @ unit[mine].T
                own[np.triu_indices(len(mine))] = -2.0
                around = np.concatenate([view[here], np.broadcast_to(mine, own.shape)], axis=1)
                close = np.concatenate([near[here], own.astype(np.float32)], axis=1)
                around = np.where(close > -2.0, around, -1)
                best = np.argsort(-close, axis=1, kind="stable")[:, :width]
                around, close = np.take_along_axis(around, best, 1), np.take_along_axis(close, best, 1)
                _connect(unit, graph.links[level], mine, _choose(unit, around, close, links))
        at += len(new)
    graph.nodes = [np.concatenate([[top], np.flatnonzero((height >= level) & (np.arange(n) != top))]) for level in range(len(graph.links))]
    return graph


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that its squares stay in range; no cosine changes by that."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = _scaled(vectors)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _total(sizes: DataFrame, column: str) -> int:
    return sizes.agg(F.sum(F.expr(column))).first()[0] or 0


def _dealt(rows: DataFrame, number: Column, tasks: int) -> DataFrame:
    """Rows dealt out to tasks by a number that starts at 0 for each length of vectors; equal numbers stay together."""
    tasks = min(max(tasks, 1), MOST_TASKS)
    start = F.pmod(F.xxhash64("dim"), F.lit(tasks))
    return rows.repartitionById(tasks, F.pmod(start + number, F.lit(tasks)).cast("int"))


def build_index(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", neighbours: int = 5,
    shard_entries: int = SHARD_ENTRIES,
) -> DataFrame:
    """The stored index of ``vectors``, a row per shard: see ``INDEX``.

    ``members`` are the smallest ids of each entry's vector, one more than ``neighbours``: no result needs others. Vectors
    of unlike lengths lie in unlike shards. Rows that are not usable, or repeat id and vector, add nothing.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, id_column, vector_column).distinct()
    # A vector that very many rows share is thinned out in parts before its parts meet.
    for by in (["vec", F.pmod(F.xxhash64("id"), F.lit(SALTS))], ["vec"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
        rows = rows.withColumn("place", place).where(F.col("place") <= neighbours + 1).drop("place")
    entries = stage(rows.groupBy("vec", "dim").agg(F.sort_array(F.collect_list("id")).alias("members")), "entries")
    held = F.least(F.greatest(F.lit(shard_entries), F.count("*") / F.lit(SHARDS)), F.lit(SHARD_BYTES) / (8 * F.col("dim")))
    sizes = entries.groupBy("dim").agg(F.ceil(F.count("*") / F.greatest(held, F.lit(1))).cast("int").alias("shards"))
    placed = entries.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int"))

    def shard(table: pa.Table) -> pa.RecordBatch:
        dim = table.column("dim")[0].as_py()
        raw = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        graph = build(_unit(raw))
        row = {
            "dim": dim, "shard": table.column("shard")[0].as_py(), "n": len(raw), "vectors": raw.astype("<f8").tobytes(),
            "members": table.column("members").to_pylist(),
            "nodes": np.concatenate(graph.nodes).astype("<i4").tobytes(),
            "links": np.concatenate([l[k].ravel() for l, k in zip(graph.links, graph.nodes)]).astype("<i4").tobytes(),
            "levels": [len(k) for k in graph.nodes],
        }
        schema = pa.schema(
            [
                ("dim", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("vectors", pa.binary()),
                ("members", pa.list_(pa.list_(pa.int64()))), ("nodes", pa.binary()), ("links", pa.binary()),
                ("levels", pa.list_(pa.int32())),
            ]
        )
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def shards(batches):
        """Rows come sorted by shard."""
        own, parts = None, []
        for batch in batches:
            dims, numbers = batch.column("dim").to_numpy(), batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(numbers) != 0)) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if parts and own != (dims[a], numbers[a]):
                    yield shard(pa.Table.from_batches(parts))
                    parts = []
                own = (dims[a], numbers[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield shard(pa.Table.from_batches(parts))

    # Building a graph takes long for its bytes, so each shard has a task of its own.
    placed = _dealt(placed, F.col("shard"), _total(sizes, "shards")).sortWithinPartitions("dim", "shard", F.col("members")[0])
    return placed.select("dim", "shard", "vec", "members").mapInArrow(shards, INDEX)


def stored_graph(vectors: np.ndarray, nodes: np.ndarray, links: np.ndarray, levels: list[int], most: int = LINKS) -> Graph:
    """The graph of a stored row."""
    held, arrays, a, b = [], [], 0, 0
    for level, count in enumerate(levels):
        own = nodes[a : a + count].astype(np.int64)
        width = most * (2 if level == 0 else 1)
        table = np.full((len(vectors), width), -1, np.int64)
        table[own] = links[b : b + count * width].reshape(count, width)
        held.append(own)
        arrays.append(table)
        a, b = a + count, b + count * width
    return Graph(_unit(vectors), held, arrays)


def search(
    index: DataFrame, queries: DataFrame, neighbours: int = 5, width: int = SEARCH_WIDTH, id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest entries found for each usable query, its own id left out.

    The score is the cosine in double precision; equal ones go by the smaller id. Queries meet entries of their length
    only; ids that come with several vectors are several queries under one id, whose results are merged.
    """
    spark = queries.sparkSession
    ship_package(spark)
    index = stage(index, "index")
    sizes = index.groupBy("dim").agg(F.count("*").cast("int").alias("shards"))
    asked = usable(queries, id_column, vector_column).distinct()
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("blocks"))
    asked = asked.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.col("blocks")).cast("int"))
    found_schema = "query_id long, vec_id long, score double"

    def pack(table: pa.Table) -> pa.Table:
        raw = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table(
            {
                "dim": table.column("dim").slice(0, 1), "block": table.column("block").slice(0, 1),
                "queries": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())),
                "asked": pa.array([raw.astype("<f8").tobytes()], pa.binary()),
            }
        )

    packed = asked.select("dim", "block", "id", "vec").groupBy("dim", "block").applyInArrow(
        pack, "dim int, block int, queries array<bigint>, asked binary"
    )
    # Each shard meets all blocks of its length, up to TASK_BLOCKS of them in one task.
    plan = stage(
        sizes.join(blocks, "dim").withColumn("parts", F.ceil(F.col("blocks") / F.lit(TASK_BLOCKS)).cast("int")), "plan"
    )
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    sent = packed.join(plan, "dim").select("dim", every, F.floor(F.col("block") / F.lit(TASK_BLOCKS)).cast("int").alias("part"), "parts", "block", "queries", "asked")
    opened = index.join(plan, "dim").select(
        "dim", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", F.lit(-1).alias("block"),
        "n", "vectors", "members", "nodes", "links", "levels",
    )
    tasks = _total(plan, "shards * parts")
    met = _dealt(opened.unionByName(sent, allowMissingColumns=True), F.col("shard") * F.col("parts") + F.col("part"), tasks)
    # The shard itself comes first, its blocks behind it.
    met = met.sortWithinPartitions("dim", "shard", "part", "block").select(
        "n", "vectors", "members", "nodes", "links", "levels", "queries", "asked"
    )

    def look(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["vectors"] is not None:
                    vectors = _scaled(np.frombuffer(row["vectors"], "<f8").reshape(row["n"], -1))
                    graph = stored_graph(
                        vectors, np.frombuffer(row["nodes"], "<i4"), np.frombuffer(row["links"], "<i4"), row["levels"]
                    )
                    norm, members = np.linalg.norm(vectors, axis=1), row["members"]
                    firsts = np.array([m[0] for m in members])
                    continue
                asked = _scaled(np.frombuffer(row["asked"], "<f8").reshape(-1, vectors.shape[1]))
                view, _ = graph.search(_unit(asked), max(width, neighbours + 1))
                own = np.linalg.norm(asked, axis=1)
                ids, hits, scores = [], [], []
                for q, query in enumerate(row["queries"]):
                    near = view[q][view[q] >= 0]
                    cosine = (vectors[near] @ asked[q]) / (norm[near] * own[q])
                    for p in np.lexsort((firsts[near], -cosine))[: neighbours + 1].tolist():
                        for member in members[near[p]]:
                            if member != query:
                                ids.append(query)
                                hits.append(member)
                                scores.append(float(cosine[p]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(hits, pa.int64()), pa.array(scores, pa.float64())],
                    ["query_id", "vec_id", "score"],
                )

    # A row holds a whole shard: few of them travel at once.
    with _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
        found = stage(met.mapInArrow(look, found_schema), "found")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
