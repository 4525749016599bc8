"""Exact Jaccard join on word shingles: a prefix join of groups, and components of the links found.

Shingles stand in one global order, those of frequent words last. Two sets as similar as asked for share a shingle among the first
few of each (the prefix), and differ little in size. Sets with the same prefix and size form one group, and only groups
meet. Where groups share a prefix shingle, those of like size gather around the first of them, their leader; any pair
that could link meets at a leader, and no list of pairs is made. A leader's groups are then expanded to their sets.
Counts of a set's shingles by parts of the hash range bound what two sets can share; sets without a partner that the
bound allows drop out, and the others are compared exactly. Large gatherings are cut into blocks, and every two blocks
meet in a task of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from specloom.llm.words import text_buffers
from specloom.llm.components import component_roots
from specloom.llm.shingles import Weights, shingle_sets, word_counts
from specloom.session import ship_package, stage

#: Words of known frequency, the most frequent ones; this concerns the order of shingles alone, not what is compared.
KNOWN_WORDS = 1 << 18
#: Bits kept of a shingle in the index and of a group's name. Shorter numbers are fewer bytes to shuffle; where unlike
#: things get one number, sets are compared that need not be.
TOKEN_BITS, GROUP_BITS = 48, 40
#: Parts of the hash range whose shingles are counted, a byte each.
COUNT_PARTS_BITS = 9
#: Sets of a gathering that one block holds.
BLOCK_SETS = 1024


def needed_overlap(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def prefix_length(size: int, percent: int) -> int:
    """Two sets that link share one of so many first shingles of each."""
    return size - needed_overlap(size, percent) + 1


def _frequent_words(texts: DataFrame) -> Weights:
    """The most frequent words, by counts over all texts; words met once in an Arrow batch are not counted there."""

    def count(batches):
        for batch in batches:
            word, n = word_counts(*text_buffers(batch.column(0)))
            often = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(n[often])], ["word", "n"])

    counted = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).toArrow()
    return Weights(top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy())


def _features(docs: DataFrame, id_column: str, text_column: str, words: int, percent: int) -> DataFrame:
    """(row, id, text_hash, n, set_key, gid, prefix, counts) of each row of ``docs``; gid names its group.

    Within an Arrow batch only the first row of a group has its prefix.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    shared = spark.sparkContext.broadcast(_frequent_words(rows.select("text")))
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType), T.StructField("text_hash", T.LongType()),
            T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()),
            T.StructField("gid", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())),
            T.StructField("counts", T.BinaryType()),
        ]
    )

    def features(batches):
        for batch in batches:
            sizes, keys, groups, prefixes, counts, seen = [], [], [], [], [], set()
            for one, weight in shingle_sets(*text_buffers(batch.column(2)), words, shared.value):
                first = one[:0]
                if len(one):
                    length = prefix_length(len(one), percent)
                    # By weight, then by hash.
                    first = one[np.argsort(weight, kind="stable")[:length]]
                sizes.append(len(one))
                counts.append(_part_counts(one))
                keys.append(hashlib.blake2b(one.tobytes(), digest_size=16).digest())
                group = first.tobytes() + len(one).to_bytes(8, "little")
                whole = hashlib.blake2b(group, digest_size=8).digest()
                gid = int.from_bytes(whole, "little") >> 64 - GROUP_BITS
                groups.append(gid)
                prefixes.append((first >> np.uint64(64 - TOKEN_BITS)).view(np.int64) if group not in seen else [])
                seen.add(group)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                    pa.array(groups, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(counts, pa.binary()),
                ],
                schema.fieldNames(),
            )

    return stage(rows.mapInArrow(features, schema).withColumn("row", F.monotonically_increasing_id()), "features")


def _part_counts(one: np.ndarray) -> bytes | None:
    """Numbers of a set's shingles by part of the hash range; null if one does not fit in a byte."""
    counts = np.bincount((one >> np.uint64(64 - COUNT_PARTS_BITS)).astype(np.int64), minlength=1 << COUNT_PARTS_BITS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def partners(counts: np.ndarray, known: np.ndarray, size: np.ndarray, block: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have a partner, in another block if there are two, that their counts allow a link with.

    Two sets share at most the lesser count of each part. Sets without counts are partners of all.
    """
    any_ = np.zeros(len(size), bool)
    cross = len(np.unique(block)) > 1
    for i in range(1, len(size)):
        shared = np.minimum(counts[:i], counts[i]).sum(1, dtype=np.int64)
        shared = np.where(known[:i] & known[i], shared, np.minimum(size[:i], size[i]))
        ok = 100 * shared >= percent * (size[:i] + size[i] - shared)
        if cross:
            ok &= block[:i] != block[i]
        any_[:i] |= ok
        any_[i] |= ok.any()
    return any_


def _leaders(percent: int):
    """Over rows (token, gid, n) in that order: (leader, gid) pairs. Repeated rows count once.

    A group whose size links with that of an earlier leader belongs to it, else it leads itself. It also goes to leaders
    whose own groups it could link with, two steps of size away. So of two groups that could link, the later one goes to
    the leader of the earlier one. A token has as many leaders as sizes need, however many groups it has.
    """

    def near(a: int, b: int) -> bool:
        return 100 * min(a, b) >= percent * max(a, b)

    def reach(a: int, b: int) -> bool:
        return 10000 * min(a, b) >= percent * percent * max(a, b)

    def gather(batches):
        token, leaders, before = None, [], None
        for batch in batches:
            tokens, gids, sizes = (batch.column(i).to_numpy() for i in range(3))
            if not len(tokens):
                continue
            again = np.zeros(len(tokens), bool)
            again[0] = before == (tokens[0], gids[0], sizes[0])
            again[1:] = (tokens[1:] == tokens[:-1]) & (gids[1:] == gids[:-1]) & (sizes[1:] == sizes[:-1])
            before = tokens[-1], gids[-1], sizes[-1]
            tokens, gids, sizes = tokens[~again], gids[~again], sizes[~again]
            if not len(tokens):
                continue
            # A token that stands alone needs no look, unless the batch's edge cuts its rows.
            same = np.concatenate([[False], tokens[1:] == tokens[:-1]])
            look = same | np.concatenate([same[1:], [True]])
            look[0] = True
            found = set()
            for t, gid, n in zip(tokens[look].tolist(), gids[look].tolist(), sizes[look].tolist()):
                if t != token:
                    token, leaders = t, []
                home = False
                for leader, size in leaders:
                    if reach(n, size):
                        found.add((leader, gid))
                        found.add((leader, leader))
                        home = home or near(n, size)
                if not home:
                    leaders.append((gid, n))
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["leader", "gid"])

    return gather


def linked_sets(sets: list[np.ndarray], block: np.ndarray, percent: int) -> np.ndarray:
    """For each of some sets the first one that it reaches by links between sets of unlike block, or of one single block.

    Overlaps with all sets before come from a list of the sets that hold each shingle.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    holder, first = owner[order], np.searchsorted(code[order], np.arange(code.max() + 1))
    cross = len(np.unique(block)) > 1
    at = 0
    # How many of a shingle's holders come before the set at hand.
    before = np.arange(len(code)) - first[code[order]]
    earlier = np.empty(len(code), np.int64)
    earlier[order] = before
    for i in range(len(sets)):
        mine = code[at : at + size[i]]
        counts = earlier[at : at + size[i]]
        at += size[i]
        total = int(counts.sum())
        if not total:
            continue
        spots = np.repeat(first[mine] - (np.cumsum(counts) - counts), counts) + np.arange(total)
        shared = np.bincount(holder[spots], minlength=i)[:i]
        hits = np.flatnonzero(100 * shared >= percent * (size[:i] + size[i] - shared))
        for j in hits.tolist():
            if not cross or block[i] != block[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sets))])


def _gatherings(batches):
    """Tables of the rows that agree in the first three columns, from batches sorted by these."""
    held, key = [], None
    for batch in batches:
        keys = [batch.column(i).to_numpy() for i in range(3)]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                now = tuple(int(k[lo]) for k in keys)
                if now != key and held:
                    yield pa.Table.from_batches(held)
                    held = []
                key = now
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _hopeful(percent: int):
    """Over rows (leader, a, b, block, node, n, counts): those with a partner the counts allow, without the last two."""

    def hopeful(batches):
        for rows in _gatherings(batches):
            if rows.num_rows < 2:
                continue
            raw = rows.column("counts").to_pylist()
            empty = bytes(1 << COUNT_PARTS_BITS)
            counts = np.frombuffer(b"".join(empty if c is None else c for c in raw), np.uint8).reshape(len(raw), -1)
            known = np.array([c is not None for c in raw])
            wanted = partners(counts, known, rows.column("n").to_numpy(), rows.column("block").to_numpy(), percent)
            yield from rows.select(["leader", "a", "b", "block", "node"]).filter(pa.array(wanted)).to_batches()

    return hopeful


def _verify(words: int, percent: int):
    """Over rows (leader, a, b, block, node, text) with the rows of a leader's two blocks together: links (u, v)."""

    def verify(batches):
        for rows in _gatherings(batches):
            nodes, place = np.unique(rows.column("node").to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            texts = rows.column("text").take(pa.array(place)).combine_chunks()
            block = rows.column("block").to_numpy()[place]
            sets = list(shingle_sets(*text_buffers(texts), words))
            root = linked_sets(sets, block, percent)
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["u", "v"])

    return verify


def link_documents(
    docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text",
    block_sets: int = BLOCK_SETS,
) -> DataFrame:
    """(id, n_shingles, component_id) of each row of ``docs``.

    Texts are lower-cased in A-Z and split at ASCII blanks; a set is the distinct shingles of ``words`` words, or the one
    shingle of all words if there are fewer. Rows link if 100 * shared >= percent * union; component_id is the smallest
    id reachable. A null, empty or blank text has no shingles and links with nothing. Repeated rows, and rows with equal
    ids, link as their sets do; null ids are never the smallest. Other columns are ignored; no rows give no rows.
    """
    linked = linked_rows(docs, words, percent, id_column, text_column, block_sets)
    return linked.select(F.col("id").alias(id_column), "n_shingles", "component_id")


def linked_rows(
    docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text",
    block_sets: int = BLOCK_SETS,
) -> DataFrame:
    """(id, n_shingles, component_id, text_hash, root): see :func:`link_documents`; root names the component's one node."""
    spark = docs.sparkSession
    ship_package(spark)
    features = _features(docs, id_column, text_column, words, percent)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    index = (
        features.select(F.explode("prefix").alias("token"), "gid", "n")
        .repartition(parts, "token")
        .sortWithinPartitions("token", "gid", "n")
    )
    gathered = index.mapInArrow(_leaders(percent), "leader long, gid long")

    # Equal sets are one node, named by its first row; nodes of equal prefix and size share the name of their group.
    narrow = features.where("n > 0").drop("prefix")
    keyed = narrow.groupBy("set_key").agg(F.min("row").alias("node"))
    nodes = narrow.join(keyed.select("node"), F.col("row") == F.col("node")).drop("row", "set_key")
    nodes = stage(nodes, "nodes")
    alone = nodes.groupBy("gid").agg(F.count("*").alias("sets")).where("sets > 1").select(F.col("gid").alias("leader"), "gid")
    gathered = stage(gathered.unionByName(alone).distinct(), "gathered")

    members = stage(gathered.join(nodes.select("node", "gid"), "gid").select("leader", "node").distinct(), "members")
    sizes = members.groupBy("leader").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(block_sets)).cast("int")
    placed = members.join(sizes, "leader").withColumn("blocks", blocks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Block pairs: (b, b) within a block, and b with every other.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "leader", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node"
    )
    filtered = (
        placed.join(nodes.select("node", "n", "counts"), "node")
        .select("leader", "a", "b", "block", "node", "n", "counts")
        .repartition(parts, "leader", "a", "b")
        .sortWithinPartitions("leader", "a", "b")
        .mapInArrow(_hopeful(percent), "leader long, a int, b int, block int, node long")
    )
    placed = stage(filtered, "placed")
    wanted = nodes.join(placed.select("node").distinct(), "node").select("node", F.col("id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    same = texts["id"].eqNullSafe(wanted["wanted_id"]) & (texts["text_hash"] == wanted["wanted_hash"])
    texts = texts.join(wanted, same).select("node", "text")
    links = (
        placed.join(texts, "node")
        .select("leader", "a", "b", "block", "node", "text")
        .repartition(parts, "leader", "a", "b")
        .sortWithinPartitions("leader", "a", "b")
        .mapInArrow(_verify(words, percent), "u long, v long")
    )
    roots = component_roots(stage(links, "links"))

    node_of = features.join(keyed, "set_key", "left").select("id", "text_hash", "n", F.coalesce("node", "row").alias("node"))
    rooted = node_of.join(roots, "node", "left").select("id", "text_hash", "n", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, "rooted")
    # Staged, so that the join is one that Spark can split where very many rows have one root.
    least = stage(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    return rooted.join(least, "root").select("id", F.col("n").alias("n_shingles"), "component_id", "text_hash", "root")
