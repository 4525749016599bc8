"""Packing of documents into sequences of fixed length: best fit, then local search by swaps.

Token counts are all that packing needs, so texts are encoded once, in place, and only (id, piece, length) is shuffled.
Pieces are dealt out to shards by hash; each shard packs its own. Where a shard ends with a sequence at most half full -
best fit leaves one at most - its pieces meet those of other shards in a further round.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from specloom.llm.byte_bpe import encoder
from specloom.session import ship_package, stage

#: Pieces a shard packs; a shard's work grows a little faster than its number of pieces.
SHARD_PIECES = 40_000
#: Shards whose leftovers meet in one.
MERGED_SHARDS = 256


def cut_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, limit: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's pieces, in the order of its ids.

    The ids of a text end with ``end_id``; null and empty texts are the end id alone. More than ``limit`` ids are cut so
    that all pieces but the first are full. Repeated rows give repeated pieces; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    schema = T.StructType(
        [T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    )

    def cut(batches):
        bpe, tail = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at = 0
            for ids, edge in bpe.encode(batch.column(1)):
                ids, edges = ids.astype("<u4"), edge.tolist()
                row, piece, start, length, crc = [], [], [], [], []
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    n = b - a + 1
                    cuts = [0, *range(n - (n - 1) // limit * limit, n + 1, limit)]
                    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                        raw = ids[a + lo : a + min(hi, n - 1)].tobytes() + (tail if hi == n else b"")
                        row.append(at + k)
                        piece.append(i)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(raw))
                at += len(edges) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    schema.fieldNames(),
                )

    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(cut, schema)


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Bins of places in ``sizes``: largest first, each into the fullest bin that it fits."""
    by_free: list[list[int]] = [[] for _ in range(limit + 1)]
    # A bit per free space that some bin has, so the tightest fit is one bit operation away.
    present = 0
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fitting = present >> sizes[i]
        if fitting:
            free = sizes[i] + (fitting & -fitting).bit_length() - 1
            home = by_free[free].pop()
            if not by_free[free]:
                present &= ~(1 << free)
            bins[home].append(i)
        else:
            free, home = limit, len(bins)
            bins.append([i])
        free -= sizes[i]
        by_free[free].append(home)
        present |= 1 << free
    return bins


def swap_search(bins: list[list[int]], sizes: list[int], limit: int) -> list[list[int]]:
    """Fewer bins by local search among those that are not full.

    From the emptiest bin pieces move to fuller bins, one is exchanged for a smaller one, or two for one; each step moves
    tokens from a bin to a fuller one and so raises the sum of squared fills, until the bin is empty or no step is left.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    # For each size of piece (0: none, a plain move) the bins that hold one, most room first; outdated entries are skipped.
    rooms: list[list[tuple[int, int, int]]] = [[] for _ in range(limit + 1)]

    def listed(b: int) -> None:
        free = limit - fill[b]
        if free:
            heapq.heappush(rooms[0], (-free, b, -1))
            for i in bins[b]:
                heapq.heappush(rooms[sizes[i]], (-free, b, i))

    def home(held: int, free: int, source: int) -> tuple[int, int] | None:
        """A bin other than ``source``, at least as full, with that much room beside a piece of size ``held``."""
        heap, aside, found = rooms[held], [], None
        while heap and -heap[0][0] >= free:
            entry = heap[0]
            room, b, i = -entry[0], entry[1], entry[2]
            if limit - fill[b] != room or i >= 0 and where[i] != b:
                heapq.heappop(heap)
            elif b == source or fill[b] < fill[source]:
                aside.append(heapq.heappop(heap))
            else:
                found = b, i
                break
        for entry in aside:
            heapq.heappush(heap, entry)
        return found

    where = [0] * len(sizes)
    for b, items in enumerate(bins):
        for i in items:
            where[i] = b
    for b in range(len(bins)):
        listed(b)

    def shift(source: int, out: list[int], b: int, back: int) -> None:
        moved = sum(sizes[i] for i in out)
        for i in out:
            bins[source].remove(i)
            bins[b].append(i)
            where[i] = b
        if back >= 0:
            moved -= sizes[back]
            bins[b].remove(back)
            bins[source].append(back)
            where[back] = source
        fill[source] -= moved
        fill[b] += moved
        listed(source)
        listed(b)

    def step(source: int) -> bool:
        items = sorted(bins[source], key=lambda i: -sizes[i])
        for i in items:
            if hit := home(0, sizes[i], source):
                shift(source, [i], *hit)
                return True
        # The less comes back, the emptier the source; a piece never swaps with its like.
        # Of pairs of the same two sizes one will do, so their number is bounded by the sizes that fit in a bin.
        by_size: dict[int, list[int]] = {}
        for i in items:
            by_size.setdefault(sizes[i], []).append(i)
        some = [i for like in by_size.values() for i in like[:2]]
        pairs: dict[tuple[int, int], list[int]] = {}
        for k, i in enumerate(some):
            for j in some[k + 1 :]:
                pairs.setdefault((sizes[i], sizes[j]), [i, j])
        for out in [*([i] for i in items), *pairs.values()]:
            taken = sum(sizes[i] for i in out)
            for held in range(max(1, taken - widest), min(taken - 1, limit) + 1):
                if rooms[held] and (hit := home(held, taken - held, source)):
                    shift(source, out, *hit)
                    return True
        return False

    for source in sorted(range(len(bins)), key=lambda b: fill[b]):
        if fill[source] >= limit:
            break
        widest = max((-rooms[0][0][0] if rooms[0] else 0), 0)
        while bins[source] and step(source):
            pass
    return [b for b in bins if b]


def _pack(shard: int, sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset and fill of the sequence for each piece."""
    whole = sizes.tolist()
    order = [i for i, n in enumerate(whole) if n < limit]
    small = [whole[i] for i in order]
    bins = [[order[i] for i in b] for b in swap_search(best_fit(small, limit), small, limit)]
    bins += [[i] for i, n in enumerate(whole) if n >= limit]
    sequence, offset, fill = (np.zeros(len(whole), np.int64) for _ in range(3))
    for number, items in enumerate(bins):
        at = 0
        for i in items:
            sequence[i], offset[i] = (shard << 32) + number, at
            at += whole[i]
        fill[items] = at
    return sequence, offset, fill


def pack_pieces(pieces: DataFrame, limit: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``limit``) and for each its ``sequence_id`` and ``offset`` in it.

    Pieces of a sequence stand without gaps from offset 0. Columns of these names, or named shard or fill, are replaced.
    Pieces that agree in all columns lie in shards like others do.
    """
    ship_package(pieces.sparkSession)
    pieces = stage(pieces.drop("sequence_id", "offset", "shard", "fill"), "pieces")
    schema = T.StructType(
        pieces.schema.fields
        + [T.StructField(c, T.LongType()) for c in ("shard", "sequence_id", "offset", "fill")]
    )

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([(k, "ascending") for k in keys])
        found = _pack(first + group.column("shard")[0].as_py(), group.column("length").to_numpy(), limit)
        for name, values in zip(("sequence_id", "offset", "fill"), found):
            group = group.append_column(name, pa.array(values))
        return group

    keys = [f.name for f in pieces.schema.fields if isinstance(f.dataType, (T.IntegralType, T.StringType))]
    shards, first, done = max(1, -(-pieces.count() // shard_pieces)), 0, None
    # A row's place in the staged files tells rows that are alike apart.
    left = pieces.withColumn("shard", F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.lit(shards)))
    while True:
        packed = left.groupBy("shard").applyInArrow(pack, schema)
        if shards == 1:
            done = packed if done is None else done.unionByName(packed)
            return done.drop("shard", "fill")
        packed = stage(packed, "packed")
        full = packed.where(F.col("fill") * 2 > limit)
        done = full if done is None else done.unionByName(full)
        first, shards = first + shards, -(-shards // MERGED_SHARDS)
        left = packed.where(F.col("fill") * 2 <= limit).drop("sequence_id", "offset", "fill")
        left = left.withColumn("shard", F.floor(F.col("shard") / MERGED_SHARDS))


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int, limit: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per piece of each document: see :func:`cut_pieces` and :func:`pack_pieces`. No documents, no rows."""
    return pack_pieces(cut_pieces(docs, vocabulary, end_id, limit, id_column, text_column), limit)
