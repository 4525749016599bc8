"""Removal of byte strings that occur earlier in the corpus, by suffix arrays of what could repeat.

Every window of ``length`` bytes has an anchor: its k-gram with the least hash. Equal windows have equal anchors at equal
places, so it is enough to compare windows with the same anchor. Neighbouring windows with one anchor form a segment.
Segments are dealt out by anchor; of equal segments all but the earliest are removed whole, and the distinct segments of
an anchor are read from their documents and put into one text, whose suffix array brings equal windows together.

A segment's bytes are read in chunks of eight from its anchor on, each chunk one symbol. As equal windows lie alike round
their anchor, sorted suffixes of symbols stand for all windows: those that start up to seven bytes before a chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from specloom.llm.words import text_buffers
from specloom.llm.shingles import powers
from specloom.llm.suffix_order import suffix_array
from specloom.session import ship_package, stage

#: Bytes of an anchor.
GRAM = 32
CHUNK = 8
SLAB_BYTES = 1 << 20
#: Longest window: sums modulo 2**64, by which equal segments are known, do not tell some far longer ones apart.
LONGEST = 256
#: Segments whose suffixes are sorted together; an anchor with more has its windows dealt out by their bytes instead, and
#: they are compared by digests of 128 bits.
GROUP_SEGMENTS = 20_000
BATCH_SEGMENTS = 4_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTE = [np.random.RandomState(s).randint(1, 2**62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1) for s in (21, 22)]
_PLACE = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` bytes, by joining hashes of shorter stretches."""
    values = _BYTE[0][raw]
    hashes, n = values, 1
    for bit in bin(size)[3:]:
        hashes = hashes[:-n] * np.uint64(pow(_BASES[1], n, 1 << 64)) + hashes[n:]
        n *= 2
        if bit == "1":
            hashes = hashes[:-1] * np.uint64(_BASES[1]) + values[n:]
            n += 1
    return _mixed(hashes)


def segments(raw: np.ndarray, bounds: np.ndarray, length: int):
    """(anchor hash, segment hash, text, first window, last window, anchor) of all segments, places within their text.

    The least hash of a window, and of equal ones the first, is its anchor; texts below ``length`` bytes have none.
    """
    with np.errstate(over="ignore"):
        if len(raw) < length:
            empty = np.empty(0, np.int64)
            return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty
        hashes = _gram_hashes(raw, GRAM)
        least = (hashes & ~_PLACE) | (np.arange(len(hashes), dtype=np.uint64) & _PLACE)
        seen, width = 1, length - GRAM + 1
        while seen < width:
            step = min(seen, width - seen)
            least = np.minimum(least[:-step], least[step:])
            seen += step
        count = len(raw) - length + 1
        anchor = (least & _PLACE).astype(np.int64)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:count]
        inside = np.arange(count) + length <= bounds[1:][text]
        change = np.ones(count, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(change & inside)
        breaks = np.append(np.flatnonzero(change | ~inside), count)
        last = breaks[np.searchsorted(breaks, first) + 1] - 1
        anchor = anchor[first]
        power, inverse = powers(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[1][raw] * power[: len(raw)], out=total[1:])
        whole = _mixed((total[last + length] - total[first]) * inverse[first])
        whole = _mixed(whole + (anchor - first).astype(np.uint64) * np.uint64(_BASES[1]) + (last - first).astype(np.uint64))
        text = text[first]
        base = bounds[text]
    return hashes[anchor], whole, text, first - base, last - base, anchor - base


def _cut(raw: np.ndarray, bounds: np.ndarray, length: int):
    """Slabs of texts; a text beyond a slab comes in stretches that overlap by a window, with their place in it."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLAB_BYTES, "right")) - 1)
        part = raw[bounds[i] : bounds[j]]
        if len(part) <= 2 * SLAB_BYTES:
            yield i, 0, part, bounds[i : j + 1] - bounds[i]
        else:
            # Windows of a stretch end where those of the next start.
            for lo in range(0, len(part), SLAB_BYTES):
                piece = part[lo : lo + SLAB_BYTES + length - 1]
                yield i, lo, piece, np.array([0, len(piece)])
        i = j


def _spread(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(key.view(np.uint64) * np.uint64(_BASES[0]) + place.astype(np.uint64))


def _find(length: int):
    """Over rows (key, text): the segments to compare, and spans already known to be repeated.

    Columns (anchor, segment, key, at): ``at`` packs the first window, the number of further windows and the anchor's
    distance. A span has a negative ``at``, its place, and its length in ``segment``. Of segments that are equal within a
    batch only the earliest goes on; the others are spans, as they repeat it.
    """

    def find(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            found = [[] for _ in range(6)]
            raw, bounds = text_buffers(batch.column(1))
            for base, lo, part, inner in _cut(raw, bounds, length):
                h, s, text, first, last, anchor = segments(part, inner, length)
                for kept, one in zip(found, (h, s, keys[base + text], first + lo, last - first, anchor - first)):
                    kept.append(one)
            h, s, key, first, more, gap = (np.concatenate(f) for f in found) if found[0] else (np.empty(0, np.int64),) * 6
            order = np.lexsort((first, key, s, h))
            h, s, key, first, more, gap = (x[order] for x in (h, s, key, first, more, gap))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            key_, start, size = _joined(key[~new], first[~new], more[~new] + length)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h[new], _spread(key_, start)]).view(np.int64)),
                    pa.array(np.concatenate([s[new].view(np.int64), size])),
                    pa.array(np.concatenate([key[new], key_])),
                    pa.array(np.concatenate([first[new] << 24 | more[new] << 12 | gap[new], ~start])),
                ],
                ["anchor", "segment", "key", "at"],
            )

    return find


def _joined(key: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (key, start, size) with those that overlap or touch made one."""
    if not len(key):
        return (np.empty(0, np.int64),) * 3
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], (start + size)[order]
    # The farthest end so far within a key: ends of a later key count from its own first row.
    opens = np.append(True, key[1:] != key[:-1])
    part = np.cumsum(opens) - 1
    reach = np.maximum.accumulate(end + part * (1 << 40)) - part * (1 << 40)
    fresh = opens.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return key[at], start[at], reach[np.append(at[1:], len(key)) - 1] - start[at]


def _settle(length: int):
    """Over the rows of :func:`_find` sorted by (anchor, segment, key, at): spans, and segments that need their bytes.

    Columns (key, start, size, anchor, gap); a span has no ``gap``. An anchor with a single distinct segment needs none.
    """

    def settle(batches):
        before = None
        held = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            spans = columns[3] < 0
            key_, start_, size_ = columns[2][spans], ~columns[3][spans], columns[1][spans]
            anchor, segment, key, at = (c[~spans] for c in columns)
            start, more, gap = at >> 24, at >> 12 & 0xFFF, at & 0xFFF
            # The first segment of an anchor waits until a second one turns up.
            out = []
            if len(anchor):
                fresh = np.append(before is None or before[0] != anchor[0], anchor[1:] != anchor[:-1])
                new = fresh | np.append(before is None or before[1] != segment[0], segment[1:] != segment[:-1])
                repeated = ~new
                key_ = np.concatenate([key_, key[repeated]])
                start_ = np.concatenate([start_, start[repeated]])
                size_ = np.concatenate([size_, (more + length)[repeated]])
                at_new = np.flatnonzero(new)
                alone = fresh[at_new] & np.append(fresh[at_new][1:], False)
                last = len(at_new) - 1
                if len(at_new) and not fresh[at_new[0]] and held is not None:
                    out.append(held)
                if len(at_new):
                    held = None
                wanted = at_new[~alone]
                if len(at_new) and fresh[at_new[last]]:
                    i = at_new[last]
                    held = tuple(int(x[i]) for x in (key, start, more + length, anchor, gap))
                    wanted = wanted[wanted != i]
                rows = [np.append(np.array([o[k] for o in out], np.int64), x[wanted]) for k, x in enumerate((key, start, more + length, anchor, gap))]
                before = anchor[-1], segment[-1]
            else:
                rows = [np.empty(0, np.int64)] * 5
            key_, start_, size_ = _joined(key_, start_, size_)
            n = len(key_)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key_, rows[0]])), pa.array(np.concatenate([start_, rows[1]])),
                    pa.array(np.concatenate([size_, rows[2]])), pa.array(np.concatenate([np.zeros(n, np.int64), rows[3]])),
                    pa.array(np.concatenate([np.zeros(n, np.int64), rows[4]]), mask=np.arange(n + len(rows[4])) < n),
                ],
                ["key", "start", "size", "anchor", "gap"],
            )

    return settle


def repeated_windows(
    key: np.ndarray, start: np.ndarray, gap: np.ndarray, raw: np.ndarray, bounds: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the windows of some segments that an earlier window equals.

    Segment i is bytes bounds[i]:bounds[i+1] of ``raw``, lies at ``start`` in document ``key``, its anchor ``gap`` bytes in.
    """
    count, size = len(key), np.diff(bounds)
    lead = gap % CHUNK
    chunks = -(-(size - lead) // CHUNK)
    # Symbols: a separator, then the segment's chunks; the last one is filled up with zeros.
    width = chunks + 1
    base = np.cumsum(width) - width
    total = int(width.sum())
    owner = np.repeat(np.arange(count), width)
    place = np.arange(total) - base[owner] - 1
    offset = lead[owner] + place * CHUNK
    padded = np.append(raw, np.zeros(CHUNK, np.uint8))
    value = np.zeros(total, np.uint64)
    real = place >= 0
    for k in range(CHUNK):
        spot = offset + k
        byte = np.where(real & (spot < size[owner]), padded[np.minimum(bounds[owner] + np.maximum(spot, 0), len(raw))], 0)
        value = value << np.uint64(8) | byte.astype(np.uint64)
    _, symbol = np.unique(value, return_inverse=True)
    symbol = np.where(real, symbol.astype(np.int64) + 1, 0)
    order = suffix_array(symbol)
    order = order[real[order]]

    # Bytes that neighbours in the order share, as far as a window goes.
    reach = -(-length // CHUNK)
    after = np.append(value, np.zeros(reach + 1, np.uint64))
    shared, going = np.zeros(len(order), np.int64), np.ones(len(order), bool)
    going[:1] = False
    for k in range(reach):
        here = after[order + k]
        differ = np.zeros(len(order), np.uint64)
        differ[1:] = here[1:] ^ here[:-1]
        equal = np.full(len(order), CHUNK)
        for b in range(CHUNK):
            equal[differ >= np.uint64(1 << 8 * b)] = CHUNK - 1 - b
        shared += np.where(going, equal, 0)
        going &= equal == CHUNK
    # Windows that start ``back`` bytes before a chunk: equal if the chunk's suffixes share the rest and so do those bytes.
    found_key, found_place = [], []
    seg, spot = owner[order], offset[order]
    for back in range(CHUNK):
        first = spot - back
        ok = (first >= 0) & (first + length <= size[seg])
        run = np.cumsum(shared < length - back)
        left = np.zeros(len(order), np.uint64)
        for k in range(back, 0, -1):
            left = left << np.uint64(8) | np.where(ok, raw[np.minimum(bounds[seg] + np.maximum(spot - k, 0), len(raw) - 1)], 0).astype(np.uint64)
        run, left, first, of = run[ok], left[ok], first[ok], seg[ok]
        if not len(run):
            continue
        whose, where = key[of], start[of] + first
        by = np.lexsort((where, whose, left, run))
        same = np.zeros(len(by), bool)
        same[1:] = (run[by][1:] == run[by][:-1]) & (left[by][1:] == left[by][:-1])
        found_key.append(whose[by][same])
        found_place.append(where[by][same])
    if not found_key:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_key), np.concatenate(found_place)


def _compare(length: int):
    """Over rows (route, digest, key, start, gap, bytes) in the order of the first four: spans (key, start, size).

    A row with a digest is a window; of equal ones all but the first are spans. The others are segments, routed by their
    anchor, and go into suffix arrays.
    """

    def spans(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks()
        key, start, gap = (rows.column(c).to_numpy() for c in ("key", "start", "gap"))
        column = rows.column("bytes").combine_chunks().cast(pa.large_binary())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        return repeated_windows(key, start, gap, raw, bounds - bounds[0], length)

    def result(key: np.ndarray, start: np.ndarray):
        found = _joined(key, start, np.full(len(start), length))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["key", "start", "size"])

    def compare(batches):
        # Texts are cut where the anchor changes, once enough segments have come together.
        held, count, before, digest = [], 0, None, None
        for batch in batches:
            windows = batch.filter(batch.column(1).is_valid())
            if windows.num_rows:
                digests = windows.column(1)
                same = np.zeros(len(digests), bool)
                same[0] = digests[0].as_py() == digest
                same[1:] = pc.equal(digests.slice(1), digests.slice(0, len(digests) - 1)).to_numpy(zero_copy_only=False)
                digest = digests[len(digests) - 1].as_py()
                yield result(windows.column(2).to_numpy()[same], windows.column(3).to_numpy()[same])
            batch = batch.filter(batch.column(1).is_null())
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            if held and count >= BATCH_SEGMENTS and before != anchor[0]:
                yield result(*spans(held))
                held, count = [], 0
            changes, at = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, 0
            while True:
                k = np.searchsorted(changes, at + max(1, BATCH_SEGMENTS - count))
                if k == len(changes):
                    break
                held.append(batch.slice(at, int(changes[k]) - at))
                yield result(*spans(held))
                held, count, at = [], 0, int(changes[k])
            held.append(batch.slice(at))
            count, before = count + batch.num_rows - at, anchor[-1]
        if held:
            yield result(*spans(held))

    return compare


def _ordered(docs: DataFrame, id_column: str, text_column: str, others: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, text, others), key a long that ascends with the id; and (key, text) with each key once.

    Unique whole numbers are their own keys. Else a key is the place among the sorted (id, hash of the text).
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.struct(*others).alias("others"))
    ids = docs.select(F.col(id_column).alias("id"))
    whole = dict(ids.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint")
    if whole and ids.where("id IS NULL").isEmpty() and ids.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.select("id", F.col("id").cast("long").alias("key"), "text", "others")
        return rows, rows.select("key", "text")
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    places = stage(
        hashed.select("id", "text_hash").distinct().orderBy("id", "text_hash").withColumn("key", F.monotonically_increasing_id()),
        "places",
    )
    same = hashed["id"].eqNullSafe(places["id"]) & (hashed["text_hash"] == places["text_hash"])
    rows = hashed.join(places, same).select(hashed["id"], "key", "text", "others")
    return rows, rows.select("key", "text").dropDuplicates(["key"])


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """(key, start, size): stretches of the texts of ``rows`` (key, text) that an earlier place covers, not yet merged.

    Each key comes once.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select("key", "text").mapInArrow(_find(length), "anchor long, segment long, key long, at long")
    settled = stage(
        found.repartition(parts, "anchor")
        .sortWithinPartitions("anchor", "segment", "key", "at")
        .mapInArrow(_settle(length), "key long, start long, size long, anchor long, gap long"),
        "settled",
    )
    open_ = settled.where("gap IS NOT NULL")
    sizes = stage(open_.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_SEGMENTS), "large")
    wanted = open_.withColumn("large", F.lit(False))
    if not sizes.isEmpty():
        large = sizes.select("anchor", F.lit(True).alias("large"))
        wanted = open_.join(large, "anchor", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    cut = F.expr("substring(CAST(text AS BINARY), CAST(start + 1 AS INT), CAST(size AS INT))").alias("bytes")
    read = wanted.join(rows, "key").select("large", "anchor", "key", "start", "gap", cut)
    # The windows of an anchor with very many contexts are dealt out each by its bytes.
    window = f"substring(bytes, i + 1, {length})"
    pieces = F.expr(f"""
        CASE WHEN large THEN transform(sequence(0, octet_length(bytes) - {length}), i -> named_struct(
            'route', xxhash64({window}), 'digest', unhex(md5({window})), 'key', key, 'start', start + i,
            'gap', CAST(NULL AS BIGINT), 'bytes', CAST(NULL AS BINARY)))
        ELSE array(named_struct('route', anchor, 'digest', CAST(NULL AS BINARY), 'key', key, 'start', start,
            'gap', gap, 'bytes', bytes)) END
    """)
    compared = (
        read.select(F.inline(pieces))
        .repartition(parts, "route")
        .sortWithinPartitions("route", "digest", "key", "start")
        .mapInArrow(_compare(length), "key long, start long, size long")
    )
    return settled.where("gap IS NULL").select("key", "start", "size").unionByName(compared)


def remove_repeats(
    docs: DataFrame, length: int = 100, id_column: str = "doc_id", text_column: str = "text", others: tuple[str, ...] = ()
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) of each row of ``docs``, and a struct of ``others``.

    Texts are taken as UTF-8 bytes, null as none. Each byte is removed that lies in ``length`` bytes which also start
    earlier: in a row with a smaller id, or before in the same text; strings are judged on the input. ``n_spans`` counts
    maximal removed runs; ``kept`` is the remaining bytes as text, broken characters left out. Null ids come first, rows
    with equal ids follow each other in a fixed order, and rows that agree in id and text count as one document, so each
    has the same result. Columns not in ``others`` are ignored; no rows give no rows. ``length`` is from GRAM + CHUNK to LONGEST.
    """
    if not GRAM + CHUNK <= length <= LONGEST:
        raise ValueError(f"length must be from {GRAM + CHUNK} to {LONGEST}")
    ship_package(docs.sparkSession)
    rows, once = _ordered(docs, id_column, text_column, list(others))
    spans = repeated_spans(once, length)
    merged = spans.groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = rows.join(merged, "key", "left").select("id", "text", "spans.start", "spans.size", "others")
    id_type, kinds = docs.schema[id_column].dataType.simpleString(), rows.schema["others"].dataType.simpleString()

    def remove(batches):
        for batch in batches:
            raw, bounds = text_buffers(batch.column(1))
            removed, runs, texts, digests = [], [], [], []
            for i in range(batch.num_rows):
                text = raw[bounds[i] : bounds[i + 1]]
                start, size = (np.array(batch.column(k)[i].as_py() or [], np.int64) for k in (2, 3))
                _, start, size = _joined(np.zeros(len(start), np.int64), start, size)
                keep = np.ones(len(text), bool)
                for a, n in zip(start.tolist(), size.tolist()):
                    keep[a : a + n] = False
                rest = text[keep].tobytes() if len(start) else text.tobytes()
                removed.append(len(text) - len(rest))
                runs.append(len(start))
                texts.append(rest.decode("utf-8", "ignore"))
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                    pa.array(texts, pa.string()), pa.array(digests, pa.string()), batch.column(4),
                ],
                ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "others"],
            )

    result = joined.mapInArrow(
        remove,
        f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept string, kept_sha256 string, others {kinds}",
    )
    return (result if others else result.drop("others")).withColumnRenamed("id", id_column)
