"""Token counts, packing and token files against the tokenizers library, text by text."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from specloom.llm import bin_packing, simple8b, token_files
from specloom.llm.byte_bpe import ByteBpe
from specloom.llm.words import safe_cuts
from specloom.llm.token_counts import count_tokens
from specloom.llm.token_files import read_documents, write_token_files
from specloom.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = " \t\n\r  ''''srtvemldlLa1٣é  日本😀!?-_‍\x85Ǆ²½Ⅷ"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choices([*ODD, "<|endoftext|>", "'ve", "the "], k=rng.randint(0, 60))) for _ in range(400)]
    return [None, "", " ", "\n\n", "word " * 3000, "x" * 9000, *made, *made[:3]]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("slab, cache", [(1 << 21, 700_000), (64, 50)])
def test_words_give_the_ids_of_whole_texts(library, texts, slab, cache):
    bpe = ByteBpe(PATH, slab, cache)
    column, expected = pa.array(texts, pa.string()), [ids_of(library, t) for t in texts]
    found = [ids[a:b].tolist() for ids, edge in bpe.encode(column) for a, b in zip(edge, edge[1:])]
    assert found == expected
    assert bpe.count(column).tolist() == [len(e) for e in expected]


def test_cuts_stand_before_a_blank():
    raw = np.frombuffer(("ab  cd\n" * 50 + "z" * 300 + " end").encode(), np.uint8)
    blank = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
    cuts = safe_cuts(raw, 40, blank)
    assert cuts and all(raw[c] in (32, 10) and raw[c - 1] not in (32, 10) for c in cuts)


def frame(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, shard int")


def test_counts(spark, library, texts):
    rows = count_tokens(frame(spark, texts), PATH).collect()
    assert sorted(map(tuple, rows)) == [(i, len((t or "").encode()), len(ids_of(library, t))) for i, t in enumerate(texts)]
    assert count_tokens(frame(spark, texts).limit(0), PATH).collect() == []


def packed_rows(library, texts, limit):
    out = {}
    for i, t in enumerate(texts):
        ids = [*ids_of(library, t), 2]
        first = len(ids) % limit or limit
        edges = [0, *range(first, len(ids) + 1, limit)]
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            out[i, p] = a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
    return out


@pytest.mark.parametrize("shard_pieces", [40_000, 50])
def test_packing(spark, library, texts, shard_pieces):
    pieces = bin_packing.cut_pieces(frame(spark, texts), PATH, 2, 100)
    rows = bin_packing.pack_pieces(pieces, 100, shard_pieces).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == packed_rows(library, texts, 100)
    assert len(rows) == len({(r.doc_id, r.piece) for r in rows})
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 100
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / 100 + 3


def test_packing_null_and_large_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (2**62 + 1, None), (2**62 + 1, "b c")], "doc_id long, text string")
    rows = bin_packing.pack_documents(docs, PATH, 2, 8).collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in rows) == [
        (str(2**62 + 1), 0, 1), (str(2**62 + 1), 0, 3), ("None", 0, 2)
    ]
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows)[0] == 0


def test_packing_nothing(spark):
    assert bin_packing.pack_documents(frame(spark, ["a"]).limit(0), PATH, 2, 1024).collect() == []


def test_swaps_save_bins_and_keep_pieces():
    # Best fit needs three bins here, an exchange two.
    sizes, limit = [6, 4, 4, 3, 2, 1], 10
    bins = bin_packing.swap_search([[0, 3], [1, 2], [4], [5]], sizes, limit)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == list(range(6))
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(0, 80))]
        start = bin_packing.best_fit(sizes, 60)
        found = bin_packing.swap_search([list(b) for b in start], sizes, 60)
        assert sorted(i for b in found for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 60 for b in found) and len(found) <= len(start)


def test_two_for_one_exchanges_of_bins_with_many_pieces():
    # Only two pieces of size 2 for one of size 3 fill the other bins.
    sizes = [3] * 99 + [2] * 40
    bins = [list(range(33 * b, 33 * b + 33)) for b in range(3)] + [list(range(99, 139))]
    found = bin_packing.swap_search(bins, sizes, 100)
    assert sorted(sum(sizes[i] for i in b) for b in found) == [77, 100, 100, 100]
    assert sorted(i for b in found for i in b) == list(range(139))


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**40, 2**64])
def test_simple8b_round_trip(n, top):
    rng = random.Random(n)
    values = np.array([rng.randrange(top) for _ in range(n)], np.uint64)
    words, first, escapes = simple8b.encode(values)
    assert (simple8b.decode(words, first, escapes, n) == values).all()
    if top <= 2**60:
        assert len(words) <= n and not len(escapes)


def test_token_files(spark, library, texts):
    docs = frame(spark, texts).repartition(5)
    path = scratch_path(spark, "files")
    write_token_files(docs, path, PATH, 2, files=4)
    start, expected = 0, []
    for i, t in enumerate(texts):
        ids = [*ids_of(library, t), 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, read_documents(spark, path, checksum=True).collect())) == expected
    whole = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in read_documents(spark, path).collect()}
    assert whole == {i: [*ids_of(library, t), 2] for i, t in enumerate(texts)}


def test_token_files_of_null_and_equal_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, None), (1, "b"), (1, "b")], "doc_id long, text string")
    path = scratch_path(spark, "files")
    write_token_files(docs, path, PATH, 2, files=2)
    rows = sorted((r.doc_id is not None, r.start, r.n_tokens) for r in read_documents(spark, path).collect())
    assert [r[0] for r in rows] == [False, False, True, True] and sum(r[2] for r in rows) == 7
    path = scratch_path(spark, "files")
    write_token_files(docs.limit(0), path, PATH, 2, files=2)
    assert read_documents(spark, path).collect() == []


def test_rows_that_are_alike_are_dealt_out_over_shards(spark):
    pieces = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(7).cast("long").alias("length"))
    packed = bin_packing.pack_pieces(pieces, 100, shard_pieces=100).collect()
    assert len(packed) == 3000 and len({r.sequence_id >> 32 for r in packed}) > 20
    places = {(r.sequence_id, r.offset) for r in packed}
    assert len(places) == 3000 and len({s for s, _ in places}) <= 3000 // 14 + 40


def test_number_of_files_follows_the_bytes_and_equal_ids_fill_several(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "FILE_BYTES", 1000)
    rows = [(None if i % 2 else 5, f"text number {i} " * 5, "x", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, n_tokens int").repartition(3)
    write_token_files(docs, str(tmp_path / "files"), PATH, 2)
    stored = spark.read.parquet(str(tmp_path / "files"))
    per_file = [len(r["ids"]) for r in stored.groupBy("shard").agg(F.flatten(F.collect_list("ids")).alias("ids")).collect()]
    assert len(per_file) > 3 and max(per_file) < 60
    found = read_documents(spark, str(tmp_path / "files")).orderBy("start").collect()
    assert sorted(r.doc_id or 0 for r in found) == [0] * 30 + [5] * 30 and found[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:]))
    assert all(r.doc_id is None for r in found[:1]) and found[-1].doc_id == 5
