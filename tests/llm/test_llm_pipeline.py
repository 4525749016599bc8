"""Every stage of the pipeline against a brute-force version, on planted cases."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from test_llm_ngram_join import components
from test_llm_suffix_dedup import expected as without_repeats
from test_llm_tokens import packed_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    rng = random.Random(1)
    english = [r for r in rows if r[2] == "en" and 600 < r[4] < 4000]
    extra, at = [], 10_000

    def add(text, lang="en"):
        nonlocal at
        extra.append((at, text, lang, "planted", len(text or "")))
        at += 1

    add(None), add(""), add("12 345 !!"), add("漢字仮名交じり文の例文です。" * 30), add("ок это русский текст, который никто не учил " * 20)
    add(english[0][1].upper()), add(english[1][1]), add(english[1][1])
    words = english[2][1].split(" ")
    for _ in range(4):
        copy = list(words)
        copy[rng.randrange(len(copy))] = "changed"
        add(" ".join(copy))
    passage = english[3][1][:300]
    add("Something else first. " + passage + " and then an end of its own."), add("Another start. " + passage)
    return rows + extra


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def collected(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=repr)


def test_stages(spark, planted):
    stages, library = dict(corpus_pipeline.STAGES), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = frame(spark, planted)

    known = collected(stages["language_id"](spark, docs, SF_DIR))
    gone = {r[0] for r in planted} - {r[0] for r in known}
    assert {10_000, 10_001, 10_002, 10_003, 10_004} <= gone and len(gone) <= 7
    assert set(known) <= set(planted)

    best = {}
    for r in known:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])
        best[low] = max(best.get(low, r), r)
    unique = collected(stages["exact_dedup"](spark, frame(spark, known), SF_DIR))
    assert unique == sorted(best.values(), key=repr)

    linked = components([(r[0], r[1]) for r in unique], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    firsts = {d for d, _, c in linked if d == c}
    apart = collected(stages["ngram_jaccard_join"](spark, frame(spark, unique), SF_DIR))
    assert apart == [r for r in unique if r[0] in firsts] and len(apart) < len(unique)

    cleaned = {x[0]: x for x in without_repeats(sorted((r[0], r[1]) for r in apart), corpus_pipeline.REPEAT_BYTES)}
    left = collected(stages["suffix_array_dedup"](spark, frame(spark, apart), SF_DIR))
    assert left == sorted(((r[0], cleaned[r[0]][4], *r[2:4], len(cleaned[r[0]][4])) for r in apart), key=repr)
    assert any(c[2] for c in cleaned.values())

    pieces = stages["best_fit_packing"](spark, frame(spark, left), SF_DIR).collect()
    numbered = [r[0] for r in left]
    expected = packed_rows(library, [r[1] for r in left], corpus_pipeline.SEQUENCE_TOKENS)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in pieces} == {
        (numbered[i], p): v for (i, p), v in expected.items()
    }


def test_run_is_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 100


def test_columns_stay_and_nulls_pass(spark):
    rows = [(None, None, None, None, None), (None, "the of and to in that", "en", None, None), (3, "the of and to in that", None, "s", 1)]
    docs = frame(spark, rows)
    for name, function in corpus_pipeline.STAGES[1:4]:
        assert function(spark, docs, SF_DIR).columns == list(corpus_pipeline.COLUMNS), name
    assert [r[0] for r in collected(corpus_pipeline.exact_duplicates(spark, docs, SF_DIR))].count(3) == 1
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), SF_DIR).collect() == [], name


def test_one_row_of_each_group_stays_for_null_and_repeated_ids(spark):
    """Rows, not ids, survive: one row of each group of near copies."""
    words = [[f"{group}{i}" for i in range(200)] for group in "abcd"]
    copy = lambda group, n: " ".join([*words[group], *(f"end{k}" for k in range(n))])
    rows = [
        (None, copy(0, 0)), (None, copy(0, 1)),
        (1, copy(1, 0)), (None, copy(1, 1)),
        (7, copy(2, 0)), (7, copy(2, 1)),
        (7, copy(3, 0)), (5, copy(3, 1)),
        (None, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    groups = sorted(next((g for g in range(4) if t.startswith(words[g][0])), 4) for _, t in left)
    assert groups == [0, 1, 2, 3, 4]
    assert (1, copy(1, 0)) in left and (5, copy(3, 1)) in left


def test_every_stage_keeps_columns_of_any_name(spark):
    names = ["_id", "_hash", "_digest", "_letters", "_ANY", "id", "text_hash", "root", "key", "kept", "others", "digest", "row", "n", "spans"]
    words = " ".join(f"the of and w{i}" for i in range(400))
    rows = [(1, "the of and to in that is was", "en", "s", 1, *names), (2, words, "en", None, 2, *names), (2, words, "en", None, 2, *names)]
    rows.append((3, "q" * 200_000 + " " + words, "en", "s", 3, *names))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, function in corpus_pipeline.STAGES[:4]:
        left = function(spark, docs, SF_DIR)
        assert left.columns == docs.columns, name
        found = left.collect()
        assert found and all(tuple(r)[5:] == tuple(names) for r in found), name
    assert {r.doc_id for r in corpus_pipeline.packed_sequences(spark, docs, SF_DIR).collect()} == {1, 2, 3}
