"""Exact deduplication against grouping in plain Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from specloom.llm import exact_dedup
from specloom.session import scratch_path

ROWS = [
    (1, "Same Text"), (7, "same text"), (5, "SAME TEXT"), (2, None), (3, ""), (4, "ÀB"), (6, "àb"), (8, "long " * 5000),
    (9, "LONG " * 5000), (10, "alone"), (None, "alone"), (None, "nobody"), (11, "twice"), (11, "twice"),
]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, sha))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.withColumn("digest", F.lower(F.hex("digest"))).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, digest string, n int")


def test_groups(spark):
    assert found(exact_dedup.mark_duplicates(frame(spark, ROWS).repartition(3))) == expected(ROWS)


def test_no_rows(spark):
    assert exact_dedup.mark_duplicates(frame(spark, ROWS).limit(0)).collect() == []


@pytest.mark.parametrize("weak", [lambda t: F.substring(t, 1, 1), lambda t: F.lit("x")])
def test_full_texts_decide_when_digests_clash(spark, weak):
    rows = exact_dedup.mark_duplicates(frame(spark, ROWS), digest=weak).drop("digest").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted((r[:4] for r in expected(ROWS)), key=repr)


def test_state_goes_on_with_later_files(spark):
    keys, state = scratch_path(spark, "keys"), scratch_path(spark, "state")
    schema = "digest string, id long, row long, place string"
    spark.createDataFrame([("a", 1, 0, "p"), ("a", 3, 1, "p"), ("b", 2, 2, "p")], schema).write.parquet(keys)
    assert sorted((r.digest, r.keep.id, r.n) for r in exact_dedup.retain(spark, keys, state).collect()) == [("a", 3, 2), ("b", 2, 1)]
    spark.createDataFrame([("b", 9, 3, "q"), ("c", 4, 4, "q")], schema).write.mode("append").parquet(keys)
    after = sorted((r.digest, r.keep.id, r.keep.place, r.n) for r in exact_dedup.retain(spark, keys, state).collect())
    assert after == [("a", 3, "p", 2), ("b", 9, "q", 2), ("c", 4, "q", 1)]


def written(spark, rows, parts=2):
    path = scratch_path(spark, "docs of a day")
    frame(spark, rows).repartition(parts).write.parquet(path)
    return path


LATER = [(12, "Alone"), (3, "same text"), (13, "new"), (None, "nobody"), (20, "TWICE"), (14, "new"), (15, None)]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.hex(F.substring(t, 1, 1)))])
def test_calls_on_one_folder_find_copies_across_them(spark, digest):
    folder = scratch_path(spark, "met")
    first, second = written(spark, ROWS), written(spark, LATER)

    def marked(path):
        return found_marks(exact_dedup.mark_files(spark, [path], digest=digest, folder=folder))

    def found_marks(df):
        return sorted((tuple(r) for r in df.drop("digest").collect()), key=repr)

    whole = sorted((r[:4] for r in expected(ROWS + LATER)), key=repr)
    assert marked(first) == sorted((r[:4] for r in expected(ROWS)), key=repr)
    later = marked(second)
    of_both = {(r[0], r[1], r[2]) for r in whole}
    assert len(later) == len(LATER) and {r[:3] for r in later} <= of_both
    assert found_marks(exact_dedup.marks_so_far(spark, folder)) == whole
    # Files taken in before add nothing, and their rows are judged again over all.
    again = marked(first)
    assert len(again) == len(ROWS) and {r[:3] for r in again} <= of_both
    assert found_marks(exact_dedup.marks_so_far(spark, folder)) == whole
    assert sorted(again + later, key=repr) == whole


def test_a_call_that_failed_halfway_is_made_up_for(spark, monkeypatch):
    folder, first, second = scratch_path(spark, "met"), written(spark, ROWS), written(spark, LATER)
    weak = lambda t: F.unhex(F.hex(F.substring(t, 1, 1)))
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "retain", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            exact_dedup.mark_files(spark, [first], digest=weak, folder=folder)
    exact_dedup.mark_files(spark, [second], digest=weak, folder=folder)
    exact_dedup.mark_files(spark, [first], digest=weak, folder=folder)
    marks = sorted((tuple(r) for r in exact_dedup.marks_so_far(spark, folder).drop("digest").collect()), key=repr)
    assert marks == sorted((r[:4] for r in expected(ROWS + LATER)), key=repr)


def test_frames_on_one_folder(spark):
    folder = scratch_path(spark, "met")
    for _ in range(2):
        rows = exact_dedup.mark_duplicates(frame(spark, [(1, "a"), (2, "A")]), folder=folder)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows.collect()) == [(1, 2, 4), (2, 2, 4)]
    assert exact_dedup.marks_so_far(spark, folder).where("kept").count() == 1


def test_kept_rows_have_all_columns_of_any_name(spark):
    rows = [(1, "a", 1, 2, 3), (2, "A", 4, 5, 6), (2, "A", 4, 5, 6), (None, None, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, place int, `_metadata` int")
    docs = docs.withColumn("a.b", F.lit(1))
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == [(2, "A", 4, 5, 6, 1), (None, None, 7, 8, 9, 1)]


def test_a_table_as_it_stands_is_not_written_again(spark):
    path = written(spark, ROWS)
    table = spark.read.parquet(path)
    assert exact_dedup.own_path(table).endswith(path.rpartition("/")[2])
    for other in (table.where("doc_id > 3"), table.withColumn("text", F.lower("text")), table.union(table), frame(spark, ROWS),
                  table.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))):
        assert exact_dedup.own_path(other) is None
    kept = sorted((r[0], r[4]) for r in expected(ROWS) if r[3] and r[0] is not None)
    rows = exact_dedup.drop_duplicates(table).where("doc_id is not null").select("doc_id", "text").collect()
    assert sorted((r.doc_id, hashlib.sha256(low(r.text).encode()).hexdigest()) for r in rows) == kept
