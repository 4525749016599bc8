"""The graph index against all cosines."""

import math

import numpy as np
import pytest

from specloom.llm import hnsw
from specloom.llm.queries import op1_nearest_neighbours

SF_DIR = "/root/testdata/sf0.01"


def nearest(rows, asked, k):
    """rows, asked: (id, vector); {id: [(rank, id, score)]} over all rows."""
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], float)
    norm = np.linalg.norm(matrix, axis=1)
    out = {}
    for q, v in asked:
        v = np.array(v, float)
        score = matrix @ v / (norm * np.linalg.norm(v))
        other = np.flatnonzero(ids != q)
        order = other[np.lexsort((ids[other], -score[other]))][:k]
        out[q] = [(r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return out


def results(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def recall(found, expected):
    pairs = {(q, i) for q, v in expected.items() for _, i, _ in v}
    return len(pairs & {(q, i) for q, v in found.items() for _, i, _ in v}) / len(pairs)


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    found = results(op1_nearest_neighbours(spark, SF_DIR))
    expected = nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert set(found) == set(expected) and recall(found, expected) >= 0.95
    exact = dict(rows)
    for q, hits in found.items():
        assert [r for r, _, _ in hits] == [1, 2, 3, 4, 5]
        for _, i, score in hits:
            a, b = np.array(exact[q], float), np.array(exact[i], float)
            assert score == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_recall_over_shards(spark):
    rng = np.random.RandomState(1)
    centres = rng.normal(size=(20, 24))
    rows = [(i * 3, (centres[i % 20] + 0.6 * rng.normal(size=24)).tolist()) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = hnsw.build_index(vectors, neighbours=10, shard_entries=600)
    asked = rows[::40]
    found = results(hnsw.search(index, vectors.where("vec_id % 120 = 0"), 10))
    assert index.count() == 5 and recall(found, nearest(rows, asked, 10)) > 0.95


def test_copies_ties_and_unusable_vectors(spark):
    base = [1.0, 2.0, 2.0]
    rows = [(i, base) for i in range(0, 300)] + [
        (400, [2.0, 1.0, -1.0]), (401, None), (402, []), (403, [0.0, 0.0, 0.0]), (404, [1.0, None, 1.0]),
        (405, [float("nan"), 1.0, 1.0]), (406, [float("inf"), 1.0, 1.0]), (None, base), (7, base), (500, [1.0, 0.0]),
        (550, [3.0, 4.0]), (600, [1e200, 1e200, 0.0]),
    ]
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, members string, dim int")
    found = results(hnsw.search(hnsw.build_index(vectors), vectors.where("vec_id % 50 = 0")))
    assert set(found) == {0, 50, 100, 150, 200, 250, 400, 500, 550, 600}
    assert [i for _, i, _ in found[0]] == [1, 2, 3, 4, 5] and [i for _, i, _ in found[250]] == [0, 1, 2, 3, 4]
    assert all(s == pytest.approx(1.0) for _, _, s in found[50])
    assert [(r, i) for r, i, _ in found[500]] == [(1, 550)] and [(r, i) for r, i, _ in found[550]] == [(1, 500)]
    assert [i for _, i, _ in found[400]] == [600, 0, 1, 2, 3] and found[400][0][2] == pytest.approx(3 / math.sqrt(12))
    none = vectors.limit(0)
    assert hnsw.search(hnsw.build_index(none), none).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_small_graphs_find_everything(n):
    unit = hnsw._unit(np.random.RandomState(n).normal(size=(n, 5)))
    graph = hnsw.build(unit)
    view, near = graph.search(unit, 50)
    for i in range(n):
        assert sorted(view[i][view[i] >= 0].tolist()) == list(range(n)) and view[i][0] == i


def test_many_shards_in_few_tasks_and_shards_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 16)
    monkeypatch.setattr(hnsw, "TASK_BLOCKS", 2)
    monkeypatch.setattr(hnsw, "MOST_TASKS", 7)
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 200 * 8 * 16)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.RandomState(2).normal(size=(3000, 16)))]
    # One id has a third of the queries' vectors.
    rows = [(0 if i % 150 == 0 else i, v) for i, v in rows]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = hnsw.build_index(vectors, shard_entries=1000)
    shards = index.select("dim", "shard", "n").collect()
    assert len(shards) == len(set(shards)) == 15 and sum(r.n for r in shards) == 3000
    found = results(hnsw.search(index, vectors.where("vec_id % 50 = 0")))
    asked = [r for r in rows if r[0] % 50 == 0 and r[0]]
    assert set(found) == {i for i, _ in asked} | {0}
    assert recall({q: v for q, v in found.items() if q}, nearest(rows, asked, 5)) >= 0.9
    assert [r for r, _, _ in found[0]] == [1, 2, 3, 4, 5]


def test_shards_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARDS", 3)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.RandomState(3).normal(size=(900, 4)))]
    vectors = spark.createDataFrame(rows + [(5000, [1.0])], "vec_id long, embedding array<double>")
    assert sorted(r["dim"] for r in hnsw.build_index(vectors, shard_entries=10).collect()) == [1, 4, 4, 4]
