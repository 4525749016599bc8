"""Language identification: held-out accuracy, odd texts, and vectors against a plain computation."""

import math
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from specloom.llm import language_id
from specloom.llm.queries import op2_language_id

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language_id.learn(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = op2_language_id(spark, SF_DIR).join(docs, "doc_id").collect()
    unseen = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(unseen) > 200
    assert sum(r.lang == r.lang_pred for r in unseen) > 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) < 0.01 * len(rows)


def test_odd_texts(spark, model):
    texts = [None, "", "12 !?", "the", "漢字仮名交じり文の例文です。" * 40, "the of and " * 400_000, "ünter ß", "the", "퟿"]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    rows = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and all(rows[i].rejected and rows[i].score == 0 for i in range(3))
    assert rows[3].lang_pred == "en" and not rows[3].rejected and rows[3][1:] == rows[7][1:]
    assert rows[4].rejected and rows[4].lang_pred in model.languages
    assert rows[5].lang_pred == "en" and rows[6].lang_pred == "de"
    assert language_id.predict(docs.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, "en"), (3, "7", "en")], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert model.languages == []
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()} == {("und", 0.0)}


def grams(text):
    padded, out = f" {text} ", Counter()
    for i in range(len(padded)):
        mixed = ord(padded[i])
        for n in range(2, 4):
            if i + n > len(padded):
                break
            mixed = (mixed * 0x01000193 + ord(padded[i + n - 1]) + n) % 2**32
            out[mixed * 0x9E3779B1 % 2**32 >> 19] += 1
    return out


@pytest.mark.parametrize("slab", [1 << 20, 50])
def test_counts_of_whole_texts(monkeypatch, slab):
    monkeypatch.setattr(language_id, "SLAB_CHARS", slab)
    texts = ["", "a", "ab", "the quick brown fox " * 20, "ß é 漢", "x" * 333]
    found = {}
    for a, b, counts in language_id.gram_counts(texts):
        for i in range(a, b):
            found[i] = {int(k): int(counts[i - a][k]) for k in np.flatnonzero(counts[i - a])}
    assert [found[i] for i in range(len(texts))] == [dict(grams(t)) for t in texts]


def test_unit_vectors():
    counts, idf = np.array([[2, 0, 1], [0, 0, 0]], np.float32), np.array([1.0, 5.0, 3.0], np.float32)
    a, b = 1 + math.log(2), 3.0
    assert np.allclose(language_id.unit_vectors(counts, idf), [[a / math.hypot(a, b), 0, b / math.hypot(a, b)], [0, 0, 0]])


def plain_prediction(model, text):
    """Language, cosine and rejection, gram by gram and centroid by centroid."""
    letters = regex.sub(r"[^\p{L}\p{M}]+", " ", (text or "").lower()).strip(" ")
    if not regex.search(r"\p{L}", text or ""):
        return "und", 0.0, True
    counts = grams(letters)
    weight = {k: (1 + math.log(n)) * float(model.idf[k]) for k, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weight.values())) or 1.0
    cosines = [sum(w / norm * float(c[k]) for k, w in weight.items()) for c in model.centroids]
    best = max(range(len(cosines)), key=lambda j: (cosines[j], -j))
    step = min(language_id.SIZE_STEPS - 1, int(2 * math.log2(max(1, len(counts)))))
    return model.languages[model.owner[best]], min(1.0, max(0.0, cosines[best])), cosines[best] < model.floors[best, step]


def odd_and_real(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(None, rows[0][1], "en"), rows[1], rows[1], (9001, None, "en"), (9002, "12 !", None), (9003, "漢字仮名 " * 90, None)]
    rows += [(9004, "x y", "en"), (9005, "ок это русский текст " * 20, None), (9006, "The OF and", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), rows


def test_predictions_and_the_stage_against_brute_force(spark):
    docs, rows = odd_and_real(spark)
    known = language_id.learn(docs)
    expected = [(r, plain_prediction(known, r[1])) for r in rows]
    found = language_id.predict(docs, known).collect()
    by_id = lambda pairs: sorted(pairs, key=repr)
    assert by_id([(g.doc_id, g.lang_pred, round(g.score, 4), g.rejected) for g in found]) == by_id(
        [(r[0], lang, round(score, 4), rejected) for r, (lang, score, rejected) in expected]
    )
    kept = language_id.keep_known(docs.withColumn("_letters", F.lit(1)).withColumn("_ANY", F.lit("a")), known)
    assert kept.columns == ["doc_id", "text", "lang", "_letters", "_ANY"]
    assert by_id([tuple(r)[:3] for r in kept.collect()]) == by_id([r for r, (_, _, rejected) in expected if not rejected])
    assert any(rejected and r[1] for r, (_, _, rejected) in expected)
