"""Ranked search against scores of every document for every item, and against SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from checks.compare import connect, difference, spark_result, sql_result
from specloom.llm import bag_search
from specloom.llm.bag_search import ItemBlock, rank_documents
from specloom.llm.queries import SQL, op13_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or ""))


def ranked(docs, items, top):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, bag, sum(bag.values())) for i, bag in bags if bag]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for i, bag, n in bags:
            m = 75 + 25 * n * n_docs // n_terms
            score = 0
            for t, times in terms(text).items():
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def check(spark, docs, items, top):
    left = spark.createDataFrame([(*d, 0, "x", 1) for d in docs], "doc_id long, text string, rank int, score string, item_id int")
    right = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id int")
    found = sorted(map(tuple, rank_documents(left.repartition(3), right, top).collect()), key=repr)
    assert found == sorted(ranked(docs, items, top), key=repr)
    return found


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 13, 512, 1024), (40, 9, 3, 4), (1 << 20, 2, 512, 1024)])
def test_scores_of_all_documents(spark, monkeypatch, limits):
    for name, limit in zip(("ITEM_BYTES", "ITEM_ROWS", "BLOCK_CLASSES", "BLOCK_TERMS"), limits):
        monkeypatch.setattr(bag_search, name, limit)
    rng = random.Random(11)
    words = ["Alpha", "beta", "GAMMA", "delta", "é", "x1", "zz", "rare", "other", "more"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(60)]
    # Copies, the same bag in another order, and texts with the same item terms but other words.
    texts += texts[:20] + ["beta alpha", "alpha, Beta", "alpha beta"] * 9 + [None, "", "...", "nothing here", "q" * 100_000]
    docs = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    items = [
        (1, "alpha"), (2, "beta alpha beta"), (3, None), (4, "--"), (5, "absent words"), (6, "é é x1 zz rare"), (None, "gamma"),
        (7, "delta delta"), (7, "delta delta"), (8, " ".join(words)),
    ]
    found = check(spark, docs, items, 20)
    assert {r[0] for r in found} == {1, 2, 6, 7, 8, None}


def test_a_large_class_fills_all_ranks_in_order_of_id(spark):
    docs = [(i, "same words") for i in range(500, 0, -1)] + [(i, "same words") for i in range(1, 4)] + [(0, "same")]
    check(spark, docs, [(1, "words"), (2, "same same")], 5)


def test_repeated_items_are_scored_once_and_listed_each(spark, monkeypatch):
    scored = []
    monkeypatch.setattr(bag_search, "score_classes", lambda c, items, *rest, of=bag_search.score_classes: scored.extend(items) or of(c, items, *rest))
    items = [(1, "one two")] * 300 + [(None, "two")] * 3 + [(2, "one two")]
    found = check(spark, [(i, "one two three"[: 7 + i % 7]) for i in range(8)], items, 5)
    assert len(found) == 304 * 5 and sorted(scored, key=repr) == [(1, 300), (2, 1), (None, 3)]


def test_nothing_to_rank(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert rank_documents(docs.limit(0), items).collect() == [] == rank_documents(docs, items.limit(0)).collect()
    # One document holds the only term: ln(4 / 3) is above 0.
    assert [tuple(r)[:3] for r in rank_documents(docs, items).collect()] == [("i", 1, 1)]


def test_sums_beyond_doubles_stay_exact():
    weights = np.array([40_000, 3])
    block = ItemBlock([0], [{0: 10**7, 1: 1}], weights, 2)
    assert block.values.dtype == np.int64
    scores = block.scores(np.array([0, 0]), np.array([0, 1]), np.array([999_999, 999_999]), 1)
    assert scores.tolist() == [[40_000 * 10**7 * 999_999 + 3 * 999_999]]


def test_query_agrees_with_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = spark_result(op13_lexical_search(spark, sf_dir))
    assert difference(found, sql_result(connect(sf_dir), SQL["op13_lexical_search"])) is None
    assert len(found[1]) > 500
