"""The Jaccard join and its components against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from specloom.llm import ngram_join
from specloom.llm.words import text_buffers
from specloom.llm.components import component_roots
from specloom.llm.ngram_join import link_documents
from specloom.llm.shingles import shingle_sets
import pyarrow as pa


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def set_of(text, k):
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def components(rows, k, percent):
    sets = [set_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, copies=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "Été", "A"]
    texts = [None, "", " \n", "one", "ONE", "one two", "one two", "a b c", "A b\tc", "the of the of the of", "x " * 500]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 30, 60, 120]))
        for _ in range(rng.randint(1, copies)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    line = " ".join(rng.choices(vocabulary, k=12))
    texts += [f"{line} {' '.join(rng.choices(vocabulary, k=n))}" for n in range(0, 40)]
    rng.shuffle(texts)
    return [(i * 3 % 10007, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, n int, node string")


@pytest.mark.parametrize("seed, k, percent, block", [(1, 3, 90, 1024), (2, 3, 90, 8), (3, 5, 80, 1024), (4, 2, 60, 16)])
def test_components_of_all_pairs(spark, seed, k, percent, block):
    rows = corpus(seed)
    found = link_documents(frame(spark, rows).repartition(4), k, percent, block_sets=block).collect()
    assert sorted(map(tuple, found), key=repr) == components(rows, k, percent)


def test_frequent_words_only_change_the_order(spark, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(ngram_join, "KNOWN_WORDS", 3)
    found = link_documents(frame(spark, rows), 3, 90).collect()
    assert sorted(map(tuple, found), key=repr) == components(rows, 3, 90)


def test_null_and_equal_ids(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(None, text), (4, text), (4, text), (4, "other words here"), (None, None), (9, text + " end"), (9, None)]
    found = link_documents(frame(spark, rows), 3, 90).collect()
    assert sorted(map(tuple, found), key=repr) == components(rows, 3, 90)
    assert link_documents(frame(spark, rows).limit(0), 3, 90).collect() == []


def test_sets_of_texts():
    texts = ["", None, "a b c d a b c", "one", "A  B", "é È x", "w " * 1000, "\t", "z" * 5000 + " y x"]
    sets = list(shingle_sets(*text_buffers(pa.array(texts, pa.string())), 3))
    assert [len(s) for s in sets] == [len(set_of(t, 3)) for t in texts]
    assert all((np.diff(s.view(np.uint64).astype(object)) > 0).all() for s in sets if len(s) > 1)
    again = list(shingle_sets(*text_buffers(pa.array(["q", "a b", "A B C D A B C"])), 3))
    assert (again[2] == sets[2]).all() and again[1][0] == sets[4][0]


@pytest.mark.parametrize("size", [1, 2, 9, 10, 11, 100])
def test_linked_sets_share_a_prefix_shingle(size):
    for percent in (50, 80, 90, 100):
        prefix = ngram_join.prefix_length(size, percent)
        # A partner that misses all of a prefix shares too little, whatever its size.
        assert 100 * (size - prefix) < percent * size


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_counts_never_part_sets_that_link(percent):
    rng = np.random.RandomState(percent)
    base = rng.randint(0, 2**62, 400).astype(np.uint64) * np.uint64(4)
    sets = [np.unique(np.concatenate([rng.choice(base, k, replace=False), rng.randint(0, 2**62, m).astype(np.uint64)]))
            for k, m in zip(rng.randint(150, 400, 40), rng.randint(1, 60, 40))] + [np.arange(5000, dtype=np.uint64)]
    raw = [ngram_join._part_counts(x) for x in sets]
    assert raw[-1] is None
    known = np.array([c is not None for c in raw])
    counts = np.frombuffer(b"".join(c or bytes(512) for c in raw), np.uint8).reshape(len(raw), -1)
    size, block = np.array([len(x) for x in sets]), rng.randint(0, 2, len(sets))
    linked = np.zeros(len(sets), bool)
    for i in range(len(sets)):
        for j in range(len(sets)):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if block[i] != block[j] and 100 * shared >= percent * (size[i] + size[j] - shared):
                linked[i] = True
    assert not (linked & ~ngram_join.partners(counts, known, size, block, percent)).any()


def test_component_roots(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 400)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    root = {n: n for e in edges for n in e}
    for _ in range(500):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    found = {r.node: r.root for r in component_roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    touched = {n for u, v in edges if u != v for n in (u, v)}
    assert found == {n: root[n] for n in touched}
    assert component_roots(spark.createDataFrame([], "u long, v long")).collect() == []


def test_unlike_groups_of_one_name_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_BITS", 1)
    rows = [(2 * i + k, " ".join(f"{i}w{j}" for j in range(60 + k))) for i in range(12) for k in (0, 1)]
    found = link_documents(frame(spark, rows).coalesce(1), 3, 90).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in found) and len(found) == 24


def test_long_words_whose_sums_agree_stay_apart(spark):
    # Two complementary Thue-Morse words: all sums of their bytes by powers of an odd base modulo 2**64 agree.
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    texts = [one, other, f"{one} x y", f"{other} x y", one.upper(), f"z {other}", "A" * 70, "a" * 70, "a" * 71]
    rows = list(enumerate(texts))
    for words, percent in ((3, 90), (5, 80), (1, 50)):
        found = link_documents(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
        assert sorted(map(tuple, found), key=repr) == components(rows, words, percent)
