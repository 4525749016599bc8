"""Periodic runs against all stretches of every period, and the query against a plain reading of its contract."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from specloom.llm import periodic_runs
from specloom.llm.periodic_runs import collapse_runs, find_runs
from specloom.llm.queries import op12_periodic_runs, with_planted_runs


def plain_runs(words, least, periods):
    """Maximal stretches of every period, each with its smallest one."""
    n, found = len(words), {}
    for p in range(1, n // periods + 1):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j > i:
                start, length = i - p, j - i + p
                if length >= max(least, periods * p):
                    found.setdefault((start, length), p)
            i = j + 1
    return sorted((s, l, p) for (s, l), p in found.items())


def collapsed(words, runs):
    gone = {i for s, l, p in runs for i in range(s + p, s + l)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_text(rng):
    words = []
    while len(words) < rng.choice([0, 5, 40, 150, 400]):
        part = [rng.choice("abcd") for _ in range(rng.randint(1, rng.choice([2, 9, 40])))]
        words += part * rng.choice([1, 1, 2, 3, 7, 30]) + part[: rng.randint(0, len(part))]
    return words


@pytest.mark.parametrize("least,periods", [(24, 3), (1, 3), (7, 3), (24, 4), (30, 5), (100, 3)])
def test_runs_of_random_texts(least, periods):
    rng = random.Random(least * 10 + periods)
    texts = [random_text(rng) for _ in range(150)]
    codes = np.array([ord(w) for t in texts for w in t])
    bounds = np.cumsum([0, *map(len, texts)])
    found = {}
    for text, *run in zip(*find_runs(codes, bounds, least, periods)):
        found.setdefault(int(text), []).append(tuple(map(int, run)))
    for i, text in enumerate(texts):
        assert found.get(i, []) == plain_runs(text, least, periods), text
    assert len(found) > 20


def test_frequent_words_do_not_cost_their_square():
    # Blocks of one word, and one word alone: every earlier occurrence of it would be 10**10 pairs.
    codes = np.array(([0] * 999 + [1] + [0] * 998 + [2]) * 100 + [0] * 200_000)
    found = list(zip(*find_runs(codes, np.array([0, len(codes)]))))
    assert (0, 0, 1999 * 100 + 999, 1999) in found and (0, 1999 * 100, 200_000, 1) in found


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLAB_WORDS", 200)
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a " * 30, "a\x0bb\x0cc\rd\te\n" * 9 + "é " * 24, "w" * 200_000 + " x" * 24]
    texts += [" ".join(random_text(rng)) for _ in range(40)]
    texts += [texts[3], "Ab ab " * 12, " ".join("ab") + " " + "  " * 24]
    rows = [(i if i != 7 else None, t, "x", 1, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int, collapsed string")
    found = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in collapse_runs(docs).collect()), key=repr)
    expected = []
    for i, text, *_ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        runs = plain_runs(words, 24, 3)
        expected.append((i, len(words), runs, collapsed(words, runs)))
    assert found == sorted(expected, key=repr)
    assert collapse_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        find_runs(np.array([1]), np.array([0, 1]), 24, 2)


def expected_rows(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 24, 3)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{l},{p}\n" for s, l, p in runs)), sha(collapsed(words, runs)))


def test_query_on_the_smallest_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = sorted(tuple(r) for r in op12_periodic_runs(spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert found == sorted(expected_rows(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in found) > 5


def test_planted_runs_of_odd_rows(spark):
    rows = [(None, "a b"), (3, None), (4, ""), (5, " \n"), *((i, "one  two three four five six seven") for i in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, collapse_runs(with_planted_runs(docs), 1, 3).select("doc_id", "n_words", "runs").collect()), key=repr)
    expected = []
    for i, text in rows:
        words, h = (text or "").split(), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(len(words))]
        expected.append((i, len(words), plain_runs(words, 1, 3)))
    assert found == sorted(expected, key=repr)
