"""Suffix arrays against sorting, and the removal of repeats against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest

from specloom.llm import suffix_dedup
from specloom.llm.suffix_dedup import remove_repeats
from specloom.llm.suffix_order import suffix_array


@pytest.mark.parametrize("top", [0, 1, 2, 6])
def test_suffix_arrays(top):
    rng = random.Random(top)
    for _ in range(400):
        text = [rng.randint(0, top) for _ in range(rng.randint(0, 60))]
        assert suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_repeats():
    for text in ([3] * 200, [0, 1] * 100, [1, 0] * 100, [0, 0, 1] * 60 + [2], [5, 4, 5, 4, 4] * 40):
        assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def expected(rows, length):
    """rows: (id, text), ids unique and ascending."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            window = raw[s : s + length]
            if window in seen:
                gone[s : s + length] = True
            seen.add(window)
        rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(raw), int(gone.sum()), runs, rest.decode("utf-8", "ignore"), hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed, n=70):
    rng = random.Random(seed)
    words = ["ab", "b", "ça", "long", "er", "the", "漢"]
    prose = lambda k: " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(k))
    passages = [prose(rng.randint(5, 60)) for _ in range(6)] + ["x" * 70, "ab" * 90]
    texts = [None, "", "a" * 39, "a" * 40, "a" * 41, "a" * 900, "abc" * 300]
    for _ in range(n):
        parts = [prose(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p))
            parts += [rng.choice([p, p[cut:], p[:cut]]), prose(rng.randint(0, 6))]
        texts.append(rng.choice(["", " "]).join(parts))
    texts += rng.sample(texts, 5)
    rng.shuffle(texts)
    return [(i * 2 - 30, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, key int, n_spans string")


@pytest.mark.parametrize("seed, length, large", [(1, 40, None), (2, 47, None), (3, 100, None), (4, 40, 1), (5, 101, 3), (6, 64, None)])
def test_every_repeated_byte_goes(spark, monkeypatch, seed, length, large):
    if large is not None:
        monkeypatch.setattr(suffix_dedup, "GROUP_SEGMENTS", large)
    rows = corpus(seed)
    found = remove_repeats(frame(spark, rows).repartition(5), length).collect()
    assert sorted(map(tuple, found)) == expected(rows, length)


def test_null_and_equal_ids(spark):
    a, b = "first passage " * 12, "second, other passage " * 9
    rows = [(3, a), (3, a), (None, b), (5, b + a), (3, "short")]
    found = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in remove_repeats(frame(spark, rows), 100).collect()))
    alone = {t: x[2] for t, x in zip((a, b), expected([(1, a), (2, b)], 100))}
    both = expected([(1, b), (2, a), (3, b + a)], 100)[2][2]
    assert found == sorted([(True, 3, len(a), alone[a])] * 2 + [(False, 0, len(b), alone[b]), (True, 5, len(a + b), both), (True, 3, 5, 0)])
    assert remove_repeats(frame(spark, rows).limit(0), 100).collect() == []


def test_long_texts_are_cut_with_all_their_windows(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLAB_BYTES", 50)
    raw = np.random.RandomState(0).randint(0, 4, 1000).astype(np.uint8)
    windows = []
    for base, lo, part, inner in suffix_dedup._cut(raw, np.array([0, 30, 1000]), 40):
        _, _, text, first, last, _ = suffix_dedup.segments(part, inner, 40)
        windows += [(base + t, lo + w) for t, a, b in zip(text, first, last) for w in range(a, b + 1)]
    assert sorted(windows) == [(1, i) for i in range(1000 - 30 - 40 + 1)]
