"""Benchmark windows against a plain reading of them, and against SQL."""

import random
import re

import pytest

from checks.compare import connect, difference, spark_result, sql_result
from specloom.llm import decontamination, plain_words
from specloom.llm.decontamination import Scanner, find_overlaps, item_windows
from specloom.llm.queries import SQL, op11_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text, items, window):
    found = list(WORD.finditer(lowered(text)))
    words = [m.group() for m in found]
    hit, names = set(), set()
    for item, body in items:
        own = WORD.findall(lowered(body))
        size = min(len(own), window)
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit |= set(range(j, j + size))
                    names.add(item)
    names.discard(None)
    spans = []
    for j in sorted(hit):
        if j - 1 in hit:
            spans[-1][1] = found[j].end()
        else:
            spans.append([found[j].start(), found[j].end()])
    return len(words), len(hit), sorted(names), [tuple(s) for s in spans]


ITEMS = [
    (1, "One two THREE four five"), (2, "two-three"), (3, None), (4, "  ... "), (5, "ünï Ünï"), (6, "x"), (None, "five six"),
    (7, "two-three"), (2, "seven eight nine ten"), (8, "a b a b a b a b"),
]
TEXTS = [
    None, "", "...", "one two three four five", "ONE,two;three four-five six", "twothree", "two  three two three", "x", "xx x X",
    "ünï ünï Ünï", "0 seven eight nine ten", "a b " * 40, "one two three " * 3, "word " * 3000 + "two three " + "word " * 3000,
    "y" * 200_000 + " two three", "two three",
]


@pytest.mark.parametrize("limit", [1 << 20, 12])
@pytest.mark.parametrize("window", [3, 10])
def test_windows_as_read_plainly(spark, monkeypatch, limit, window):
    monkeypatch.setattr(decontamination, "ITEM_BYTES", limit)
    docs = spark.createDataFrame(
        [(i if i != 5 else None, t, 0, "s", "i") for i, t in enumerate([*TEXTS, TEXTS[4]])],
        "doc_id int, text string, n_words int, spans string, items string",
    )
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    found = sorted(
        ((r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in find_overlaps(docs, items, window).collect()), key=repr
    )
    assert found == sorted(((r.doc_id, *plain(r.text, ITEMS, window)) for r in docs.collect()), key=repr)


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id string, text string")
    assert [tuple(r) for r in find_overlaps(docs, items).collect()] == [(1, 2, 0, [], [])]
    assert find_overlaps(docs.limit(0), items).collect() == []
    with pytest.raises(ValueError):
        find_overlaps(docs, items, 0)


def test_pieces_of_any_size_give_the_same(monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for i in range(12)]
    scanner = Scanner(item_windows(items, 4))
    texts = ["".join(rng.choice(["a", "b", "c", " ", ".", "dd "]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    whole = [scanner.scan(t.encode()) for t in texts]
    for size in (1, 7, 30):
        monkeypatch.setattr(decontamination, "word_pieces", lambda t, table, s=size: plain_words.word_pieces(t, table, s))
        assert [scanner.scan(t.encode()) for t in texts] == whole
    for text, (n, owners, hits) in zip(texts, whole):
        covered = sum(b - a + 1 for a, b in decontamination.covered(hits))
        assert (n, covered, sorted(owners)) == plain(text, items, 4)[:3]


def test_a_text_full_of_occurrences_holds_stretches_only(monkeypatch):
    held = []
    monkeypatch.setattr(decontamination, "word_pieces", lambda t, table: plain_words.word_pieces(t, table, 1000))
    monkeypatch.setattr(decontamination, "covered", lambda hits, of=decontamination.covered: held.append(len(hits)) or of(hits))
    n, owners, hits = Scanner(item_windows([(1, "a b a b a b"), (2, "b a")], 4)).scan(b"a b " * 50_000)
    assert (n, owners, hits) == (100_000, {1, 2}, [(0, 99_999)])
    assert len(held) == 200 and max(held) < 1500


def test_repeated_items_are_brought_together_once(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(decontamination, "item_windows", lambda items, n, of=decontamination.item_windows: taken.extend(items) or of(items, n))
    docs = spark.createDataFrame([(1, "x one two y")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "one two")] * 200 + [(None, "one two"), (6, "one two")], "item_id long, text string")
    assert [tuple(r)[:4] for r in find_overlaps(docs, items).collect()] == [(1, 4, 2, [5, 6])]
    assert sorted(taken, key=repr) == [(5, "one two"), (6, "one two"), (None, "one two")]


def test_query_agrees_with_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = spark_result(op11_decontamination(spark, sf_dir))
    assert difference(found, sql_result(connect(sf_dir), SQL["op11_decontamination"])) is None
    assert sum(r[0] for r in found[1]) > 0
