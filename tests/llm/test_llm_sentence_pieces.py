"""The window search against a whole-text search and against the sentencepiece library; exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from specloom.llm import sentence_pieces
from specloom.llm.sentence_pieces import MARK, PieceIds, Vocabulary, decode_pieces, encode_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "a", " ", "   ", "Hello world", " two  spaces  and   three", "tabs\tand\nlines \n", "naïve café 漢字 😀 ‍", "mark " + MARK + " " + MARK,
    "", "the " * 900, "x" * 5000, "=" * 700, "1234567890" * 30, "Ünïcode ẞ ", "\x00\x01 control", "-- == ## //" * 40,
]


@pytest.fixture(scope="module")
def known():
    return Vocabulary(PATH)


def whole_search(vocabulary, text):
    """The best sum of scores, over the whole text at once."""
    spelled = vocabulary.escaped(" " + text)
    best = [0.0] + [-float("inf")] * len(spelled)
    for i in range(len(spelled)):
        for size in range(1, min(vocabulary.longest, len(spelled) - i) + 1):
            hit = vocabulary.pieces.get(spelled[i : i + size])
            if hit:
                best[i + size] = max(best[i + size], best[i] + hit[1])
        if spelled[i] not in vocabulary.pieces:
            best[i + 1] = max(best[i + 1], best[i] + vocabulary.unknown_score)
    return best[-1]


def score_of(vocabulary, ids):
    scores = {i: s for i, s in vocabulary.pieces.values()}
    total, left = 0.0, 0
    for i in ids:
        if i in scores:
            total += scores[i]
        elif left:
            left -= 1
        else:
            # The first byte says how many more belong to the unknown character.
            byte = vocabulary.byte_ids.index(i)
            left = 0 if byte < 0x80 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
            total += vocabulary.unknown_score
    return total


@pytest.mark.parametrize("text", TEXTS)
def test_best_score_and_round_trip(known, text):
    ids = known.encode(text)
    assert known.decode(ids) == text
    assert score_of(known, ids) == whole_search(known, text)


@pytest.mark.parametrize("seed", range(6))
def test_small_vocabularies(seed):
    rng = random.Random(seed)
    alphabet = "ab" + MARK
    pieces = {"".join(rng.choices(alphabet, k=rng.randint(1, 6))): -rng.random() * 9 for _ in range(25)}
    vocabulary = Vocabulary.of(pieces)
    for _ in range(60):
        text = "".join(rng.choices("ab c", k=rng.randint(1, 300)))
        ids = vocabulary.encode(text)
        assert vocabulary.decode(ids) == text
        assert score_of(vocabulary, ids) == pytest.approx(whole_search(vocabulary, text), abs=1e-6)
        # However a text is cut into parts, its ids are the same.
        cuts = sorted(rng.sample(range(len(text) + 1), min(3, len(text))))
        parts = [(" " + text)[a:b] for a, b in zip([0, *cuts], [*cuts, len(text) + 1])]
        assert [i for run in vocabulary.search(parts) for i in run] == ids
        column = pa.array([" " + text, None, " " + text])
        found = [x[a:b].tolist() for x, edge in PieceIds(vocabulary, 64, 10).encode(column) for a, b in zip(edge, edge[1:])]
        assert found == [ids, [], ids]


def test_ids_are_committed_on_the_way(known):
    seen = []

    def parts():
        for n in range(400):
            seen.append(n)
            yield "some words without end " if n else " start"

    runs = known.search(parts())
    next(runs)
    assert len(seen) < 10
    vocabulary = Vocabulary.of({"a": -3.0, "b": -3.0, "ab": -1.0, "ba": -9.0})
    ways = list(vocabulary.search(["ab" * 2500]))
    assert len(ways) > 10 and sum(map(len, ways)) == 2500
    # Two ways that never meet wait for the end.
    vocabulary = Vocabulary.of({"a": -9.0, "aa": -1.0})
    assert [len(w) for w in vocabulary.search(["a" * 5000])] == [2500]


def as_unigram(raw: bytes) -> bytes:
    """The model file with its kind of model (field 3 of the trainer's settings, field 2 of the file) set to unigram."""

    def number(at):
        value = shift = 0
        while True:
            value |= (raw[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 0x80:
                return value, at

    def fields(at, end):
        while at < end:
            tag, after = number(at)
            size = 0
            if tag & 7 == 2:
                size, after = number(after)
            elif tag & 7 == 0:
                _, stop = number(after)
                size = stop - after
            else:
                size = 8 if tag & 7 == 1 else 4
            yield tag, after, after + size
            at = after + size

    out = bytearray(raw)
    for tag, a, b in fields(0, len(raw)):
        if tag == 2 << 3 | 2:
            for inner, c, _ in fields(a, b):
                if inner == 3 << 3:
                    out[c] = 1
    return bytes(out)


def test_scores_of_the_library_for_a_unigram_model(known, tmp_path):
    """The library's search over a lattice finds as good a segmentation, of the same pieces where only one is best."""
    path = tmp_path / "unigram.model"
    with open(PATH, "rb") as file:
        path.write_bytes(as_unigram(file.read()))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng = random.Random(4)
    words = "the of and running unbelievable naïve café Zürich foo bar segmentation lattices a I".split()
    same = 0
    for _ in range(80):
        text = " ".join(rng.choices(words, k=8)) + rng.choice(["", ".", " end"])
        mine, theirs = known.encode(text), library.nbest_encode_as_ids(text, 3)[0]
        assert score_of(known, mine) == score_of(known, theirs), text
        assert library.decode(mine) == text
        same += mine == theirs
    assert same > 40


def test_documents(spark, known):
    texts = [None, "", *TEXTS, TEXTS[3], "long text " * 30_000]
    rows = [(i if i != 4 else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    encoded = encode_pieces(docs, PATH)
    found = sorted(map(tuple, decode_pieces(encoded, PATH).collect()), key=repr)
    expected = []
    for i, t, _, _ in rows:
        ids = known.encode(t or "")
        expected.append((i, len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), t or ""))
    assert found == sorted(expected, key=repr)
    assert decode_pieces(encode_pieces(docs.limit(0), PATH), PATH).collect() == []


LIBRARY_TEXTS = [t for t in TEXTS if MARK not in t] + [
    "Unbelievable segmentations, e.g. internationalisation!", "ab" * 4000 + "===" * 3000 + "漢字かな交じり" * 300, "a\u0301é ﬁ  \u00a0x\u3000y",
]


def merging():
    return sentence_pieces.merges(PATH)


@pytest.mark.parametrize("text", LIBRARY_TEXTS)
def test_merges_are_those_of_the_library(known, text):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for slab in (64, 1 << 20):
        words = PieceIds(known, slab, 1000, merging())
        ids, edge = next(words.encode(pa.array([" " + text if text else ""])))
        assert ids.tolist() == library.encode(text) and edge.tolist() == [0, len(ids)]


def test_the_registered_query_gives_the_ids_of_the_library(spark, tmp_path):
    from specloom.llm.queries import op10_sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [None, *LIBRARY_TEXTS, MARK]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in op10_sentencepiece(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts[:-1]):
        ids = library.encode(text or "")
        assert (found[i].n_tokens, found[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))
    assert found[len(texts) - 1].n_bytes == len(MARK.encode())


def test_the_kind_of_model_decides(known, tmp_path):
    path = tmp_path / "unigram.model"
    with open(PATH, "rb") as file:
        path.write_bytes(as_unigram(file.read()))
    assert merging() is not None and sentence_pieces.merges(str(path)) is None


def test_user_defined_pieces_are_taken_whole():
    vocabulary = Vocabulary.of({MARK: -9.0, "a": -8.0, "b": -7.0, "ab": -1.0, "aba": 0.0, "bb": -2.0})
    pieces = {i: p for p, (i, _) in vocabulary.pieces.items()}
    spell = lambda m, t: [pieces[i] for i in m.encode_word(t)]
    assert spell(sentence_pieces.Merges(vocabulary), "abab") == ["aba", "b"]
    assert spell(sentence_pieces.Merges(vocabulary), "abbb") == ["ab", "bb"]
    assert spell(sentence_pieces.Merges(vocabulary, ["aba"]), "aabab") == ["a", "aba", "b"]


def test_short_and_long_runs_merge_alike(known):
    merging = sentence_pieces.merges(PATH)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices("theionrsa▁é=.", k=rng.randint(1, 60)))
        assert merging._merged_short(list(text)) == merging._merged_long(list(text))
