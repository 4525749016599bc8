"""SentencePiece vocabularies: encoding by merges or by a Viterbi search over a moving window, and decoding.

A model file says which of the two it was trained for. For a merging model the neighbouring symbols whose joint piece
scores most become one, the first ones where several do, until none can; see :class:`Merges`. The rest is about the search.

The best segmentation is the one whose pieces' scores add up to most. The search goes through a text once and holds only
the positions within the longest piece ahead, and the way back from them to the last committed boundary. Whenever all
ways that are still open run through one boundary, the ids up to it are committed. A character that no piece starts with
costs more than any piece and becomes the ids of its UTF-8 bytes, or the unknown id if the vocabulary has no bytes.

As no piece goes on with a word mark after another character, the ways always meet before a word; so distinct words are
searched once and remembered. A vocabulary with other pieces is searched text by text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from specloom.llm.words import CACHE_WORDS, SLAB_BYTES, WordIds
from specloom.session import ship_package

#: Fixed value: the character that stands for a space in pieces.
MARK = "▁"
#: Fixed value: how much worse than the worst piece an unknown character is.
UNKNOWN_PENALTY = 10.0
#: Positions after which a search looks whether all its ways meet.
MEET_EVERY = 64
#: Symbols above which a run is merged with a heap and not remembered, and runs a worker remembers.
LONG_RUN, KNOWN_RUNS = 48, 1 << 18

#: Kinds of models and pieces, as model files number them.
MERGING = 2
USER_DEFINED, UNUSED = 4, 5

_vocabularies: dict[str, "Vocabulary"] = {}
_encoders: dict[tuple[str, bool], "PieceIds"] = {}


def _fields(raw: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(field, number or start, end, wire type) of a serialized message; a number has no end."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 0x80:
                return value, at

    while at < end:
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
            yield tag >> 3, value, 0, kind
        else:
            size, at = number(at) if kind == 2 else (8 if kind == 1 else 4, at)
            yield tag >> 3, at, at + size, kind
            at += size


def model_type(raw: bytes) -> int:
    """The kind of a model: 1 unigram, 2 merging, 3 words, 4 characters."""
    for field, a, b, _ in _fields(raw, 0, len(raw)):
        if field == 2:
            for inner, value, _, _ in _fields(raw, a, b):
                if inner == 3:
                    return value
    return 1


def piece_types(raw: bytes) -> list[int]:
    """The kind of each piece, 1 for an ordinary one."""
    pieces = [(a, b) for field, a, b, _ in _fields(raw, 0, len(raw)) if field == 1]
    return [next((value for field, value, _, _ in _fields(raw, a, b) if field == 3), 1) for a, b in pieces]


class Vocabulary:
    """Pieces and scores of a model file. Control, unused and unknown pieces match no text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown = model.unk_id()
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids = [-1] * 256
        self.text_of: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.text_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unused(i) or model.is_unknown(i):
                self.text_of.append(b"")
            else:
                self.pieces[piece] = i, model.get_score(i)
                self.text_of.append(piece.replace(MARK, " ").encode())
        self._finish()

    @classmethod
    def of(cls, pieces: dict[str, float], byte_fallback: bool = True) -> "Vocabulary":
        """A vocabulary from pieces and scores; id 0 is unknown, bytes follow, then the pieces."""
        made = cls.__new__(cls)
        made.unknown = 0
        made.byte_ids = [b + 1 if byte_fallback else -1 for b in range(256)]
        made.text_of = [b""] + [bytes([b]) for b in range(256)]
        made.pieces = {}
        for piece, score in pieces.items():
            made.pieces[piece] = len(made.text_of), score
            made.text_of.append(piece.replace(MARK, " ").encode())
        made._finish()
        return made

    def _finish(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        # Every beginning of a piece, with the piece's (id, score) where it is one.
        self.table: dict[str, tuple[int, float] | None] = {p[:k]: None for p in self.pieces for k in range(1, len(p))}
        self.table |= self.pieces
        self.by_words = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        # A mark in the text itself must not be taken for a space: it is matched as a character of no piece.
        used = {c for p in self.pieces for c in p}
        self.stranger = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in used)

    def escaped(self, text: str) -> str:
        """The text as pieces spell it: spaces become marks."""
        if MARK in text:
            text = text.replace(MARK, self.stranger)
        return text.replace(" ", MARK)

    def search(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Committed ids, run by run, of a text that comes in consecutive parts (spaces as they are)."""
        get, longest = self.table.get, self.longest
        parts, more = iter(texts), True
        # ``window`` is the escaped text from position ``base`` on, ``plain`` the text itself.
        window, plain, base, at, committed = "", "", 0, 0, 0
        best: dict[int, float] = {0: 0.0}
        back: dict[int, tuple[int, int]] = {}
        while True:
            while more and at + longest > base + len(window):
                part = next(parts, None)
                if part is None:
                    more = False
                else:
                    window, plain = window + self.escaped(part), plain + part
            end = base + len(window)
            if at >= end:
                break
            score, off = best.pop(at), at - base
            single = False
            for size in range(1, min(longest, end - at) + 1):
                hit = get(window[off : off + size], 0)
                if hit == 0:
                    break
                if hit is not None:
                    single = single or size == 1
                    to, total = at + size, score + hit[1]
                    if to not in best or total > best[to]:
                        best[to], back[to] = total, (at, hit[0])
            if not single:
                to, total = at + 1, score + self.unknown_score
                if to not in best or total > best[to]:
                    best[to], back[to] = total, (at, -1)
            at += 1
            if len(best) == 1 or at - committed >= MEET_EVERY and (at - committed) % MEET_EVERY == 0:
                meet = self._meeting(best, back, committed)
                if meet > committed:
                    yield self._way(back, committed, meet, plain, base)
                    # Scores go on from the boundary, so they never lose precision on long texts.
                    level = min(best.values())
                    best = {k: v - level for k, v in best.items()}
                    back = {k: v for k, v in back.items() if k > meet}
                    keep = meet - base
                    window, plain, base, committed = window[keep:], plain[keep:], meet, meet
        if at > committed:
            yield self._way(back, committed, at, plain, base)

    def search_word(self, word: str) -> list[int]:
        """:meth:`search` for a word no longer than the window, which needs no moving of it."""
        spelled, get = self.escaped(word), self.table.get
        n = len(spelled)
        best: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        unknown = self.unknown_score
        for at in range(n):
            score = best[at]
            to = at + 1
            single = False
            while to <= n:
                hit = get(spelled[at:to], 0)
                if hit == 0:
                    break
                if hit is not None:
                    single = single or to == at + 1
                    total, held = score + hit[1], best[to]
                    if held is None or total > held:
                        best[to], back[to] = total, (at, hit[0])
                to += 1
            if not single and (best[at + 1] is None or score + unknown > best[at + 1]):
                best[at + 1], back[at + 1] = score + unknown, (at, -1)
        ids: list[int] = []
        while n:
            n, piece = back[n]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += reversed(self._strange(word[n]))
        ids.reverse()
        return ids

    def _strange(self, character: str) -> list[int]:
        # A lone surrogate has no UTF-8; it becomes what stands for broken text.
        raw = character.encode("utf-8", "replace")
        return [self.byte_ids[b] for b in raw] if self.byte_ids[0] >= 0 else [self.unknown]

    @staticmethod
    def _meeting(best: dict[int, float], back: dict[int, tuple[int, int]], committed: int) -> int:
        """The last boundary that the ways from all open positions run through."""
        open_ = sorted(best)
        while len(open_) > 1:
            # The farthest one steps back; equal ones become one.
            last = open_.pop()
            if last == committed:
                break
            before = back[last][0]
            if before not in open_:
                open_.append(before)
                open_.sort()
        return open_[0] if len(open_) == 1 else committed

    def _way(self, back: dict[int, tuple[int, int]], start: int, end: int, plain: str, base: int) -> list[int]:
        steps = []
        while end > start:
            before, piece = back[end]
            steps.append((before, piece))
            end = before
        ids: list[int] = []
        for before, piece in reversed(steps):
            ids += [piece] if piece >= 0 else self._strange(plain[before - base])
        return ids

    def encode(self, text: str) -> list[int]:
        """All ids of one text, which counts as having a space in front; none for an empty one."""
        return [i for run in self.search([" " + text]) for i in run] if text else []

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.text_of.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


class Merges:
    """Encoding by merges.

    No merge goes over two characters that stand together in no piece, so words are cut there first. What lies between
    two cuts, a run, is merged once and remembered: a short one by the least of a list of ranks, a long one with a heap
    of places. Pieces the user defined are taken whole before any merge, the longest first.
    """

    def __init__(self, vocabulary: Vocabulary, user_defined: Iterable[str] = ()):
        self.vocabulary = vocabulary
        self.user_defined = frozenset(user_defined)
        pieces = vocabulary.pieces
        ranks = {score: rank for rank, score in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        self.rank = {piece: ranks[score] for piece, (_, score) in pieces.items()}
        self.never = len(ranks)
        together = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.together = np.array(sorted(ord(a) << 21 | ord(b) for a, b in together), np.int64)
        longest = sorted(self.user_defined, key=len, reverse=True)
        self.symbols = re.compile("|".join([*map(re.escape, longest), "."]), re.DOTALL).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word, its spaces as they are."""
        return self.encode_words([word])[1].tolist()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word: their numbers, and the ids one after the other. No word is empty."""
        joined = "".join(words)
        points = np.frombuffer(self.vocabulary.escaped(joined).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cut = np.ones(len(points) + 1, bool)
        if len(self.together):
            pairs = points[:-1] << 21 | points[1:]
            at = np.minimum(np.searchsorted(self.together, pairs), len(self.together) - 1)
            cut[1:-1] = self.together[at] != pairs
        cut[ends] = True
        at = np.flatnonzero(cut)
        found = self._runs([joined[a:b] for a, b in pairwise(at.tolist())])
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(total[-1]))
        last = total[np.searchsorted(at, ends)]
        if self.vocabulary.byte_ids[0] < 0:
            # Unknown characters of a word that follow each other are one unknown id, if they are not bytes.
            unknown = ids == self.vocabulary.unknown
            again = np.concatenate([[False], unknown[1:] & unknown[:-1]])
            again[last[:-1][last[:-1] < len(ids)]] = False
            ids, last = ids[~again], last - np.concatenate([[0], np.cumsum(again)])[last]
        return np.diff(last, prepend=0), ids

    def _runs(self, runs: list[str]) -> list[tuple[int, ...]]:
        if len(self.known) > KNOWN_RUNS:
            self.known.clear()
        known = self.known
        found = list(map(known.get, runs))
        for i, ids in enumerate(found):
            if ids is None:
                # Long runs are rare, and may be very long.
                ids = known.get(runs[i])
                if ids is None:
                    ids = self._ids(runs[i])
                    if len(runs[i]) <= LONG_RUN:
                        known[runs[i]] = ids
                found[i] = ids
        return found

    def _ids(self, plain: str) -> tuple[int, ...]:
        pieces, ids, at = self.vocabulary.pieces, [], 0
        for symbol in self._merged(self.vocabulary.escaped(plain)):
            if symbol in pieces:
                ids.append(pieces[symbol][0])
            else:
                ids += self.vocabulary._strange(plain[at])
            at += len(symbol)
        return tuple(ids)

    def _joint(self, left: str, right: str) -> int:
        """Rank of the merge of two symbols."""
        if left in self.user_defined or right in self.user_defined:
            return self.never
        return self.rank.get(left + right, self.never)

    def _merged(self, spelled: str) -> list[str]:
        if len(spelled) == 1 or spelled in self.user_defined:
            return [spelled]
        symbols = self.symbols(spelled) if self.user_defined else list(spelled)
        return self._merged_short(symbols) if len(symbols) <= LONG_RUN else self._merged_long(symbols)

    def _merged_short(self, symbols: list[str]) -> list[str]:
        never = self.never
        if self.user_defined:
            joint = self._joint
        else:
            rank = self.rank

            def joint(left: str, right: str) -> int:
                return rank.get(left + right, never)

        ranks = list(map(joint, symbols, symbols[1:]))
        while ranks:
            least = min(ranks)
            if least == never:
                break
            i = ranks.index(least)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = joint(symbols[i - 1], symbols[i])
            if i < len(ranks):
                ranks[i] = joint(symbols[i], symbols[i + 1])
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        n, never = len(symbols), self.never
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

        def joint(i: int) -> int:
            j = after[i]
            return self._joint(symbols[i], symbols[j]) if j < n else never

        # Rank and place in one number.
        heap = [r << 40 | i for i in range(n - 1) if (r := joint(i)) != never]
        heapq.heapify(heap)
        while heap:
            least = heapq.heappop(heap)
            i = least & (1 << 40) - 1
            if not symbols[i] or joint(i) != least >> 40:
                continue
            j = after[i]
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := joint(k)) != never:
                    heapq.heappush(heap, r << 40 | k)
        return [s for s in symbols if s]


class PieceIds(WordIds):
    """Word by word encoding of texts that have a space in front, by merges if these are given."""

    def __init__(
        self, vocabulary: Vocabulary, slab_bytes: int = SLAB_BYTES, cache_words: int = CACHE_WORDS, merges: Merges | None = None
    ):
        self.vocabulary, self.merges = vocabulary, merges
        # Without words to rely on, a text is one word and is never cut.
        self.blanks = b" " if vocabulary.by_words else b""
        super().__init__(slab_bytes, cache_words)

    def word_starts(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        start = np.zeros(len(raw) + 1, bool)
        if self.vocabulary.by_words:
            space = raw == 32
            start[1:-1] = space[1:] & ~space[:-1]
        start[bounds[:-1]] = True
        return np.flatnonzero(start[: len(raw)])

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.vocabulary
        if self.merges:
            return self.merges.encode_words(words)
        found = [known.search_word(w) if len(w) <= MEET_EVERY else [i for run in known.search([w]) for i in run] for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return size, np.fromiter((i for ids in found for i in ids), np.int32, int(size.sum()))


def vocabulary(path: str) -> Vocabulary:
    """The worker's copy of a model file."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def merges(path: str) -> Merges | None:
    """The merges of a merging model's file; none for a unigram model."""
    with open(path, "rb") as file:
        raw = file.read()
    kind, types, known = model_type(raw), piece_types(raw), vocabulary(path)
    if kind == 1:
        return None
    if kind != MERGING or UNUSED in types:
        raise ValueError(f"{path}: models of kind {kind}, or with unused pieces to merge, are not supported")
    if known.by_words and MARK not in known.pieces:
        raise ValueError(f"{path}: a model whose pieces lack the word mark is not supported")
    spelled = {i: piece for piece, (i, _) in known.pieces.items()}
    return Merges(known, (spelled[i] for i, type_ in enumerate(types) if type_ == USER_DEFINED))


def encode_as_trained(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """:func:`encode_pieces` by the method the model file was trained for: merges or the search for the best sum.

    The ids are those of the sentencepiece library for models that normalize nothing and put a space in front, but for a
    word mark in a text, which stays one. Files of other kinds, or with unused pieces to merge, are refused.
    """
    return encode_pieces(docs, model, id_column, text_column, as_trained=True)


def encode_pieces(
    docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", as_trained: bool = False
) -> DataFrame:
    """(id, n_tokens, ids): the piece ids of each row's whole text, as a binary of little-endian 32-bit numbers.

    They have the best sum of scores, whatever the kind of the model, unless ``as_trained``. A null or empty text has no ids. Repeated rows and null ids are kept; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def encode(batches):
        key = model, as_trained
        if key not in _encoders:
            _encoders[key] = PieceIds(vocabulary(model), merges=merges(model) if as_trained else None)
        words = _encoders[key]
        for batch in batches:
            at = 0
            for ids, edge in words.encode(batch.column(1)):
                raw = pa.py_buffer(np.ascontiguousarray(ids, "<i4"))
                count = len(edge) - 1
                offsets = pa.py_buffer((edge * 4).astype(np.int64))
                values = pa.Array.from_buffers(pa.large_binary(), count, [None, offsets, raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, count), pa.array(np.diff(edge)), values], schema.fieldNames()
                )
                at += count

    text = F.col(text_column).cast("string")
    # The space in front is that of the first word.
    spaced = F.when(F.length(text) > 0, F.concat(F.lit(" "), text))
    return docs.select(F.col(id_column), spaced).mapInArrow(encode, schema)


def decode_pieces(encoded: DataFrame, model: str, id_column: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_crc32, text) of rows (id, ids): the text that the ids spell, and their CRC-32. Null: no ids."""
    ship_package(encoded.sparkSession)
    schema = T.StructType(
        [
            T.StructField(id_column, encoded.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()), T.StructField("text", T.StringType()),
        ]
    )

    def decode(batches):
        known = vocabulary(model)
        for batch in batches:
            texts, sizes, sums = [], [], []
            for raw in batch.column(1).to_pylist():
                ids = np.frombuffer(raw or b"", "<i4").tolist()
                texts.append(known.decode(ids))
                sizes.append(len(ids))
                sums.append(zlib.crc32(raw or b""))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(texts, pa.string())],
                schema.fieldNames(),
            )

    return encoded.select(id_column, "ids").mapInArrow(decode, schema)
