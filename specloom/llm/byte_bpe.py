"""Exact byte-level BPE ids for whole Arrow columns of text, inside a task.

The tokenizers library splits a text into words by one fixed pattern and merges bytes within each word. Here a batch is
split into the same words by array operations, and the library encodes each distinct word. Which class (letter, digit,
blank, other) a code point has is asked of the library itself. A text holding the string of a special token is handed to
the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from specloom.llm.words import CACHE_WORDS, LONG_WORD, SLAB_BYTES, WordIds

LETTER, DIGIT, OTHER, SPACE, BLANK = 1, 2, 3, 4, 5
#: Contractions of the pattern that splits texts into words.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")

_encoders: dict[str, "ByteBpe"] = {}


def encoder(path: str) -> "ByteBpe":
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


class ByteBpe(WordIds):
    blanks = b" \t\n\v\f\r"

    def __init__(self, path: str, slab_bytes: int = SLAB_BYTES, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.classes = np.zeros(0x110000, np.uint8)
        self._learn_classes(np.arange(128))
        self.ascii = np.zeros(256, np.uint8)
        self.ascii[:128] = self.classes[:128]
        super().__init__(slab_bytes, cache_words)

    def _learn_classes(self, points: np.ndarray) -> None:
        split = self.library.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            if 0xD800 <= p < 0xE000:
                kind = OTHER
            elif p == 32:
                kind = SPACE
            else:
                c = chr(p)
                kind = next((k for k, probe in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")) if len(split(probe + c)) == 1), BLANK)
            self.classes[p] = kind

    def _byte_classes(self, raw: np.ndarray) -> np.ndarray:
        kinds = self.ascii[raw]
        lead = np.flatnonzero(raw >= 0xC2)
        if len(lead):
            b = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.uint32)
            head = b[lead]
            two, four = head < 0xE0, head >= 0xF0
            tail = [b[lead + i] & 0x3F for i in (1, 2, 3)]
            point = np.where(
                two, (head & 0x1F) << 6 | tail[0],
                np.where(four, (head & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2], (head & 15) << 12 | tail[0] << 6 | tail[1]),
            )
            point = np.minimum(point, 0x10FFFF)
            kind = self.classes[point]
            if (kind == 0).any():
                self._learn_classes(np.unique(point[kind == 0]))
                kind = self.classes[point]
            kinds[lead] = kind
            for i, has in ((1, None), (2, ~two), (3, four)):
                at = lead if has is None else lead[has]
                value = kind if has is None else kind[has]
                ok = at + i < len(raw)
                kinds[at[ok] + i] = value[ok]
        return kinds

    def word_starts(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(raw)
        kinds = self._byte_classes(raw)
        group = np.minimum(kinds, SPACE)
        opens = np.zeros(n + 4, bool)
        opens[bounds[:-1][bounds[:-1] < n]] = True
        start = opens.copy()
        start[1:n] |= group[1:] != group[:-1]
        # A word takes the one space before it; of a longer blank run the last character stands apart.
        inner = np.flatnonzero(start[1:n] & ~opens[1:n] & (group[1:] != SPACE) & (group[:-1] == SPACE)) + 1
        start[inner[kinds[inner - 1] == SPACE]] = False
        last = inner - 1
        for _ in range(3):
            last = last - ((raw[last] & 0xC0) == 0x80)
        start[last] = True
        quote = np.flatnonzero((raw == 39) & start[:n])
        if len(quote):
            padded = np.concatenate([raw, np.zeros(4, np.uint8)])
            one, two = padded[quote + 1], padded[quote + 2]
            size = np.where(np.isin(one, [ord(c) for c in SHORT_ENDINGS]) & ~opens[quote + 1], 2, 0)
            for pair in LONG_ENDINGS:
                hit = (one == ord(pair[0])) & (two == ord(pair[1])) & ~opens[quote + 1] & ~opens[quote + 2]
                size[hit] = 3
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            after = quote + size
            after = after[after < n]
            start[after[kinds[after] == LETTER]] = True
        raw_bytes = raw.tobytes()
        for special in self.special:
            at = raw_bytes.find(special)
            while at >= 0:
                text = int(np.searchsorted(bounds, at, "right")) - 1
                if at + len(special) <= bounds[text + 1]:
                    start[bounds[text] + 1 : bounds[text + 1]] = False
                    at = raw_bytes.find(special, int(bounds[text + 1]))
                else:
                    at = raw_bytes.find(special, at + 1)
        return np.flatnonzero(start[:n])

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, from the library: sizes and the ids one after the other.

        Words that hold no line feed and end in no blank go joined by line feeds, which the library keeps apart.
        """
        alone = [i for i, w in enumerate(words) if "\n" in w or w[-1:].isspace() or len(w) > LONG_WORD or w[0].isspace() and w[0] != " "]
        apart = set(alone)
        joined = [i for i in range(len(words)) if i not in apart]
        size = np.zeros(len(words), np.int64)
        feed = self.library.encode("\n", add_special_tokens=False).ids
        runs = [joined[k : k + 4096] for k in range(0, len(joined), 4096)]
        order, flats = [], []
        texts = ["\n".join([words[i] for i in run]) + "\n" for run in runs]
        for run, found in zip(runs, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, np.int32)
            at = np.flatnonzero(ids == feed[0])
            if len(feed) != 1 or len(at) != len(run):
                alone.extend(run)
                continue
            size[run] = np.diff(np.concatenate([[-1], at])) - 1
            order.extend(run)
            flats.append(ids[ids != feed[0]])
        for i, found in zip(alone, self.library.encode_batch_fast([words[i] for i in alone], add_special_tokens=False)):
            flats.append(np.array(found.ids, np.int32))
            size[i] = len(flats[-1])
            order.append(i)
        flat = np.concatenate(flats) if flats else np.empty(0, np.int32)
        first = np.empty(len(words), np.int64)
        sizes = size[order]
        first[order] = np.cumsum(sizes) - sizes
        return size, flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
