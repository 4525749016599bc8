"""Words of whole texts as bytes. ASCII characters outside a word are blanks; all other characters belong to words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from specloom.llm.words import text_buffers

#: Bytes of a text that are split into words at once.
PIECE_BYTES = 1 << 20

# By byte: white space becomes a blank.
WHITE_SPACE = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))


def _letter_or_digit(b: int) -> int:
    if 0x41 <= b <= 0x5A:
        return b + 0x20
    return b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20


# By byte: A-Z become a-z, all ASCII but letters and digits becomes a blank.
LETTERS_AND_DIGITS = bytes(_letter_or_digit(b) for b in range(256))


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """Each text of a string column as UTF-8; null is empty."""
    raw, bounds = text_buffers(column)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield raw[a:b].tobytes()


def word_pieces(text: bytes, table: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Words of a text in order, those of about ``size`` bytes at once; ``table`` says what is a blank."""
    plain = text.translate(table)
    at = 0
    while at < len(plain):
        # Where a word would be cut, the piece goes on up to the next blank.
        end = plain.find(b" ", at + size) if at + size < len(plain) else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def word_places(text: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends in the text, in characters."""
    plain = np.frombuffer(text.translate(table), np.uint8)
    word = np.concatenate([[False], plain != 0x20, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    characters = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return characters[edges[::2]], characters[edges[1::2]]
