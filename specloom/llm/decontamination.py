"""Benchmark passages in documents, found by one Aho-Corasick automaton over windows of normalised item words.

Texts are normalised to words of letters and digits, A-Z lower-cased, with one blank between them. Each window of
consecutive item words is a pattern with a blank on both sides, so it matches whole words only. A document goes through
the automaton once, in pieces; the places where patterns end give the words they cover, and these give the characters of
the original text.

The automaton is built once by each worker from windows that are broadcast. Items beyond ``ITEM_BYTES`` are dealt out to
several automata, one pass each, so neither driver nor worker holds more.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from specloom.llm.plain_words import LETTERS_AND_DIGITS, texts_of, word_pieces, word_places
from specloom.session import ship_package, stage

WINDOW = 10
#: Item text that one automaton is built from; it takes about 300 times as much memory.
ITEM_BYTES = 1 << 20

_scanners: dict[str, "Scanner"] = {}


def item_windows(items: list[tuple], window: int) -> dict[str, tuple[int, set]]:
    """Each window of the items' words: how many words it has, and the ids of the items that hold it."""
    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        words = [w for piece in word_pieces((text or "").encode("utf-8", "replace"), LETTERS_AND_DIGITS) for w in piece]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            # One character per byte, as the automaton takes text: UTF-8 matches byte by byte.
            pattern = f" {b' '.join(part).decode('latin-1')} "
            owners = found.setdefault(pattern, (len(part), set()))[1]
            if item is not None:
                owners.add(item)
    return found


class Scanner:
    """The automaton of some windows."""

    def __init__(self, windows: dict[str, tuple[int, set]]):
        self.automaton = ahocorasick.Automaton()
        for pattern, found in windows.items():
            self.automaton.add_word(pattern, found)
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def scan(self, text: bytes) -> tuple[int, set, list[tuple[int, int]]]:
        """Number of words, ids of the items with windows in the text, and (first, last) word of each stretch of hits."""
        n, owners, hits, search, base = 0, set(), [], None, 0
        for words in word_pieces(text, LETTERS_AND_DIGITS):
            if words and not self.empty:
                spelled = b" ".join(words).decode("latin-1") + " "
                if search:
                    # Goes on after the blank that closed the piece before.
                    search.set(spelled, False)
                else:
                    search = self.automaton.iter(" " + spelled)
                found = list(search)
                if found:
                    # Where each word's closing blank stands in all that the automaton has seen.
                    closing = np.array(list(accumulate((len(w) + 1 for w in words), initial=base))[1:])
                    last = n + np.searchsorted(closing, [end for end, _ in found])
                    for end, (_, (size, items)) in zip(last.tolist(), found):
                        hits.append((end - size + 1, end))
                        owners |= items
                    # Occurrences of a piece become stretches at once, so a text that is full of them takes no more memory.
                    hits = covered(hits)
                base += len(spelled)
            n += len(words)
        return n, owners, hits


def _scanner(windows: Broadcast, key: str) -> Scanner:
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(windows.value)
    return _scanners[key]


def covered(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches of words that (first, last) pairs cover, in order; neighbouring stretches are one."""
    out: list[list[int]] = []
    for first, last in sorted(set(hits)):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, items, spans) of each row of ``docs``.

    ``n_hit`` counts the document's words within any occurrence of ``window`` consecutive words of an item, or of all
    words of an item that has fewer. ``items`` holds the distinct ids of the items with such an occurrence, in ascending
    order, ``spans`` the (start, end) of each maximal stretch of hit words in characters of the original text, from 0,
    the end excluded.

    A null or empty text has no words: such a document has no hits, such an item no windows. An item whose id is null
    marks words, but is not listed; items that share an id are listed once. Repeated documents are judged each for itself,
    null ids are kept, other columns are ignored.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    ship_package(docs.sparkSession)
    item_type = items.schema[item_id_column].dataType
    if not isinstance(item_type, T.AtomicType):
        raise ValueError("item ids must be of a type that has an order")
    text = F.col(item_text_column).cast("string")
    # Repeated items give the same windows: they are one before any of them is brought together.
    known = items.select(F.col(item_id_column).alias("id"), text.alias("text")).where(F.length("text") > 0).distinct()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // ITEM_BYTES) + 1
    found = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"),
        F.array().cast(T.ArrayType(item_type)).alias("items"), F.array().cast(found).alias("spans"),
    )
    for part in range(parts):
        mine = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        windows = item_windows([tuple(r) for r in mine.collect()], window)
        held = docs.sparkSession.sparkContext.broadcast(windows)
        if part + 1 < parts:
            rows = stage(_pass(rows, held, last=False), "overlaps")
    return _pass(rows, held, last=True).withColumnRenamed("id", id_column)


def _pass(rows: DataFrame, windows: Broadcast, last: bool) -> DataFrame:
    """Adds what one automaton finds; the last pass turns words into places of the text."""
    key = uuid.uuid4().hex
    if last:
        longs = [T.StructField(c, T.LongType()) for c in ("start", "end")]
        schema = T.StructType(
            [
                rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                rows.schema["items"], T.StructField("spans", T.ArrayType(T.StructType(longs))),
            ]
        )
    else:
        schema = rows.schema

    def scan(batches):
        scanner, arrow = _scanner(windows, key), to_arrow_schema(schema)
        for batch in batches:
            items, spans, words, hits = [], [], [], []
            before = zip(batch.column("items").to_pylist(), batch.column("spans").to_pylist())
            for text, (items_before, spans_before) in zip(texts_of(batch.column("text")), before):
                n, owners, pairs = scanner.scan(text)
                items.append(sorted({*items_before, *owners}))
                stretches = covered([*((s["first"], s["last"]) for s in spans_before), *pairs])
                words.append(n)
                hits.append(sum(b - a + 1 for a, b in stretches))
                if last and stretches:
                    start, end = word_places(text, LETTERS_AND_DIGITS)
                    spans.append([{"start": int(start[a]), "end": int(end[b])} for a, b in stretches])
                else:
                    spans.append([{"first": a, "last": b} for a, b in stretches])
            columns = {"items": items, "spans": spans, "n_words": words, "n_hit": hits}
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else batch.column(f.name).cast(f.type) for f in arrow],
                schema=arrow,
            )

    return rows.mapInArrow(scan, schema)
