"""Stretches of words that repeat with a period, and texts with the repetitions left out.

Diagonal p of a text holds the words that equal the word p places earlier. A stretch of matches on it that is long enough
is a run of period p. Going through the words in order, a word's earlier occurrences lengthen the diagonals that are
active and end the others, and a diagonal that ends with sufficient length is emitted at once.

Taking every earlier occurrence would cost the square of a frequent word's number. So the table is sparse: a match of a
long run lasts at least k words for a k that follows from the asked length, and periods up to k are looked for among the
stretches of k words that end at each word. Of those the nearest earlier occurrence alone can be the smallest period of a
run: were a nearer one also within the run, two periods would overlap by their sum, and their common divisor would be a
smaller period. Periods over k wait for stretches of 2k words, then 4k. Stretches that do not occur again in their text
drop out, and with them all longer ones around them; little text is left after a few steps. Work is linear in the words
for each doubling, memory linear in the words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from specloom.llm.plain_words import WHITE_SPACE, texts_of, word_pieces
from specloom.session import ship_package

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words that are worked on at once; a longer text is worked on alone.
SLAB_WORDS = 1 << 19


def _again(keys: np.ndarray) -> np.ndarray:
    """Numbers of equal keys, -1 for a key that occurs once."""
    codes, distinct = pd.factorize(keys)
    return np.where(np.bincount(codes, minlength=len(distinct))[codes] > 1, codes, -1)


def find_runs(
    codes: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs in some texts, by text, start and period.

    ``codes`` are the numbers of the words of all texts, ``bounds`` the n+1 places where texts start. A run has at least
    ``least`` words and ``periods`` times its smallest period, and neither neighbouring word extends it.
    """
    if periods < 3:
        raise ValueError("a run holds its period three times at least")
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    first, size = bounds[:-1][text], sizes[text]
    # The longest stretch that every run still holds after its first period, whatever that is.
    shortest, bound = 1, (periods - 1) * least // periods
    while shortest * 2 <= bound:
        shortest *= 2
    found = [np.empty((4, 0), np.int64)]
    ids = _again(codes + text * (int(codes.max(initial=0)) + 1))
    at, k = np.flatnonzero(ids >= 0), 1
    while len(at):
        if k >= shortest:
            found.append(_diagonals(ids[at], at, k, 0 if k == shortest else k // 2, least, periods))
        # Stretches of twice the size: two that stand side by side, both met again in the same text.
        reaches = at - k >= first[at]
        if k >= shortest:
            reaches &= size[at] > periods * k
        wider = at[reaches]
        wider = wider[ids[wider - k] >= 0]
        again = _again(ids[wider] * np.int64(len(ids) + 1) + ids[wider - k])
        ids[at] = -1
        at = wider[again >= 0]
        ids[at] = again[again >= 0]
        k *= 2
    start, length, period, _ = np.concatenate(found, axis=1)
    of = text[start]
    order = np.lexsort((period, start))
    return of[order], (start - bounds[of])[order], length[order], period[order]


def _diagonals(ids: np.ndarray, at: np.ndarray, k: int, over: int, least: int, periods: int) -> np.ndarray:
    """Runs with periods from ``over`` + 1 to ``k``, from the stretches of k words that end at ``at``."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    lag = np.zeros(len(at), np.int64)
    lag[order[1:][same]] = (at[order[1:]] - at[order[:-1]])[same]
    active = (lag > over) & (lag <= k)
    word, lag = at[active], lag[active]
    # A diagonal goes on as long as the next word lies on it too.
    ends = (np.diff(word) != 1) | (np.diff(lag) != 0)
    opening, closing = np.concatenate([[True], ends])[: len(word)], np.concatenate([ends, [True]])[: len(word)]
    period = lag[opening]
    start = word[opening] - k + 1 - period
    length = word[closing] + 1 - start
    kept = (length >= least) & (length >= periods * period)
    return np.stack([start[kept], length[kept], period[kept], period[kept]])


def repeated_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """For each of n words, whether a run holds it after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _slabs(column: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Some texts at a time: the texts, the numbers of their words, and where each text's words start."""
    texts, codes, bounds = [], [], [0]
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    for text in texts_of(column):
        texts.append(text)
        n = 0
        for words in word_pieces(text, WHITE_SPACE):
            codes.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            n += len(words)
        bounds.append(bounds[-1] + n)
        if bounds[-1] >= SLAB_WORDS:
            yield texts, np.concatenate(codes), np.array(bounds)
            texts, codes, bounds = [], [], [0]
            numbers = defaultdict(count().__next__)
    if texts:
        yield texts, np.concatenate([np.empty(0, np.int64), *codes]), np.array(bounds)


def _kept(text: bytes, dropped: np.ndarray | None) -> str:
    at, kept = 0, []
    for words in word_pieces(text, WHITE_SPACE):
        if dropped is not None:
            kept.append(b" ".join(compress(words, ~dropped[at : at + len(words)])))
        else:
            kept.append(b" ".join(words))
        at += len(words)
    return b" ".join(filter(None, kept)).decode("utf-8", "replace")


def collapse_runs(
    docs: DataFrame,
    least: int = LEAST_WORDS,
    periods: int = LEAST_PERIODS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row of ``docs``; words are what white space of ASCII separates.

    ``runs`` holds (start, length, period) of every run in words, by start, then period; ``collapsed`` the words that no
    run holds after its first period, joined by one space. A null, empty or blank text has no words, no runs and an empty
    ``collapsed``. Repeated rows are worked on each for itself, null ids are kept, other columns are ignored.
    """
    ship_package(docs.sparkSession)
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType()),
        ]
    )

    def collapse(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            at = 0
            for texts, codes, bounds in _slabs(batch.column(1)):
                of, start, length, period = find_runs(codes, bounds, least, periods)
                edges = np.searchsorted(of, np.arange(len(texts) + 1))
                collapsed = []
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    n = int(bounds[i + 1] - bounds[i])
                    dropped = repeated_words(n, start[a:b], length[a:b], period[a:b]) if b > a else None
                    collapsed.append(_kept(texts[i], dropped))
                values = pa.StructArray.from_arrays(
                    [pa.array(c, pa.int64()) for c in (start, length, period)], fields=list(arrow.field("runs").type.value_type)
                )
                columns = [
                    batch.column(0).slice(at, len(texts)), pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values), pa.array(collapsed, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
                at += len(texts)

    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(collapse, schema)
