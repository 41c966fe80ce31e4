"""Periodic runs of words: maximal stretches with a smallest period, found on a harmonic grid of common extensions.

A stretch of period p that is three periods long holds at least two grid points ``jp`` and ``(j+1)p`` next to each other. For
each p and j the words from the two points on are compared as far as they agree (forward) and so are the words before them
(backward); together they tell the whole stretch that repeats with period p around the points. Over all p that is
n ln n comparisons, each answered in constant time: forward ones by a suffix array with the common prefixes of its
neighbours and a table of range minima, backward ones by those of the reversed words. A comparison whose first words
differ is 0 at once, and one that is too short to be the first of a run goes no further. The same stretch found with several
periods belongs to the smallest.

Suffix arrays are built over many texts at once, by prefix doubling over what is still tied; words of different texts never
compare equal. A text is one task's work and nothing is shuffled; batches are bounded in words, or hold one text.

Defined results: a null or empty text has no words and no runs; words are bounded by ASCII white space and compared
byte by byte; repeated rows are judged one by one; a null id is passed on; an empty table gives an empty result; other columns
are never looked at.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.line_dedup import slices
from weft.llm.tables import id_text

#: A run has at least so many words, and so many periods.
LEAST = 24
PERIODS = 3
#: Bytes of text in one suffix array, and grid pairs compared at a time.
MOST_BYTES = 1_000_000
MOST_PAIRS = 2_000_000


class Extensions:
    """How far the words from two places on agree: suffix array, common prefixes of its neighbours, range minima."""

    def __init__(self, words: np.ndarray):
        """words: numbers that are equal for equal words of one text only."""
        n = len(words)
        order = np.argsort(words, kind="stable")
        tied = words[order][1:] == words[order][:-1]
        at = np.arange(n)
        rank = np.empty(n, np.int64)
        # the rank of a place is where its group of equals begins in the order
        rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], ~tied]), at, 0))
        most = int(np.bincount(rank, minlength=1).max())
        levels, width = [rank], 1
        slots = np.flatnonzero(np.concatenate([[False], tied]) | np.concatenate([tied, [False]]))
        while len(slots):
            items = order[slots]
            beyond = items + width
            key = rank[items] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
            by = np.argsort(key)
            order[slots] = items[by]
            tied = key[by][1:] == key[by][:-1]
            rank = rank.copy()
            rank[items[by]] = slots[np.maximum.accumulate(np.where(np.concatenate([[True], ~tied]), np.arange(len(slots)), 0))]
            levels.append(rank)
            width *= 2
            slots = slots[np.concatenate([[False], tied]) | np.concatenate([tied, [False]])]
        self.words, self.rank = words, rank
        self.minima = self._minima(self._shared(order, levels), most)

    @staticmethod
    def _shared(order: np.ndarray, levels: list) -> np.ndarray:
        """The words that each suffix of the order shares with the one before it, from the ranks by 1, 2, 4 ... words."""
        n, out = len(order), np.zeros(len(order), np.int32)
        some = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
        a, b = order[some - 1], order[some]
        shared = np.zeros(len(some), np.int64)
        for k in reversed(range(len(levels))):
            x, y = a + shared, b + shared
            inside = np.maximum(x, y) < n
            shared += (inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])).astype(np.int64) << k
        out[some] = shared
        return out

    @staticmethod
    def _minima(shared: np.ndarray, most: int) -> np.ndarray:
        """Row k: the least of each 2^k neighbours; ranges never leave a group of equal first words, of ``most`` at most."""
        rows = [shared]
        while 2 << len(rows) <= 2 * most:
            half, last = 1 << (len(rows) - 1), rows[-1]
            row = last.copy()
            row[: len(last) - half] = np.minimum(last[: len(last) - half], last[half:])
            rows.append(row)
        return np.stack(rows)

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that agree from x and from y on, for places x and y that differ."""
        out = np.zeros(len(x), np.int64)
        some = np.flatnonzero(self.words[x] == self.words[y])
        x, y = self.rank[x[some]], self.rank[y[some]]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y)
        k = np.frexp(hi - lo + 1)[1] - 1
        out[some] = np.minimum(self.minima[k, lo], self.minima[k, hi + 1 - (1 << k)])
        return out


def grid(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
    """Parts of the harmonic grid, as arrays of a text's number, jp and p, where the words at jp and (j+1)p are equal."""
    texts = np.flatnonzero(sizes >= LEAST)
    periods = sizes[texts] // PERIODS
    text = np.repeat(texts, periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (sizes[text] - 1) // p
    ends = np.cumsum(points)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MOST_PAIRS, "right")))
        count = points[lo:hi]
        j = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        each = np.repeat(p[lo:hi], count)
        left = np.repeat(begins[text[lo:hi]], count) + j * each
        same = np.flatnonzero(words[left] == words[left + each])
        yield np.repeat(text[lo:hi], count)[same], left[same], each[same]
        lo = hi


def runs_of(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start in the text, length and period of every run, by text, start and period.

    words: a number for each word, equal for equal words; the texts lie end to end.
    """
    none = (np.zeros(0, np.int64),) * 4
    if not len(words):
        return none
    own = np.repeat(np.arange(len(sizes)), sizes) * (int(words.max()) + 1) + words
    forward, found = Extensions(own), []
    for text, left, p in grid(own, begins, sizes):
        ahead = forward.at(left, left + p)
        # the first grid point of a run lies less than a period after its start
        first = ahead > np.maximum(LEAST, PERIODS * p) - 2 * p
        found.append((text[first], left[first], p[first], ahead[first]))
    text, left, p, ahead = (np.concatenate(x) for x in zip(*found, strict=True)) if found else none
    if not len(text):
        return none
    # only texts with such a point need their reversed words
    few = np.unique(text)
    size = sizes[few]
    ends = np.cumsum(size)
    back = own[np.repeat(begins[few] + ends - 1, size) - np.arange(ends[-1])]
    of = np.searchsorted(few, text)
    behind = np.zeros(len(text), np.int64)
    some = np.flatnonzero(left > begins[text])
    mirrored = (ends[of] - (left - begins[text]))[some]
    behind[some] = Extensions(back).at(mirrored, mirrored - p[some])
    start, length = left - begins[text] - behind, p + ahead + behind
    long = length >= np.maximum(LEAST, PERIODS * p)
    text, start, length, p = text[long], start[long], length[long], p[long]
    by = np.lexsort((p, length, start, text))
    text, start, length, p = text[by], start[by], length[by], p[by]
    fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])])[: len(text)]
    text, start, length, p = text[fresh], start[fresh], length[fresh], p[fresh]
    by = np.lexsort((p, start, text))
    return text[by], start[by], length[by], p[by]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and kept, of every row.

    kept: the words, joined by one space, that no run holds after its first period.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1), MOST_BYTES):
                part = batch.slice(lo, hi - lo)
                split = [(t.as_py() or "").encode().split() for t in part.column(1)]
                sizes = np.array([len(w) for w in split], np.int64)
                begins = np.cumsum(sizes) - sizes
                words = pa.array(chain.from_iterable(split), pa.binary(), size=int(sizes.sum())).dictionary_encode().indices.to_numpy().astype(np.int64)
                text, start, length, p = runs_of(words, begins, sizes)
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, begins[text] + start + p, 1)
                np.add.at(edges, begins[text] + start + length, -1)
                stays = np.cumsum(edges[:-1]) == 0
                kept = [b" ".join(w if full else (x for x, s in zip(w, stays[at : at + len(w)], strict=True) if s)) for w, at, full in zip(split, begins, ~np.isin(np.arange(len(split)), text), strict=True)]
                offsets = np.searchsorted(text, np.arange(len(split) + 1))
                runs = pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, p)], fields=list(run)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), runs, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "kept"])

    return id_text(docs, id_col, text_col).mapInArrow(find, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, kept string")
