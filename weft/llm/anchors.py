"""Anchors of text windows: which positions of a sequence a window of fixed length is looked up by.

A sequence is an array of 64-bit unit hashes (words, lines or bytes), several documents laid end to end. Each window of
``span`` units is dealt to one anchor in a way that depends on the window's own content only, so equal windows of
different documents always meet at an equal anchor. All windows dealt to one anchor are a run of neighbouring starts;
a run is one row: anchor hash ``a``, hash ``c`` of everything its windows cover, first start ``lo`` and count ``n``.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}

#: A fixed random 64-bit number for each byte value.
BYTE_HASH = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=U)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for k, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(max(n, 1 << 16), base, U)
            steps[0] = U(1)
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers["up"], _powers["down"]


class Rolling:
    """Hashes of any stretch of a sequence, from one running sum."""

    def __init__(self, units: np.ndarray):
        up, self.down = _grown(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, U)
        np.cumsum(units * up[: len(units)], out=self.sums[1:])

    def at(self, starts: np.ndarray, lengths) -> np.ndarray:
        return mixed((self.sums[starts + lengths] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    full = -(-len(x) // width) * width
    padded = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _window_starts(begins: np.ndarray, sizes: np.ndarray, span: int) -> np.ndarray:
    counts = np.maximum(0, sizes - span + 1)
    total = int(counts.sum())
    firsts = np.cumsum(counts) - counts
    return np.repeat(begins - firsts, counts) + np.arange(total)


def winnowed(units: np.ndarray, begins: np.ndarray, sizes: np.ndarray, span: int, gram: int):
    """Runs (a, c, lo, n) by winnowing: a window's anchor is its least gram of ``gram`` units, the last one of equals."""
    starts = _window_starts(begins, sizes, span)
    if not len(starts):
        return (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)), None
    rolling = Rolling(units)
    grams = rolling.all(gram)
    low = (1 << 20) - 1
    places = low - (np.arange(len(grams)) & low)
    least = sliding_min((grams & ~U(low)) | places.astype(U), span - gram + 1)[starts]
    anchor = starts + ((low - (least & U(low)).astype(np.int64) - starts) & low)
    first = np.ones(len(starts), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(first)
    lo, p = starts[at], anchor[at]
    n = np.diff(np.append(at, len(starts)))
    return (grams[p], _cover(rolling, lo, n, p, span), lo, n), rolling


def synchronised(units: np.ndarray, begins: np.ndarray, sizes: np.ndarray, span: int, gram: int, step: int):
    """Runs (a, c, lo, n) and anchor places p, by a string synchronising set.

    A position is in the set if the least gram of it and the ``step`` after it is its first or its last. Of any ``step``
    neighbours at least one is in the set, by what follows it alone; a window's anchor is the first at or after its start.
    All windows of an anchor cover the ``span - step + 1`` units from it on; their hash is ``a``.
    """
    none = (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    keep = sizes >= span
    begins, sizes = begins[keep], sizes[keep]
    if not len(begins):
        return none
    rolling = Rolling(units)
    grams = rolling.all(gram)
    least = sliding_min(grams, step + 1)
    p = np.flatnonzero((grams[: len(least)] == least) | (grams[step : step + len(least)] == least))
    doc = np.searchsorted(begins, p, "right") - 1
    p, doc = p[doc >= 0], doc[doc >= 0]
    before = np.concatenate([[-1], p[:-1]])
    lo = np.maximum(before + 1, begins[doc])
    hi = np.minimum(p, begins[doc] + sizes[doc] - span)
    some = lo <= hi
    lo, n, p = lo[some], (hi - lo + 1)[some], p[some]
    return rolling.at(p, span - step + 1), _cover(rolling, lo, n, p, span), lo, n, p


def _cover(rolling: Rolling, lo: np.ndarray, n: np.ndarray, p: np.ndarray, span: int) -> np.ndarray:
    shape = ((p - lo).astype(U) << U(32)) | n.astype(U)
    return mixed(rolling.at(lo, n - 1 + span) ^ mixed(shape))


def covered(size: int, starts: np.ndarray, lengths: np.ndarray, span: int) -> np.ndarray:
    """Which of ``size`` units lie in a window whose start is in one of the runs [start, start + length)."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths - 1 + span, -1)
    return np.cumsum(edges[:size]) > 0
