"""Multilingual mixture inference: the language proportions of each document.

Each language is a distribution over hashed byte trigrams of lower-cased text (``BUCKETS`` cells), counted over all
labelled documents with map-side sums; only the finished counts, languages times buckets, reach the driver.

A document is a mixture of languages. Its proportions are found by expectation-maximisation over the likelihoods of
its trigrams. The set of languages is the one of best penalised likelihood among the nested sets of largest proportions:
each language more must raise the log likelihood by ``PENALTY`` times half the log of the number of trigrams. Where no
mixture with another language is likelier than the best language alone (the derivative of the likelihood says so, which
is concave), nothing is iterated.

Defined results: null text, or text without a letter, is ``und`` with score 0, as is all text if nothing was learned;
rows with a null language are not learned from; ties go to the language that sorts first; repeated rows get equal
results; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import stored

#: Cells of a language's distribution; halved while languages times cells are more than ``MOST_CELLS``, which bounds the model.
BUCKETS = 1 << 16
MOST_CELLS = 1 << 25
SMOOTHING = 0.5
#: Expectation-maximisation ends when no proportion moves by this.
STILL = 1e-4
MOST_ROUNDS = 1000
PENALTY = 6.0
#: Languages whose counts a task holds before it hands them on.
MOST_HELD = 64
UND = "und"

#: Letters, and such numbers as are no digits.
_WORDY = re.compile(r"[^\W\d_]")
#: ASCII bytes that are no letters count as blanks.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numbers such as one half, a raised two or a Roman eight are none."""
    return any(m.group().isalpha() for m in _WORDY.finditer(text))


def trigrams(text: str) -> np.ndarray:
    """The bucket of each byte trigram of a text, blanks around it included."""
    b = _FOLD[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)]
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    key = key[key != 0x202020]
    return (key * np.uint32(2654435761)) >> np.uint32(16)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_cells: int = MOST_CELLS) -> tuple[list, np.ndarray]:
    """Languages in order, and the probability of each bucket (rows) in each (columns)."""

    def count(batches):
        sums: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                have = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                t = trigrams(text.as_py())
                if len(t) > 2000:
                    have += np.bincount(t, minlength=BUCKETS)
                else:
                    np.add.at(have, t, 1)
                if len(sums) > MOST_HELD:
                    yield from emit(sums)
                    sums = {}
        yield from emit(sums)

    def emit(sums):
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype("i4")), pa.array(have[at])], ["lang", "bucket", "n"])

    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = stored(labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    fold = 0
    while len(langs) << (16 - fold) > most_cells:
        fold += 1
    names = counts.sparkSession.createDataFrame([(x, k) for k, x in enumerate(langs)], "lang string, place int")
    n = np.zeros((BUCKETS >> fold, len(langs)))
    cells = counts.join(names, "lang").groupBy(F.call_function("shiftright", F.col("bucket"), F.lit(fold)).alias("bucket"), "place").agg(F.sum("n").alias("n"))
    table = cells.select("bucket", "place", "n").toArrow()
    n[table.column(0).to_numpy(), table.column(1).to_numpy()] = table.column(2).to_numpy()
    return langs, ((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * len(n))).astype(np.float32)


def _em(g: np.ndarray, pi: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """The proportions that maximise the likelihood, from pi on; times: how often each row counts."""
    share = np.full(len(g), 1 / len(g)) if times is None else times / times.sum()
    for _ in range(MOST_ROUNDS):
        new = pi * (share @ (g / (g @ pi)[:, None]))
        still = np.abs(new - pi).max() < STILL
        pi = new
        if still:
            break
    return pi / pi.sum()


def mixture(g: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """The proportions of the languages (columns) in a document of different trigrams (rows) with these likelihoods,
    each of which occurs so many times."""
    n, languages = g.shape
    times = np.ones(n) if times is None else times.astype(float)
    out = np.zeros(languages)
    logs = times @ np.log(g, dtype=float)
    best = int(np.argmax(logs))
    out[best] = 1.0
    total = times.sum()
    if languages == 1 or (times @ (g / g[:, best : best + 1]) / total).max() <= 1 + 1e-6:
        return out
    full = _em(g, np.full(languages, 1.0 / languages), times)
    order = np.argsort(-full, kind="stable")
    score = logs[best] - PENALTY * 0.5 * np.log(total)
    for size in range(2, languages + 1):
        members = order[:size]
        part = np.ascontiguousarray(g[:, members])
        pi = _em(part, full[members] / full[members].sum(), times)
        new = times @ np.log(part @ pi) - PENALTY * 0.5 * size * np.log(total)
        if new <= score:
            break
        score = new
        out[:] = 0
        out[members] = pi
    return out


def identify(docs: DataFrame, langs: list, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the largest proportion) and langs (the set with its proportions) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))
    schema = "doc_id long, lang_pred string, score double, langs map<string,double>"

    def infer(batches):
        names, likelihood = shared.value
        fold = np.uint32((BUCKETS // max(1, len(likelihood))).bit_length() - 1)
        for batch in batches:
            out: tuple = ([], [], [])
            for text in batch.column(1):
                text, shares = text.as_py(), None
                if text is not None and names and has_letter(text):
                    # a document has as many rows as different trigrams, at most one a cell, however long it is
                    cells, times = np.unique(trigrams(text) >> fold, return_counts=True)
                    shares = mixture(likelihood[cells], times)
                for column, value in zip(out, (UND, 0.0, []) if shares is None else (names[int(np.argmax(shares))], float(min(1.0, shares.max())), [(names[k], float(shares[k])) for k in np.flatnonzero(shares)]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "langs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(infer, schema)


def held_out(doc_id: Column) -> Column:
    """True for the fold that nothing is learned from; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))
