"""Substring dedup by seed and extend: repeats of at least ``SPAN`` words across documents.

Seeds are winnowed anchors (window minima of 10-word grams): any two equal passages of ``SPAN`` words share one.
Documents are joined on them; anchors of one document alone are dropped there. A seed is extended both ways over the
windows dealt to it: first as a whole, by the hash of everything they cover, so that the inside of a copied passage is
settled by its class; where several classes of surroundings meet at a seed (the ends of a passage, edits), window by
window, once for each class. Windows that touch are merged, which leaves the maximal repeats.

A word is removed if a window of ``SPAN`` words over it also starts in a document with a smaller doc_id.

Defined results: a null or empty text has no words; texts under ``SPAN`` words are kept; rows with the same doc_id never
remove each other's words; rows with a null doc_id are left alone and remove nothing; an empty table gives an empty
result; other columns are never looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.anchors import Rolling, covered, winnowed
from weft.llm.repeats import KEY, RUNS, joined, keyed
from weft.session import stored

SPAN = 50
GRAM = 10
#: Words hashed at a time; a longer text is cut into stretches that overlap by a window.
STRETCH = 250_000


def word_hashes(words: list) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def stretches(rows, span: int, most: int):
    """Lists of (row, first unit, units) of at most about ``most`` units; a long sequence in overlapping parts."""
    batch, held = [], 0
    for row, units in rows:
        for at in range(0, max(1, len(units) - span + 1), most):
            part = units[at : at + most + span - 1]
            if held and held + len(part) > most:
                yield batch
                batch, held = [], 0
            batch.append((row, at, part))
            held += len(part)
    if batch:
        yield batch


def seeds(texts: DataFrame, span: int, gram: int) -> DataFrame:
    def find(batches):
        for batch in batches:
            docs, hashes = (batch.column(k).to_pylist() for k in (0, 1))
            rows = ((k, words) for k, t in enumerate(batch.column(2)) if t.is_valid and docs[k] is not None and len(words := t.as_py().encode().split()) >= span)
            for part in stretches(rows, span, STRETCH):
                sizes = np.array([len(w) for _, _, w in part])
                begins = np.cumsum(sizes) - sizes
                (a, c, lo, n), _ = winnowed(np.concatenate([word_hashes(w) for _, _, w in part]), begins, sizes, span, gram)
                of = np.searchsorted(begins, lo, "right") - 1
                row, at = np.array([r for r, _, _ in part]), np.array([x for _, x, _ in part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(docs, "i8")[row[of]] if None not in docs else [docs[r] for r in row[of]], pa.int64()), pa.array([hashes[r] for r in row[of]], pa.int64()), pa.array(a.view("i8")), pa.array(c.view("i8")), pa.array((lo - begins[of] + at[of]).astype("i4")), pa.array(n.astype("i4"))],
                    ["doc_id", "h", "a", "c", "lo", "n"],
                )

    return texts.mapInArrow(find, RUNS)


def _windows(texts: DataFrame, first: DataFrame, span: int) -> DataFrame:
    """a, c, m, off and the hash of each window of the first occurrence of each class."""

    def hashed(batches):
        for batch in batches:
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                if not found.is_valid:
                    continue
                runs = found.as_py()
                rolling = Rolling(word_hashes(text.as_py().encode().split()))
                n = np.array([r["n"] for r in runs])
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                wh = rolling.at(np.repeat([r["lo"] for r in runs], n) + off, span)
                each = lambda k: pa.array(np.repeat(np.array([r[k] for r in runs], "i8"), n))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([each("a"), each("c"), each("m"), pa.array(off.astype("i4")), pa.array(wh.view("i8"))], ["a", "c", "m", "off", "wh"])

    return joined(texts, first, F.struct("a", "c", "m", "lo", "n")).mapInArrow(hashed, "a long, c long, m long, off int, wh long")


def repeats(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Runs of windows to remove: doc_id, h, lo, n and offs (null: the whole run, else the offsets of its windows)."""
    runs = stored(seeds(texts, span, gram), "seeds")
    # tables of keys are written before they are joined: a join of two plain shuffles can split a hot key
    group = runs.groupBy("a").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    shared = stored(group.filter("low < high").select("a", "low", (F.col("c0") != F.col("c1")).alias("many")), "shared")
    met = runs.join(shared, "a")
    alone = met.filter("not many and doc_id > low").select(*KEY, "lo", "n", F.lit(None).cast("array<int>").alias("offs"))

    many = stored(met.filter("many").drop("low", "many"), "met")
    classes = many.groupBy("a", "c").agg(F.min(F.struct("doc_id", "h", "lo", "n")).alias("x"))
    first = classes.select("a", "c", F.col("x.doc_id").alias("m"), "x.*")
    windows = stored(_windows(texts, first, span), "windows")
    least = stored(windows.groupBy("a", "wh").agg(F.min("m").alias("least"), F.max("m").alias("most")).filter("least < most").select("a", "wh", "least"), "least")
    later = windows.join(least, ["a", "wh"]).filter("m > least").groupBy("a", "c").agg(F.collect_list("off").alias("offs"))
    verdict = stored(first.select("a", "c", "m").join(later, ["a", "c"], "left"), "verdict")
    judged = many.join(verdict, ["a", "c"]).select(*KEY, "lo", "n", F.when(F.col("doc_id") > F.col("m"), F.lit(None)).otherwise(F.coalesce("offs", F.array().cast("array<int>"))).alias("offs"))
    return alone.unionByName(judged.filter("offs is null or size(offs) > 0"))


def removed_units(found, size: int, span: int) -> np.ndarray:
    """Which of ``size`` units the found runs remove."""
    starts, lengths = [], []
    for r in found:
        if r["offs"] is None:
            starts.append(r["lo"])
            lengths.append(r["n"])
        else:
            starts += [r["lo"] + o for o in r["offs"]]
            lengths += [1] * len(r["offs"])
    return covered(size, np.array(starts, np.int64), np.array(lengths, np.int64), span)


def substring_dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words, joined by one space) of every row."""
    return _judged(docs, span, gram, id_col, text_col, digest=False)


def substring_digest(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As substring_dedup, with the SHA-256 of the kept text in its place."""
    return _judged(docs, span, gram, id_col, text_col, digest=True)


def _judged(docs: DataFrame, span: int, gram: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    texts = keyed(docs, id_col, text_col)

    def cut(batches):
        for batch in batches:
            out: tuple = ([], [], [])
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = 0
                n_words = len(words)
                if found.is_valid:
                    mask = removed_units(found.as_py(), n_words, span)
                    gone = int(mask.sum())
                    words = [words[i] for i in np.flatnonzero(~mask)]
                kept = b" ".join(words)
                for column, value in zip(out, (n_words, gone, hashlib.sha256(kept).hexdigest() if digest else kept.decode()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "n_words", "n_removed", last])

    last = "kept_sha256" if digest else "kept_text"
    found = repeats(texts, span, gram)
    return joined(texts, found, F.struct("lo", "n", "offs")).mapInArrow(cut, f"doc_id long, n_words long, n_removed long, {last} string")
