"""Line dedup by winnowing over line hashes.

Of each ``SPAN`` lines in a row the line of least hash is selected (the last of equals), so two equal runs of ``SPAN``
lines always select the same line: fingerprints are guaranteed. Positions are joined on them and fingerprints that occur
once are dropped. Around the others a match is extended both ways over the windows dealt to the fingerprint; the first
occurrence of each window, by (doc_id, position), is found with map-side minima, and every later one is deleted.
Windows that touch merge, which leaves whole repeated runs.

Lines are compared without outer white space; blank lines are no lines and stay. Runs are judged on the input, not on
what is left of it.

Defined results: a null or empty text has no lines and stays as it is; texts of fewer than ``SPAN`` lines are kept; rows
that repeat a doc_id and a text are one document; rows with a null doc_id are left alone and delete nothing; an empty
table gives an empty result; other columns are passed on or not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.anchors import covered, winnowed
from weft.llm.repeats import KEY
from weft.llm.substring_dedup import stretches, word_hashes
from weft.session import stored

SPAN = 3
#: Lines hashed at a time, and bytes of text in one batch that goes back to Spark.
STRETCH = 100_000
MOST_BYTES = 4_000_000
BLANK = b" \t\n\r\x0b\x0c"


def lines_of(text: str) -> list:
    """The lines of a text as stripped bytes; blank ones are empty."""
    return [x.strip(BLANK) for x in text.encode().split(b"\n")]


def fingerprints(docs: DataFrame, span: int) -> DataFrame:
    """doc_id, h, the fingerprint a, and the start and hash of each window dealt to it."""

    def find(batches):
        for batch in batches:
            docs, hashes = batch.column(0), batch.column(1)
            rows = ((k, lines) for k, t in enumerate(batch.column(2)) if t.is_valid and docs[k].is_valid and len(lines := [x for x in lines_of(t.as_py()) if x]) >= span)
            for part in stretches(rows, span, STRETCH):
                sizes = np.array([len(w) for _, _, w in part])
                begins = np.cumsum(sizes) - sizes
                (a, _, lo, n), rolling = winnowed(np.concatenate([word_hashes(w) for _, _, w in part]), begins, sizes, span, 1)
                starts = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                of = np.searchsorted(begins, starts, "right") - 1
                row, at = np.array([r for r, _, _ in part]), np.array([x for _, x, _ in part])
                take = pa.array(row[of])
                yield pa.RecordBatch.from_arrays(
                    [docs.take(take), hashes.take(take), pa.array(np.repeat(a, n).view("i8")), pa.array(rolling.at(starts, span).view("i8")), pa.array((starts - begins[of] + at[of]).astype("i4"))],
                    ["doc_id", "h", "a", "wh", "lo"],
                )

    return docs.mapInArrow(find, "doc_id long, h long, a long, wh long, lo int")


def later_runs(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, h and the starts of all windows that occur before, as an array."""
    found = stored(fingerprints(docs, span), "lines")
    # tables of keys are written before they are joined: a join of two plain shuffles can split a hot key
    shared = stored(found.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "shared")
    place = F.struct("doc_id", "h", "lo")
    met = found.join(shared, "a")
    first = stored(met.groupBy("a", "wh").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("a", "wh", "first"), "first")
    return met.join(first, ["a", "wh"]).filter(place > F.col("first")).groupBy(*KEY).agg(F.collect_list("lo").alias("found"))


def cut_lines(text: str, starts, span: int) -> tuple[int, int, str]:
    """How many lines a text has, how many of them windows at ``starts`` (numbers of lines that are not blank) delete, and the rest."""
    if "\n" not in text and starts is None:
        return int(bool(text.encode().strip(BLANK))), 0, text
    lines = text.split("\n")
    full = [k for k, x in enumerate(lines) if x.encode().strip(BLANK)]
    if starts is None:
        return len(full), 0, text
    at = np.asarray(starts, np.int64)
    dead = {full[k] for k in np.flatnonzero(covered(len(full), at, np.ones(len(at), np.int64), span))}
    return len(full), len(dead), "\n".join(x for k, x in enumerate(lines) if k not in dead)


def slices(texts: pa.Array, most: int = MOST_BYTES):
    """(from, to) of stretches of a column of texts that hold about ``most`` bytes each, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _judged(docs: DataFrame, span: int, id_col: str, text_col: str) -> DataFrame:
    """docs with the columns __text, __id and __found: the starts of the windows that go (null: none)."""
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__h": F.xxhash64(text), "__text": text})
    found = later_runs(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")), span)
    found = found.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("found").alias("__found"))
    return keyed.join(found, ["__id", "__h"], "left")


def _cut(docs: DataFrame, span: int, id_col: str, text_col: str, last: str, kept) -> DataFrame:
    """doc_id, n_lines, n_removed and ``kept`` of what is left, as column ``last``. Batches out are bounded in bytes."""

    def cut(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                rows = [(0, 0, None) if not t.is_valid else cut_lines(t.as_py(), f.as_py(), span) for t, f in zip(part.column(1), part.column(2), strict=True)]
                lines, gone, rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(map(kept, rest), pa.string(), size=len(rest))], ["doc_id", "n_lines", "n_removed", last])

    rows = _judged(docs, span, id_col, text_col).select("__id", "__text", "__found")
    return rows.mapInArrow(cut, f"doc_id long, n_lines long, n_removed long, {last} string")


def line_dedup(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, of every row."""
    return _cut(docs, span, id_col, text_col, "text", lambda rest: rest)


def line_digest(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As line_dedup, with the SHA-256 of the text that is left (null: of none) in its place, so that no text goes back to Spark."""
    return _cut(docs, span, id_col, text_col, "kept_sha256", lambda rest: hashlib.sha256((rest or "").encode()).hexdigest())


def without_later_runs(docs: DataFrame, span: int = SPAN, text_col: str = "text") -> DataFrame:
    """docs with later repeated runs deleted from the text, n_chars (a whole number, if there) kept in step; rows that lose their last line go."""
    # columns by place, whatever their names
    own = [f"__{k}" for k in range(len(docs.columns))]
    text_at, size_at = docs.columns.index(text_col), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    rows = _judged(docs, span, "doc_id", text_col)
    rows = rows.select(*(F.col("__text" if k == text_at else f"`{c}`").alias(own[k]) for k, c in enumerate(docs.columns)), "__found")

    def cut(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(text_at)):
                part = batch.slice(lo, hi - lo)
                columns, found = part.columns[:-1], part.column(len(own))
                texts, kept = columns[text_at], [True] * len(part)
                if found.null_count < len(part):
                    texts = texts.to_pylist()
                    sizes = None if size_at is None else columns[size_at].to_pylist()
                    for k in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)):
                        lines, gone, texts[k] = cut_lines(texts[k], found[k].as_py(), span)
                        kept[k] = gone < lines
                        if sizes and gone:
                            sizes[k] = len(texts[k])
                    columns[text_at] = pa.array(texts, columns[text_at].type)
                    if sizes:
                        columns[size_at] = pa.array(sizes, pa.int64()).cast(columns[size_at].type)
                yield pa.RecordBatch.from_arrays(columns, own).filter(pa.array(kept))

    return rows.mapInArrow(cut, T.StructType([T.StructField(n, rows.schema[n].dataType) for n in own])).toDF(*docs.columns)
