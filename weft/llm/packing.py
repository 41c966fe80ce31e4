"""Best-fit packing planned over a histogram of lengths.

Texts become token ids plus a closing 0 and are cut into pieces of at most ``capacity``. Only the counts per length (at
most ``capacity`` rows, whatever the input) come to the driver. Best-fit decreasing runs over those counts: all
pieces of one length that go into sequences with the same room are placed in one step. The plan is a short list of
slots (length, ranks, first sequence, pieces a sequence, offset); pieces find theirs by joining on their rank within
their length. Ranks are dealt out in two levels, so no length, however common, is numbered in one task.

Defined results: a null or empty text is the single id 0; white space alone gives the same; repeated rows are packed as
often as they occur; rows with a null id are packed with a null id; an empty table gives no pieces.
"""

from __future__ import annotations

import array
import bisect
import re
import sys
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.tables import id_text
from weft.session import stored

CAPACITY = 2048
#: The plan is broadcast up to so many slots; a longer one is joined like any table.
MOST_BROADCAST_SLOTS = 200_000
#: Words whose ids a worker remembers.
MOST_CACHED_WORDS = 1_600_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: A lone full stop or comma between a letter and white space.
STOP = re.compile(rb"([a-z])([.,])(?=[ \n])")

_encoders: dict = {}


class WordEncoder:
    """Token ids of texts by their white-space separated words, as little-endian uint32 bytes.

    The tokenizer lowers case and drops white space, and no token spans it, so the ids of a text are those of its words
    in turn. ASCII letters are lowered and a single full stop or comma after one is set apart before words are looked
    up, which the tokenizer would do too; texts that may hold its special tokens, whose case counts, are left as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def words(self, text: str) -> list:
        raw = text.encode()
        return raw.split() if b"<|" in raw else STOP.sub(rb"\1 \2", raw.lower()).split()

    def learn(self, words: list) -> None:
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if len(self.known) + len(new) > MOST_CACHED_WORDS:
            self.known = {}
            new = list(dict.fromkeys(words))
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.known[w] = array.array("I", e.ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in e.ids)

    def ids(self, text: str) -> bytes:
        words = self.words(text)
        self.learn(words)
        return b"".join(map(self.known.__getitem__, words)) + b"\0\0\0\0"


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the CRC of its ids."""

    def cut(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            out: tuple = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(enc.ids(text.as_py() or ""))
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs, id_col, text_col).mapInArrow(cut, PIECES)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Slots (length, rank_from, rank_to, sequence, each, offset) and the number of sequences.

    Ranks rank_from up to rank_to, ``each`` a sequence, go into the sequences from ``sequence`` on, from ``offset`` on.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # rooms that some sequences have, ascending
    slots, sequences = [], 0

    def put(r: int, first: int, n: int) -> None:
        if r > 0 and n > 0:
            if not room.setdefault(r, []):
                bisect.insort(sizes, r)
            room[r].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left > 0:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                r = sizes[k]
                first, n = room[r].pop()
                if not room[r]:
                    del sizes[k]
            else:
                r, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            most = r // length
            full = min(n, left // most)
            for begin, bins, each in ((first, full, most), (first + full, min(1, n - full) if left - full * most > 0 else 0, left - full * most)):
                if bins:
                    each = min(each, most)
                    slots.append((length, rank, rank + bins * each, begin, each, capacity - r))
                    rank, left = rank + bins * each, left - bins * each
                    put(r - each * length, begin, bins)
                    first, n = begin + bins, n - bins
            put(r, first, n)
    return slots, sequences


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its place in it."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = best_fit(counts, capacity)
    plan = spark.createDataFrame(slots, "length long, rank_from long, rank_to long, first_sequence long, each long, base long")

    parts = max(64, sum(counts.values()) // 100_000)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(within) - 1).join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("place"))
    plan = F.broadcast(plan) if len(slots) <= MOST_BROADCAST_SLOTS else plan
    a, s = ranked.alias("a"), plan.alias("s")
    placed = a.join(s, (F.col("a.length") == F.col("s.length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", F.col("a.length").alias("length"), "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("base") + nth % F.col("each") * F.col("a.length")).alias("offset"),
    )
