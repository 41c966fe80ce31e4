"""Language-model scoring by cross-entropy difference.

Two matched bigram models, of a target corpus and of the whole (background) corpus, share one vocabulary and one
smoothing: every word of the corpus is in it, and every bigram has its own count. The background is counted over all
documents and its counts are scaled to the target's number of tokens, which is what a draw of that size would hold on
average; so both models trust what they have seen equally, however much larger the corpus is. A document's score is its
mean loss per token under the target model less that under the background model: the lower, the more it is like the target.

A word's probability after another is (pairs + PRIOR * unigram) / (occurrences of the other + PRIOR), the unigram one
(count + 1) / (tokens + words + 1).

Texts are read once, into chunks of about ``CHUNK`` tokens (numbers into the chunk's own words). A chunk sends one
count for each different word and bigram it has to the bucket of that key; a bucket sums the counts of all chunks and
answers each chunk in the chunk's own order, so a hot bigram is one entry a chunk and no task holds a whole model. Keys
are 63-bit hashes with a bit that tells words from bigrams.

Defined results: a null or empty text, or one without words, has no tokens and null losses; without target documents
the target model is uniform and the background is not scaled; rows with null ids are counted and scored; repeated rows count as often as they occur; an
empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.anchors import mixed
from weft.llm.jaccard_join import _groups
from weft.llm.substring_dedup import word_hashes
from weft.session import stored

#: Occurrences of a context that its bigrams need to weigh as much as the unigram estimate.
PRIOR = 4.0
#: Tokens of a chunk, but for a longer last text.
CHUNK = 1 << 20
#: Least buckets, and tokens of the corpus for each when there are more.
BUCKETS, BUCKET_TOKENS = 64, 1 << 22

U = np.uint64
#: The word before the first of a text.
START = U(0x9E3779B97F4A7C15)

_BLANKS = bytes(32 if chr(b) in '.,;:!?"()[]{}' else b for b in range(256))


def tokens(text: str | None) -> list:
    """Lower-case words without punctuation around them, as bytes."""
    return text.lower().encode().translate(_BLANKS).split() if text else []


def _packed(values: np.ndarray) -> bytes:
    """Numbers by byte planes, deflated."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def chunks(texts: DataFrame, most: int = CHUNK) -> DataFrame:
    """(chunk, tokens, ids, sizes, words, at): texts as numbers into the hashes of a chunk's words, the commonest first."""

    def cut(batches):
        number, ids, held, tasks = defaultdict(), [], [], 0
        number.default_factory = number.__len__

        def row():
            sizes = np.array([len(x) for x in held], "u4")
            at = np.concatenate(held) if held else np.zeros(0, "u4")
            order = np.argsort(-np.bincount(at, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), "u4")
            rank[order] = np.arange(len(order), dtype="u4")
            columns = ([TaskContext.get().partitionId() << 32 | tasks], [len(at)], [ids], [_packed(sizes)], [word_hashes(list(number))[order].tobytes()], [_packed(rank[at])])
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), *(pa.binary(),) * 3), strict=True)], ["chunk", "tokens", "ids", "sizes", "words", "at"])

        n = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = tokens(text.as_py())
                ids.append(doc_id)
                held.append(np.fromiter(map(number.__getitem__, words), "u4", len(words)))
                n += len(words)
                if n >= most:
                    yield row()
                    number.clear()
                    ids, held, tasks, n = [], [], tasks + 1, 0
        if ids:
            yield row()

    return texts.mapInArrow(cut, "chunk long, tokens long, ids array<long>, sizes binary, words binary, at binary")


class Chunk:
    """A chunk's documents (``doc`` of each token), its bigrams (``pair`` of each token, ``a`` and ``b`` of each pair) and keys.

    Word number ``len(words) - 1`` is the start. keys: those of pairs, then of words; order: the same by key.
    """

    def __init__(self, sizes: bytes, words: bytes, at: bytes):
        self.sizes, at = _unpacked(sizes, "u4").astype(np.int64), _unpacked(at, "u4").astype(np.int64)
        words = np.concatenate([np.frombuffer(words, U), [START]])
        self.words = m = len(words)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        begins = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        before = np.empty_like(at)
        before[1:] = at[:-1]
        before[begins] = m - 1
        pairs, self.pair = np.unique(before * m + at, return_inverse=True)
        self.a, self.b = np.divmod(pairs, m)
        self.at, bit = at, U(1)
        scrambled = mixed(words)
        self.keys = np.concatenate([mixed(scrambled[self.a] * U(3) + words[self.b]) & ~bit, scrambled | bit])
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self, marked: np.ndarray) -> tuple:
        """Of each key, in the marked documents and in all."""
        for weights in (marked.astype(float), np.ones(len(marked))):
            each = weights[self.doc]
            words = np.bincount(self.at, each, self.words)
            words[-1] = weights[self.sizes > 0].sum()
            yield np.concatenate([np.bincount(self.pair, each, len(self.a)), words]).astype("u4")


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))


def sent(marked: DataFrame, bits: int) -> DataFrame:
    """(bucket, chunk, keys, counts) of chunks with ``marks``, the positions of target documents. keys: sorted, as differences."""

    def send(batches):
        for batch in batches:
            for row in (r for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
                c = Chunk(row["sizes"], row["words"], row["at"])
                target = np.zeros(len(c.sizes), bool)
                target[np.array(row["marks"] or [], int)] = True
                keys, (t, b) = c.keys[c.order], (x[c.order] for x in c.counts(target))
                cuts = _bounds(keys, bits)
                full = np.flatnonzero(np.diff(cuts))
                spans = [slice(cuts[k], cuts[k + 1]) for k in full]
                columns = (pa.array(full.astype("i4")), pa.array(np.full(len(full), row["chunk"])), pa.array([_packed(np.diff(keys[s], prepend=U(0))) for s in spans], pa.binary()), pa.array([_packed(np.concatenate([t[s], b[s]])) for s in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(list(columns), ["bucket", "chunk", "keys", "counts"])

    return marked.select("chunk", "sizes", "words", "at", "marks").mapInArrow(send, "bucket int, chunk long, keys binary, counts binary")


def summed(requests: DataFrame) -> DataFrame:
    """(bucket, chunk, counts, words, target, background): what each chunk asked for, summed over all chunks.

    words and tokens of the bucket stand in its first row.
    """

    def answer(bucket, rows):
        each = [np.cumsum(_unpacked(k, "u8"), dtype=U) for _, k, _ in rows]
        keys, sizes = np.concatenate(each), [len(k) for k in each]
        own = [_unpacked(x, "u4").reshape(2, -1) for _, _, x in rows]
        found, place = np.unique(keys, return_inverse=True)
        sums = [np.bincount(place, np.concatenate([x[k] for x in own]), len(found)).astype("i8") for k in (0, 1)]
        word = (found & U(1) == 1) & (found != (mixed(np.array([START])) | U(1))[0])
        totals = [int(word.sum()), *(int(s[word].sum()) for s in sums)]
        ends = np.cumsum(sizes)
        parts = [_packed(np.concatenate([s[place[e - n : e]] for s in sums])) for n, e in zip(sizes, ends, strict=True)]
        zero = [0] * (len(rows) - 1)
        columns = ([bucket] * len(rows), [c for c, _, _ in rows], parts, *([t, *zero] for t in totals))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["bucket", "chunk", "counts", "words", "target", "background"])

    def add(batches):
        last, rows = None, []
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            values = list(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True))
            for lo, hi in _groups(buckets):
                if rows and buckets[lo] != last:
                    yield answer(last, rows)
                    rows = []
                last = int(buckets[lo])
                rows += values[lo:hi]
        if rows:
            yield answer(last, rows)

    return requests.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "bucket int, chunk long, counts binary, words long, target long, background long")


def lm_score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row. targets: the ids (doc_id) of target documents."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = stored(chunks(texts, chunk), "chunks")
    bits = (max(BUCKETS, (held.agg(F.sum("tokens")).first()[0] or 0) // BUCKET_TOKENS) - 1).bit_length()
    # ids of target documents grow with the corpus, so they are merged with its ids, never broadcast
    wanted = targets.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    marks = held.select("chunk", F.posexplode("ids").alias("pos", "doc_id")).join(wanted.hint("merge"), "doc_id").groupBy("chunk").agg(F.collect_list("pos").alias("marks"))
    answers = stored(summed(sent(held.drop("ids").join(marks.hint("merge"), "chunk", "left"), bits)), "answers")
    words, target, background = (x or 0 for x in answers.agg(F.sum("words"), F.sum("target"), F.sum("background")).first())
    models = [(target, 1.0), (background, target / background if target else 1.0)]

    def score(batches):
        for batch in batches:
            for row in (r for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
                c = Chunk(row["sizes"], row["words"], row["at"])
                sorted_counts = [np.concatenate(x) for x in zip(*(_unpacked(a["counts"], "i8").reshape(2, -1) for a in sorted(row["answers"], key=lambda a: a["bucket"])), strict=True)]
                losses = []
                for (total, scale), by_key in zip(models, sorted_counts, strict=True):
                    n = np.empty(len(by_key))
                    n[c.order] = by_key * scale
                    pairs, single = n[: len(c.a)], n[len(c.a) :]
                    unigram = (single[c.b] + 1) / (total * scale + words + 1)
                    loss = -np.log((pairs + PRIOR * unigram) / (single[c.a] + PRIOR))
                    losses.append(np.bincount(c.doc, loss[c.pair], len(c.sizes)) / np.maximum(c.sizes, 1))
                none = c.sizes == 0
                columns = [pa.array(row["ids"], pa.int64()), pa.array(c.sizes), *(pa.array(x, mask=none) for x in (*losses, losses[0] - losses[1]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    # every chunk has an answer: at least that on the start
    each = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    return held.join(each.hint("merge"), "chunk").select("ids", "sizes", "words", "at", "answers").mapInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
