"""Suffix-array dedup: byte strings of ``SPAN`` that start at two places, found by deep-shallow suffix sorting.

Only suffixes at the positions of a string synchronising set are sorted (about one byte in a hundred); any string of
``SPAN`` bytes holds one, at a place that its own content fixes. Runs of strings that share their surroundings form
classes; a class with two members is settled by counting, and a suffix whose first ``SPAN - STEP + 1`` bytes occur once
in the corpus goes no further. The rest, one suffix per class, is dealt to tasks by those bytes and sorted there:

* multikey quicksort, four symbols at a time, over the ``SHALLOW`` bytes after those that a group shares, all groups of a
  batch at once;
* groups that are still tied have long common prefixes; a blind trie over each orders them, comparing whole strings
  only once an insertion.

The bytes before the suffixes are sorted likewise, backwards. A string that starts ``l`` bytes before its suffix occurs
twice if another suffix agrees with it for ``SPAN - l`` bytes on and ``l`` bytes back: both are intervals of the sorted
orders, so pairs of interval numbers are compared, never pairs of suffixes.

A group of more than ``MOST_GROUP`` classes is not sorted in one task: its strings are counted by hash, with map-side sums.

Defined results: a null or empty text has no bytes; texts under ``SPAN`` bytes are kept; repeated rows count as places
of their own, whatever their doc_id; a null doc_id is an id like any other; an empty table gives an empty result; other
columns are never looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.anchors import BYTE_HASH, Rolling, covered, synchronised
from weft.llm.repeats import KEY, RUNS, joined, keyed
from weft.session import dealt, stored

SPAN = 400
STEP = 160
GRAM = 16
SHALLOW = 64
MOST_GROUP = 50_000
#: Bytes hashed at a time; longer texts are cut into stretches that overlap by a string.
STRETCH = 500_000
#: Suffixes sorted at a time.
BATCH = 20_000

_END = -1
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


def seeds(texts: DataFrame, span: int, step: int) -> DataFrame:
    def find(batches):
        for batch in batches:
            docs, hashes = batch.column(0), batch.column(1)
            rows = [(k, at, t[at : at + STRETCH + span - 1]) for k, x in enumerate(batch.column(2)) if x.is_valid and len(t := x.as_py().encode()) >= span for at in range(0, len(t) - span + 1, STRETCH)]
            while rows:
                held, many = 0, 0
                while many < len(rows) and (not many or held + len(rows[many][2]) <= 2 * STRETCH):
                    held, many = held + len(rows[many][2]), many + 1
                part, rows = rows[:many], rows[many:]
                sizes = np.array([len(t) for _, _, t in part])
                begins = np.cumsum(sizes) - sizes
                a, c, lo, n, p = synchronised(BYTE_HASH[np.frombuffer(b"".join(t for _, _, t in part), np.uint8)], begins, sizes, span, GRAM, step)
                of = np.searchsorted(begins, lo, "right") - 1
                row, at = np.array([r for r, _, _ in part]), np.array([x for _, x, _ in part])
                take = pa.array(row[of])
                yield pa.RecordBatch.from_arrays(
                    [docs.take(take), hashes.take(take), pa.array(a.view("i8")), pa.array(c.view("i8")), pa.array((lo - begins[of] + at[of]).astype("i4")), pa.array(n.astype("i4")), pa.array((p - lo).astype("i4"))],
                    ["doc_id", "h", "a", "c", "lo", "n", "back"],
                )

    return texts.mapInArrow(find, f"{RUNS}, back int")


def blind_trie(strings: list) -> tuple[list[int], list[int]]:
    """The order of strings, and how many bytes each shares with the one before it (the first: 0).

    Inner nodes are [depth, {byte: child}], leaves lists of equal strings' numbers. A string goes down by the bytes at
    the nodes' depths alone, is compared with one leaf, and is put in where the two part.
    """
    root = None
    at = lambda s, d: s[d] if d < len(s) else _END
    for k, s in enumerate(strings):
        if root is None:
            root = (None, [k])
            continue
        node, path = root, []
        while node[0] is not None:
            path.append(node)
            children = node[1]
            node = children.get(at(s, node[0])) or next(iter(children.values()))
        other = strings[node[1][0]]
        if s == other:
            node[1].append(k)
            continue
        shared = _shared(s, other)
        above = None
        for step in path:
            if step[0] >= shared:
                break
            above = step
        below = root if above is None else above[1].get(at(s, above[0]))
        if below is not None and below[0] == shared:
            below[1][at(s, shared)] = (None, [k])
            continue
        fresh = (shared, {at(other, shared): below, at(s, shared): (None, [k])})
        if above is None:
            root = fresh
        else:
            above[1][at(s, above[0])] = fresh
    order, lcp = [], []
    stack = [(root, 0)] if root else []
    while stack:
        node, shared = stack.pop()
        if node[0] is None:
            for i, k in enumerate(node[1]):
                order.append(k)
                lcp.append(len(strings[k]) if i else shared)
        else:
            for i, b in enumerate(sorted(node[1], reverse=True)):
                stack.append((node[1][b], shared if i == len(node[1]) - 1 else node[0]))
    return order, lcp


def _shared(s: bytes, t: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(s), len(t))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if s[lo:mid] == t[lo:mid] else (lo, mid - 1)
    return lo


def multikey_quicksort(words: np.ndarray, order: np.ndarray, sizes: np.ndarray) -> None:
    """Sorts the items of each segment of ``order`` (segments of ``sizes``, end to end) by their rows of ``words``, in place.

    Three-way partitions: each segment's items go before, with or after its pivot at the segment's word; those with it
    go on to the next word, the others stay at this one. All segments are parted in the same round.
    """
    starts = np.cumsum(sizes) - sizes
    depth = np.zeros(len(sizes), np.int64)
    while True:
        open_ = (sizes > 1) & (depth < words.shape[1])
        starts, sizes, depth = starts[open_], sizes[open_], depth[open_]
        if not len(sizes):
            return
        of = np.repeat(np.arange(len(sizes)), sizes)
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(of))
        items = order[at]
        key = words[items, depth[of]]
        thirds = np.stack([words[order[starts + k], depth] for k in (0 * sizes, sizes // 2, sizes - 1)])
        pivot = np.sort(thirds, axis=0)[1][of]
        part = 3 * of + np.where(key < pivot, 0, np.where(key == pivot, 1, 2))
        order[at] = items[np.argsort(part, kind="stable")]
        counts = np.bincount(part, minlength=3 * len(sizes)).reshape(-1, 3)
        starts = (starts[:, None] + np.cumsum(counts, axis=1) - counts).ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()
        sizes = counts.ravel()


def deep_shallow(strings: list, groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings within their groups: their order, and the bytes each shares with the one before it (-1: none there)."""
    m = len(strings)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.array([len(s) for s in strings], np.int64)
    symbols = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), np.uint8).reshape(m, shallow).astype(">u2") + np.uint16(1)
    symbols = np.where(np.arange(shallow) < ends[:, None], symbols, 0).astype(">u2")
    order = np.argsort(groups, kind="stable")
    fresh = np.concatenate([[True], groups[order][1:] != groups[order][:-1]])
    starts = np.flatnonzero(fresh)
    # four symbols to a word, of two bytes each: 0 stands for the end of a string
    multikey_quicksort(np.ascontiguousarray(symbols).view(">u8").astype(np.uint64), order, np.diff(np.append(starts, m)))
    sorted_ = symbols[order]
    differ = sorted_[1:] != sorted_[:-1]
    lcp = np.full(m, -1, np.int64)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), -2)  # -2: tied with the one before, so far
    lcp[fresh] = -1
    starts = np.flatnonzero(lcp != -2)
    stops = np.append(starts[1:], m)
    for lo, hi in zip(starts[stops - starts > 1], stops[stops - starts > 1], strict=True):
        inside = order[lo:hi]
        rank, shared = blind_trie([strings[i] for i in inside])
        order[lo:hi] = inside[rank]
        lcp[lo + 1 : hi] = shared[1:]
    return order, lcp


def repeated_starts(left: list, right: list, groups: np.ndarray, least: np.ndarray, most: np.ndarray, span: int, common: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, l) for each string of ``span`` bytes from l back (least to most) that another item of the group has too.

    left: the bytes before each suffix, backwards; right: the suffixes without the ``common`` bytes that all of a group share.
    """
    m = len(right)
    by_right, shared_right = deep_shallow(right, groups)
    shared_right = np.where(shared_right < 0, -1, shared_right + common)
    by_left, shared_left = deep_shallow(left, groups)
    rank, items, backs = np.empty(m, np.int64), [], []
    other = np.empty(m, np.int64)
    for back in range(int(least.min(initial=span)), int(most.max(initial=-1)) + 1):
        some = np.flatnonzero((least <= back) & (back <= most))
        if len(some) < 2:
            continue
        rank[by_right] = np.cumsum(shared_right < span - back)
        other[by_left] = np.cumsum(shared_left < back)
        key = rank[some] * (m + 1) + other[some]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(some), bool)
        twice[by[1:]] |= same
        twice[by[:-1]] |= same
        items.append(some[twice])
        backs.append(np.full(int(twice.sum()), back))
    return (np.concatenate(items), np.concatenate(backs)) if items else (np.zeros(0, np.int64), np.zeros(0, np.int64))


CONTEXT = "a long, c long, k long, back int, n int, bytes binary"


def contexts(texts: DataFrame, first: DataFrame, span: int) -> DataFrame:
    """The bytes that the first run of each class covers; back: bytes before the suffix."""

    def cut(batches):
        for batch in batches:
            out: tuple = ([], [], [], [], [], [])
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                if found.is_valid:
                    raw = text.as_py().encode()
                    for r in found.as_py():
                        for column, value in zip(out, (r["a"], r["c"], r["k"], r["back"], r["n"], raw[r["lo"] : r["lo"] + r["n"] - 1 + span]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["a", "c", "k", "back", "n", "bytes"])

    return joined(texts, first, F.struct("a", "c", "k", "back", "lo", "n")).mapInArrow(cut, CONTEXT)


def sort_groups(rows: DataFrame, span: int, common: int) -> DataFrame:
    """For rows that come group by group: a, c and the offsets in the run of strings that another class has."""

    def settle(rows):
        a = np.array([r[0] for r in rows], np.int64)
        p = np.array([r[2] for r in rows], np.int64)
        n = np.array([r[3] for r in rows], np.int64)
        left = [r[4][: r[2]][::-1] for r in rows]
        right = [r[4][r[2] + common : r[2] + span] for r in rows]
        item, back = repeated_starts(left, right, np.unique(a, return_inverse=True)[1], p - n + 1, p, span, common)
        by = np.lexsort((-back, item))
        item, off = item[by], (p[item] - back)[by]
        cuts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
        offsets = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(item)).astype("i4")), pa.array(off.astype("i4")))
        return pa.RecordBatch.from_arrays([pa.array(a[item[cuts]]), pa.array(np.array([r[1] for r in rows], np.int64)[item[cuts]]), offsets], ["a", "c", "offs"])

    def run(batches):
        held: list = []
        for batch in batches:
            held += list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True))
            end = len(held)
            while end and held[end - 1][0] == held[-1][0]:
                end -= 1
            if end >= BATCH:
                yield settle(held[:end])
                held = held[end:]
        if held:
            yield settle(held)

    return rows.mapInArrow(run, "a long, c long, offs array<int>")


def _counted(rows: DataFrame, span: int) -> DataFrame:
    """As sort_groups, for groups of any size: strings counted by hash."""

    def hashed(batches):
        for batch in batches:
            a, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, raw in enumerate(batch.column(5)):
                wh = Rolling(BYTE_HASH[np.frombuffer(raw.as_py(), np.uint8)]).all(span).view("i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(wh), a[k])), pa.array(np.full(len(wh), c[k])), pa.array(np.arange(len(wh), dtype="i4")), pa.array(wh)], ["a", "c", "off", "wh"])

    each = stored(rows.mapInArrow(hashed, "a long, c long, off int, wh long"), "strings")
    twice = each.groupBy("a", "wh").agg(F.count("*").alias("n")).filter("n > 1").select("a", "wh")
    return each.join(twice, ["a", "wh"]).groupBy("a", "c").agg(F.collect_list("off").alias("offs"))


def repeats(texts: DataFrame, span: int = SPAN, step: int = STEP, most_group: int = MOST_GROUP) -> DataFrame:
    """Runs of strings to remove: doc_id, h, lo, n and offs (null: the whole run, else the offsets of its strings)."""
    runs = stored(seeds(texts, span, step), "seeds")
    # tables of keys are written before they are joined: a join of two plain shuffles can split a hot key
    group = runs.groupBy("a").agg(F.count("*").alias("k"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    shared = stored(group.filter("k > 1").select("a", (F.col("c0") != F.col("c1")).alias("many")), "shared")
    met = runs.join(shared, "a")
    alone = met.filter("not many").select(*KEY, "lo", "n", F.lit(None).cast("array<int>").alias("offs"))

    many = stored(met.filter("many").drop("many"), "met")
    classes = many.groupBy("a", "c").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "h", "lo", "n", "back")).alias("x")).select("a", "c", "k", "x.*")
    sizes = classes.groupBy("a").agg(F.count("*").alias("size"))
    # dealt by a once for the sort; a group that is too large for one task leaves before
    cut = stored(contexts(texts, classes, span), "contexts")
    large = sizes.filter(F.col("size") > most_group).select("a")
    if large.isEmpty():
        later = sort_groups(cut.repartition("a").sortWithinPartitions("a"), span, span - step + 1)
    else:
        later = sort_groups(dealt(cut.join(large, "a", "left_anti"), "a").sortWithinPartitions("a"), span, span - step + 1)
        later = later.unionByName(_counted(cut.join(large, "a", "left_semi").select(*cut.columns), span))
    verdict = stored(cut.select("a", "c", "k").join(later, ["a", "c"], "left"), "verdict")
    judged = many.join(verdict, ["a", "c"]).select(*KEY, "lo", "n", F.when(F.col("k") > 1, F.lit(None)).otherwise(F.coalesce("offs", F.array().cast("array<int>"))).alias("offs"))
    return alone.unionByName(judged.filter("offs is null or size(offs) > 0"))


def suffix_dedup(docs: DataFrame, span: int = SPAN, step: int = STEP, id_col: str = "doc_id", text_col: str = "text", most_group: int = MOST_GROUP) -> DataFrame:
    """doc_id, n_bytes, spans (the removed runs as [from, to) pairs) and the digest of what is kept, for every row."""
    texts = keyed(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))

    def remove(batches):
        for batch in batches:
            out: tuple = ([], [], [])
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                raw, spans = (text.as_py() or "").encode(), np.zeros((0, 2), np.int64)
                size = len(raw)
                if found.is_valid:
                    starts, lengths = [], []
                    for r in found.as_py():
                        starts += [r["lo"]] if r["offs"] is None else [r["lo"] + o for o in r["offs"]]
                        lengths += [r["n"]] if r["offs"] is None else [1] * len(r["offs"])
                    gone = covered(size, np.array(starts, np.int64), np.array(lengths, np.int64), span)
                    spans = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype("i1"))).reshape(-1, 2)
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (size, [{"start": int(x), "end": int(y)} for x, y in spans], hashlib.sha256(raw).hexdigest()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "spans", "kept_sha256"])

    found = repeats(texts, span, step, most_group)
    out = joined(texts, found, F.struct("lo", "n", "offs")).mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start long, end long>>, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))
