"""N-gram Jaccard join by chosen paths.

Texts become sets of 5-word shingles; equal sets are one class of copies, joined once. Each set is embedded in
``COORDINATES`` min-hashes. A repetition splits the sets recursively: a node draws each coordinate with probability
BRANCHING / (threshold * COORDINATES), by a hash of its path, and deals its sets to one child for each value of a drawn
coordinate, so sets of at least the threshold's similarity meet in BRANCHING children or more on average. A bucket of at most
``SMALL`` sets, or whose sets are alike on average (see ``buckets_of``), is compared by brute force on sketches of the
min-hashes; others go a level deeper. Repetitions go
on until a pair at the threshold is missed with probability under ``MISS`` (see ``repetitions``).

Sketch pairs only propose; sets that proposals connect are brought together, block by block, and every pair among them is
compared by its exact intersection. Pairs are counted where they are found and never written: each block gives one
row per set, with its links and its least neighbour, and classes are the connected components of those.

Buckets that stay large at the deepest level, and large connected groups, are compared block against block, so no
task holds more than two blocks and no link is lost.

Defined results: a text of one to four words is one shingle; a null, empty or blank text has no set, is its own class
and has no links; rows with a null doc_id are returned with a null class and no links; repeated rows are copies; an
empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.anchors import Rolling, mixed
from weft.llm.repeats import KEY, joined, keyed
from weft.llm.substring_dedup import word_hashes
from weft.operators.components import connected_components
from weft.session import stored

WORDS = 5
THRESHOLD = 0.8
COORDINATES = 64
#: Largest bucket that is compared by brute force, and depth at which larger ones are compared by blocks instead.
SMALL = 1024
DEPTH = 4
#: Children in which a pair at the threshold meets, on average, for each node it is in. Above 1 a pair is less likely to
#: die out, so fewer repetitions do; each node has more children in turn.
BRANCHING = 1.25
#: Mean similarity from which a bucket is not split, and the min-hashes it is estimated from.
ALIKE = 0.5
SIGNS = 16
#: A pair at the threshold may be missed with this probability.
MISS = 1e-4
#: Share of equal min-hashes from which a pair is proposed: about 4.5 standard deviations under the threshold.
PROPOSED = 0.57
#: Sketches of one block of a large bucket.
BLOCK_SKETCHES = 2048
#: Sets, and shingles in all, of one block in the exact comparison.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 2_000_000

U = np.uint64
#: Stands for a null doc_id where one row of each class is chosen.
LAST = (1 << 63) - 1
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, COORDINATES, dtype=U) * U(2) + U(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    h = word_hashes(text.encode().split())
    if not len(h):
        return np.zeros(0, U)
    return np.unique(Rolling(h).all(min(words, len(h))))


def unproposed(threshold: float) -> float:
    """The chance that the sketches of a pair at the threshold agree too little for a proposal."""
    return sum(math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in range(math.ceil(PROPOSED * COORDINATES)))


def repetitions(threshold: float, miss: float, depth: int = DEPTH) -> int:
    """Repetitions until a pair at the threshold is missed with probability under ``miss``, however deep its buckets are split.

    At the root each of the coordinates is drawn with probability BRANCHING / (threshold * COORDINATES) and agrees with
    probability ``threshold``: none is drawn and agrees with probability (1 - BRANCHING / COORDINATES) ^ COORDINATES.
    Each level further lets a pair through with at least the fraction that such a branching process keeps. What sketches
    miss is taken off ``miss``, up to half of it.
    """
    kept = 1.0
    for _ in range(depth):
        kept = 1 - (1 - BRANCHING * kept / COORDINATES) ** COORDINATES
    return math.ceil(math.log(miss - min(unproposed(threshold), miss / 2)) / math.log(1 - kept))


def sets(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, h, two hashes of the set of shingles, its size and its min-hashes."""

    def embed(batches):
        for batch in batches:
            rows = [shingles(t.as_py(), words) if t.is_valid else np.zeros(0, U) for t in batch.column(2)]
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                n = np.array([len(r) for r in part])
                full = np.flatnonzero(n)
                values = np.concatenate(part) if len(full) else np.zeros(0, U)
                begins = (np.cumsum(n) - n)[full]
                s1, s2 = np.zeros(len(part), U), np.zeros(len(part), U)
                sig = np.zeros((len(part), COORDINATES), np.uint32)
                if len(full):
                    s1[full] = np.add.reduceat(mixed(values), begins)
                    s2[full] = np.bitwise_xor.reduceat(mixed(values ^ U(0x5851F42D4C957F2D)), begins)
                    for k, factor in enumerate(_FACTORS):
                        sig[full, k] = (np.minimum.reduceat(values * factor, begins) >> U(32)).astype(np.uint32)
                ids, h = batch.column(0).slice(at, 512), batch.column(1).slice(at, 512)
                packed = pa.array([r.tobytes() for r in sig], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, h, pa.array(s1.view("i8")), pa.array(s2.view("i8")), pa.array(n.astype("i4")), packed], ["doc_id", "h", "s1", "s2", "n", "sig"])

    return texts.mapInArrow(embed, "doc_id long, h long, s1 long, s2 long, n int, sig binary")


def _drawn(paths: np.ndarray, threshold: float) -> np.ndarray:
    """Which coordinates each node draws, by its path."""
    chance = mixed(paths[:, None] ^ mixed(np.arange(1, COORDINATES + 1, dtype=U))[None, :])
    return chance < U(int((1 << 64) * BRANCHING / (threshold * COORDINATES)))


def children(rows: DataFrame, threshold: float, roots: int = 0) -> DataFrame:
    """(id, path, signs) of the next level for rows (id, sig[, path]); without paths, of the first level of ``roots``
    repetitions. signs: one bit of each of ``SIGNS`` min-hashes."""

    def split(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(ids), COORDINATES)
            signs = ((sig[:, :SIGNS] & np.uint32(1)) << np.arange(SIGNS, dtype=np.uint32)).sum(axis=1).astype("i4")
            starts = [np.full(len(ids), mixed(np.array([r + 1], U))[0]) for r in range(roots)] or [batch.column(2).to_numpy().view(U)]
            for paths in starts:
                row, k = np.nonzero(_drawn(paths, threshold) if not roots else np.broadcast_to(_drawn(paths[:1], threshold), sig.shape)) if len(ids) else (np.zeros(0, int),) * 2
                child = mixed(paths[row] ^ mixed((sig[row, k].astype(U) << U(8)) | k.astype(U)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(child.view("i8")), pa.array(signs[row])], ["id", "path", "signs"])

    columns = ["id", "sig"] if roots else ["id", "sig", "path"]
    return rows.select(*columns).mapInArrow(split, "id long, path long, signs int")


def buckets_of(at: DataFrame) -> DataFrame:
    """(path, size, alike): buckets of two sets or more, and the mean similarity of their sets.

    Signs of equal min-hashes are equal and others are so by chance, so the square of a sum of signs (+1, -1) over a
    bucket of n sets is n + n (n - 1) similarity on average: sums on the map side, whatever the bucket's size.
    """
    size = F.count("*").cast("double")
    bit = lambda k: F.call_function("shiftright", F.col("signs"), F.lit(k)).bitwiseAND(F.lit(1)).cast("long")
    sums = [F.pow(2 * F.sum(bit(k)) - size, F.lit(2.0)) for k in range(SIGNS)]
    alike = (sum(sums[1:], sums[0]) / SIGNS - size) / (size * (size - 1))
    return at.groupBy("path").agg(F.count("*").alias("size"), F.when(size > 1, alike).alias("alike")).filter("size > 1")


def _groups(keys: np.ndarray):
    """(from, to) of each stretch of equal keys."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
    return zip(cuts[:-1], cuts[1:], strict=True)


def _roots_of(linked: np.ndarray) -> np.ndarray:
    """The least index each index is connected to, for a symmetric boolean matrix."""
    m = len(linked)
    label = np.arange(m)
    linked = linked | np.eye(m, dtype=bool)
    while True:
        least = np.where(linked, label[None, :], m).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _by_group(batches, key: int, least: int):
    """Rows of sorted batches as column lists, cut between groups, of at least ``least`` rows where there are so many."""
    held: list | None = None
    for batch in batches:
        new = [c.to_pylist() for c in batch.columns]
        held = new if held is None else [a + b for a, b in zip(held, new, strict=True)]
        end = len(held[key])
        while end and held[key][end - 1] == held[key][-1]:
            end -= 1
        if end >= least:
            yield [c[:end] for c in held]
            held = [c[end:] for c in held]
    if held and held[key]:
        yield held


def propose(buckets: DataFrame) -> DataFrame:
    """(src, dst) edges that connect the sets of a bucket whose sketches agree. Rows: bucket, side, id, sketch, sorted by bucket.

    Sides 0 and 1 are two blocks of one large bucket; where both occur only pairs across are looked at, 2 is a block alone.
    """

    def compare(batches):
        for bucket, side, ids, sketch in _by_group(batches, 0, 4096):
            ids, side = np.array(ids), np.array(side)
            flat = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(ids), COORDINATES)
            src, dst = [], []
            for lo, hi in _groups(np.array(bucket)):
                m = hi - lo
                if m == 1:
                    continue
                a, linked = flat[lo:hi], np.zeros((m, m), bool)
                for k in range(0, m, 128):
                    linked[k : k + 128] = (a[k : k + 128, None, :] == a[None, :, :]).sum(axis=2, dtype=np.int32) >= PROPOSED * COORDINATES
                if (side[lo:hi] != 2).any():
                    linked &= side[lo:hi, None] != side[None, lo:hi]
                group = ids[lo:hi]
                order = np.argsort(group)
                root = _roots_of(linked[np.ix_(order, order)])
                moved = root != np.arange(m)
                src.append(group[order][moved])
                dst.append(group[order][root[moved]])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return buckets.mapInArrow(compare, "src long, dst long")


def blocked(rows: DataFrame, blocks: str) -> DataFrame:
    """Rows (bucket, id, ...) of buckets cut into ``blocks`` (a column), once for every pair of blocks they belong to.

    Gives bucket as a new key of the pair and side: 2 for a block alone, else 0 or 1.
    """
    own = F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    pairs = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    key = F.when(F.col(blocks) == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return pairs.withColumns({"bucket": key, "side": side})


def proposals(reps: DataFrame, threshold: float, small: int, depth: int, miss: float) -> DataFrame:
    """(src, dst): edges whose components hold every pair at the threshold, but for the chance ``miss``."""
    at = stored(children(reps, threshold, repetitions(threshold, miss, depth)), "paths-1")
    leaves = []
    for level in range(1, depth + 1):
        # further levels would not part the sets of a bucket that are alike
        counts = buckets_of(at).select("path", "size", ((F.col("size") > small) & (F.col("alike") < ALIKE)).alias("split"))
        sizes = stored(counts, f"sizes-{level}")
        known = at.select("id", "path").join(sizes, "path")
        deeper = level < depth and not sizes.filter("split").isEmpty()
        leaves.append(known.filter("not split") if deeper else known)
        if not deeper:
            break
        at = stored(children(known.filter("split").join(reps.select("id", "sig"), "id"), threshold), f"paths-{level + 1}")
    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    rows = rows.select(F.col("path").alias("bucket"), "id", F.ceil(F.col("size") / F.lit(BLOCK_SKETCHES)).alias("blocks"))
    sketches = reps.select("id", "sketch")
    rows = blocked(rows.join(sketches, "id"), "blocks").select("bucket", "side", "id", "sketch")
    return propose(rows.repartition("bucket").sortWithinPartitions("bucket")).distinct()


def _linked(sizes: np.ndarray, values: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets (laid end to end, by size) are at the threshold: exact intersections by a matrix product."""
    m = len(sizes)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    many = np.bincount(column)[column] > 1
    owner, column = owner[many], np.unique(column[many], return_inverse=True)[1]
    common = np.zeros((m, m), np.float32)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if hi > lo:
            block = np.zeros((m, width), np.float32)
            block[owner[lo:hi], column[lo:hi] - k * width] = 1
            common += block @ block.T
    both = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * both
    np.fill_diagonal(linked, False)
    return linked


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, root, sets, docs): exact links of each set within its pair of blocks. Rows: bucket, side, id, copies, values."""

    def compare(batches):
        for bucket, side, ids, copies, values in _by_group(batches, 0, 256):
            ids, side, copies = np.array(ids), np.array(side), np.array(copies)
            out: tuple = ([], [], [], [])
            for lo, hi in _groups(np.array(bucket)):
                if hi - lo == 1:
                    continue
                sizes = np.array([len(v) // 8 for v in values[lo:hi]])
                linked = _linked(sizes, np.frombuffer(b"".join(values[lo:hi]), U), threshold)
                if (side[lo:hi] != 2).any():
                    linked &= side[lo:hi, None] != side[None, lo:hi]
                some = np.flatnonzero(linked.any(axis=1))
                if not len(some):
                    continue
                linked, group = linked[np.ix_(some, some)], ids[lo:hi][some]
                order = np.argsort(group)
                root = np.empty(len(some), np.int64)
                root[order] = group[order][_roots_of(linked[np.ix_(order, order)])]
                for column, value in zip(out, (group, root, linked.sum(axis=1), linked @ copies[lo:hi][some]), strict=True):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype("i8")) for x in out], ["id", "root", "sets", "docs"])

    return rows.mapInArrow(compare, "id long, root long, sets long, docs long")


def _exact(texts: DataFrame, reps: DataFrame, groups: DataFrame, words: int, threshold: float) -> DataFrame:
    def gather(batches):
        for batch in batches:
            out: tuple = ([], [], [], [], [])
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                if found.is_valid:
                    values = shingles(text.as_py(), words).tobytes()
                    for r in found.as_py():
                        for column, value in zip(out, (r["bucket"], r["id"], r["copies"], r["blocks"], values), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(),) * 4 + (pa.binary(),), strict=True)], ["bucket", "id", "copies", "blocks", "values"])

    members = groups.join(reps.select("id", "doc_id", "h", "n", "copies"), "id")
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    sizes = stored(sizes, "group-sizes")
    placed = members.join(sizes, "component").select(*KEY, F.col("component").alias("bucket"), "id", "copies", "blocks")
    full = joined(texts, placed, F.struct("bucket", "id", "copies", "blocks")).mapInArrow(gather, "bucket long, id long, copies long, blocks long, values binary")
    rows = blocked(full, "blocks").select("bucket", "side", "id", "copies", "values")
    return verify(rows.repartition("bucket").sortWithinPartitions("bucket"), threshold)


def _classes(texts: DataFrame, threshold: float, words: int, small: int, depth: int, miss: float) -> DataFrame:
    """doc_id, h, copy (the doc_id and h of the first copy), class_of (those of its class's first), copies, sets and docs of
    every row of texts; the last five are null where a row has no set."""
    all_sets = stored(sets(texts, words), "sets")
    some = all_sets.filter("doc_id is not null and n > 0")
    first = some.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "h")).alias("x"), F.count("*").alias("copies")).select("s1", "s2", "copies", "x.*")
    kept = F.first(F.struct("doc_id", "h", "n", "copies", "sig")).alias("x")
    reps = some.join(first, ["s1", "s2", *KEY]).groupBy("s1", "s2").agg(kept).select(F.xxhash64("s1", "s2").alias("id"), "s1", "s2", "x.*")
    # the sketch is the low byte of each min-hash
    sketch = F.unhex(F.expr(f"array_join(transform(sequence(0, {COORDINATES - 1}), i -> substring(hex(sig), 8 * i + 1, 2)), '')"))
    reps = stored(reps.withColumn("sketch", sketch), "reps")
    place = F.struct("doc_id", "h")
    if reps.isEmpty():
        nothing = F.lit(None).cast("struct<doc_id:bigint,h:bigint>")
        return all_sets.select(*KEY, nothing.alias("copy"), nothing.alias("class_of"), *(F.lit(None).cast("long").alias(x) for x in ("copies", "sets", "docs")))
    groups = connected_components(proposals(reps, threshold, small, depth, miss))
    exact = stored(_exact(texts, reps, groups, words, threshold), "links")
    counts = exact.groupBy("id").agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs"))
    classes = connected_components(exact.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    named = reps.select("id", "s1", "s2", "copies", place.alias("copy")).join(classes, "id", "left").join(counts, "id", "left")
    least = named.filter("component is not null").groupBy("component").agg(F.min("copy").alias("class_of"))
    of = named.join(least, "component", "left").select("s1", "s2", "copy", F.coalesce("class_of", "copy").alias("class_of"), "copies", "sets", "docs")
    of = stored(of, "classes")
    held = all_sets.select(*KEY, F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("s1")).alias("s1"), "s2").join(of, ["s1", "s2"], "left")
    return held.select(*KEY, "copy", "class_of", "copies", "sets", "docs")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, depth: int = DEPTH, miss: float = MISS) -> DataFrame:
    """doc_id, copy_id (least doc_id with the same set), class_id (least of the near-duplicate class), n_copies (other
    documents with the same set), n_set_links (other sets at the threshold) and n_links (other documents at it)."""
    held = _classes(keyed(docs, id_col, text_col), threshold, words, small, depth, miss)
    copies = F.coalesce("copies", F.lit(1)) - 1
    return held.select(
        "doc_id", F.coalesce("copy.doc_id", "doc_id").alias("copy_id"), F.coalesce("class_of.doc_id", "doc_id").alias("class_id"),
        copies.cast("long").alias("n_copies"), F.coalesce("sets", F.lit(0)).cast("long").alias("n_set_links"),
        (copies + F.coalesce("docs", F.lit(0))).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that of the least doc_id (null ids last), then of the least text hash.

    Rows are told apart by doc_id and text, so texts that share an id are judged one by one; of rows that repeat both one
    stays. Rows without a set (null or blank text) stay as they are, but for such repeats.
    """
    text = F.col(text_col).cast("string")
    own = [f"__{k}" for k in range(len(docs.columns))]
    # a null id sorts last among the documents of its class
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("__id"), F.xxhash64(text).alias("__h")]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)), *key, text.isNull().alias("__none"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    found = _classes(texts, threshold, words, SMALL, DEPTH, MISS)
    gone = found.filter("class_of.doc_id <> doc_id or class_of.h <> h").select(F.col("doc_id").alias("__gone"), F.col("h").alias("__of")).distinct()
    # repeats are met on the map side first, so that a row that occurs very often is one row a task; the join needs no further shuffle
    once = rows.groupBy("__id", "__h", "__none").agg(F.first(F.struct(*own)).alias("__row"))
    left = once.join(gone, (F.col("__id") == F.col("__gone")) & (F.col("__h") == F.col("__of")), "left_anti")
    return left.select(*(F.col(f"__row.{n}").alias(n) for n in own)).toDF(*docs.columns)
