"""Prefix trie of conversations, its subtree totals by leaf-peeling message passing.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. Turns become short rows
(digest of role and text, code points) before anything is shuffled. The steps:

* turns are numbered by a range sort over (conversation, turn), so that a conversation that holds a third of all rows is cut
  over many tasks; only the few conversations that go on over a border need an offset, one row a partition at most;
* a prefix is known by sums of hashes over its (place, turn) pairs. Sums run within blocks of ``BLOCK`` turns, and blocks
  are offset by the sums of those before, so that a long conversation is no task of its own either;
* nodes are counts by prefix, with map-side sums; each is named by its smallest member and its depth;
* nodes in a row that have the same members form a chain, which passes messages in one hop;
* leaf peeling: each chain holds a counter of children that have not answered. In every round the chains whose counter is
  0 are completed, and their totals go to their parents, summed on the map side; the parents count down. It ends when
  the root is completed, after as many rounds as the tallest branch has chains. Each round's state is written to the
  shared folder.

Defined results: null turns come first; turns of equal number are ordered by their digest; null role or text is empty; rows
with a null conversation id belong to none and are left out; repeated rows are turns of their own; conversations
without turns are members of the root; without conversations there is no node; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.session import stored

#: Turns that one running sum goes over; ids that are put into one string.
BLOCK = 1024
ID_BLOCK = 4096
SUMS = ["s0", "s1", "s2", "s3", "upto"]


class Trie(NamedTuple):
    """nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. ends: conv_id and depth of the node where each ``member`` ends."""

    nodes: DataFrame
    ends: DataFrame


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest and chars of every turn. Columns: conv_id, turn, role, text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    short = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(digest).alias("digest"), F.length(text).cast("long").alias("chars"))
    order = ["conv_id", "turn", "digest"]
    ranged = short.filter("conv_id is not null").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "turns")
    pieces = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a later piece begins at a border of two partitions: one row a partition at most
    later = pieces.select("conv_id", "part", before.alias("before")).filter("before is not null")
    place = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("turn", "digest")) - 1
    local = ranged.select("conv_id", "part", place.alias("place"), "digest", "chars")
    joined = local.join(F.broadcast(later), ["conv_id", "part"], "left")
    return joined.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "digest", "chars")


def _prefixes(paths: DataFrame) -> DataFrame:
    """Each turn with the keys of the prefix that ends with it and of the one before, and the code points up to it."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    a, b = F.xxhash64("pos", "digest"), F.xxhash64("digest", "pos")
    halves = [low(a), F.shiftrightunsigned(a, 32), low(b), F.shiftrightunsigned(b, 32), F.col("chars")]
    rows = paths.select("conv_id", "pos", F.floor(F.col("pos") / BLOCK).alias("block"), "chars", *[x.alias(f"own_{s}") for x, s in zip(halves, SUMS, strict=True)])
    # sums of the blocks before, for the conversations that have several
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(f"own_{s}").alias(s) for s in SUMS], F.max("pos").alias("last"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("conv_id", "block", *[F.sum(s).over(before).alias(f"before_{s}") for s in SUMS]).filter("block > 0")
    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.join(offsets, ["conv_id", "block"], "left").withColumns({s: F.sum(f"own_{s}").over(running) + F.coalesce(f"before_{s}", F.lit(0)) for s in SUMS})
    now = [F.col(s) for s in SUMS[:4]]
    past = [F.col(s) - F.col(f"own_{s}") for s in SUMS[:4]]
    depth = F.col("pos") + 1
    keys = lambda d, s: (F.xxhash64(d, *s), F.xxhash64(*s, d))
    (k1, k2), (p1, p2) = keys(depth, now), keys(depth - 1, past)
    return summed.select("conv_id", depth.alias("depth"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "chars", "upto")


def _peeled(chains: DataFrame) -> DataFrame:
    """c, n, leaves and below (what the subtrees under the chain save) of every chain."""
    key = ["c", "n"]
    counts = chains.groupBy(F.col("pc").alias("c"), F.col("pn").alias("n")).agg(F.count("*").alias("kids"))
    open_ = chains.join(counts.filter("c is not null"), key, "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long")))
    zero = F.lit(0).cast("long")
    open_ = stored(open_.withColumns({"waits": F.col("kids"), "leaves": F.when(F.col("kids") == 0, 1).otherwise(0).cast("long"), "below": zero}), "peel")
    done = []
    while not open_.isEmpty():
        leaf = open_.filter("waits = 0")
        done.append(leaf.select(*key, "kids", "bottom", "reach", "leaves", "below"))
        sent = leaf.filter("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pn").alias("n")).agg(F.count("*").alias("came"), F.sum("leaves").alias("more"), F.sum(F.col("below") + F.col("own")).alias("saved"))
        after = open_.filter("waits > 0").join(sent, key, "left")
        open_ = stored(
            after.select(
                *key, "pc", "pn", "own", "bottom", "reach", "kids",
                (F.col("waits") - F.coalesce("came", zero)).alias("waits"),
                (F.col("leaves") + F.coalesce("more", zero)).alias("leaves"),
                (F.col("below") + F.coalesce("saved", zero)).alias("below"),
            ), "peel",
        )
    none = open_.select(*key, "kids", "bottom", "reach", "leaves", "below")
    return reduce(DataFrame.unionByName, done, none)


def trie(paths: DataFrame, convs: DataFrame) -> Trie:
    """The trie of conversations whose turns are numbered: paths has conv_id, pos, digest and chars, convs every conv_id once."""
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("chars"), zero.alias("upto"))
    first = F.col("depth") == 1
    steps = _prefixes(paths).withColumns({"p1": F.when(first, 0).otherwise(F.col("p1")), "p2": F.when(first, 0).otherwise(F.col("p2"))})
    prefixes = stored(steps.unionByName(root), "prefixes")
    one = lambda c: F.max(c).alias(c)
    nodes = stored(prefixes.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), one("p1"), one("p2"), one("chars"), one("upto")), "nodes")

    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("pc"), F.col("n_convs").alias("pn"))
    linked = stored(nodes.join(above, ["depth", "p1", "p2"], "left").select("conv_id", "depth", "n_convs", "chars", "upto", "pc", "pn"), "linked")
    # the first node of a chain is one that has not the members of its parent
    top = F.coalesce((F.col("pc") != F.col("conv_id")) | (F.col("pn") != F.col("n_convs")), F.lit(True))
    at_top = lambda c: F.max(F.when(top, c))
    chains = linked.groupBy(F.col("conv_id").alias("c"), F.col("n_convs").alias("n")).agg(
        at_top(F.col("pc")).alias("pc"), at_top(F.col("pn")).alias("pn"), at_top(F.col("upto") - F.col("chars")).alias("start"), F.max("depth").alias("bottom"), F.max("upto").alias("reach")
    )
    chains = chains.select("c", "n", "pc", "pn", ((F.col("n") - 1) * (F.col("reach") - F.col("start"))).alias("own"), "bottom", "reach")
    totals = stored(_peeled(chains), "totals")
    own = (F.col("n_convs") - 1) * (F.col("reach") - F.col("upto") + F.col("chars"))
    out = linked.join(totals, (F.col("conv_id") == F.col("c")) & (F.col("n_convs") == F.col("n"))).select(
        "conv_id", "depth", F.col("pc").alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") == F.col("bottom"), F.col("kids")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("below") + own).alias("saved_tokens"),
    )

    last = prefixes.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    stops = prefixes.join(last, ["conv_id", "depth"]).select("depth", "k1", "k2", F.col("conv_id").alias("member"))
    ends = stops.join(nodes.select("depth", "k1", "k2", "conv_id"), ["depth", "k1", "k2"]).select("conv_id", "depth", "member")
    return Trie(out, ends)


def prefix_trie(conversations: DataFrame) -> Trie:
    """The trie of a table of turns (conv_id, turn, role, text)."""
    paths = stored(numbered(conversations), "paths")
    return trie(paths, paths.select("conv_id").distinct())


def digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth and sha256 of the decimal members of each node where conversations end, ascending, joined by commas.

    Ids are sorted and joined within blocks of neighbouring ids; the blocks of a node are then fed to its hash one after the
    other, in bounded memory. A SHA-256 can't be cut: the bytes of one node's list go through one task.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",")
    blocks = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / ID_BLOCK).alias("block")).agg(ids.alias("ids"))

    def run(batches):
        node, hashed = None, None
        for batch in batches:
            out = []
            for c, d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (c, d) == node:
                    hashed.update(b",")
                else:
                    if node:
                        out.append((*node, hashed.hexdigest()))
                    node, hashed = (c, d), hashlib.sha256()
                hashed.update(text.as_buffer())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["conv_id", "depth", "sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, hashed.hexdigest())], ["conv_id", "depth", "sha256"])

    dealt = blocks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    return dealt.select("conv_id", "depth", "ids").mapInArrow(run, "conv_id long, depth long, sha256 string")
