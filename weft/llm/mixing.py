"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) with map-side sums, so a hot source costs one row a task.
Raking runs over the cells: each round scales the cells' keep probabilities so that the expected tokens meet the
targets of one margin after the other, never above 1. Where all margins can't be met so, since no document is taken twice,
a smaller share of the corpus is kept: the largest at which they can. Then every document is kept with its cell's probability, by a
hash of its id: the draw is repeatable, and independent of partitions.

The topic is a column that is named, or else a cluster of word sets: each document's different words give 64 sums of
signs, less the mean of the document's language, so that topics part what languages have in common; spherical k-means over all
documents makes ``TOPICS`` clusters. Only sums reach the driver: languages share ``SLOTS`` means by hash.

Cells are raked in the driver up to ``MOST_DRIVER_CELLS`` (a checked count), else by DataFrame joins.

Defined results: a null source, language or topic is a category of its own (``?``); a null or empty text has no tokens
and draws with its cell's probability; rows that repeat an id and text are kept or left together; an empty table gives
an empty result; a margin without targets is tempered from what the corpus has; targets that no share can meet (those of two
margins contradict each other) are raked at the share that was asked for, and reported as not met.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.substring_dedup import word_hashes
from weft.session import stored

MARGINS = ("source", "lang", "topic")
NONE = "?"
#: Share of all tokens to keep at most, and the exponents that temper each margin's observed shares into targets.
KEEP_SHARE = 0.6
TEMPERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Rounds of raking at most (they end when no probability moves by ``TOLERANCE``), and rounds of clustering.
ROUNDS, TOLERANCE = 500, 1e-7
CLUSTER_ROUNDS = 8
TOPICS = 8
#: A category is met if its share is this close, and the halvings by which the share to keep is found.
WITHIN, HALVINGS = 0.01, 6
SLOTS = 256
#: Vectors of least hash that the clusters start from.
STARTS = 1024
MOST_DRIVER_CELLS = 100_000
SEED = 17
_UNIT = 16


def _vectors(texts: pd.Series) -> tuple[list, np.ndarray]:
    """Words of each text, and the signature of its different words: 64 sums of signs, scaled by the root of their number."""
    counts, rows = [], np.zeros((len(texts), 64), np.int64)
    for k, t in enumerate(texts):
        words = t.encode().split() if t else []
        counts.append(len(words))
        if words:
            h = word_hashes(list(set(words)))
            sums = 2.0 * np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0) - len(h)
            rows[k] = np.clip(np.rint(_UNIT * sums / np.sqrt(len(h))), -127, 127)
    return counts, rows


@F.pandas_udf(T.StructType().add("n_tokens", "long").add("vec", "binary"))
def _signature(text: pd.Series) -> pd.DataFrame:
    counts, rows = _vectors(text)
    return pd.DataFrame({"n_tokens": counts, "vec": [r.tobytes() for r in rows.astype(np.int8)]})


def _read(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int8).reshape(-1, 64).astype(np.int64)


def slot(lang: Column) -> Column:
    """The number of the mean that a language's documents are set off against."""
    return (F.crc32(F.coalesce(lang, F.lit(NONE))) % SLOTS).cast("int")


class Topics:
    """Clusters of signatures about the means of their languages. Whole numbers all through, so that every machine assigns alike."""

    def __init__(self, means: np.ndarray, centres: np.ndarray):
        self.means, self.centres = means, centres

    def nearest(self, vectors: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return ((vectors - self.means[slots]) @ self.centres.T).argmax(axis=1) if len(vectors) else np.zeros(0, np.int64)

    @staticmethod
    def directions(sums: np.ndarray) -> np.ndarray:
        size = np.sqrt((sums.astype(float) ** 2).sum(axis=1, keepdims=True))
        return np.rint(1000 * np.divide(sums, size, out=np.zeros(sums.shape), where=size > 0)).astype(np.int64)


def learn_topics(signatures: DataFrame, topics: int = TOPICS) -> Topics:
    """Spherical k-means over the signatures (vec, lang) of all documents; a round brings one sum a cluster and task together."""
    signatures = signatures.select("vec", slot(F.col("lang")).alias("slot"))

    def summed(model, groups):
        def add(batches):
            sums, n = np.zeros((groups, 64), np.int64), np.zeros(groups, np.int64)
            for batch in batches:
                v, slots = _read(batch.column(0).to_pylist()), batch.column(1).to_numpy()
                own = model.nearest(v, slots) if model else slots
                np.add.at(sums, own, v - (model.means[slots] if model else 0))
                n += np.bincount(own, minlength=groups)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["topic", "n", "sums"])

        parts = signatures.mapInArrow(add, "topic int, n long, sums array<long>")
        rows = parts.select("topic", "n", F.posexplode("sums").alias("k", "s")).groupBy("topic", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        total, counts = np.zeros((groups, 64), np.int64), np.zeros(groups, np.int64)
        for r in rows:
            total[r["topic"], r["k"]], counts[r["topic"]] = r["s"], r["n"]
        return total, counts

    total, counts = summed(None, SLOTS)
    means = np.rint(total / np.maximum(1, counts)[:, None]).astype(np.int64)
    some = signatures.distinct().orderBy(F.xxhash64("vec"), "vec", "slot").limit(STARTS).collect()
    v = Topics.directions(_read([bytes(r["vec"]) for r in some]) - means[[r["slot"] for r in some]]) if some else np.zeros((0, 64), np.int64)
    picks = [0] if len(v) else []
    while len(picks) < min(topics, len(v)):  # the next start is the one least like those there are
        picks.append(int((v @ v[picks].T).max(axis=1).argmin()))
    model = Topics(means, np.concatenate([v[picks], np.zeros((topics - len(picks), 64), np.int64)]))
    for _ in range(CLUSTER_ROUNDS):
        total, counts = summed(model, topics)
        centres = np.where(counts[:, None] > 0, Topics.directions(total), model.centres)
        if (centres == model.centres).all():
            break
        model = Topics(means, centres)
    return model


def with_traits(docs: DataFrame, model: Topics | None, text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """docs with a struct __mix of source, lang, topic and n_tokens; without a model the signature stands for the topic."""
    text = F.col(text_col).cast("string")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) if c in docs.columns else F.lit(NONE)
    if model is None:
        given, topic = docs.withColumn("__mix", _signature(text)), F.col("__mix.vec").alias("vec")
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf(T.StructType().add("n_tokens", "long").add("topic", "string"))
        def assigned(texts: pd.Series, slots: pd.Series) -> pd.DataFrame:
            counts, rows = _vectors(texts)
            return pd.DataFrame({"n_tokens": counts, "topic": [f"t{k}" if n else NONE for k, n in zip(shared.value.nearest(rows, slots.to_numpy()), counts, strict=True)]})

        given, topic = docs.withColumn("__mix", assigned(text, slot(known("lang")))), F.col("__mix.topic").alias("topic")
    if topic_col is not None:
        topic = F.coalesce(F.col(topic_col).cast("string"), F.lit(NONE)).alias("topic")
    return given.withColumn("__mix", F.struct(known("source").alias("source"), known("lang").alias("lang"), topic, F.col("__mix.n_tokens").alias("n_tokens")))


def targets(cells: DataFrame, margin: str, given: dict | None = None) -> DataFrame:
    """Tokens wanted of each category of a margin, as shares that sum to 1."""
    seen = cells.groupBy(margin).agg(F.sum("tokens").alias("seen"))
    if given is not None:
        wish = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items()], f"{margin} string, wish double")
        seen = seen.join(wish, margin, "left").select(margin, F.when(F.col("seen") > 0, F.coalesce("wish", F.lit(0.0))).otherwise(0.0).alias("weight"))
    else:
        seen = seen.select(margin, F.pow("seen", F.lit(TEMPERS[margin])).alias("weight"))
    total = seen.agg(F.sum("weight")).first()[0] or 0.0
    return seen.select(margin, (F.col("weight") / total if total else F.lit(0.0)).alias("share"))


def largest_share(keep: float, off) -> float:
    """The largest share up to ``keep`` whose raking is off by ``WITHIN`` at most; keep itself if none is. off(share): how far."""
    if off(keep) <= WITHIN:
        return keep
    lo, hi = 0.0, keep
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if off(mid) <= WITHIN else (lo, mid)
    return lo or keep


def _rake_here(cells: DataFrame, wanted: dict[str, DataFrame], keep: float) -> tuple[DataFrame, float]:
    frame, spark = cells.toPandas(), cells.sparkSession
    tokens = frame["tokens"].to_numpy("f8")
    shares = {m: frame[m].map(dict(w.toPandas().itertuples(index=False, name=None))).to_numpy("f8") for m, w in wanted.items()}
    codes = {m: frame[m].astype("category").cat.codes.to_numpy() for m in wanted}
    of = lambda m, p: np.bincount(codes[m], weights=p * tokens, minlength=1)[codes[m]] if len(p) else p

    def rake(share: float) -> np.ndarray:
        p, goal = np.full(len(frame), share), share * tokens.sum()
        for _ in range(ROUNDS):
            old = p.copy()
            for m in wanted:
                have = of(m, p)
                ratio = np.divide(shares[m] * goal, have, out=np.ones_like(p), where=have > 0)
                p = np.minimum(1.0, p * ratio)
            if not len(p) or np.abs(p - old).max() < TOLERANCE:
                break
        return p

    def off(share: float) -> float:
        p = rake(share)
        total = (p * tokens).sum()
        return max((np.abs(of(m, p) / total - shares[m]).max() for m in wanted), default=0.0) if total else 0.0

    keep = largest_share(keep, off)
    frame["probability"] = rake(keep)
    return spark.createDataFrame(frame[[*MARGINS, "tokens", "probability"]], "source string, lang string, topic string, tokens long, probability double"), keep


def _rake_joined(cells: DataFrame, wanted: dict[str, DataFrame], keep: float) -> tuple[DataFrame, float]:
    tried: dict = {}

    def off(share: float) -> float:
        tried[share] = _raked(cells, wanted, share)
        weight = F.col("probability") * F.col("tokens")
        total = tried[share].agg(F.sum(weight)).first()[0] or 0.0
        far = lambda m, w: tried[share].groupBy(m).agg((F.sum(weight) / total).alias("have")).join(w, m).agg(F.max(F.abs(F.col("have") - F.col("share")))).first()[0]
        return max(far(m, w) or 0.0 for m, w in wanted.items()) if total else 0.0

    keep = largest_share(keep, off)
    return tried[keep], keep


def _raked(cells: DataFrame, wanted: dict[str, DataFrame], keep: float) -> DataFrame:
    goal = keep * (cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("probability", F.lit(float(keep)))
    for k in range(ROUNDS):
        old = now.select(*MARGINS, F.col("probability").alias("old"))
        for m, share in wanted.items():
            have = now.groupBy(m).agg(F.sum(F.col("probability") * F.col("tokens")).alias("have")).join(share, m)
            ratio = have.select(m, F.when(F.col("have") > 0, F.col("share") * goal / F.col("have")).otherwise(1.0).alias("ratio"))
            now = now.join(ratio, m).select(*MARGINS, "tokens", F.least(F.lit(1.0), F.col("probability") * F.col("ratio")).alias("probability"))
        now = stored(now, f"rake-{k}")
        moved = now.join(old, list(MARGINS)).agg(F.max(F.abs(F.col("probability") - F.col("old")))).first()[0]
        if (moved or 0) < TOLERANCE:
            break
    return now.select(*MARGINS, "tokens", "probability")


def plan(docs: DataFrame, keep: float = KEEP_SHARE, wishes: dict | None = None, most_driver_cells: int = MOST_DRIVER_CELLS, text_col: str = "text", topic_col: str | None = None) -> tuple[DataFrame, bool, Topics, float]:
    """The keep probability of each cell (with its tokens, and for each margin what is wanted and expected), whether the cells
    are few enough to be broadcast, the topics, and the share that is kept."""
    signed = stored(with_traits(docs, None, text_col).select("__mix.*", *([F.coalesce(F.col(topic_col).cast("string"), F.lit(NONE)).alias("topic")] if topic_col else [])), "signatures")
    model = learn_topics(signed.filter("n_tokens > 0"), TOPICS) if topic_col is None else Topics(np.zeros((SLOTS, 64), np.int64), np.zeros((1, 64), np.int64))
    if topic_col is None:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("string")
        def topic(vec: pd.Series, slots: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([f"t{k}" if m else NONE for k, m in zip(shared.value.nearest(_read(vec), slots.to_numpy()), n, strict=True)], dtype=object)

        signed = signed.withColumn("topic", topic("vec", slot(F.col("lang")), "n_tokens"))
    cells = stored(signed.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    few = cells.count() <= most_driver_cells
    wanted = {name: targets(cells, name, (wishes or {}).get(name)) for name in MARGINS}
    raked, keep = (_rake_here if few else _rake_joined)(cells, wanted, keep)
    return _told(stored(raked, "raked"), wanted), few, model, keep


def _told(cells: DataFrame, wanted: dict[str, DataFrame]) -> DataFrame:
    """cells with margin_wanted and margin_expected (shares of the kept tokens) of each margin."""
    weight = F.col("probability") * F.col("tokens")
    total = cells.agg(F.sum(weight)).first()[0]
    out = cells
    for m, share in wanted.items():
        have = cells.groupBy(m).agg(F.coalesce(F.try_divide(F.sum(weight), F.lit(total)), F.lit(0.0)).alias(f"{m}_expected"))
        out = out.join(have.join(share.withColumnRenamed("share", f"{m}_wanted"), m), m)
    return out.select(*MARGINS, "tokens", "probability", *(f"{m}_{x}" for m in wanted for x in ("wanted", "expected")))


def achieved(docs: DataFrame, keep: float = KEEP_SHARE, wishes: dict | None = None, text_col: str = "text", topic_col: str | None = None, within: float = WITHIN) -> DataFrame:
    """margin, category, wanted and expected (shares of the kept tokens) and met: within ``within`` of each other."""
    cells, _, _, _ = plan(docs, keep, wishes, text_col=text_col, topic_col=topic_col)
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(m).alias("category"), F.col(f"{m}_wanted").alias("wanted"), F.col(f"{m}_expected").alias("expected")) for m in MARGINS)))
    out = cells.select(rows.alias("x")).select("x.*").distinct()
    return out.withColumn("met", F.abs(F.col("wanted") - F.col("expected")) <= within)


def _drawn(docs: DataFrame, cells: DataFrame, few: bool, model: Topics, text_col: str, topic_col: str | None, seed: int) -> DataFrame:
    cells = cells.drop("tokens")
    cells = F.broadcast(cells) if few else cells
    keys = [F.col(f"__mix.{m}") == F.col(f"__cell.{m}") for m in MARGINS]
    joined = with_traits(docs, model, text_col, topic_col).join(cells.select(F.struct(*cells.columns).alias("__cell")), keys, "left")
    id_col = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")
    draw = F.call_function("shiftrightunsigned", F.xxhash64(id_col, F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(seed)), F.lit(11)) / F.lit(float(1 << 53))
    return joined.withColumn("__kept", draw < F.coalesce(F.col("__cell.probability"), F.lit(0.0)))


def mix(docs: DataFrame, keep: float = KEEP_SHARE, wishes: dict | None = None, most_driver_cells: int = MOST_DRIVER_CELLS, text_col: str = "text", topic_col: str | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, its cell, n_tokens, probability and whether the draw keeps it, for every row.

    Beside them, for each margin, the shares of the kept tokens that are wanted and expected of its category, ``met`` (whether
    the document's three are within ``WITHIN``) and ``keep_share``: the share of all tokens that is kept.
    """
    cells, few, model, share = plan(docs, keep, wishes, most_driver_cells, text_col, topic_col)
    at = _drawn(docs, cells, few, model, text_col, topic_col, seed)
    told = [F.col(f"__cell.{m}_{x}").alias(f"{m}_{x}") for m in MARGINS for x in ("wanted", "expected")]
    met = F.lit(True)
    for m in MARGINS:
        met = met & (F.abs(F.col(f"__cell.{m}_wanted") - F.col(f"__cell.{m}_expected")) <= WITHIN)
    return at.select("doc_id", "__mix.*", F.col("__cell.probability").alias("probability"), F.col("__kept").alias("kept"), *told, met.alias("met"), F.lit(share).alias("keep_share"))


def sampled(docs: DataFrame, keep: float = KEEP_SHARE, wishes: dict | None = None, text_col: str = "text", topic_col: str | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs that the draw keeps, with their own columns."""
    cells, few, model, _ = plan(docs, keep, wishes, text_col=text_col, topic_col=topic_col)
    return _drawn(docs, cells, few, model, text_col, topic_col, seed).filter("__kept").select(*docs.columns)
