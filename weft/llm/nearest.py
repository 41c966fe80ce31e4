"""Approximate nearest neighbours by balanced posting lists on boundary-replicated vectors.

Centroids are fitted on at most ``SAMPLE`` vectors (those of least hash of their id) by k-means with a penalty on full
lists, so lists stay balanced; there is one for about ``LIST`` vectors, ``MOST_LISTS`` at most, which bounds what is
broadcast. Every vector is indexed: it goes to its nearest centroid and, near a boundary, to up to ``REPLICAS`` lists
whose centroids are within ``BOUNDARY`` times its least distance. Centroids are searched through an in-memory graph of
neighbours, many vectors at a time. A query opens the lists whose centroids lie within a ratio of its least distance;
the ratio is read off the sample, where it finds ``SAMPLE_RECALL`` of the true neighbours.

Equal vectors are one entry with its ``k + 1`` least ids, more of which can never be among the k nearest. Lists and
the queries that open them are cut into chunks of bounded size, every chunk of one met by every chunk of the other, so
no list is too large for a task. Scores are cosines of the original vectors in double precision; of equal ones the
smaller id comes first, however many there are.

Defined results: vectors that are null, empty, zero, or hold null or non-finite numbers take no part, nor do rows with a
null id; vectors of different lengths are never near each other; repeated ids count once; fewer candidates than k give as many rows; an empty
table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.session import stored

SAMPLE = 20_000
LIST = 256
MOST_LISTS = 4096
REPLICAS = 4
BOUNDARY = 1.15
SAMPLE_RECALL = 0.975
SAMPLE_QUERIES = 256
DEGREE = 24
CHUNK = 4096
#: Parts that the rows of one vector are dealt in, and how far off a rough score may be.
PARTS = 64
ROUGH = 1e-9
#: Most bytes of vectors in a batch that is given out, and most cells of a table of queries and lists. A query may open most of
#: the lists, each of which takes its vector along.
ROOM = 4 << 20
CELLS = 1 << 20
K = 5


def entries(vectors: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """Distinct usable vectors with their k + 1 least ids."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    v = v.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).distinct()
    # the least ids of each part of a vector's rows first: a vector that most rows hold is no task of its own
    for keys in (["v", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))], ["v"]):
        v = v.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).filter(F.col("nth") <= k + 1).drop("nth")
    return v.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components to about 1: cosines stay as they are, digit by digit,
    but squares of very large or small components neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _nearest_of(x: np.ndarray, centroids: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 2000] @ centroids.T - bias).argmax(axis=1) for i in range(0, len(x), 2000)])


class Index:
    """Centroids and their neighbour graph; ``ratio`` prunes the lists of a query."""

    def __init__(self, sample: np.ndarray, lists: int, k: int):
        rng = np.random.default_rng(3)
        x = _unit(sample)
        lists = max(1, min(lists, len(x)))
        self.centroids = x[rng.permutation(len(x))[:lists]].copy()
        bias, mean = np.zeros(lists, np.float32), len(x) / lists
        for _ in range(10):
            own = _nearest_of(x, self.centroids, bias)
            sizes = np.bincount(own, minlength=lists)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, own, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), self.centroids).astype(np.float32)
            bias = (0.7 * bias + 0.02 * np.clip(sizes / mean - 1, -1, 4)).astype(np.float32)
        degree = min(DEGREE, lists)
        near = np.concatenate([np.argsort(-(self.centroids[i : i + 500] @ self.centroids.T), axis=1, kind="stable")[:, :degree] for i in range(0, lists, 500)])
        far = rng.integers(0, lists, (lists, 2))
        self.graph = np.concatenate([near, far], axis=1)
        self.entry = np.unique(rng.integers(0, lists, 16))
        self.ratio = self._calibrated(x, k)

    def _calibrated(self, x: np.ndarray, k: int) -> float:
        """The ratio at which queries from the sample find the wanted share of their neighbours in it."""
        if len(self.centroids) == 1 or len(x) < 2:
            return 1.0
        q = x[:: max(1, len(x) // SAMPLE_QUERIES)]
        sims = q @ x.T
        sims[np.arange(len(q)), np.arange(len(q)) * max(1, len(x) // SAMPLE_QUERIES)] = -2
        near = np.argpartition(-sims, min(k, sims.shape[1] - 1), axis=1)[:, :k]
        row, homes = self.homes(x[near.ravel()])
        to = self._distance(q @ self.centroids.T)
        need = to[row // k, homes] / to.min(axis=1)[row // k]
        best = np.full(near.size, np.inf)
        np.minimum.at(best, row, need)
        return float(np.quantile(best, SAMPLE_RECALL))

    @staticmethod
    def _distance(sims: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * sims, 1e-6))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids that a best-first walk of the graph finds, and their distances, nearest first."""
        m, lists = len(x), len(self.centroids)
        beam = min(beam, lists)
        seen = np.zeros((m, lists), bool)
        ids = np.zeros((m, beam), np.int64)
        sims = np.full((m, beam), -np.inf, np.float32)
        done = np.ones((m, beam), bool)
        fresh = np.broadcast_to(self.entry, (m, len(self.entry)))
        rows = np.arange(m)[:, None]
        while True:
            score = np.einsum("md,mnd->mn", x, self.centroids[fresh])
            score[seen[rows, fresh]] = -np.inf
            by = np.argsort(fresh, axis=1, kind="stable")
            again = np.take_along_axis(fresh, by, 1)
            twice = np.zeros_like(again, bool)
            twice[:, 1:] = again[:, 1:] == again[:, :-1]
            score = np.where(twice, -np.inf, np.take_along_axis(score, by, 1))
            seen[rows, fresh] = True
            all_ids = np.concatenate([ids, again], axis=1)
            all_sims = np.concatenate([sims, score], axis=1)
            all_done = np.concatenate([done, ~np.isfinite(score)], axis=1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
            if done.all():
                return ids, np.where(np.isfinite(sims), self._distance(sims), np.inf)
            step = np.argsort(np.where(done, 1, 0), axis=1, kind="stable")[:, : min(8, beam)]
            open_ = ~np.take_along_axis(done, step, 1)
            np.put_along_axis(done, step, True, 1)
            fresh = np.where(open_[:, :, None], self.graph[np.take_along_axis(ids, step, 1)], self.entry[0]).reshape(m, -1)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list a vector is stored in."""
        ids, far = self.search(x, 4 * REPLICAS)
        row, nth = np.nonzero((far <= BOUNDARY * far[:, :1]) & (np.arange(far.shape[1]) < REPLICAS))
        return row, ids[row, nth]

    def opened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list a query opens: the walk widens until its end lies outside the ratio."""
        beam, lists = 64, len(self.centroids)
        while True:
            ids, far = self.search(x, beam)
            inside = far <= self.ratio * far[:, :1]
            if beam >= lists or not inside[:, -1].any():
                return (r := np.nonzero(inside))[0], ids[r]
            beam *= 4


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of a matrix, without a Python number for each component."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _deal(batches, index: Index, pick: str, columns: list[str]):
    """Batches' rows once for each list that ``pick`` names, with the list, in batches of at most ``ROOM`` bytes of vectors."""
    few = max(1, min(512, CELLS // len(index.centroids)))
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("v"))
        many = max(1, ROOM // (8 * x.shape[1]))
        for at in range(0, len(x), few):
            row, lists = getattr(index, pick)(_unit(x[at : at + few]))
            for k in range(0, len(row), many):
                taken = batch.take(pa.array(row[k : k + many] + at))
                yield pa.RecordBatch.from_arrays([pa.array(lists[k : k + many].astype("i4")), *taken.columns], ["list", *columns])


def _dealt(rows: DataFrame, index, pick: str, columns: list[str]) -> DataFrame:
    """rows once for each list that ``pick`` names, with the list."""
    schema = "list int, " + ", ".join(f"{c} {t}" for c, t in rows.select(*columns).dtypes)
    return rows.select(*columns).mapInArrow(lambda batches: _deal(batches, index.value, pick, columns), schema)


def _best(k: int):
    def search(stored_in: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        if not stored_in.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        x, q = (scaled(_matrix(t.column("v"))) for t in (stored_in, asked))
        norms = lambda a: np.sqrt((a * a).sum(axis=1))
        nx, nq = norms(x), norms(q)
        ids, queries, out = stored_in.column("ids").to_pylist(), asked.column("query_id").to_pylist(), []
        for at in range(0, len(q), 256):
            rough = (q[at : at + 256] / nq[at : at + 256, None]) @ (x / nx[:, None]).T
            few = min(k + 1, len(x))  # the query's own vector may be among them
            enough = np.partition(rough, len(x) - few, axis=1)[:, len(x) - few]
            for i in range(len(rough)):
                # all that may be as near as the last one: the exact score and then the id decide
                picks = np.flatnonzero(rough[i] >= enough[i] - ROUGH)
                score = (q[at + i] * x[picks]).sum(axis=1) / (nq[at + i] * nx[picks])
                found = sorted((-s, v) for s, p in zip(score.tolist(), picks.tolist(), strict=True) for v in ids[p] if v != queries[at + i])
                out += [(queries[at + i], v, -s) for s, v in found[:k]]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), kinds, strict=True)], names)

    return search


def nearest(vectors: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    usable = stored(entries(vectors, id_col, vec_col, k), "vectors")
    width = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if width is None:
        return spark.createDataFrame([], schema)
    main = F.size("v") == width["d"]
    sample = np.array([r[0] for r in usable.filter(main).orderBy(F.xxhash64(F.col("ids")[0])).limit(SAMPLE).select("v").collect()], float)
    index = spark.sparkContext.broadcast(Index(sample, lists or min(MOST_LISTS, -(-width["n"] // LIST)), k))

    asked = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("v")).filter((F.col("query_id") % every == 0)).distinct()
    asked = asked.join(usable.select("v"), "v", "left_semi")
    # vectors of another length than most have a list for each length, which queries of that length open
    dealt = lambda rows, pick, columns: _dealt(rows.filter(main), index, pick, columns).unionByName(rows.filter(~main).select((-F.size("v")).alias("list"), *columns))
    postings = stored(dealt(usable, "homes", ["v", "ids"]), "postings")
    probes = stored(dealt(asked, "opened", ["v", "query_id"]), "probes")
    chunks = lambda rows, name: rows.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    # one row a list
    sizes = stored(chunks(postings, "p").join(chunks(probes, "q"), "list"), "list-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= 2 * MOST_LISTS else sizes

    def chunked(rows, own, other, mine, its, key):
        at = rows.join(sizes, "list").withColumn(mine, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return at.withColumn(its, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("p", "q")

    left = chunked(postings, "p", "q", "pc", "qc", F.col("ids")[0]).groupBy("list", "pc", "qc")
    right = chunked(probes, "q", "p", "qc", "pc", F.col("query_id")).groupBy("list", "pc", "qc")
    found = left.cogroup(right).applyInArrow(_best(k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
