"""Queries on labels, file discovery, splits, review samples and the tree baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import discovery, labels, learning, policies, splits
from weft.plans.relations import predictions, scores, votes, with_
from weft.plans.sweep_queries import rounded
from weft.session import table

#: The labels of these queries.
WORDS = labels.Vocabulary({1: "thin", 2: "wide", 3: "side"}, {"wd": "wide"}, {0: "unlabeled", 255: "uncertain"})
CLASSES = WORDS.classes


def _votes_sql() -> str:
    return "WITH c AS (SELECT user_id AS edge, length(event_type) AS value, count(*) AS n FROM events GROUP BY ALL), v AS (SELECT edge, arg_min(value, (-n, value)) AS value, max(n) / sum(n)::DOUBLE AS purity, sum(n)::BIGINT AS samples FROM c GROUP BY edge) "


def _vote(s, d):
    return rounded(labels.vote(votes(s, d), ["edge"], "value", 1, 0.3)).withColumn("value", F.col("value").cast("long"))


def _vote_reasons(s, d):
    """Customers as edges, their events as pixels: most have none, some only excluded ones, and some values are no label."""
    samples = table(s, d, "events").select(F.col("user_id").alias("edge"), F.when(F.col("user_id") % 11 == 3, 9).otherwise((F.length("event_type") + F.col("user_id")) % 4).alias("value"), ((F.col("event_id") % 5 == 0) | (F.col("user_id") % 7 == 2)).alias("excluded"))
    return rounded(labels.edge_votes(table(s, d, "customer").select(F.col("c_custkey").alias("edge")), samples, ["edge"], WORDS, 0.45))


_VOTE_REASONS = """WITH s AS (
  SELECT user_id AS edge, CASE WHEN user_id % 11 = 3 THEN 9 ELSE (length(event_type) + user_id) % 4 END AS value, event_id % 5 = 0 OR user_id % 7 = 2 AS excluded FROM events
), c AS (
  SELECT edge, value, count(*) AS n FROM s WHERE NOT excluded AND value IN (0, 1, 2, 3) GROUP BY ALL
), b AS (
  SELECT edge, arg_min(value, (-n, value)) AS value, max(n) / sum(n)::DOUBLE AS purity, sum(n)::BIGINT AS samples FROM c GROUP BY edge
), f AS (
  SELECT edge, count(*) FILTER (NOT excluded) AS free FROM s GROUP BY edge
), r AS (
  SELECT c_custkey AS edge, value, coalesce(purity, 0) AS purity, coalesce(samples, 0) AS samples,
         CASE WHEN free IS NULL THEN 'no_samples' WHEN free = 0 THEN 'junction_only' WHEN samples IS NULL THEN 'no_annotation' WHEN purity < 0.45::DOUBLE THEN 'mixed_below_purity' ELSE 'majority' END AS reason
  FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN f ON f.edge = c_custkey LEFT JOIN b ON b.edge = c_custkey
)
SELECT edge, CASE WHEN reason IN ('no_samples', 'no_annotation') THEN 'unlabeled' WHEN reason = 'majority' THEN ['unlabeled', 'thin', 'wide', 'side'][value + 1] ELSE 'uncertain' END AS label,
       round(purity, 6) AS purity, samples, reason FROM r"""


def _raw(s, d):
    """Free-text labels made of documents."""
    raw = F.when(F.col("doc_id") % 6 == 0, " Thin ").when(F.col("doc_id") % 6 == 1, "2").when(F.col("doc_id") % 6 == 2, "").when(F.col("doc_id") % 6 == 3, "wd").when(F.col("doc_id") % 6 == 4, "1.0").otherwise(F.col("lang"))
    return table(s, d, "documents").select("doc_id", raw.alias("raw"), "n_chars", "source")


_RAW = "WITH r AS (SELECT doc_id, n_chars, source, CASE doc_id % 6 WHEN 0 THEN ' Thin ' WHEN 1 THEN '2' WHEN 2 THEN '' WHEN 3 THEN 'wd' WHEN 4 THEN '1.0' ELSE lang END AS raw FROM documents), n AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'thin' WHEN 1 THEN 'wide' WHEN 2 THEN 'unlabeled' WHEN 3 THEN 'wide' WHEN 4 THEN 'thin' END AS label FROM r) "


def _normalized(s, d):
    return _raw(s, d).withColumn("label", labels.normalized(F.col("raw"), WORDS))


def _overlay(s, d):
    base = _normalized(s, d)
    derived = base.filter("doc_id % 2 = 0").select("doc_id", F.lit("side").alias("label"))
    review = base.filter("doc_id % 4 = 0").select("doc_id", "label")
    return labels.overlay(base.select("doc_id"), derived, review, ["doc_id"])


def _files(s, d):
    """Two names for each page: an exact one and a longer one, the odd pages' longer one as an array."""
    p = table(s, d, "pages").select("page_id")
    exact = p.filter("page_id % 3 > 0").select(F.concat(F.lit("out/p"), F.col("page_id"), F.lit(".png")).alias("path"))
    longer = p.select(F.concat(F.lit("out/p"), F.col("page_id"), F.lit("_s1_prob"), F.when(F.col("page_id") % 2 == 1, ".npy").otherwise(".png")).alias("path"))
    return exact.union(longer), p.select(F.concat(F.lit("p"), F.col("page_id")).alias("id"))


def _rank(s, d):
    files, ids = _files(s, d)
    return discovery.best_file(files, ids)


def _longest(s, d):
    """Types of parts against the ids 'X' and 'X_Y' that are prefixes of some of them."""
    names = table(s, d, "part").select(F.regexp_replace("p_type", " ", "_").alias("name")).distinct()
    ids = names.select(F.substring_index("name", "_", 1).alias("id")).union(names.filter("length(name) % 2 = 0").select(F.substring_index("name", "_", 2).alias("id"))).distinct()
    return discovery.owner(names, ids)


_LONGEST = "WITH n AS (SELECT DISTINCT replace(p_type, ' ', '_') AS name FROM part), i AS (SELECT split_part(name, '_', 1) AS id FROM n UNION SELECT CASE WHEN len(string_split(name, '_')) > 1 THEN split_part(name, '_', 1) || '_' || split_part(name, '_', 2) ELSE name END FROM n WHERE length(name) % 2 = 0) SELECT name, arg_max(id, length(id)) AS owner FROM n LEFT JOIN i ON name = id OR starts_with(name, id || '_') GROUP BY name"


def _catalogue(s, d):
    ids = table(s, d, "pages").select(F.col("page_id").cast("string").alias("image_id"))
    part = lambda k, name: ids.filter(f"image_id % {k} = 0").select("image_id", F.concat(F.lit(name), F.col("image_id")).alias("path"))
    groups = ids.filter("image_id % 5 > 0").select("image_id", F.concat(F.lit("g"), (F.col("image_id").cast("int") % 7)).alias("group"))
    return discovery.catalogue(ids, part(2, "p/"), part(3, "m/"), part(5, "l/"), groups)


def _last(s, d):
    rows = table(s, d, "events").select(F.concat(F.lit(" u"), F.col("user_id"), F.lit(" ")).alias("image_id"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("g"), F.col("event_id") % 11)).otherwise(" ").alias("panel"), "event_id")
    return discovery.last_wins(rows, "image_id", "panel", "event_id")


def _stale(s, d):
    doc = table(s, d, "documents")
    now = doc.select(F.col("doc_id").alias("image_id"), F.substring(F.sha2(F.col("text"), 256), 1, 16).alias("signature"))
    return discovery.stale(now, now.filter("image_id % 7 > 0"))


def _folds(s, d):
    rows = predictions(s, d)
    return splits.grouped_folds(rows, "source", 5)


def _leaks(s, d):
    return splits.leaks(predictions(s, d).withColumn("part", F.col("doc_id") % 7), "source", "part")


def _forest(s, d):
    """A forest over length features of labelled documents, by grouped folds; rows under a confidence abstain."""
    rows = predictions(s, d)
    text = table(s, d, "documents").select("doc_id", F.length(F.regexp_replace("text", "[#*$%&|<>!]+", "")).alias("clean"), F.size(F.split("text", " ")).alias("words"))
    rows = rows.join(text, "doc_id").join(splits.grouped_folds(rows, "source", 3).select(F.col("group").alias("source"), F.col("fold").alias("k")), "source")
    done = learning.cross_validated(rows.select("doc_id", "y", "length", "clean", "words", "k"), ["length", "clean", "words"], "y", "k", trees=8, depth=4)
    return policies.abstain(done.withColumn("label", F.col("prediction").cast("int").cast("string")), "confidence", "label", 0.55).select("doc_id", "y", "raw_label", "predicted_label", F.round("confidence", 6).alias("confidence"))


QUERIES = {
    "label_vote": (_vote, _votes_sql() + "SELECT edge, value, round(purity, 6) AS purity, samples, CASE WHEN purity < 0.3::DOUBLE THEN 'mixed_below_purity' ELSE 'majority' END AS reason FROM v"),
    "vote_reasons": (_vote_reasons, _VOTE_REASONS),
    "normalize_labels": (lambda s, d: _normalized(s, d).select("doc_id", F.coalesce("label", F.lit("?")).alias("label")), _RAW + "SELECT doc_id, coalesce(label, '?') AS label FROM n"),
    "label_overlay": (_overlay, _RAW + "SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND label IS NOT NULL THEN label WHEN doc_id % 2 = 0 THEN 'side' ELSE 'unlabeled' END AS label FROM n"),
    "trainable_rows": (
        lambda s, d: labels.trainable(_normalized(s, d), s.createDataFrame([(c,) for c in CLASSES.values()], "name string")).select("doc_id", "label"),
        _RAW + "SELECT doc_id, label FROM n WHERE label IN ('thin', 'wide', 'side')",
    ),
    "label_progress": (lambda s, d: labels.progress(_raw(s, d).select(F.col("raw").alias("label"))), _RAW + "SELECT count(*) AS n, count(*) FILTER (trim(raw) <> '') AS labelled, count(*) FILTER (NOT coalesce(trim(raw) <> '', FALSE)) AS unlabelled FROM r"),
    "label_distribution": (lambda s, d: rounded(labels.distribution(predictions(s, d), "lang")), with_("predictions") + "SELECT lang AS label, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM predictions GROUP BY lang"),
    "duplicate_keys": (lambda s, d: labels.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "candidate_rank": (
        _rank,
        "WITH f AS (SELECT page_id, 'out/p' || page_id || '.png' AS path, 2 AS score FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT page_id, 'out/p' || page_id || '_s1_prob' || CASE WHEN page_id % 2 = 1 THEN '.npy' ELSE '.png' END, CASE WHEN page_id % 2 = 1 THEN 1 ELSE 3 END FROM pages) SELECT 'p' || page_id AS id, arg_min(path, (score, path)) AS path, min(score)::INT AS score FROM f GROUP BY page_id",
    ),
    "longest_prefix": (lambda s, d: _longest(s, d), _LONGEST),
    "first_wins": (
        lambda s, d: discovery.first_wins(table(s, d, "pages").select("page_id", F.length("url").alias("k")), ["k"], ["page_id"]),
        "SELECT min(page_id) AS page_id, length(url)::INT AS k FROM pages GROUP BY length(url)",
    ),
    "last_wins": (_last, "SELECT 'u' || user_id AS image_id, 'g' || (max(event_id) % 11) AS panel FROM events WHERE event_id % 3 > 0 GROUP BY user_id"),
    "dataset_left_joins": (
        _catalogue,
        "SELECT page_id::VARCHAR AS image_id, CASE WHEN page_id % 2 = 0 THEN 'p/' || page_id END AS probability_path, CASE WHEN page_id % 3 = 0 THEN 'm/' || page_id END AS mask_path, CASE WHEN page_id % 5 = 0 THEN 'l/' || page_id END AS label_path, CASE WHEN page_id % 5 > 0 THEN 'g' || (page_id % 7) ELSE page_id::VARCHAR END AS panel_id FROM pages",
    ),
    "signature_diff": (_stale, "SELECT doc_id AS image_id, sha256(text)[1:16] AS signature FROM documents d WHERE doc_id % 7 = 0"),
    "group_folds": (
        _folds,
        with_("predictions") + ", g AS (SELECT source AS \"group\", count(*) AS n FROM predictions GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, \"group\") - 1 AS r FROM g) SELECT \"group\", n, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END::INT AS fold FROM r",
    ),
    "group_leakage": (_leaks, with_("predictions") + "SELECT source AS \"group\", count(DISTINCT doc_id % 7) AS folds FROM predictions GROUP BY source HAVING count(DISTINCT doc_id % 7) > 1"),
    "group_holdout": (
        lambda s, d: splits.holdout(predictions(s, d), "source", 0.25),
        with_("predictions") + ", g AS (SELECT DISTINCT source AS \"group\" FROM predictions) SELECT \"group\", row_number() OVER (ORDER BY md5(\"group\"), \"group\") <= ceil(0.25 * count(*) OVER ()) AS held FROM g",
    ),
    "shared_groups": (lambda s, d: splits.shared_groups(predictions(s, d).filter("doc_id % 7 = 0"), predictions(s, d).filter("doc_id % 7 > 0"), "source"), with_("predictions") + "SELECT source FROM predictions WHERE doc_id % 7 = 0 INTERSECT SELECT source FROM predictions WHERE doc_id % 7 > 0"),
    "review_sample": (
        lambda s, d: policies.review_sample(table(s, d, "documents"), "doc_id", "lang", "n_chars", 100, 20),
        "WITH r AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE n_chars >= 100), t AS (SELECT *, row_number() OVER (PARTITION BY lang, r > 10 ORDER BY md5(doc_id::VARCHAR), doc_id) AS n FROM r) SELECT lang, doc_id, n_chars, r <= 10 AS longest FROM t WHERE r <= 10 OR n <= 10",
    ),
    "top_k_importance": (
        lambda s, d: policies.top_by_size(table(s, d, "customer"), "c_name", "c_acctbal", 25),
        "SELECT c_name, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_name LIMIT 25",
    ),
    "rf_baseline": (_forest, None),
}
