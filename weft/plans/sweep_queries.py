"""Queries on threshold sweeps and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import metrics, sweeps
from weft.plans.relations import predictions, scores, with_


def rounded(df, places: int = 6):
    return df.select(*(F.round(c, places).alias(c) if t == "double" else c for c, t in df.dtypes))


def _at(spark, sf_dir):
    return sweeps.curve(scores(spark, sf_dir), "image", "score", "truth")


_SWEEP = with_("scores") + """, t AS (SELECT k::INT AS k, k * 0.01::DOUBLE AS threshold FROM range(100) AS r(k)
), pts AS (
  SELECT image, k, threshold, count(*) FILTER (score > threshold * 255 AND truth) AS tp, count(*) FILTER (score > threshold * 255 AND NOT truth) AS fp,
         count(*) FILTER (score <= threshold * 255 AND truth) AS fn, count(*) FILTER (score <= threshold * 255 AND NOT truth) AS tn
  FROM scores, t GROUP BY image, k, threshold
), f AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM pts
), micro AS (
  SELECT k, threshold, tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 1) AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall
  FROM (SELECT k, threshold, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM pts GROUP BY k, threshold)
), curve AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM micro
), ods AS (SELECT k, threshold, avg(f1) AS ods FROM f GROUP BY k, threshold ORDER BY round(avg(f1), 9) DESC, k LIMIT 1
), ois AS (SELECT avg(best) AS ois, count(*) AS images FROM (SELECT image, max(f1) AS best FROM f GROUP BY image)
), miou AS (
  SELECT max(m) AS best_miou FROM (SELECT k, avg((tp / nullif(tp + fp + fn, 0)::DOUBLE + tn / nullif(tn + fp + fn, 0)::DOUBLE) / 2) AS m FROM pts GROUP BY k)
) """

_CONFUSION = with_("predictions") + """, c AS (SELECT y AS truth, yhat AS predicted, count(*) AS n FROM predictions WHERE NOT abstained GROUP BY ALL
), k AS (SELECT truth AS class FROM c UNION SELECT predicted FROM c
), s AS (
  SELECT class, coalesce((SELECT sum(n) FROM c WHERE truth = class), 0)::BIGINT AS support, coalesce((SELECT sum(n) FROM c WHERE predicted = class), 0) AS predicted,
         coalesce((SELECT sum(n) FROM c WHERE truth = class AND c.predicted = class), 0) AS tp FROM k
), m AS (
  SELECT class, support, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall,
         coalesce(2 * tp / nullif(support + predicted, 0)::DOUBLE, 0) AS f1 FROM s
) """


def _decided(spark, sf_dir):
    return predictions(spark, sf_dir).filter("not abstained")


def _classes(spark, sf_dir):
    return metrics.per_class(metrics.confusion(_decided(spark, sf_dir), "y", "yhat"))


def _fold_metrics(spark, sf_dir):
    c = metrics.per_class(metrics.confusion(_decided(spark, sf_dir), "y", "yhat", ["fold"]), ["fold"])
    return metrics.over_folds(metrics.summary(c, ["fold"]), ["accuracy", "macro_f1", "weighted_f1", "balanced_accuracy"])


_FOLDS = with_("predictions") + """, c AS (SELECT fold, y AS truth, yhat AS predicted, count(*) AS n FROM predictions WHERE NOT abstained GROUP BY ALL
), k AS (SELECT fold, truth AS class FROM c UNION SELECT fold, predicted FROM c
), s AS (
  SELECT k.fold, k.class, coalesce(sum(n) FILTER (truth = k.class), 0) AS support, coalesce(sum(n) FILTER (c.predicted = k.class), 0) AS predicted,
         coalesce(sum(n) FILTER (truth = k.class AND c.predicted = k.class), 0) AS tp FROM k JOIN c ON c.fold = k.fold GROUP BY ALL
), m AS (
  SELECT fold, support, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0)::DOUBLE, 0) AS f1 FROM s
), e AS (
  SELECT fold, sum(recall * support) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, avg(recall) FILTER (support > 0) AS balanced_accuracy FROM m GROUP BY fold
), l AS (UNPIVOT e ON accuracy, macro_f1, weighted_f1, balanced_accuracy INTO NAME metric VALUE value)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS folds FROM l GROUP BY metric"""


QUERIES = {
    "threshold_sweep_curve": (lambda s, d: rounded(sweeps.micro_curve(_at(s, d))), _SWEEP + "SELECT k, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM curve"),
    "threshold_sweep_ods": (lambda s, d: rounded(sweeps.ods(_at(s, d))), _SWEEP + "SELECT k, round(threshold, 6) AS threshold, round(ods, 6) AS ods FROM ods"),
    "threshold_sweep_ois": (lambda s, d: rounded(sweeps.ois(_at(s, d))), _SWEEP + "SELECT round(ois, 6) AS ois, images FROM ois"),
    "threshold_sweep_miou": (lambda s, d: rounded(sweeps.best_miou(_at(s, d))), _SWEEP + "SELECT round(best_miou, 6) AS best_miou FROM miou"),
    "sweep_report": (
        lambda s, d: rounded(sweeps.report(_at(s, d))),
        _SWEEP + "SELECT round((SELECT max(f1) FROM curve), 6) AS f1, round((SELECT max(precision) FROM curve), 6) AS precision, round((SELECT max(recall) FROM curve), 6) AS recall, round((SELECT ods FROM ods), 6) AS ods, round((SELECT ois FROM ois), 6) AS ois, round((SELECT best_miou FROM miou), 6) AS best_miou",
    ),
    "pixel_accuracy": (
        lambda s, d: sweeps.accuracy(scores(s, d).withColumn("set", F.col("score") > 127), "set", "truth"),
        with_("scores") + "SELECT count(*) FILTER ((score > 127) = truth) AS \"right\", count(*) AS pixels FROM scores",
    ),
    "confusion_long": (lambda s, d: metrics.confusion(_decided(s, d), "y", "yhat"), _CONFUSION + "SELECT truth, predicted, n FROM c"),
    "class_metrics": (lambda s, d: rounded(_classes(s, d)), _CONFUSION + "SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m"),
    "metric_summary": (
        lambda s, d: rounded(metrics.summary(_classes(s, d))),
        _CONFUSION + "SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy FROM m",
    ),
    "length_weighted_metrics": (
        lambda s, d: rounded(metrics.length_weighted(_decided(s, d), "y", "yhat", "length")).withColumn("class", F.coalesce(F.col("class").cast("string"), F.lit("all"))),
        with_("predictions") + "SELECT coalesce(y::VARCHAR, 'all') AS class, sum(length)::DOUBLE AS length, round(sum(CASE WHEN y = yhat THEN length ELSE 0 END) / nullif(sum(length), 0)::DOUBLE, 6) AS recall FROM predictions WHERE NOT abstained GROUP BY ROLLUP (y)",
    ),
    "abstention_coverage": (
        lambda s, d: rounded(metrics.coverage(predictions(s, d), "abstained", "y", "yhat")),
        with_("predictions") + "SELECT count(*) AS n, count(*) FILTER (NOT abstained) AS decided, round(count(*) FILTER (NOT abstained) / nullif(count(*), 0)::DOUBLE, 6) AS coverage, round(count(*) FILTER (NOT abstained AND y = yhat) / nullif(count(*) FILTER (NOT abstained), 0)::DOUBLE, 6) AS accuracy FROM predictions",
    ),
    "fold_aggregate": (lambda s, d: rounded(_fold_metrics(s, d)), _FOLDS),
    "contingency": (
        lambda s, d: metrics.contingency(predictions(s, d), "source", "lang", ["de", "en", "es", "fr"]),
        with_("predictions") + "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM predictions GROUP BY source",
    ),
    "balanced_weights": (
        lambda s, d: rounded(metrics.balanced_weights(predictions(s, d), "lang")),
        with_("predictions") + "SELECT lang AS class, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM predictions GROUP BY lang",
    ),
    "feature_scaler": (
        lambda s, d: rounded(metrics.scaler(scores(s, d).withColumn("flat", F.lit(1)), ["score", "flat"])),
        with_("scores") + "SELECT 'score' AS feature, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS scale FROM scores UNION ALL SELECT 'flat', 1.0, 1.0",
    ),
    "length_share": (
        lambda s, d: rounded(metrics.share_of_total(predictions(s, d), "lang", "length")),
        with_("predictions") + "SELECT lang AS label, count(*) AS n, sum(length)::BIGINT AS length, round(sum(length) / (sum(sum(length)) OVER ())::DOUBLE, 6) AS share FROM predictions GROUP BY lang",
    ),
}
