"""Edge labels: votes of pixels, review tables laid over them, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNLABELED = "unlabeled"
UNCERTAIN = "uncertain"


class Vocabulary:
    """Which labels there are: classes by raster value, raster values that are no class, and accepted spellings of either.

    A blank text is unlabeled. Spellings are compared in lower case without outer blanks.
    """

    def __init__(self, classes: dict[int, str], spellings: dict[str, str] | None = None, no_class: dict[int, str] | None = None):
        self.classes, self.no_class = classes, {0: UNLABELED} if no_class is None else no_class
        labels = {*classes.values(), *self.no_class.values(), UNLABELED, UNCERTAIN}
        self.spellings = {"": UNLABELED} | {x.lower(): x for x in labels} | {k.strip().lower(): v for k, v in (spellings or {}).items()}
        if unknown := {v for v in self.spellings.values() if v not in labels}:
            raise ValueError(f"spellings of no label: {sorted(unknown)}")

    @classmethod
    def of(cls, rows: DataFrame) -> Vocabulary:
        """From a small table of kind (class, no_class or spelling), key and label."""
        by = {k: {r["key"]: r["label"] for r in rows.filter(F.col("kind") == k).select("key", "label").collect()} for k in ("class", "no_class", "spelling")}
        numbered = lambda d: {int(k): v for k, v in d.items()}
        return cls(numbered(by["class"]), by["spelling"], numbered(by["no_class"]) or None)


def normalized(raw: Column, words: Vocabulary) -> Column:
    """A label from free text: a spelling, a label's name, or a raster value (1 or 1.0); NULL if it is none of them."""
    text = F.lower(F.trim(F.coalesce(raw.cast("string"), F.lit(""))))
    names = F.create_map(*(F.lit(x) for kv in words.spellings.items() for x in kv))
    numbers = F.create_map(*(F.lit(x) for kv in (words.no_class | words.classes).items() for x in kv))
    number = F.when(text.rlike(r"^[0-9]{1,9}(\.0+)?$"), F.try_element_at(numbers, F.split(text, r"\.")[0].cast("int")))
    return F.coalesce(F.try_element_at(names, text), number)


def vote(samples: DataFrame, keys: list[str], value: str, least_samples: int = 1, least_purity: float = 0.6) -> DataFrame:
    """The most frequent value of each key, the smallest of equals, with its share and why it holds or not."""
    counts = samples.groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct(F.col("n"), (-F.col("value")).alias("minus"))).alias("x"), F.sum("n").alias("samples"))
    purity = F.col("x.n") / F.col("samples")
    reason = F.when(F.col("samples") < least_samples, "no_samples").when(purity < least_purity, "mixed_below_purity").otherwise("majority")
    return best.select(*keys, (-F.col("x.minus")).alias("value"), purity.alias("purity"), "samples", reason.alias("reason"))


def edge_votes(edges: DataFrame, samples: DataFrame, keys: list[str], words: Vocabulary, least_purity: float = 0.6) -> DataFrame:
    """keys, label, purity, samples and reason of every edge, by the annotated pixels it has.

    samples: keys, value (of the label raster; NULL outside of it) and excluded (near a junction). Values that are in no
    vocabulary do not count; of equally frequent labels the one of the least value wins. Reasons: no_samples,
    junction_only, no_annotation, mixed_below_purity, majority.
    """
    named = F.create_map(*(F.lit(x) for kv in (words.no_class | words.classes).items() for x in kv))
    kept = F.when(~F.coalesce("excluded", F.lit(False)), F.try_element_at(named, F.col("value").cast("int")))
    at = samples.select(*keys, F.coalesce("excluded", F.lit(False)).alias("excluded"), "value", kept.alias("label")).filter("value is not null")
    counts = at.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.count_if(~F.col("excluded")).alias("free"), F.min("value").alias("least"))
    order = F.struct(F.col("n"), (-F.col("least")).alias("minus"), F.col("label"))
    each = counts.groupBy(*keys).agg(F.max(F.when(F.col("label").isNotNull(), order)).alias("best"), F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).alias("total"), F.sum("free").alias("free"))
    out = edges.select(*keys).distinct().join(each, keys, "left").withColumn("purity", F.coalesce(F.col("best.n") / F.col("total"), F.lit(0.0)))
    reason = F.when(F.col("free").isNull(), "no_samples").when(F.col("free") == 0, "junction_only").when(F.col("best").isNull(), "no_annotation").when(F.col("purity") < least_purity, "mixed_below_purity").otherwise("majority")
    label = F.when(reason.isin("no_samples", "no_annotation"), UNLABELED).when(reason == "majority", F.col("best.label")).otherwise(UNCERTAIN)
    return out.select(*keys, label.alias("label"), "purity", F.coalesce("total", F.lit(0)).alias("samples"), reason.alias("reason"))


def overlay(features: DataFrame, derived: DataFrame, review: DataFrame, keys: list[str], blank_keeps: bool = False) -> DataFrame:
    """Labels from pixels with a review table over them; a blank review cell also wins, unless ``blank_keeps``."""
    given = review.select(*keys, F.col("label").alias("__review"))
    if blank_keeps:
        given = given.filter(F.col("__review") != UNLABELED)
    at = features.join(derived.select(*keys, F.col("label").alias("__derived")), keys, "left").join(given, keys, "left")
    return at.withColumn("label", F.coalesce("__review", "__derived", F.lit(UNLABELED))).drop("__review", "__derived")


def duplicates(review: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a review table holds more than once."""
    return review.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def trainable(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows whose label is a class."""
    return rows.join(classes.select(F.col("name").alias("label")), "label", "left_semi")


def progress(review: DataFrame) -> DataFrame:
    """Rows, and how many of them have a label."""
    done = F.coalesce(F.trim("label") != "", F.lit(False))
    return review.agg(F.count("*").alias("n"), F.count_if(done).alias("labelled"), F.count_if(~done).alias("unlabelled"))


def distribution(rows: DataFrame, label: str) -> DataFrame:
    n = F.count("*")
    return rows.groupBy(F.col(label).alias("label")).agg(n.alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
