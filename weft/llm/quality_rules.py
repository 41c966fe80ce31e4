"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

``measures`` computes every ratio of a text from one array of its words, its lines and a few character counts;
``verdict`` turns a table of (measure, least, most) rows into one boolean. Both are plain column expressions, so a
filter or a projection over them is a single narrow stage: nothing is shuffled and no text leaves the JVM.

Defined results: a null or empty text has no words and fails; a ratio over nothing is 0; repeated rows are judged
one by one; an empty table gives an empty result; other columns of the input are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.tables import id_text, let, words_of

#: Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "as", "by", "at", "be", "this", "from", "are", "or", "an"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "im", "für", "auf", "dem", "ein", "eine", "sich", "des", "nicht", "auch"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "en", "est", "que", "pour", "dans", "du", "au", "par", "sur", "ou"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "del", "por", "con", "para", "se", "es", "al", "lo"],
}
SYMBOLS = "[#*$%&|<>]"
#: Matches once in each word with a letter.
LETTER_WORD = r"\p{L}[^\x20\x09-\x0D]*"

#: measure, least value kept, most kept (None: no bound). Shares are of words, of lines or of characters, 0 to 1.
RULES = [
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.3),
    ("exclaims_per_word", None, 0.3),
    ("letter_word_share", 0.6, None),
    ("stop_word_share", 0.02, None),
    ("dup_line_share", None, 0.5),
    ("bullet_line_share", None, 0.9),
    ("ellipsis_line_share", None, 0.4),
]


def _repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text holds at least twice.

    Each window becomes one long, the upper bits of a hash over the bits of its position; sorted, equal windows are
    neighbours. Neighbours of equal hash count only where their three words are equal too.
    """

    def covered(bits: Column, keys: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
        word = lambda x, j: F.get(words, place(x) + j)

        def same(x: Column, y: Column) -> Column:
            alike = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
            return F.coalesce(alike & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2)), F.lit(False))

        twice = F.filter(keys, lambda x, i: same(x, F.get(keys, i - 1)) | same(x, F.get(keys, i + 1)))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            F.sort_array(F.transform(twice, place)), start,
            lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")),
            lambda acc: acc["n"],
        )

    def keyed(bits: Column) -> Column:
        hashed = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        key = lambda i: F.call_function("shiftleft", F.call_function("shiftright", hashed(i), bits), bits).bitwiseOR(i.cast("long"))
        return let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), key)), lambda keys: covered(bits, keys))

    bits = F.ceil(F.log2(F.size(words).cast("double") + 1)).cast("int")
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(bits, keyed))


def measures(text: Column) -> Column:
    """A struct of counts and ratios of one text."""
    text = F.coalesce(text, F.lit(""))
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})

    def from_words(words: Column) -> Column:
        n = F.size(words).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(stops))).cast("long").alias("n_stop"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    def from_lines(lines: Column) -> Column:
        n = F.size(lines).cast("long")
        return F.struct(
            n.alias("n_lines"),
            (n - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))).cast("long").alias("n_bullets"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipses"),
        )

    def ratios(w: Column, x: Column, symbols: Column, exclaims: Column, letters: Column) -> Column:
        share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
        return F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), symbols.alias("n_symbols"),
            x["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
            share(w["word_chars"], w["n_words"]).alias("mean_word_chars"),
            share(symbols, w["n_words"]).alias("symbols_per_word"),
            share(exclaims, w["n_words"]).alias("exclaims_per_word"),
            share(letters, w["n_words"]).alias("letter_word_share"),
            share(w["n_stop"], w["n_words"]).alias("stop_word_share"),
            share(x["n_dup_lines"], x["n_lines"]).alias("dup_line_share"),
            share(x["n_bullets"], x["n_lines"]).alias("bullet_line_share"),
            share(x["n_ellipses"], x["n_lines"]).alias("ellipsis_line_share"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return let(
        F.struct(let(words_of(text), from_words).alias("w"), let(lines, from_lines).alias("x"), count(SYMBOLS).alias("s"), count("!").alias("e"), count(LETTER_WORD).alias("l")),
        lambda p: ratios(p["w"], p["x"], p["s"], p["e"], p["l"]),
    )


def base_failed(m: Column) -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def verdict(m: Column, rules=None) -> Column:
    """True where every row of the threshold table holds."""
    kept = ~base_failed(m)
    for name, least, most in RULES if rules is None else rules:
        if least is not None:
            kept = kept & (m[name] >= F.lit(least))
        if most is not None:
            kept = kept & (m[name] <= F.lit(most))
    return kept


def quality_rules(docs: DataFrame, rules=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, all measures, base_failed and kept of every row."""
    m = id_text(docs, id_col, text_col).select("doc_id", measures(F.col("text")).alias("m"))
    return m.select("doc_id", "m.*", base_failed(F.col("m")).alias("base_failed"), verdict(F.col("m"), rules).alias("kept"))


def passing(docs: DataFrame, rules=None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    return docs.filter(let(measures(docs[text_col].cast("string")), lambda m: verdict(m, rules)))
