"""The queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.llm import exact_dedup, jaccard_join, language_id, line_dedup, lm_score, mixing, nearest, packing, periodic_runs, prefix_trie, substring_dedup, suffix_dedup
from weft.llm import quality_rules as rules
from weft.llm.tables import let, words_of
from weft.session import stored, table


def word_bpe() -> str:
    """The installed tokenizer file that the packing query counts with."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_jaccard_join(spark, sf_dir):
    out = jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


_OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS s FROM g
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b, c = x.n AND c = y.n AS equal FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c)
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
), k AS (
  SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id
), m AS (
  SELECT a, count(*) AS n_links, count(*) FILTER (equal) AS n_copies, min(b) FILTER (equal) AS first FROM l GROUP BY a
)
SELECT k.doc_id, class_id, least(k.doc_id, coalesce(first, k.doc_id)) AS copy_id,
       coalesce(n_copies, 0)::BIGINT AS n_copies, coalesce(n_links, 0)::BIGINT AS n_links
FROM k LEFT JOIN m ON m.a = k.doc_id"""


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_digest(table(spark, sf_dir, "documents"))


_OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - {substring_dedup.SPAN - 2})) AS i, ws FROM d WHERE len(ws) >= {substring_dedup.SPAN}
), k AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + {substring_dedup.SPAN - 1}], ' ')) AS k FROM s
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM k
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM m, range(0, {substring_dedup.SPAN}) AS o(j) WHERE m < doc_id
), w AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""


def op3_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


_OP4_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents WHERE text IS NOT NULL
), f AS (
  SELECT doc_id, p, trim(raw, E' \t\n\r\x0b\x0c') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM l WHERE trim(raw, E' \t\n\r\x0b\x0c') <> ''
), w AS (
  SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {line_dedup.SPAN - 1} FOLLOWING) AS x FROM f
), m AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS nth FROM w WHERE len(x) = {line_dedup.SPAN}
), gone AS (
  SELECT DISTINCT f.doc_id, f.p FROM m JOIN f ON f.doc_id = m.doc_id AND f.i BETWEEN m.i AND m.i + {line_dedup.SPAN - 1} WHERE nth > 1
), kept AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY p) AS t FROM l ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM f GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id) USING (doc_id)"""


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    langs, model = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    out = language_id.identify(docs, langs, model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe())


def op7_lm_score(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    return lm_score.lm_score(table(spark, sf_dir, "documents"), good)


def op8_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


_OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(x) // 2 AS n FROM documents
), b AS (
  SELECT doc_id, n, k * 1024 AS lo, substring(x, k * 2048 + 1, 2048 + 2 * {suffix_dedup.SPAN}) AS x FROM d, unnest(range(0, (n + 1023) // 1024)) AS u(k)
), w AS (
  SELECT doc_id, lo + j AS i, substring(x, 2 * j - 1, 2) AS b,
         CASE WHEN lo + j <= n - {suffix_dedup.SPAN - 1} THEN md5_number(substring(x, 2 * j - 1, {2 * suffix_dedup.SPAN})) END AS k
  FROM b, unnest(range(1, least(1024, n - lo) + 1)) AS u(j)
), r AS (
  SELECT k FROM w WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1
), m AS (
  SELECT doc_id, i, b, bool_or(r.k IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {suffix_dedup.SPAN - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN r ON w.k = r.k
), s AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS first FROM m
), g AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans,
         sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
  FROM s GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


def op9_nearest(spark, sf_dir):
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark, sf_dir):
    out = rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op10_sql() -> str:
    stops = ", ".join("'" + w + "'" for w in sorted({w for ws in rules.STOP_WORDS.values() for w in ws}))
    bounds = []
    for name, least, most in rules.RULES:
        bounds += [f"{name} >= {least}"] * (least is not None) + [f"{name} <= {most}"] * (most is not None)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM d
), h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id
), c AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(regexp_extract_all(t, '!'))::BIGINT AS n_exclaims,
         len(list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}')))::BIGINT AS n_letter_words,
         len(list_filter(ws, lambda w: lower(rtrim(w, '.,;:!?')) IN ({stops})))::BIGINT AS n_stop,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullets,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_ellipses,
         coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id
), m AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
         coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
         coalesce(n_exclaims / nullif(n_words, 0), 0) AS exclaims_per_word,
         coalesce(n_letter_words / nullif(n_words, 0), 0) AS letter_word_share,
         coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_share,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
         coalesce(n_bullets / nullif(n_lines, 0), 0) AS bullet_line_share,
         coalesce(n_ellipses / nullif(n_lines, 0), 0) AS ellipsis_line_share,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(bounds)} AS kept
FROM m"""


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text of ASCII characters: bytes are taken in, -1 stands for a shift by one bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: {step}), 4294967295::BIGINT)"


def _planted(doc_id, text):
    """The text of op11's documents: one in ten, by the hash of its id, ends in a repeated stretch of its own words."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")

    return F.when((h % 10 == 0) & (text.rlike(r"[^\x20\x09-\x0D]")), let(words_of(text), repeated)).otherwise(text)


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = periodic_runs.periodic_runs(docs.select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text")))
    # of runs with the greatest exponent the first by start, then period: the array is in that order
    longer = lambda x, y: F.coalesce(y["length"] * x["period"] > x["length"] * y["period"], F.lit(True))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(longer(x, y), y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    digest = out.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return digest.select("doc_id", "n_words", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


_OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, len(ws) AS n, {_crc32("doc_id::VARCHAR")} AS h FROM documents
), p AS (
  SELECT *, (h // 10) % greatest(n, 1) AS a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM d
), w AS (
  SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w
  FROM (SELECT *, unnest(range(0, n)) AS i FROM p)
), m AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i FROM w x JOIN w y ON y.doc_id = x.doc_id AND y.w = x.w AND y.i > x.i AND y.i - x.i <= x.n // 3
), g AS (
  SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM m
), c AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM g GROUP BY doc_id, p, g HAVING count(*) + p >= greatest({periodic_runs.LEAST}, {periodic_runs.PERIODS} * p)
), r AS (
  SELECT doc_id, start, length, min(p) AS period FROM c GROUP BY doc_id, start, length
), b AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id
), f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS nth FROM r
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), k AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, d.n::BIGINT AS n_words, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f ON f.doc_id = d.doc_id AND nth = 1 LEFT JOIN k ON k.doc_id = d.doc_id"""


def op12_prefix_trie(spark, sf_dir):
    turns = stored(prefix_trie.numbered(table(spark, sf_dir, "conversations")), "numbered")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h"))
    of_base = own.filter("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = stored(own.join(of_base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")), "rebuilt")
    # the first turns of a base, five at most, go to the hundred conversations that have it
    first = turns.filter("conv_id % 100 = 0 and pos < 5").withColumnRenamed("conv_id", "base")
    heads = convs.filter("taken > 0").join(first, "base").filter("pos < taken").select("conv_id", "pos", "digest", "chars")
    rest = turns.join(convs, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars")
    made = prefix_trie.trie(heads.unionByName(rest), convs.select("conv_id"))
    sums = prefix_trie.digests(made.ends)
    return made.nodes.join(sums, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256))).drop("sha256")


_OP12_SQL = rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, unhex(sha256(strlen(r)::VARCHAR || ':' || r || x))) - 1 AS pos, r, x
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM t GROUP BY conv_id
), b AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(o.n, 0)) AS taken FROM c LEFT JOIN c o ON o.conv_id = c.base
), m AS (
  SELECT b.conv_id, t.pos, t.r, t.x FROM b JOIN t ON t.conv_id = b.base AND t.pos < b.taken
  UNION ALL
  SELECT b.conv_id, t.pos - b.h + b.taken, t.r, t.x FROM b JOIN t ON t.conv_id = b.conv_id AND t.pos >= b.h
), f AS (
  SELECT conv_id, pos + 1 AS depth, length(x) AS chars,
         sha256(string_agg(strlen(r)::VARCHAR || ':' || strlen(x)::VARCHAR || ':' || r || x, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS k
  FROM m
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM b
), v AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM f GROUP BY depth, k
), p AS (
  SELECT f.conv_id AS member, f.depth, v.conv_id, v.n_convs, v.chars FROM f JOIN v USING (depth, k)
), l AS (
  SELECT v.conv_id, v.depth, v.n_convs, v.chars, p.conv_id AS parent_conv_id FROM v LEFT JOIN p ON p.member = v.conv_id AND p.depth = v.depth - 1
), k AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM l WHERE depth > 0 GROUP BY ALL
), s AS (
  SELECT p.conv_id, p.depth, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((l.n_convs - 1) * l.chars) AS saved_tokens
  FROM l LEFT JOIN k USING (conv_id, depth) JOIN p ON p.member = l.conv_id AND p.depth <= l.depth GROUP BY ALL
), e AS (
  SELECT p.conv_id, p.depth, string_agg(member::VARCHAR, ',' ORDER BY member) AS ends
  FROM p JOIN (SELECT conv_id AS member, max(depth) AS depth FROM f GROUP BY conv_id) USING (member, depth) GROUP BY ALL
)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM l JOIN s USING (conv_id, depth) LEFT JOIN k USING (conv_id, depth) LEFT JOIN e USING (conv_id, depth)"""


def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


_OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS l, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER g = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t ORDER BY l DESC, doc_id NULLS FIRST)"""


QUERIES = {"op1_jaccard_join": op1_jaccard_join, "op2_substring_dedup": op2_substring_dedup, "op3_mixing": op3_mixing, "op4_line_dedup": op4_line_dedup, "op5_language_id": op5_language_id, "op6_packing": op6_packing, "op7_lm_score": op7_lm_score, "op8_suffix_dedup": op8_suffix_dedup, "op9_nearest": op9_nearest, "op10_quality_rules": op10_quality_rules, "op11_periodic_runs": op11_periodic_runs, "op12_prefix_trie": op12_prefix_trie, "op13_exact_dedup": op13_exact_dedup}
ORACLES = {"op1_jaccard_join": _OP1_SQL, "op2_substring_dedup": _OP2_SQL, "op4_line_dedup": _OP4_SQL, "op8_suffix_dedup": _OP8_SQL, "op10_quality_rules": _op10_sql(), "op11_periodic_runs": _OP11_SQL, "op12_prefix_trie": _OP12_SQL, "op13_exact_dedup": _OP13_SQL}
