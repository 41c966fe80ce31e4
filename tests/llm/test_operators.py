"""The numbered operators against brute force on small tables, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import same
from weft.llm import jaccard_join, language_id, line_dedup, lm_score, mixing, nearest, packing, quality_rules, queries, substring_dedup, suffix_dedup
from weft.session import table

PASSAGE = " ".join(f"shared{k}" for k in range(70))
ODD = [
    (1, f"alpha beta {PASSAGE} gamma\nline one\nline two\nline three\nend", "en", "s"),
    (2, f"other start {PASSAGE} finish\nline one\nline two\nline three\nlast", "en", None),
    (3, None, None, "s"),
    (4, "", "en", "s"),
    (5, " \n\t ", "de", "s"),
    (6, "one two", "en", "s"),
    (6, "one two", "en", "s"),
    (7, f"alpha beta {PASSAGE} gamma\nline one\nline two\nline three\nend", "en", "s"),
    (None, f"nobody {PASSAGE} here\nline one\nline two\nline three", "en", "s"),
    (8, "x" * 3000, "fr", "s"),
    (9, " ".join(f"w{k % 977}" for k in range(30_000)), "fr", "t"),
    (10, "Ünïcödé 漢字 😀 " * 60, "fr", "t"),
    (11, "Ünïcödé 漢字 😀 " * 60, "fr", "t"),
]
CLASHES = ["h", "a", "c", "n", "lo", "found", "words", "start", "length", "piece", "id", "path", "bucket", "topic", "kept", "n_words", "rank", "v", "__x"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def words(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLES[name]).df())


# 1


def jaccard_brute(rows, threshold=0.8):
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    holders, common = defaultdict(list), Counter()
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    for ks in holders.values():
        common.update((a, b) for a in ks for b in ks if a < b)
    links, root = Counter(), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            links.update((a, b))
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: (find(k), links[k]) for k in sets}


@pytest.mark.parametrize("settings", [{}, {"small": 2, "depth": 3}])
def test_jaccard_join_finds_every_link(spark, settings):
    rng = random.Random(5)
    rows = []
    for base in range(12):
        text = [f"v{rng.randrange(5000)}" for _ in range(120)]
        for copy in range(rng.choice([1, 2, 9])):
            t = list(text)
            for _ in range(rng.choice([0, 1, 2, 4])):
                t[rng.randrange(len(t))] = f"edit{base}{copy}"
            rows.append((len(rows), " ".join(t)))
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == jaccard_brute(rows)


def test_jaccard_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_SKETCHES", 5)
    rows = [(k, " ".join(f"t{j}" if j != k else f"own{k}" for j in range(200))) for k in range(23)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), small=3).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == jaccard_brute(rows)


def test_jaccard_repetitions_reach_the_deepest_level():
    kept = 1.0
    for _ in range(jaccard_join.DEPTH):
        kept = 1 - (1 - jaccard_join.BRANCHING * kept / jaccard_join.COORDINATES) ** jaccard_join.COORDINATES
    least = int(np.ceil(jaccard_join.PROPOSED * 64))
    tail = sum(math.comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(least))
    assert (1 - kept) ** jaccard_join.repetitions(0.8, jaccard_join.MISS) + tail <= jaccard_join.MISS


def test_jaccard_recall_of_lone_pairs_in_deep_buckets(spark):
    rng, rows = random.Random(9), []
    hot = [f"hot{k}" for k in range(12)]
    for pair in range(150):
        own = [f"p{pair}w{rng.randrange(10**6)}" for _ in range(88)]
        edited = list(own)
        edited[20] = edited[60] = "edit"  # ten shingles of 96 differ on either side: 86 of 106 are common
        rows += [(2 * pair, " ".join(own + hot)), (2 * pair + 1, " ".join(edited + hot))]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), small=2).collect()
    assert all(n == 1 for _, n in jaccard_brute(rows).values())
    assert sum(r["n_links"] == 1 for r in got) >= 2 * 149


def test_similarity_of_a_bucket_is_estimated(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, 64, dtype=np.uint32)
    rows = []
    for path, similarity in ((1, 0.9), (2, 0.2), (3, 0.0)):
        for k in range(400):
            sig = np.where(rng.random(64) < similarity**0.5, base, rng.integers(0, 1 << 32, 64, dtype=np.uint32))
            rows.append((path, int(((sig[:16] & 1) << np.arange(16)).sum())))
    got = {r["path"]: r["alike"] for r in jaccard_join.buckets_of(spark.createDataFrame(rows, "path long, signs int")).collect()}
    assert abs(got[1] - 0.9) < 0.1 and abs(got[2] - 0.2) < 0.1 and abs(got[3]) < 0.1


def test_one_of_each_judges_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    near = text + " more"
    other = " ".join(f"o{k}" for k in range(60))
    lone = " ".join(f"n{k}" for k in range(60))
    rows = [(1, text), (1, text), (2, near), (2, other), (3, other), (None, near), (None, lone), (None, lone), (4, None), (5, "")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, text), (2, other), (None, lone), (4, None), (5, "")], key=str)


def test_jaccard_odd_rows(odd):
    got = jaccard_join.jaccard_join(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    want = jaccard_brute([(k, t) for k, t, _, _ in ODD if k is not None])
    assert all(by[k]["class_id"] == c for k, (c, _) in want.items())
    assert all(by[k]["n_links"] == n for k, (_, n) in want.items() if k != 6)
    assert by[7]["copy_id"] == 1 and by[1]["n_copies"] == 1 and by[6]["n_copies"] == by[6]["n_links"] == 1
    assert by[3]["n_links"] == by[4]["n_links"] == by[5]["n_links"] == 0 and by[4]["class_id"] == 4 and by[None]["class_id"] is None
    assert jaccard_join.jaccard_join(odd.limit(0)).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {c for c, _ in want.values()}  # the row without an id is a near copy of 1


# 2


def substring_brute(rows, span):
    first = {}
    for k, t in sorted(r for r in rows if r[0] is not None):
        w = words(t)
        for i in range(len(w) - span + 1):
            first.setdefault(tuple(w[i : i + span]), k)
    out = []
    for k, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - span + 1):
            if k is not None and first[tuple(w[i : i + span])] < k:
                gone |= set(range(i, i + span))
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("span", "gram"), [(50, 10), (12, 4), (3, 1)])
def test_substring_dedup(docs, odd, span, gram):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = substring_dedup.substring_digest(df, span, gram).collect()
        assert sorted(map(tuple, got), key=str) == substring_brute(rows, span)


def test_substring_stretches_and_empty(odd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "STRETCH", 100)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, substring_dedup.substring_digest(odd).collect()), key=str) == substring_brute(rows, 50)
    assert substring_dedup.substring_dedup(odd.limit(0)).count() == 0


# 3


def rake_brute(tokens, shares, keep, rounds):
    """Keep probabilities by plain loops: one margin after the other is scaled to its targets, never above 1."""
    p, goal = dict.fromkeys(tokens, keep), keep * sum(tokens.values())
    for _ in range(rounds):
        for at, share in enumerate(shares):
            have = Counter()
            for cell, n in tokens.items():
                have[cell[at]] += p[cell] * n
            p = {cell: min(1.0, x * share[cell[at]] * goal / have[cell[at]]) if have[cell[at]] > 0 else x for cell, x in p.items()}
    return p


def slot_of(lang):
    return zlib.crc32((lang or "?").encode()) % mixing.SLOTS


def assert_plan_is_raked(docs, plan, most, wishes=None):
    """The plan's probabilities are those of plain loops at its share; a share below the most has a reason."""
    cells, few, model, keep = plan
    tokens = Counter()
    for r in docs.collect():
        counts, v = mixing._vectors([r["text"]])
        tokens[r["source"] or "?", r["lang"] or "?", f"t{model.nearest(v, [slot_of(r['lang'])])[0]}" if counts[0] else "?"] += counts[0]
    got = cells.collect()
    assert few and {(r["source"], r["lang"], r["topic"]): r["tokens"] for r in got} == tokens
    shares = []
    for at, margin in enumerate(mixing.MARGINS):
        seen = Counter()
        for cell, n in tokens.items():
            seen[cell[at]] += n
        weight = {c: ((wishes or {}).get(margin, {}).get(c, 0.0) if n else 0.0) if margin in (wishes or {}) else n ** mixing.TEMPERS[margin] for c, n in seen.items()}
        shares.append({c: w / sum(weight.values()) for c, w in weight.items()})
    def off(share):
        p = rake_brute(tokens, shares, share, mixing.ROUNDS)
        total = sum(p[c] * n for c, n in tokens.items())
        return max(abs(sum(p[c] * n for c, n in tokens.items() if c[at] == k) / total - w) for at, s in enumerate(shares) for k, w in s.items())

    assert keep == most or off(most) > mixing.WITHIN
    assert keep == most or off(keep) <= mixing.WITHIN < off(keep + most / 2**mixing.HALVINGS)
    want = rake_brute(tokens, shares, keep, mixing.ROUNDS)
    assert all(abs(r["probability"] - want[r["source"], r["lang"], r["topic"]]) < 1e-4 for r in got)


@pytest.mark.parametrize("wishes", [None, {"lang": {"en": 0.25, "de": 0.25, "es": 0.25, "fr": 0.25}}])
def test_mixing_rakes_like_plain_loops(docs, wishes):
    assert_plan_is_raked(docs, mixing.plan(docs, 0.3, wishes), 0.3, wishes)


def test_mixing_draws_what_it_expects(docs):
    report = mixing.achieved(docs, 0.3, {"lang": {"en": 0.25, "de": 0.25, "es": 0.25, "fr": 0.25}}).collect()
    assert {r["margin"] for r in report} == set(mixing.MARGINS)
    assert all(abs(sum(r["wanted"] for r in report if r["margin"] == m) - 1) < 1e-9 and abs(sum(r["expected"] for r in report if r["margin"] == m) - 1) < 1e-9 for m in mixing.MARGINS)
    assert all(r["met"] == (abs(r["wanted"] - r["expected"]) <= 0.01) for r in report)
    drawn = mixing.mix(docs).toPandas()
    expected = (drawn["n_tokens"] * drawn["probability"]).sum()
    spread = float((drawn["n_tokens"] ** 2 * drawn["probability"] * (1 - drawn["probability"])).sum() ** 0.5)
    assert abs(drawn.loc[drawn["kept"], "n_tokens"].sum() - expected) < 4 * spread


def test_mixing_meets_its_targets_or_says_so(docs):
    drawn = mixing.mix(docs).toPandas()
    full = drawn[drawn["n_tokens"] > 0]
    assert full["met"].all() and 0 < full["keep_share"].iloc[0] <= mixing.KEEP_SHARE and drawn["keep_share"].nunique() == 1
    for m in mixing.MARGINS:
        by = full.groupby(m)
        have = by.apply(lambda g: (g["n_tokens"] * g["probability"]).sum(), include_groups=False) / (full["n_tokens"] * full["probability"]).sum()
        assert np.allclose(have, by[f"{m}_expected"].first()) and (abs(have - by[f"{m}_wanted"].first()) <= mixing.WITHIN).all()
    # most of the tokens are of languages that are not wanted, and the wanted one is where no wanted source is
    rows = [(k, "a b c d", "en" if k % 2 else "de", "x" if k % 2 else "y") for k in range(100)]
    odd = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    against = mixing.mix(odd, 0.5, {"lang": {"en": 1.0}, "source": {"y": 1.0}}).toPandas()
    assert not against["met"].any() and (against["keep_share"] == 0.5).all()


def test_topics_part_word_fields(spark):
    rng = random.Random(3)
    fields = [[f"f{f}w{k}" for k in range(300)] for f in range(4)]
    common = [f"c{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices(fields[k % 4], k=60) + rng.choices(common, k=60))) for k in range(800)]
    signed = mixing.with_traits(spark.createDataFrame(rows, "doc_id long, text string"), None).select("__mix.*")
    model = mixing.learn_topics(signed, 4)
    own = model.nearest(mixing._vectors([t for _, t in rows])[1], [slot_of(None)] * len(rows))
    assert sum(max(Counter(own[f::4].tolist()).values()) for f in range(4)) > 0.95 * len(rows) and len(set(own.tolist())) == 4


def test_mixing_takes_a_topic_column(docs):
    named = docs.withColumn("theme", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3))
    got = mixing.mix(named, topic_col="theme")
    assert {r["topic"] for r in got.select("topic").distinct().collect()} == {"1", "2", "?"} and got.count() == docs.count()


def test_mixing_joined_equals_driver(docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 3)
    one, few, _, share = mixing.plan(docs)
    two, joined, _, also = mixing.plan(docs, most_driver_cells=0)
    assert few and not joined
    a, b = ({(r["source"], r["lang"], r["topic"]): r["probability"] for r in x.collect()} for x in (one, two))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_mixing_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r["probability"] is not None for r in got)
    assert len({r["kept"] for r in got if r["doc_id"] == 6}) == 1
    assert mixing.sampled(odd).columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0


# 4


def line_brute(rows, span):
    first, out = {}, []
    lines = lambda t: [x for x in line_dedup.lines_of(t) if x] if t is not None else []
    for k, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
        w = lines(t)
        for i in range(len(w) - span + 1):
            first.setdefault(tuple(w[i : i + span]), (k, i))
    for k, t in rows:
        if t is None:
            out.append((k, 0, 0, None))
            continue
        raw = t.split("\n")
        full, w, gone = [i for i, x in enumerate(raw) if x.encode().strip(line_dedup.BLANK)], lines(t), set()
        for i in range(len(w) - span + 1):
            if k is not None and first[tuple(w[i : i + span])] < (k, i):
                gone |= set(full[i : i + span])
        out.append((k, len(full), len(gone), "\n".join(x for i, x in enumerate(raw) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1, 3, 5])
def test_line_dedup(docs, odd, span):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert sorted(map(tuple, line_dedup.line_dedup(df, span).collect()), key=str) == line_brute(rows, span)


def test_line_dedup_stage(odd):
    kept = line_dedup.without_later_runs(odd)
    assert kept.columns == odd.columns and "line two" not in next(r["text"] for r in kept.collect() if r["doc_id"] == 2)
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0


# 5


def test_language_id_on_held_out(spark, sf_dir):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 150 and (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_mixture_is_found(spark):
    en, de = "the cat and the dog are in the house with us ", "der Hund und die Katze sind mit uns im Haus "
    langs, model = language_id.learn(spark.createDataFrame([(en * 20, "en"), (de * 20, "de")], "text string, lang string"))
    rows = spark.createDataFrame([(1, en * 5), (2, de * 5), (3, en * 6 + de * 3), (4, None), (5, "123 !"), (5, "123 !")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(rows, langs, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 4, 5)] == ["en", "de", "en", "und", "und"]
    assert set(got[3]["langs"]) == {"en", "de"} and 0.5 < got[3]["score"] < 0.8 and got[1]["score"] == 1.0


def test_language_mixture_maximises_likelihood():
    rng = np.random.default_rng(2)
    g = rng.random((400, 3)).astype(np.float32) + 0.01
    pi = language_id._em(g, np.full(3, 1 / 3, np.float32))
    best = np.log(g @ pi).sum()
    for _ in range(300):
        other = rng.dirichlet([1, 1, 1])
        assert np.log(g @ other).sum() <= best + 0.5


def language_brute(rows, texts):
    """Trigram counts in a dictionary a language, and for each text the best of all sets of languages by penalised likelihood."""
    from itertools import combinations

    counts = defaultdict(Counter)
    for t, lang in rows:
        counts[lang].update(language_id.trigrams(t).tolist())
    langs, out = sorted(counts), []
    size = {k: sum(c.values()) for k, c in counts.items()}
    prob = lambda b, k: (counts[k][b] + language_id.SMOOTHING) / (size[k] + language_id.SMOOTHING * language_id.BUCKETS)
    for t in texts:
        tri = language_id.trigrams(t).tolist()
        best = (-np.inf, ())
        for many in range(1, len(langs) + 1):
            for some in combinations(langs, many):
                g = np.array([[prob(b, k) for k in some] for b in tri])
                pi = np.full(many, 1 / many)
                for _ in range(3000):
                    pi = pi * (g / (g @ pi)[:, None]).mean(axis=0)
                score = np.log(g @ pi).sum() - language_id.PENALTY * 0.5 * many * np.log(len(tri))
                best = max(best, (score, tuple(zip(some, pi, strict=True))))
        out.append(dict(best[1]))
    return out


def test_language_sets_are_those_of_an_exhaustive_search(spark):
    rng = random.Random(6)
    pools = {k: ["".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(60)] for k, letters in (("a", "abcdef"), ("b", "cdefgh"), ("c", "ghijkl"), ("d", "klmnop"))}
    say = lambda k, n: " ".join(rng.choices(pools[k], k=n))
    rows = [(say(k, 80), k) for k in pools for _ in range(5)]
    texts = [say("a", 40), say("a", 60) + " " + say("c", 30), say("b", 40) + " " + say("d", 40), say("a", 40) + " " + say("c", 40) + " " + say("d", 40), say("b", 3)]
    langs, model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    got = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), langs, model).orderBy("doc_id").collect()
    for r, want in zip(got, language_brute(rows, texts), strict=True):
        assert r["langs"].keys() == want.keys() and all(abs(r["langs"][k] - want[k]) < 0.01 for k in want)


def test_language_model_is_bounded_without_dropping_languages(spark):
    rows = [(f"word{k} " * 20, f"l{k:02d}") for k in range(9)]
    langs, model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"), most_cells=1 << 17)
    assert len(langs) == 9 and model.shape == (1 << 13, 9) and np.allclose(model.sum(axis=0), 1, atol=1e-3)
    got = language_id.identify(spark.createDataFrame(rows, "text string, lang string").withColumn("doc_id", F.lit(1)).withColumn("id", F.col("lang")), langs, model)
    assert got.count() == 9


def test_long_text_has_one_choice(spark):
    en, de = "the cat and the dog are in the house with us ", "der Hund und die Katze sind mit uns im Haus "
    langs, model = language_id.learn(spark.createDataFrame([(en * 20, "en"), (de * 20, "de")], "text string, lang string"))
    rows = spark.createDataFrame([(1, en * 6 + de * 3), (2, en * 24_000 + de * 12_000)], "doc_id long, text string")
    short, long = language_id.identify(rows, langs, model).orderBy("doc_id").collect()
    assert short["langs"].keys() == long["langs"].keys() and abs(short["score"] - long["score"]) < 0.02


def test_numbers_are_no_letters():
    assert not any(language_id.has_letter(t) for t in ("", "12 _ !", "½ ²", "①", "Ⅷ", "٣")) and all(language_id.has_letter(t) for t in ("½a", "Ⅷ ß", "漢", "ª"))


def test_language_odd_rows(odd):
    langs, model = language_id.learn(odd)
    got = language_id.identify(odd, langs, model).collect()
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
    nothing = language_id.learn(odd.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(odd, *nothing).collect()} == {"und"}


# 6


def test_plan_places_every_piece_once():
    for seed in range(200):
        rng = random.Random(seed)
        cap = rng.choice([10, 50, 2048])
        counts = {rng.randint(1, cap): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
        slots, n = packing.best_fit(counts, cap)
        bins, seen = defaultdict(list), set()
        for length, lo, hi, first, each, base in slots:
            for r in range(lo, hi):
                assert (length, r) not in seen
                seen.add((length, r))
                bins[first + (r - lo) // each].append((base + (r - lo) % each * length, length))
        assert len(seen) == sum(counts.values()) and sorted(bins) == list(range(n))
        for members in bins.values():
            at = 0
            for offset, length in sorted(members):
                assert offset == at
                at += length
            assert at <= cap
        rooms: list[int] = []  # best fit decreasing, one piece at a time
        for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else cap) - length)
        assert n == len(rooms)


def check_packing(df, got):
    """got (a frame of pieces) against the tokenizer itself: every piece once, sequences gapless and no longer than they may be."""
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(queries.word_bpe()), []
    for r in df.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want += [(r["doc_id"], k, at, len(part := ids[at : at + 2048]), zlib.crc32(np.array(part, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    none = lambda x: None if x != x else int(x)
    assert sorted(((none(r[0]), *map(int, r[1:5])) for r in got.itertuples(index=False)), key=str) == sorted(want, key=str)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= got["length"].sum() / 2048 * 1.1 + 1


def test_pack_round_trip(docs, odd):
    for df in (docs, odd):
        check_packing(df, packing.pack(df, queries.word_bpe()).toPandas())
    assert packing.pack(odd.limit(0), queries.word_bpe()).count() == 0


def test_word_encoder_is_exact():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(queries.word_bpe()), packing.encoder(queries.word_bpe())
    for t in ["a  b", "x y don't I'LL é ́q ΑΣ ΑΣ. <|endoftext|> a<|startoftext|>b c\x1cd", "", "  ", "A.. b., c.\td. e. f, don't. x'. É. É. 3. a1. ", "<|STARTOFTEXT|> Stop.", "İ ı ß 漢字 😀👍🏽 ９", "x.\ny,\n"]:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids + [0]


# 7


def test_lm_score_matches_plain_models(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["a", "b", "c", "d."] if k % 2 else ["a", "x", "y", "z!"]) for _ in range(60))) for k in range(20)] + [(20, None), (21, ""), (None, "a x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(k,) for k in range(1, 20, 2)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_score.lm_score(df, target).collect()}
    toks = {k: [w.decode() for w in lm_score.tokens(t)] for k, t in rows}
    vocab = sorted({w for t in toks.values() for w in t})
    target_tokens = sum(len(toks[k]) for k in range(1, 20, 2))
    for corpus, name in ((range(1, 20, 2), "target_loss"), (toks, "background_loss")):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for k in corpus:
            uni.update(toks[k])
            bi.update(zip(["<s>", *toks[k]], toks[k], strict=False))
            ctx.update((["<s>", *toks[k]])[: -1 if toks[k] else None] if toks[k] else [])
            ctx.update(toks[k][-1:])
        total = sum(uni.values())
        for k in (0, 1, 5):
            loss = 0.0
            for a, b in zip(["<s>", *toks[k]], toks[k], strict=False):
                scale = 1 if name == "target_loss" else target_tokens / total
                word = (scale * uni[b] + 1) / (scale * total + len(vocab) + 1)
                loss -= np.log((scale * bi[a, b] + lm_score.PRIOR * word) / (scale * ctx[a] + lm_score.PRIOR))
            assert abs(got[k][name] - loss / len(toks[k])) < 1e-5
    assert got[1]["score"] < got[0]["score"] and got[20]["n_tokens"] == got[21]["n_tokens"] == 0 and got[20]["score"] is None


def test_lm_score_odd_rows(odd):
    assert lm_score.lm_score(odd, odd).count() == len(ODD)
    assert lm_score.lm_score(odd, odd.limit(0)).count() == len(ODD)
    assert lm_score.lm_score(odd.limit(0), odd).count() == 0


def lm_brute(rows, targets):
    toks = [lm_score.tokens(t) for _, t in rows]
    vocab, losses, target = {w for t in toks for w in t}, [], 0
    for some in ([t for (k, _), t in zip(rows, toks, strict=True) if k in targets], toks):
        uni, bi = Counter(w for t in some for w in t), Counter(x for t in some for x in zip([None, *t], t, strict=False))
        ctx, total = uni + Counter({None: sum(1 for t in some if t)}), sum(uni.values())
        target = target if losses else total
        scale = target / total
        word = lambda b: (scale * uni[b] + 1) / (scale * total + len(vocab) + 1)  # noqa: B023, E731
        prob = lambda a, b: (scale * bi[a, b] + lm_score.PRIOR * word(b)) / (scale * ctx[a] + lm_score.PRIOR)  # noqa: B023, E731
        losses.append([-sum(np.log(prob(a, b)) for a, b in zip([None, *t], t, strict=False)) / len(t) if t else None for t in toks])
    return [(k, len(t), *x) for (k, _), t, *x in zip(rows, toks, *losses, strict=True)]


@pytest.mark.parametrize("chunk", [None, 50])
def test_lm_score_counts_every_word_and_bigram(spark, chunk):
    n = 400 if chunk else 140_000  # more words than 2^17
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{rng.randrange(9)}" for _ in range(30)) + f" rare{k % 2} w1") for k in range(40)]
    rows += [(40, " ".join(f"u{k}" for k in range(n))), (41, " ".join(f"u{k}" for k in range(0, n, 2))), (41, "w1 w2"), (41, "w1 w2"), (None, "w3 u5"), (42, None)]
    targets = {*range(0, 20), 41}
    df, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in targets], "doc_id long")
    got = lm_score.lm_score(df, target, **({"chunk": chunk} if chunk else {}))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    for g, w in zip(sorted((tuple(r)[:4] for r in got.collect()), key=key), sorted(lm_brute(rows, targets), key=key), strict=True):
        assert g[:2] == w[:2] and (g[2:] == w[2:] if w[2] is None else np.allclose(g[2:], w[2:], atol=1e-9)), (g, w)


def test_lm_score_is_the_same_however_often_the_background_is_repeated(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefg") for _ in range(40))) for k in range(30)]
    wanted = spark.createDataFrame([(k,) for k in range(10)], "doc_id long")
    one = lm_score.lm_score(spark.createDataFrame(rows, "doc_id long, text string"), wanted)
    more = rows + [(100 * n + k, t) for n in (1, 2, 3) for k, t in rows]
    many = lm_score.lm_score(spark.createDataFrame(more, "doc_id long, text string"), wanted)
    a, b = ({r["doc_id"]: r["score"] for r in x.collect()} for x in (one, many))
    assert all(abs(a[k] - b[k]) < 1e-9 for k, _ in rows)


# 8


def suffix_brute(rows, span):
    counts, out = Counter(), []
    raws = [(k, (t or "").encode()) for k, t in rows]
    for _, b in raws:
        counts.update(b[i : i + span] for i in range(len(b) - span + 1))
    for k, b in raws:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if counts[b[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype("i1"))).reshape(-1, 2)
        out.append((k, len(b), [(int(x), int(y)) for x, y in runs], hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("span", "step", "most"), [(400, 160, 50_000), (60, 20, 50_000), (60, 20, 2)])
def test_suffix_dedup(odd, docs, span, step, most):
    small = docs.filter("doc_id < 60").select("doc_id", "text")
    for df in (odd.filter("doc_id is null or doc_id <> 9"), small):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = suffix_dedup.suffix_dedup(df, span, step, most_group=most).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], r["kept_sha256"]) for r in got), key=str) == suffix_brute(rows, span)


def test_suffix_stretches_and_empty(odd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    some = odd.filter("doc_id is null or doc_id <> 9")
    got = suffix_dedup.suffix_dedup(some).collect()
    assert sorted((r["doc_id"], r["kept_sha256"]) for r in got if r["doc_id"] is not None) == sorted((k, s) for k, _, _, s in suffix_brute([(r["doc_id"], r["text"]) for r in some.collect()], 400) if k is not None)
    assert suffix_dedup.suffix_dedup(odd.limit(0)).count() == 0


def test_deep_shallow_sorts():
    for seed in range(200):
        rng = random.Random(seed)
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, rng.choice([3, 30])))) for _ in range(rng.randint(1, 40))]
        strings = [b"x" * 70 + s for s in strings] if seed % 3 == 0 else strings
        groups = np.array([rng.randint(0, 2) for _ in strings])
        order, lcp = suffix_dedup.deep_shallow(strings, groups, 8 if seed % 2 else 64)
        assert [(groups[i], strings[i]) for i in order] == sorted(zip(groups, strings, strict=True))
        for k in range(1, len(strings)):
            a, b = strings[order[k - 1]], strings[order[k]]
            want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == (want if groups[order[k]] == groups[order[k - 1]] else -1)


# 9


def test_nearest_recall_and_scores(spark, sf_dir):
    e = table(spark, "/root/testdata/sf0.1", "embeddings")
    x = e.toPandas()
    ids, v = x["vec_id"].to_numpy(), np.stack(x["embedding"]).astype(float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hit = total = 0
    by = {k: g.sort_values("rank") for k, g in nearest.nearest(e).toPandas().groupby("query_id")}
    at = {k: i for i, k in enumerate(ids)}
    for k in ids[ids % 50 == 0]:
        s = u @ u[at[k]]
        s[at[k]] = -9
        g = by[k]
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and np.abs(s[[at[i] for i in g["vec_id"]]] - g["score"]).max() < 1e-12
        hit += len(set(ids[np.argsort(-s)[:5]]) & set(g["vec_id"]))
        total += 5
    assert hit / total >= 0.9


def test_nearest_opens_most_lists_in_bounded_batches():
    """Vectors without clusters open most lists: what 300 of them take along was one batch of all their rows."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 64))
    index = nearest.Index(x, 1200, 5)
    index.ratio = 100.0
    asked = pa.RecordBatch.from_arrays([pa.array(list(x[:300])), pa.array(range(300))], ["v", "query_id"])
    got = list(nearest._deal(iter([asked.slice(0, 0), asked]), index, "opened", ["v", "query_id"]))
    want = sorted(zip(*(a.tolist() for a in index.opened(nearest._unit(x[:300]))), strict=True))
    assert len(want) > 300 * 1000 and max(b.nbytes for b in got) < 2 * nearest.ROOM
    assert sorted((q, li) for b in got for q, li in zip(b["query_id"].to_pylist(), b["list"].to_pylist(), strict=True)) == want
    assert got[-1]["v"][0].as_py() == x[got[-1]["query_id"][0].as_py()].tolist()


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (8, [1.0]), (None, [1.0, 2.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (100, []), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("ids", F.lit(1)).withColumn("query_id", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 7), (0, 4, 50), (50, 1, 7), (50, 2, 0), (50, 3, 1), (50, 4, 2)]
    assert nearest.nearest(df.limit(0)).count() == 0


def test_nearest_of_any_magnitude_and_length(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 4))
    rows = [(k, (x * (1e200, 1e-200, 1.0)[k % 3]).tolist()) for k, x in enumerate(v)] + [(200, [1.0, 2.0]), (201, [2.0, 1.0]), (202, [1.0, 1.9]), (250, [5.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for k in (0, 50, 100):
        s = u @ u[k]
        s[k] = -9
        g = got[got["query_id"] == k].sort_values("rank")
        assert np.allclose(g["score"], s[g["vec_id"]], atol=1e-12) and len(set(g["vec_id"]) & set(np.argsort(-s)[:5])) >= 4
    assert got[got["query_id"] == 200].sort_values("rank")["vec_id"].tolist() == [202, 201] and not (got["query_id"] == 250).any()


def test_few_lists_are_opened_where_vectors_have_clusters():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(100, 32))
    x = centres[rng.integers(0, 100, 8000)] + 0.2 * rng.normal(size=(8000, 32))
    index = nearest.Index(x[:6000], 40, 5)
    assert len(index.opened(nearest._unit(x[6000:]))[0]) / 2000 < 4


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0, 3.0]) for k in range(120)] + [(200, [3.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {k: [] for k in (0, 50, 100, 200)}
    for r in nearest.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 200: [0, 1, 2, 3, 4]}


def test_equal_cosines_go_to_the_smaller_ids(spark):
    rows = [(k, [float(3 * (1 << (k % 7))), float(4 * (1 << (k % 7)))]) for k in range(1, 150)]
    rng = random.Random(2)
    small = [(k, [float(rng.randint(-1, 1)) for _ in range(3)]) for k in range(200, 700)]
    for batch in (rows, small):
        got = {}
        for r in nearest.nearest(spark.createDataFrame(batch, "vec_id long, embedding array<double>"), lists=1).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        some = {k: np.array(v) for k, v in batch if any(v)}
        for q, found in got.items():
            scores = sorted((-float((some[q] * x).sum() / (np.sqrt((some[q] ** 2).sum()) * np.sqrt((x * x).sum()))), k) for k, x in some.items() if k != q)
            assert [v for v, _ in found] == [k for _, k in scores[:5]]
        assert set(got) == {k for k in some if k % 50 == 0}


# 10


def test_quality_rules_on_odd_rows(odd):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == len(ODD)
    for r, (_, t, _, _) in zip(sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_words"])), sorted(ODD, key=lambda r: (r[0] or 0, len(words(r[1])))), strict=True):
        w = words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert r["n_words"] == len(w) and r["n_repeat_words"] == len(repeat)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
    assert quality_rules.passing(odd).columns == odd.columns
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


def test_quality_rules_run_no_python(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_thresholds_are_data(docs):
    assert quality_rules.quality_rules(docs, [("n_words", 10**9, None)]).filter("kept").count() == 0
