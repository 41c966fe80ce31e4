"""Periodic runs, the prefix trie and exact dedup against brute force on small tables, and on odd input."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import CLASHES, ODD
from weft.llm import exact_dedup, periodic_runs, prefix_trie, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [*ODD, (12, "tick tock " * 40 + "end", "en", "s"), (13, "a b c\n" * 12, "en", "s"), (None, "a  b c\t" * 12, "en", None)]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).withColumns({c: F.lit("clash") for c in [*CLASHES, "norm", "part", "run", "runs"]})


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """A folder of tables that the queries read."""
    at = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{at}/documents.parquet")
    return at


# 11


def runs_brute(words):
    """Every period by itself: where words that far apart are equal in a row."""
    ids, best = np.unique(np.array(words, object), return_inverse=True)[1] if len(words) else np.zeros(0, int), {}
    for p in range(1, len(words) // 3 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[p:] == ids[:-p], [False]]).astype("i1"))).reshape(-1, 2)
        for start, end in edges[edges[:, 1] - edges[:, 0] + p >= max(24, 3 * p)].tolist():
            best.setdefault((start, end - start + p), p)
    return sorted((start, p, length) for (start, length), p in best.items())


def planted_brute(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest_brute(doc_id, text):
    words = planted_brute(doc_id, (text or "").encode().split())
    runs = runs_brute(words)
    gone = {i for start, p, length in runs for i in range(start + p, start + length)}
    start, p, length = max(runs, key=lambda r: (r[2] / r[1], -r[0], -r[1]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(words), len(runs), start, length, p, None if p is None else 1000 * length // p, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_equal_brute_force_on_random_words():
    rng = random.Random(11)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, kinds = rng.choice([0, 1, 5, 23, 24, 25, 60, 200]), rng.choice([1, 2, 3, 30])
            words = [rng.randrange(kinds) for _ in range(n)]
            for _ in range(3 * (n > 10)):
                at, p = rng.randrange(n), rng.randint(1, 12)
                for i in range(at + p, min(n, at + p * rng.randint(2, 9))):
                    words[i] = words[i - p]
            texts.append(words)
        sizes = np.array([len(x) for x in texts], np.int64)
        got = [[] for _ in texts]
        for text, start, length, p in zip(*periodic_runs.runs_of(np.array(sum(texts, []), np.int64), np.cumsum(sizes) - sizes, sizes), strict=True):
            got[text].append((start, p, length))
        assert got == [runs_brute(x) for x in texts]


def test_extensions_equal_comparison():
    rng = np.random.default_rng(3)
    for words in (rng.integers(0, 2, 90), np.zeros(40, np.int64), np.tile(np.arange(7), 9), np.arange(5)):
        ext = periodic_runs.Extensions(words)
        x, y = np.array([(i, j) for i in range(len(words)) for j in range(len(words)) if i != j]).T
        brute = [next((k for k in range(len(words)) if max(i, j) + k >= len(words) or words[i + k] != words[j + k])) for i, j in zip(x, y, strict=True)]
        assert ext.at(x, y).tolist() == brute


def test_grid_in_parts_gives_the_same(monkeypatch):
    words = np.tile(np.arange(13), 40)
    whole = periodic_runs.runs_of(words, np.array([0]), np.array([len(words)]))
    monkeypatch.setattr(periodic_runs, "MOST_PAIRS", 50)
    assert all((a == b).all() for a, b in zip(whole, periodic_runs.runs_of(words, np.array([0]), np.array([len(words)])), strict=True))


def test_op11_on_odd_rows(spark, odd, folder):
    got = queries.op11_periodic_runs(spark, folder)
    want = [digest_brute(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_periodic_runs_keep_texts_and_take_empty_tables(odd):
    out = {r["doc_id"]: r for r in periodic_runs.periodic_runs(odd.filter("doc_id in (3, 4, 12, 13)")).collect()}
    assert out[12]["kept"] == "tick tock end" and [tuple(r) for r in out[12]["runs"]] == [(0, 80, 2)]
    assert out[13]["kept"] == "a b c" and out[3]["kept"] == "" and out[4]["n_words"] == 0
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0


# 12

TALKS = "conv_id long, turn long, role string, text string, digest string, pos string, part string"


def talk_rows():
    rng = random.Random(12)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 207, 208, 350, -3]:
        for t in range(rng.choice([1, 2, 2, 3, 6, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hello", "hi", "Größe", "", None])))
    rows += [(400, t, "user", f"long {t // 7}") for t in range(60)] + [(401, t, "user", f"long {t // 7}") for t in range(31)]
    rows += [(402, None, "user", "null turn"), (402, None, None, "another"), (402, 1, "user", "x"), (402, 1, "user", "x"), (None, 0, "user", "nobody's")]
    rows += [(c, 0, "user", "hot first turn") for c in range(500, 600)]
    rng.shuffle(rows)
    return [(*r, "clash", "clash", "clash") for r in rows]


def digest_of(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def turns_brute(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, digest_of(role or "", text or ""), role or "", text or ""))
    return {c: [(role, text) for _, _, _, role, text in sorted(ts)] for c, ts in own.items()}


def rebuilt_brute(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie_brute(talks):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def totals(p):
        below = [totals(k) for k in kids[p]]
        own = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        return (sum(x for x, _ in below) if below else 1), own + sum(y for _, y in below)

    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), *totals(p), hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def as_rows(nodes, sums):
    out = nodes.join(sums, ["conv_id", "depth"], "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["sha256"] or empty) for r in out)


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame(talk_rows(), TALKS)


def test_trie_equals_brute_force(talks):
    made = prefix_trie.prefix_trie(talks)
    assert as_rows(made.nodes, prefix_trie.digests(made.ends)) == trie_brute(turns_brute(talk_rows()))


def test_blocks_and_borders_change_nothing(spark, talks, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 5)
    own = turns_brute(talk_rows())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        numbers = prefix_trie.numbered(talks).collect()
        assert sorted((r["conv_id"], r["pos"], bytes(r["digest"])) for r in numbers) == sorted((c, i, digest_of(*t)) for c, ts in own.items() for i, t in enumerate(ts))
        made = prefix_trie.prefix_trie(talks)
        assert as_rows(made.nodes, prefix_trie.digests(made.ends)) == trie_brute(own)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_op12_rebuilds_conversations(spark, talks, tmp_path):
    talks.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_prefix_trie(spark, str(tmp_path)).withColumnRenamed("ends_sha256", "sha256")
    want = trie_brute(rebuilt_brute(turns_brute(talk_rows())))
    assert as_rows(got.drop("sha256"), got.select("conv_id", "depth", "sha256")) == want


def test_trie_of_no_turns_has_no_nodes(spark, talks):
    made = prefix_trie.prefix_trie(talks.limit(0))
    assert made.nodes.count() == 0 and prefix_trie.digests(made.ends).count() == 0


# 13


def exact_brute(rows):
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        text = text or ""
        groups["".join(x for x in text if x not in " \t\n\v\f\r")].append((-len(text), doc_id is not None, doc_id or 0, k, doc_id))
    out = []
    for norm, rows_ in groups.items():
        first, *_ = ranked = sorted(rows_)
        out += [(r[4], first[4], len(ranked), r is first, hashlib.sha256(norm.encode()).hexdigest()) for r in ranked]
    return sorted(map(str, out))


def test_exact_dedup_on_odd_rows(spark, odd, folder):
    want = exact_brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    got = queries.op13_exact_dedup(spark, folder)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_groups_over_many_ranges_are_put_together(spark, parts):
    rng = random.Random(13)
    rows = [(k, "hot " + " " * (k % 3) + "copy") for k in range(300)] + [(1000 + k, f"text {rng.randrange(150)}") for k in range(400)] + [(7, "hot copy"), (7, "hot copy"), (2000, " not space"), (2001, "not space")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in exact_dedup.exact_dedup(docs, parts=parts).collect()) == exact_brute(rows)


def test_exact_dedup_stays_out_of_python(spark, odd):
    plan = exact_dedup.sorted_runs(odd, "doc_id", "text", 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("shufflepartitionidpassthrough") >= 1
