"""The pipeline's stages on a small table, each judged on its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_operators import CLASHES, ODD, assert_plan_is_raked, check_packing, jaccard_brute, line_brute
from weft.llm import mixing, quality_rules
from weft.session import stored, table


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in pipeline.STAGES:
        after = stored(stage(spark, docs, sf_dir), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_all_but_the_last_return_documents(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_rules_reject_what_the_operator_rejects(stages):
    _, before, after = stages[0]
    kept = {r["doc_id"] for r in quality_rules.quality_rules(before).filter("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept


def test_lines_are_deleted_as_by_brute_force(stages):
    _, before, after = stages[1]
    want = {k: t for k, n, gone, t in line_brute([(r["doc_id"], r["text"]) for r in before.collect()], 3) if not gone or gone < n}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert after.filter("n_chars <> length(text)").count() == before.filter("n_chars <> length(text)").join(after, "doc_id").count()


def test_one_document_of_each_class_stays(stages):
    _, before, after = stages[2]
    classes = jaccard_brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {c for c, _ in classes.values()}


def test_mixing_keeps_what_its_draw_keeps(stages):
    _, before, after = stages[3]
    assert_plan_is_raked(before, mixing.plan(before), mixing.KEEP_SHARE)
    kept = [(r["doc_id"]) for r in mixing.mix(before).filter("kept").collect()]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    got = after.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(kept) and all(texts[r["doc_id"]] == r["text"] for r in got)


def test_last_stage_packs_what_is_left(stages):
    _, before, after = stages[4]
    check_packing(before, after.toPandas())


def test_stages_take_odd_rows(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in CLASHES})
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= len(ODD)
