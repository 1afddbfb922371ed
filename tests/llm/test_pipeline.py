from __future__ import annotations

import corpus_pipeline

from arborist.llm import near_dedup, pii, quality_rules
from arborist.llm.spark_io import stored

from .conftest import SCHEMA, rows
from .test_operators import check_pieces, components


def test_stages_take_effect_and_keep_the_rest(spark, docs):
    before = {r[0]: r[1] for r in rows() if r[0] is not None}
    at, seen = docs.where("doc_id is not null"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stored(stage(spark, at, ""), name)
        assert tuple(at.columns) == corpus_pipeline.COLUMNS
        seen.append({r.doc_id: r.text for r in at.collect()})
    lang, quality, near, clean = seen
    assert set(before) - set(lang) == {200, 201, 202, 204}
    assert {203, 205, 206}.isdisjoint(quality) and len([i for i in quality if i < 60]) >= 57
    classes = components(list(quality.items()))
    assert set(near) == set(classes.values())
    assert "<EMAIL>" in clean[207] if 207 in clean else 207 not in near
    assert set(clean) == set(near)
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, at, "").collect(), list(clean.items()))


def test_stages_judge_rows_whose_ids_are_null_or_recur(spark):
    good = [r for r in rows() if r[0] is not None and r[0] < 60]
    a, b, c = (good.pop(0)[1] for _ in range(3))
    more = [(None, a), (None, b), (7000, c), (7000, "12 34 !!"), (7001, "x"), (7001, b), (8000, c), (8000, c)]
    lang = {a: "en", b: "fr", c: "de"}
    df = spark.createDataFrame([(i + 100, *r[1:]) for i, r in enumerate(good)] + [(i, t, lang.get(t, "en"), "s0", len(t)) for i, t in more], SCHEMA)

    def left(stage):
        return sorted(((r.doc_id, r.text) for r in stage(spark, df, "").collect() if r.doc_id is None or r.doc_id >= 7000), key=str)

    assert left(corpus_pipeline.by_language) == sorted((x for x in more if x[1] != "12 34 !!"), key=str)
    assert left(corpus_pipeline.by_quality) == sorted((x for x in more if len(x[1]) > 20), key=str)
    assert left(corpus_pipeline.by_nearness) == sorted([(None, a), (7001, b), (7000, c), (7000, "12 34 !!"), (7001, "x")], key=str)


def test_stages_with_clashing_names_and_empty_tables(spark, docs, clashing, empty):
    more = clashing.selectExpr("*", "1 as DOC_ID", "2 as Lang", "'x' as Source")
    for _, stage in corpus_pipeline.STAGES:
        assert sorted(map(str, stage(spark, more, "").drop("sequence_id", "offset").collect())) == sorted(map(str, stage(spark, docs, "").drop("sequence_id", "offset").collect()))
        assert stage(spark, empty, "").count() == 0


def test_run_needs_only_documents(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert near_dedup and pii and quality_rules and corpus_pipeline.ORACLE_SQL is None
