"""Training samples with very long labelled texts, and pipeline stages over columns of any type."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plazaflow.llm import common, langid, neardup, quality, toxicity

from ..conftest import SMALL

LENGTH = 20_000_000


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    one = docs.orderBy("doc_id").first()
    # a text of the table, over and over, so that what the corpus counts say stays as it is
    text = (one.text + "\n") * (LENGTH // (len(one.text) + 1) + 1)
    more = spark.createDataFrame([(10**6 + k, text[k:], one.lang, one.source, len(text) - k) for k in range(2)], docs.schema)
    marks = spark.createDataFrame([(10**6, 0, 0), (10**6 + 1, 1, 1)], labels.schema)
    return docs, labels, docs.unionByName(more), labels.unionByName(marks)


def every():
    return F.lit(True)


def scores(df):
    return {r.doc_id: r.score for r in df.where("doc_id < 1000000").collect()}


def test_toxicity_with_a_long_labelled_text(spark, tables):
    docs, labels, more_docs, more_labels = tables
    before = scores(toxicity.toxicity(docs, toxicity.fit(docs, labels, every())))
    model = toxicity.fit(more_docs, more_labels, every())
    after = scores(toxicity.toxicity(docs, model))
    assert len(set(before.values())) > 10 and max(abs(before[k] - after[k]) for k in before) < 0.05
    assert toxicity.without_toxic(docs, model).count() < docs.count()


def test_language_with_a_long_text(spark, tables):
    docs, _, more_docs, _ = tables
    before, after = (scores(langid.languages(d, every())) for d in (docs, more_docs))
    assert before.keys() == after.keys() and max(abs(before[k] - after[k]) for k in before) < 0.05


def test_quality_with_a_long_labelled_text(spark, tables):
    docs, labels, more_docs, more_labels = tables
    before, after = scores(quality.quality(docs, labels, every())), scores(quality.quality(more_docs, more_labels, every()))
    # the long texts are in the corpus' word counts, two hundred times the rest, so scores move; what they decide doesn't
    moved, turned = [abs(before[k] - after[k]) for k in before], [k for k in before if (before[k] >= 0.5) != (after[k] >= 0.5)]
    assert before.keys() == after.keys() and sum(moved) / len(moved) < 0.05 and len(turned) <= len(before) // 50


def test_bounded_texts_leave_out_only_what_does_not_fit(spark):
    rows = [(k, "x" * (900 if k % 10 == 0 else 10), k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label long")
    got = common.bounded_texts(df, 1000, part=4)
    assert {r[0] for r in got} == {k for k in range(40) if k % 10}
    got = common.bounded_texts(df, 200, part=1)
    assert [sum(len(t) for _, t, label in got if label == x) for x in (0, 1)] == [100, 100]
    long = spark.createDataFrame([(k, "x" * (60 + k), k % 2) for k in range(6)], "doc_id long, text string, label long")
    assert [r[0] for r in common.bounded_texts(long, 200)] == [0, 1]
    assert common.bounded_texts(long, 20) == [] and common.bounded_texts(long.where("false"), 100) == []


def test_near_dedup_over_columns_of_any_type(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text), (2, text), (2, text), (3, "another text of some words that nobody else here has at all"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "map('a', doc_id) AS m", "array(map(1, text)) AS am", "struct(map('k', 1) AS inner) AS s", "array(doc_id) AS key", "binary(text) AS bytes", "make_dt_interval(1) AS span", "parse_json('{\"a\": 1}') AS v"
    )
    got = neardup.one_of_each_group(df)
    assert got.columns == df.columns and sorted((str(r.doc_id), str(r.m)) for r in got.collect()) == [("1", "{'a': 1}"), ("3", "{'a': 3}"), ("None", "{'a': None}")]


def test_pipeline_over_empty_tables(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").where("false").write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_failed_stage_leaves_no_files(spark, monkeypatch):
    def broken(*_):
        raise ValueError("a stage failed")

    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", lambda s, d, _: d.limit(1)), ("second", broken), ("third", broken)])
    with pytest.raises(ValueError, match="a stage failed"):
        corpus_pipeline.run(spark, SMALL)
    assert not [f for f in set(os.listdir(folder)) - before if f.startswith("pipeline")]
