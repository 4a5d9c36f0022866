from __future__ import annotations

import os

import corpus_pipeline
from test_tokens import check_packed

from tidalframe.llm import classifier, quality_rules, simhash


def test_pipeline_equals_its_stages_one_after_the_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = classifier.fit(docs, classifier.training_labels(labels))
    kept = {r["doc_id"] for r in docs.select("doc_id", classifier.score(docs, model).alias("p")).where("p >= 0.7").collect()}
    left = docs.where(docs.doc_id.isin(list(kept)))
    verdicts = quality_rules.judged(quality_rules.measured(left)).select("doc_id", "rule_verdict.kept").collect()
    kept = {r["doc_id"] for r in verdicts if r["kept"]}
    left = docs.where(docs.doc_id.isin(list(kept)))
    kept = {r["component"] for r in simhash.similar(left.select(left.doc_id.alias("row"), "text")).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    assert 0 < len(texts) < docs.count()
    check_packed(corpus_pipeline.run(spark, sf_dir).collect(), texts)


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name


def test_stages_take_nulls_repeats_and_extra_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clash = docs.selectExpr("*", "1 as row_number", "'x' as words", "2 as score", "3 as component", "'s' as fp")
    first = clash.orderBy("doc_id").limit(1)
    odd = first.selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as long) as n_chars", *clash.columns[len(docs.columns):])
    long = first.selectExpr("777777L as doc_id", "repeat(concat(text, ' '), 3000) as text", *clash.columns[2:])
    rows = clash.select(*clash.columns).union(odd.select(*clash.columns)).union(first).union(first).union(long.select(*clash.columns))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns and 0 < out.count() <= rows.count(), name
    kept = corpus_pipeline.near_dedup(spark, rows, sf_dir)
    assert kept.where(kept.doc_id == first.first()["doc_id"]).count() <= 1
    packed = corpus_pipeline.pack(spark, rows, sf_dir)
    assert packed.where("doc_id is null").count() == 1


def test_run_leaves_only_what_its_result_needs(spark, sf_dir):
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    corpus_pipeline.run(spark, sf_dir)
    left = {name.split("-")[1] for name in set(os.listdir(root)) - before}
    assert left <= {name for name, _ in corpus_pipeline.STAGES}
