"""The pipeline on the small tables, and on tables with odd rows."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F


def test_every_stage_works_on_what_the_one_before_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir).cache()
        assert kept.columns == docs.columns
        assert 0 < kept.count() <= count
        docs, count = kept, kept.count()
    texts = docs.select(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ").alias("t"))
    assert texts.distinct().count() == count
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_take_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "word", None), (None, "word word", "y"), (4, "w " * 20_000, "y")],
        "doc_id bigint, text string, row string").withColumn("text2", F.lit(1)).withColumn("__gone", F.lit(7))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and kept.count() >= 1
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.quality_stage(spark, docs, sf_dir).columns == docs.columns
    assert {r.doc_id for r in corpus_pipeline.packing_stage(spark, docs, sf_dir).collect()} == {1, 2, 3, 4, None}
