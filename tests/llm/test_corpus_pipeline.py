from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "ngram_join", "packing"]
    kept = docs.withColumn("n", F.lit(1))  # a column that clashes with names inside
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == [*docs.columns, "n"]
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    assert kept.select("text").distinct().count() == sizes[-1]
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_labels_are_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    left = corpus_pipeline.quality_stage(spark, docs, sf).select("doc_id")
    clean = labels.where("quality = 1")
    assert clean.join(left, "doc_id").count() >= 0.97 * clean.count()
