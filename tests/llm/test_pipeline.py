import corpus_pipeline


def test_stages_keep_the_columns_and_the_numbers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    assert 50 < out.count() < 3 * docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
