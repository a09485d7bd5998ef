import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= left
        left = docs.count()
    assert P.STAGES[-1][1](spark, docs, SF).count() == left
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "source_mix"]


def test_odd_rows_pass_each_stage(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
