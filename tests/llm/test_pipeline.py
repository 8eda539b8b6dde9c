"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from tessera.llm.common import written


def test_stages_hand_on_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now and now <= ids
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(packed.doc_id) == ids and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_with_nulls_repeated_rows_and_extra_columns(spark, tmp_path):
    text = "this is the first of the documents and it is about the sea and the wind in the night of that year "
    other = "for the one who was with them on that day it is not the same and the rest was said by this man at his house "
    rows = [(1, text, "en", "s1", 5), (1, text, "en", "s1", 5), (2, text, None, None, None), (3, None, "en", "s2", 0), (None, other, "fr", "s3", 9), (4, "", "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).selectExpr("*", "1 AS rank", "2 AS _row", "3 AS junk", "4 AS _tokens").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got.doc_id.fillna(-1)) <= {-1, 2} and 2 in set(got.doc_id)
