import corpus_pipeline
from rastermill.llm import queries


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert kept.columns == docs.columns
            assert kept.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
        seen.append(kept.select("doc_id").distinct().count())
        docs = kept
    assert seen == sorted(seen, reverse=True) and seen[2] == seen[3] == seen[4] > 100
    leaked = {r["doc_id"] for r in queries.op5_decontamination(spark, sf).collect()}
    assert leaked.isdisjoint(r["doc_id"] for r in docs.select("doc_id").collect())


def test_odd_rows_pass(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_id int, rid int"
    rows = [(1, None, "en", None, 0, 1, 1), (2, "", None, "s", None, 1, 1), (3, "write to a@b.com now", "en", "s", 20, 1, 1), (3, "write to a@b.com now", "en", "s", 20, 1, 1)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name, columns in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2, 3]
    masked = corpus_pipeline.mask_personal_data(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in masked} == {(1, None, 0), (2, "", 0), (3, "write to [email] now", 20)}
