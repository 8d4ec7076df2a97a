"""The operators on Python workers that can't import the package."""

from test_shipping import run_without_package


def test_operators(spark, tmp_path):
    docs = [(1, "The MIT License, released under the MIT license", "en", "a"), (2, "der und nicht mit auf sich", "de", "b"), (3, None, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    names = ["op2_neighbours", "op4_language", "op5_bpe", "op6_licenses", "op8_near_duplicates", "op9_lm", "op10_packing", "pipeline"]
    run_without_package(tmp_path, names, tmp_path)
