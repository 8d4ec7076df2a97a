"""The pipeline against its brute-force version."""

import corpus_pipeline
from tallyvox.llm import langid


def test_stages_keep_what_they_should(spark, tmp_path):
    words = "the of and that with from have this which their would there about could other into than its only some".split()
    text = lambda i: " ".join(words[(i * j + j // 3) % len(words)] + ("s" if j % (i + 2) == 0 else "") for j in range(60))
    rows = [(i, text(i), "en") for i in range(8)] + [(20, text(1), "en"), (21, text(2) + " end", "en"), (22, "123 ...", None), (23, None, None), (24, text(3).replace(" ", "  "), "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'s' AS source", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == {r[0] for r in rows if langid.has_letter(r[1])}
    assert kept[1] == kept[0] - {20, 24} and kept[2] == kept[1] - {21}
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == kept[2]


def test_language_stage_drops_texts_of_no_learned_language(spark):
    words = {"en": "the of and that with from have this", "de": "der und nicht mit auf sich eine ist", "es": "los del que una por con para como"}
    rows = [(i, " ".join(words[lang].split()[(i + i * j) % 8] for j in range(40)), lang) for i, lang in enumerate(list(words) * 20)]
    clean = [(100 + i, text, None) for i, text in enumerate(("the", "und", "This.", "para que", "with the", "nicht mit"))]
    odd = ("Съешь же ещё этих мягких французских булок", "我们今天去北京看朋友们", "Η γρήγορη καφέ αλεπού πηδάει", "xkcdqz vbnmpt wrtpsd zxcvbn qwrtpk", "bG9yZW0gaXBzdW0gZG9sb3Igc2l0IGFtZXQK")
    docs = spark.createDataFrame(rows + clean + [(200 + i, text, None) for i, text in enumerate(odd)], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == {r[0] for r in rows + clean}
