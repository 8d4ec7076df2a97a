"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.llm import bpe, crosstok, exact_dedup, fingerprints, importance, langid, licenses, lm, minhash, neighbours, packing, tools, urls


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of conversations as tool calls, linked with their answers, ordered, validated and serialised."""
    calls, results = tools.from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return tools.linked(calls, results, tools.schema_table(spark))


OP1_SQL = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, conv_id || '-' || CASE role WHEN 'user' THEN turn ELSE turn - 1 END AS call_id FROM conversations WHERE role IN ('user', 'assistant')),
c AS (SELECT call_id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, arg_min(text, '{"text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"c') AS text, count(*) AS n FROM m WHERE role = 'user' AND call_id IS NOT NULL GROUP BY call_id),
r AS (SELECT call_id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, min(text) AS content, count(*) AS n FROM m WHERE role = 'assistant' AND call_id IS NOT NULL GROUP BY call_id),
o AS (SELECT call_id, conv_id, turn, 0 AS level FROM c ANTI JOIN c AS b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2
      UNION ALL SELECT c.call_id, c.conv_id, c.turn, o.level + 1 FROM o JOIN c ON c.conv_id = o.conv_id AND c.turn = o.turn + 2),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, c.turn AS turn, call_id, r.turn AS result_turn,
       CASE WHEN c.n IS NULL THEN 'no_call' WHEN r.n IS NULL THEN 'no_result' ELSE 'linked' END AS status,
       o.level AS level, CASE WHEN c.n IS NOT NULL THEN false END AS cyclic,
       CASE WHEN c.n IS NOT NULL THEN c.text IS NOT NULL END AS valid,
       CASE WHEN c.n IS NOT NULL THEN CASE WHEN c.text IS NULL THEN 'missing text' ELSE '' END END AS problems,
       coalesce(c.n, 0) + coalesce(r.n, 0) AS copies,
       '{"arguments":' || CASE WHEN c.n IS NULL THEN 'null' ELSE '{' || CASE WHEN c.turn < 2 THEN '' ELSE '"after":"' || c.conv_id || '-' || (c.turn - 2) || '",' END || '"chars":' || coalesce(length(c.text), 0)
         || ',"place":{"conv":' || c.conv_id || ',"turn":' || c.turn || '},"text":' || coalesce(to_json(c.text)::VARCHAR, 'null') || '}' END
       || ',"id":' || to_json(call_id)::VARCHAR || ',"name":' || CASE WHEN c.n IS NULL THEN 'null' WHEN c.turn < 2 THEN '"ask"' ELSE '"follow_up"' END || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS json
  FROM c FULL JOIN r USING (call_id) LEFT JOIN o USING (call_id))
SELECT * FROM j
UNION ALL
SELECT conv_id, CASE role WHEN 'user' THEN turn END, NULL, CASE role WHEN 'assistant' THEN turn END, 'no_id', NULL, NULL, NULL, NULL, 1, NULL FROM m WHERE call_id IS NULL
"""


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every twentieth, by a forest of random-projection trees."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful streaming deduplication of all documents."""
    return exact_dedup.decided(documents(spark, sf_dir))


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(content) AS text_sha256
FROM d WINDOW w AS (PARTITION BY content ORDER BY doc_id NULLS LAST)
"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by error-correcting output codes."""
    docs = documents(spark, sf_dir)
    out = langid.identified(docs)
    return out.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(langid.fold(docs, 4) == 2, F.lit(False)).alias("held_out"),
        F.col("_language.lang_pred").alias("lang_pred"),
        F.col("_language.score").alias("score"),
        F.col("_language.ambiguous").alias("ambiguous"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text by forced boundaries, then decode; digests of both."""
    out = bpe.encoded(documents(spark, sf_dir), decode=True)
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in all documents."""
    return licenses.scanned(documents(spark, sf_dir))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL."""
    return urls.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents by HyperMinHash."""
    return minhash.linked(documents(spark, sf_dir))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * same >= 75 * (p.n_shingles + q.n_shingles - same)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-probability of every document by a backoff automaton."""
    return lm.scored(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents by power-of-two decomposition."""
    return packing_digest(packing.packed(documents(spark, sf_dir)))


def packing_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned over the bytes of every document."""
    return crosstok.linked(documents(spark, sf_dir))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text and of the next document."""
    return fingerprints.neighbours(documents(spark, sf_dir))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampling of all documents towards the benchmark's words."""
    out = importance.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: A word's CRC-32 by its bytes, one bit at a time; distinct words only, as this is slow in SQL.
OP13_SQL = """
WITH w AS (
  SELECT doc_id, true AS corpus, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL SELECT NULL, false, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
d AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM w),
b AS (SELECT word, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM d),
c AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x:
        list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295) % 10000 AS bucket FROM b),
f AS (SELECT w.doc_id, w.corpus, c.bucket FROM w JOIN c USING (word)),
n AS (SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM f GROUP BY bucket),
t AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM n),
g AS (SELECT bucket, floor(1000 * ln((n.t + 1)::DOUBLE * (t.s + 10000) / ((n.s + 1)::DOUBLE * (t.t + 10000))))::BIGINT AS gain FROM n, t),
x AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE corpus GROUP BY doc_id),
y AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM documents LEFT JOIN x USING (doc_id)),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.*, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM y LEFT JOIN z USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_tool_links": op1_tool_links, "op2_neighbours": op2_neighbours, "op3_exact_dedup": op3_exact_dedup, "op4_language": op4_language, "op5_bpe": op5_bpe, "op6_licenses": op6_licenses, "op7_urls": op7_urls, "op8_near_duplicates": op8_near_duplicates, "op9_lm": op9_lm, "op10_packing": op10_packing, "op11_alignment": op11_alignment, "op12_fingerprints": op12_fingerprints, "op13_importance": op13_importance}


def oracle_sql() -> dict[str, str]:
    return {"op1_tool_links": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op8_near_duplicates": OP8_SQL, "op13_importance": OP13_SQL}
