"""The registered queries over the reference's own operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyvox.functions import phonetic
from tallyvox.functions import text as T
from tallyvox.functions.phonetic import encoder_for
from tallyvox.functions.plain import normalised
from tallyvox.operators import alignment, evaluation, fuzzy, lexicon, matching, slots, speech
from tallyvox.plans import fixtures
from tallyvox.settings import Settings
from tallyvox.sources import reports, tickets
from tallyvox.streaming import alignment as streams
from tallyvox.tables import new_path, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL twin if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple], *names: str) -> str:
    """Literal rows as SQL."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_of(text):
    """Characters beyond ASCII as one sign each, so that both engines count alike."""
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "~")


ASCII_SQL = "regexp_replace({}, '[^\\x00-\\x7F]', '~', 'g')"
STRIP_SQL = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x1C-\\x1F\\v，。、；：？！“”‘’（）《》〈〉【】〔〕…—～·,.;:?!\"''()\\[\\]{}<>/\\\\|`~@#$%^&*_+=\\-]+"

# --- text --------------------------------------------------------------------


@query(f"SELECT doc_id, md5(n) AS norm_md5, length(n) AS norm_chars FROM (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '{STRIP_SQL}', '', 'g')) AS n FROM documents)")
def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1-SC7 over all documents."""
    n = table(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("n"))
    return n.select("doc_id", F.md5("n").alias("norm_md5"), F.length("n").cast("bigint").alias("norm_chars"))


@query(values([(k, v) for k, v in fixtures.NORMAL.items()], "written", "norm"))
def text_normal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals, units and Roman numbers against fixed expectations."""
    pairs = spark.createDataFrame([(k,) for k in fixtures.NORMAL], "written string")
    return pairs.select("written", T.normalise(F.col("written")).alias("norm"))


@query("SELECT page_id, md5(trim(regexp_replace(replace(replace(html, '<', '<|'), '>', '|>'), '<\\|[^|]*\\|>', '', 'g'), E' \\t\\n\\r')) AS plain_md5 FROM pages")
def text_without_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC8 over all pages, their markup turned into recogniser tags."""
    marked = F.replace(F.replace("html", F.lit("<"), F.lit("<|")), F.lit(">"), F.lit("|>"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.without_tags(marked)).alias("plain_md5"))


@query("SELECT doc_id, list_aggregate(regexp_extract_all(text, '[0-9]+'), 'string_agg', '') AS digits, len(regexp_extract_all(text, '[0-9]+')) AS n_groups, md5(regexp_replace(text, '[0-9]+', '', 'g')) AS skeleton_md5 FROM documents".replace("list_aggregate(regexp_extract_all(text, '[0-9]+'), 'string_agg', '')", "coalesce(array_to_string(regexp_extract_all(text, '[0-9]+'), ''), '')"))
def text_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC20, SC21 over all documents."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.digits(t).alias("digits"), F.size(T.digit_groups(t)).cast("bigint").alias("n_groups"), F.md5(T.skeleton(t)).alias("skeleton_md5"))


@query("SELECT doc_id, md5(replace(replace(text, '|', '\\|'), chr(10), ' ')) AS cell_md5 FROM documents")
def text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2 over all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.escaped_cell(F.col("text"))).alias("cell_md5"))


@query("SELECT DISTINCT source, trim(regexp_replace(source, '\\s+', ' ', 'g'), ' ,.;\"''') AS term FROM documents")
def text_clean_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC22 over all sources."""
    return table(spark, sf_dir, "documents").select("source", T.clean_term(F.col("source")).alias("term")).distinct()


# --- matching ----------------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as recordings: a user's turns are the items, an assistant's the utterances; of repeated turns the smallest text."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    norm = lambda: F.lower(ascii_of("text"))
    items = t.filter("role = 'user'").select(F.col("conv_id").alias("ticket_id"), F.col("turn").alias("pos"), norm().alias("norm"))
    said = t.filter("role = 'assistant'").select(F.col("conv_id").alias("ticket_id"), F.col("turn").alias("idx"), norm().alias("heard"))
    return items, said


TURNS_SQL = f"""
t AS (SELECT conv_id AS ticket_id, turn, role, lower({ASCII_SQL.format('min(text)')}) AS norm FROM conversations GROUP BY conv_id, turn, role),
i AS (SELECT ticket_id, turn AS pos, norm FROM t WHERE role = 'user'),
u AS (SELECT ticket_id, turn AS idx, norm AS heard FROM t WHERE role = 'assistant')"""


@query(f"""WITH {TURNS_SQL},
p AS (SELECT ticket_id, idx, pos, round(greatest(0.0, 1.0 - levenshtein(norm, heard) / greatest(length(norm), length(heard), 1)), 6) AS score
      FROM u JOIN i USING (ticket_id) WHERE pos BETWEEN idx - 2 AND idx + 2)
SELECT ticket_id, idx, arg_max(pos, (score, -pos)) AS pos, max(score) AS score, max(score) < 0.45 AS chatter FROM p GROUP BY ticket_id, idx""")
def match_best_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, JN2, TK1, FLT4: each utterance against the items near its place, the best one, ties to the lowest position."""
    items, said = turns(spark, sf_dir)
    pairs = matching.band_candidates(said.withColumn("pointer", F.col("idx")), items, Settings(lookback=2, lookahead=2))
    longest = F.greatest(F.length("norm"), F.length("heard"), F.lit(1))
    scored = pairs.withColumn("score", F.round(F.greatest(F.lit(0.0), 1.0 - F.levenshtein("norm", "heard") / longest), 6))
    return matching.best_per_utterance(scored, ["ticket_id", "idx"]).select("ticket_id", "idx", "pos", "score", (F.col("score") < 0.45).alias("chatter"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_best_in_window(spark, sf_dir)


@query(f"WITH {TURNS_SQL} SELECT i.ticket_id, i.pos FROM i ANTI JOIN u ON u.ticket_id = i.ticket_id AND u.idx = i.pos + 1")
def match_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12: items without an utterance right after."""
    items, said = turns(spark, sf_dir)
    return items.select("ticket_id", "pos").join(said.select("ticket_id", (F.col("idx") - 1).alias("pos")), ["ticket_id", "pos"], "left_anti")


def matcher(spark: SparkSession) -> matching.Matcher:
    return matching.Matcher(slots.Extractor(normalised), encoder_for(spark))


SAID = [
    (2, "将测控屏110kV桥100开关操作方式把手由就地切至远方位置", "FAIL"),
    (4, "检查测控屏110kV桥100开关机械位置指示确已拉开", "FAIL"),
    (4, "检查测控屏一百一十千伏桥一百开关电气位置指示确已拉开", "PASS"),
    (3, "拉开幺幺零千伏桥幺零零开关", "PASS"),
    (3, "桥100开关", "REVIEW"),
    (3, "拉开110kV桥200开关", "FAIL"),
    *((i + 1, text, "PASS") for i, text in enumerate(fixtures.TICKET)),
]


@query(values([(seq, text, verdict) for seq, text, verdict in SAID], "seq", "said", "verdict"))
def match_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX1, SC9-SC15, MT1-MT5 against fixed expectations."""
    said = spark.createDataFrame([(s, t) for s, t, _ in SAID], "seq int, said string").withColumn("heard", T.normalise(F.col("said")))
    pairs = said.join(fixtures.ticket_items(spark), "seq")
    return matching.scored_pairs(pairs, matcher(spark)).select("seq", "said", F.col("match.verdict").alias("verdict"))


SLOTS_OF_TWO = [("panel", "测控屏"), ("voltage", "110kv"), ("device", "桥100开关"), ("handle", "操作方式把手"), ("action", "切至"), ("src_position", "远方"), ("dst_position", "就地")]


@query(values([(i, n, v) for i, (n, v) in enumerate(SLOTS_OF_TWO)], "place", "name", "value"))
def slots_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX1, TK4: the second item of the sample ticket."""
    found = slots.with_slots(fixtures.ticket_items(spark).filter("seq = 2"), slots.Extractor(normalised))
    return found.select(F.posexplode("slots").alias("place", "s")).select("place", "s.name", "s.value")


def long_words(spark: SparkSession, sf_dir: str) -> list[str]:
    """The assets of the sample: words of six letters and more of the benchmark, at most MOST_ASSETS of them."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{6,}"), F.lit(0))).alias("word")).distinct()
    found = [r.word for r in words.limit(MOST_ASSETS + 1).collect()]
    if len(found) > MOST_ASSETS:
        raise ValueError("too many assets for one trie")
    return found


MOST_ASSETS = 100_000  # of one trie, which goes to all tasks


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{6,}')) AS word FROM benchmark)
SELECT word, count(*) AS texts, sum((length(text) - length(replace(text, word, ''))) // length(word))::BIGINT AS places FROM documents, w WHERE contains(text, word) GROUP BY word""")
def asset_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX1, TK2, SRC8: the benchmark's long words as assets, found in all documents in one pass."""
    found = slots.occurrences(table(spark, sf_dir, "documents"), long_words(spark, sf_dir), "doc_id")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("places"))


STEPS = [(fixtures.TICKET[0], "CALLER", "VERIFIED", 1, 1), (fixtures.TICKET[0], "OPERATOR", "REPEAT", 1, 1), ("今天天气真好啊", "OPERATOR", "CHATTER", None, 1), (fixtures.TICKET[2], "OPERATOR", "SKIP_WARNING", 3, 3), ("拉开110kV桥200开关", "OPERATOR", "FAILED", 3, 3), (fixtures.TICKET[2], "OPERATOR", "REPEAT", 3, 3), (fixtures.TICKET[3], "CALLER", "VERIFIED", 4, 4)]


def sample_rows(spark: SparkSession) -> DataFrame:
    said = fixtures.utterances(spark, [(t, r) for t, r, *_ in STEPS])
    return alignment.prepared(said, fixtures.ticket_items(spark), matcher(spark))


@query(values([(i, k, s, p) for i, (_, _, k, s, p) in enumerate(STEPS)], "idx", "kind", "seq", "pointer"))
def align_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGN1-AGN3 against fixed expectations."""
    return alignment.aligned(sample_rows(spark)).select("idx", "kind", "seq", "pointer")


@query(values([(1, "VERIFIED"), (2, "UNCONFIRMED"), (3, "VERIFIED"), (4, "VERIFIED"), *((s, "UNCONFIRMED") for s in range(5, 10))], "seq", "state"))
def align_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGN4: the items' final states."""
    return alignment.item_states(sample_rows(spark)).select("seq", "state")


#: The fold as a recursion: k utterances taken, the pointer, the items' states, and the event of the last one.
FOLD_SQL = f"""
{TURNS_SQL},
l AS (SELECT ticket_id, list(pos + 1 ORDER BY pos) AS seqs, list(norm ORDER BY pos) AS norms, count(*)::INT AS n FROM i GROUP BY ticket_id),
s AS (SELECT ticket_id, seqs, n, idx, heard, row_number() OVER (PARTITION BY ticket_id ORDER BY idx) AS k,
        list_transform(norms, lambda x: greatest(0.0, 1.0 - levenshtein(x, heard) / greatest(length(x), length(heard), 1))) AS scores FROM l JOIN u USING (ticket_id)),
f AS (SELECT ticket_id, 0::BIGINT AS k, 0 AS pointer, list_transform(seqs, lambda x: 'PENDING') AS states, -1::BIGINT AS idx, ''::VARCHAR AS kind, NULL::INT AS seq, NULL::DOUBLE AS score FROM l
  UNION ALL
  SELECT ticket_id, k, CASE WHEN place IS NULL OR st IN ('VERIFIED', 'FLAGGED') THEN pointer ELSE place::INT END,
    CASE WHEN place IS NULL THEN states ELSE list_transform(states, lambda x, j: CASE WHEN j = place THEN CASE WHEN best >= 0.82 OR st = 'VERIFIED' THEN 'VERIFIED' ELSE 'FLAGGED' END
      WHEN st NOT IN ('VERIFIED', 'FLAGGED') AND j > pointer AND j < place AND x = 'PENDING' THEN 'UNCONFIRMED' ELSE x END) END,
    idx, CASE WHEN place IS NULL THEN 'CHATTER' WHEN st IN ('VERIFIED', 'FLAGGED') THEN 'REPEAT' WHEN len(list_filter(states[pointer + 1:place - 1], lambda x: x = 'PENDING')) > 0 THEN 'SKIP_WARNING' WHEN best >= 0.82 THEN 'VERIFIED' ELSE 'FLAGGED' END,
    CASE WHEN place IS NOT NULL THEN seqs[place]::INT END, best
  FROM (SELECT *, states[place] AS st FROM (SELECT *, CASE WHEN best >= 0.2 THEN greatest(1, pointer) + list_position(near, best) - 1 END AS place FROM (SELECT *, list_max(near) AS best FROM (
    SELECT s.*, f.pointer, f.states, CASE WHEN trim(heard) <> '' THEN scores[greatest(1, f.pointer):least(n, f.pointer + 3)] END AS near FROM f JOIN s ON s.ticket_id = f.ticket_id AND s.k = f.k + 1)))))"""


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as rows for the alignment: assistant turns against user turns, scored by edit distance."""
    items, said = turns(spark, sf_dir)
    items = items.select(F.col("ticket_id").cast("string"), (F.col("pos") + 1).cast("int").alias("seq"), F.row_number().over(Window.partitionBy("ticket_id").orderBy("pos")).alias("pos"), "norm").withColumn("pos", F.col("pos") - 1)
    said = said.select(F.col("ticket_id").cast("string"), "idx", F.lit("OPERATOR").alias("role"), F.col("heard").alias("text"), "heard")
    pairs = matching.candidates(said, items)
    longest = F.greatest(F.length("norm"), F.length("heard"), F.lit(1))
    score = F.greatest(F.lit(0.0), 1.0 - F.levenshtein("norm", "heard") / longest)
    none = F.array().cast("array<string>")
    verdict = F.when(F.col("score") >= 0.82, "PASS").otherwise("REVIEW")
    one = F.struct("pos", "score", verdict.alias("verdict"), none.alias("reasons"), none.alias("conflicts"))
    matches = pairs.withColumn("score", score).groupBy("ticket_id", "idx").agg(F.array_sort(F.collect_list(one)).alias("matches"))
    listed = items.groupBy("ticket_id").agg(F.array_sort(F.collect_list(F.struct("pos", "seq"))).alias("items"))
    return listed.join(said.join(matches, ["ticket_id", "idx"], "left"), "ticket_id", "left")


@query(f"WITH RECURSIVE {FOLD_SQL} SELECT ticket_id::VARCHAR AS ticket_id, idx, kind, seq, round(score, 6) AS score, pointer FROM f WHERE k > 0")
def align_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGN1 over all conversations: assistant turns aligned with user turns."""
    return alignment.aligned(conversation_rows(spark, sf_dir), Settings(chatter=0.2)).select("ticket_id", "idx", "kind", "seq", F.round("score", 6).alias("score"), "pointer")


@query(f"""WITH RECURSIVE {FOLD_SQL},
e AS (SELECT ticket_id, pointer, idx, unnest(states) AS state, unnest(seqs)::INT AS seq FROM f JOIN l USING (ticket_id) QUALIFY k = max(k) OVER (PARTITION BY ticket_id))
SELECT ticket_id::VARCHAR AS ticket_id, idx, kind, seq, round(score, 6) AS score, pointer FROM f WHERE k > 0
UNION ALL SELECT ticket_id::VARCHAR, idx + 1, 'UNCONFIRMED', seq, NULL, pointer FROM e WHERE state = 'PENDING'""")
def align_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGN1, AGN4 as a stream over all conversations, in three deliveries: the first turns, the rest after a restart from the checkpoint, and a heartbeat
    whose event time lets timers finish all conversations."""
    rows = conversation_rows(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("idx") + 1))
    whole = written(spark, rows, "stream-rows")
    late = F.coalesce(F.col("idx"), F.lit(0)) >= 3
    beat = spark.range(1).select(F.lit("heartbeat").alias("ticket_id"), F.lit(0).cast("bigint").alias("idx"), F.timestamp_seconds(F.lit(1 << 33)).alias("at"))
    beat = whole.limit(0).unionByName(beat, allowMissingColumns=True).withColumn("items", F.coalesce("items", F.array().cast(whole.schema["items"].dataType)))
    source, out, check = (new_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    for delivery in (whole.filter(~late), whole.filter(late), beat):
        delivery.write.mode("append").parquet(source)
        arriving = spark.readStream.schema(whole.schema).parquet(source).withWatermark("at", "0 seconds")
        events = streams.aligned_stream(arriving, Settings(chatter=0.2), idle_ms=3_600_000, clock="at")
        events.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(alignment.EVENTS).parquet(out).filter("ticket_id <> 'heartbeat'")
    return found.select("ticket_id", "idx", "kind", "seq", F.round("score", 6).alias("score"), "pointer")


WORD_PAIRS_SQL = f"""{TURNS_SQL},
q AS (SELECT DISTINCT unnest(regexp_extract_all(norm, '[a-z]{{12,}}')) AS needle FROM i)"""


@query(f"""WITH {TURNS_SQL}
SELECT ticket_id, idx, pos, round(greatest(0.0, 1.0 - levenshtein(norm, heard) / greatest(length(norm), length(heard), 1)), 6) AS similarity FROM u JOIN i USING (ticket_id)""")
def phonetic_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC13, SC14 over all conversations: each answer against each question, where every character is its own reading."""
    items, said = turns(spark, sf_dir)
    scored = phonetic.similarities(matching.candidates(said, items), phonetic.Encoder({}, phonetic.Dialect({}), {}), "norm", "heard")
    return scored.select("ticket_id", "idx", "pos", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {WORD_PAIRS_SQL},
h AS (SELECT ticket_id, idx, heard, unnest(range(1, length(heard) + 1)) AS place FROM u),
w AS (SELECT DISTINCT length(needle) AS n FROM q),
g AS (SELECT DISTINCT n, substr(heard, place::BIGINT, size::BIGINT) AS part FROM (SELECT heard, place, n, unnest(range(n - n // 4, n + n // 4 + 1)) AS size FROM h, w) WHERE place + size - 1 <= length(heard)),
s AS (SELECT needle, part, levenshtein(needle, part) AS d FROM q JOIN g ON g.n = length(needle) WHERE levenshtein(needle, part) <= length(needle) // 4),
x AS (SELECT ticket_id, idx, needle, min(d) AS d FROM s JOIN u ON contains(heard, part) GROUP BY ALL)
SELECT ticket_id, idx, needle, round(1.0 - d / length(needle), 6) AS similarity FROM x""")
def fuzzy_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4, SC15: every word of twelve letters and more in any question against every answer of all conversations."""
    items, said = turns(spark, sf_dir)
    needles = items.select(F.explode(F.regexp_extract_all("norm", F.lit("[a-z]{12,}"), F.lit(0))).alias("needle"))
    texts = said.select(F.struct("ticket_id", "idx").alias("at"), F.col("heard").alias("text"))
    found = fuzzy.contained(texts, needles, phonetic.Encoder({}, phonetic.Dialect({}), {}), "at")
    return found.select("at.ticket_id", "at.idx", "needle", F.round("similarity", 6).alias("similarity"))


# --- speech ------------------------------------------------------------------


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as energies: a user's are one recording, in order of time."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("recording"), F.col("event_id").alias("idx"), "ts", F.col("value").alias("rms"))


BANDS_SQL = """
b AS (SELECT user_id AS recording, event_id AS idx, ts, value AS rms, median(CASE WHEN value > 0 THEN value END) OVER (PARTITION BY user_id) AS m FROM events),
r AS (SELECT *, coalesce(rms / m, 0.0) AS ratio FROM b),
c AS (SELECT *, CASE WHEN m IS NULL THEN 'UNKNOWN' WHEN ratio >= 1.6 THEN 'OPERATOR' WHEN ratio <= 1.0/1.6 THEN 'CALLER' ELSE 'UNKNOWN' END AS role,
  CASE WHEN m IS NULL THEN 0.0 WHEN ratio >= 1.6 THEN least(1.0, (ratio - 1.6) / 1.6 + 0.6) WHEN ratio <= 1.0/1.6 THEN least(1.0, (1.0/1.6 - ratio) * 1.6 + 0.6) ELSE 0.3 END AS confidence FROM r)"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select("recording", "idx", F.round("ratio", 6).alias("ratio"), "role", F.round("confidence", 6).alias("confidence"), "source")


@query(f"WITH {BANDS_SQL} SELECT recording, idx, round(ratio, 6) AS ratio, role, round(confidence, 6) AS confidence, 'energy' AS source FROM c")
def role_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN1, AG7 over all events."""
    return rounded(speech.role_bands(energies(spark, sf_dir)))


@query(f"""WITH {BANDS_SQL},
k AS (SELECT *, last_value(CASE WHEN role <> 'UNKNOWN' THEN role END IGNORE NULLS) OVER (PARTITION BY recording ORDER BY ts, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
f AS (SELECT *, role = 'UNKNOWN' AND before IS NOT NULL AS filled, CASE WHEN role = 'UNKNOWN' AND before IS NOT NULL THEN CASE WHEN ratio > 1.0 THEN 'OPERATOR' ELSE 'CALLER' END ELSE role END AS final FROM k),
l AS (SELECT *, final <> lag(final) OVER (PARTITION BY recording ORDER BY ts, idx) AS turn FROM f)
SELECT recording, idx, round(ratio, 6) AS ratio, final AS role, round(CASE WHEN filled THEN CASE WHEN turn THEN 0.55 ELSE 0.35 END ELSE confidence END, 6) AS confidence,
  CASE WHEN filled THEN CASE WHEN turn THEN 'prior' ELSE 'energy-lean' END ELSE 'energy' END AS source FROM l""")
def role_temporal_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN3 after WN1 over all events."""
    return rounded(speech.temporal_prior(speech.role_bands(energies(spark, sf_dir)), order=("ts", "idx")))


@query("""WITH e AS (SELECT user_id AS recording, event_id AS idx, ts, value AS rms, value > 0 AS voiced FROM events),
v AS (SELECT recording, idx, ts, row_number() OVER w AS n, median(rms) OVER (PARTITION BY recording ORDER BY ts, idx ROWS BETWEEN 127 PRECEDING AND CURRENT ROW) AS m FROM e WHERE voiced WINDOW w AS (PARTITION BY recording ORDER BY ts, idx)),
j AS (SELECT e.*, coalesce(last_value(v.n IGNORE NULLS) OVER w, 0) AS n, last_value(v.m IGNORE NULLS) OVER w AS m FROM e LEFT JOIN v USING (recording, idx) WINDOW w AS (PARTITION BY e.recording ORDER BY e.ts, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, CASE WHEN n >= 3 THEN rms / m ELSE 0.0 END AS ratio FROM j),
b AS (SELECT *, CASE WHEN n < 3 THEN 'UNKNOWN' WHEN ratio >= 1.6 THEN 'OPERATOR' WHEN ratio <= 1.0/1.6 THEN 'CALLER' ELSE 'UNKNOWN' END AS band FROM r),
t AS (SELECT *, n >= 3 AND band = 'UNKNOWN' AND coalesce(lag(band) OVER (PARTITION BY recording ORDER BY ts, idx) = 'CALLER', false) AS turn FROM b)
SELECT recording, idx, round(ratio, 6) AS ratio, CASE WHEN turn THEN 'OPERATOR' ELSE band END AS role,
  round(CASE WHEN n < 3 THEN 0.0 WHEN turn THEN 0.5 WHEN band = 'OPERATOR' THEN least(1.0, ratio / 1.6 * 0.6) WHEN band = 'CALLER' THEN 0.6 ELSE 0.3 END, 6) AS confidence,
  CASE WHEN n < 3 THEN 'warmup' WHEN turn THEN 'prior' ELSE 'energy' END AS source FROM t""")
def role_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN4 over all events."""
    return rounded(speech.rolling_roles(energies(spark, sf_dir), order=("ts", "idx")))


@query(f"WITH {BANDS_SQL.replace('OVER (PARTITION BY user_id)', 'OVER ()')} SELECT role, count(*) AS n, round(avg(rms), 6) AS mean_rms FROM c GROUP BY role")
def role_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN2 with the global scope, AG8, AG11."""
    found = speech.role_bands(energies(spark, sf_dir), scope=())
    return found.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rms"), 6).alias("mean_rms"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("recording").orderBy("ts", "idx")) - 1
    return energies(spark, sf_dir).select("recording", place.alias("frame"), F.col("rms").alias("energy"))


VAD_SQL = """
f AS (SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS energy FROM events),
s AS (SELECT recording, greatest(median(energy) * {share}, 1e-4) AS least, max(frame) + 1 AS n FROM f GROUP BY recording),
v AS (SELECT f.recording, frame, n, CASE WHEN frame - lag(frame) OVER (PARTITION BY f.recording ORDER BY frame) <= {gap} THEN 0 ELSE 1 END AS fresh FROM f JOIN s USING (recording) WHERE energy > least),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY recording ORDER BY frame) AS island FROM v),
g AS (SELECT recording, island, min(frame) AS a, max(frame) AS b, max(n) AS n FROM i GROUP BY recording, island),
o AS (SELECT recording, a * 30 AS start_ms, CASE WHEN n - 1 - b < {gap} THEN n ELSE b + 1 END * 30 AS end_ms FROM g),
x AS (SELECT * FROM o WHERE end_ms - start_ms >= 300),
y AS (SELECT recording, start_ms, end_ms FROM x UNION ALL SELECT recording, 0, n * 30 FROM s ANTI JOIN x USING (recording))""".format(share=0.9, gap=2)


def voiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.voice_segments(frames(spark, sf_dir), silence_frames=2, share=0.9)


@query(f"WITH {VAD_SQL} SELECT recording, start_ms, end_ms, row_number() OVER (PARTITION BY recording ORDER BY start_ms) AS idx FROM y")
def voice_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN5, WN6, FLT1, FLT3 over all events."""
    return speech.numbered(voiced(spark, sf_dir))


@query(f"WITH {VAD_SQL} SELECT recording, count(*) AS segments, CASE WHEN count(*) = 1 AND min(start_ms) = 0 AND abs(max(end_ms) - max(n * 30)) <= 20 THEN 'whole' ELSE 'split' END AS status FROM y JOIN s USING (recording) GROUP BY recording")
def voice_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT9 over all events."""
    lengths = frames(spark, sf_dir).groupBy("recording").agg(((F.max("frame") + 1) * 30).alias("length_ms"))
    return speech.segmenter_status(voiced(spark, sf_dir), lengths)


@query("""WITH f AS (SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events)
SELECT recording, pos // 10 AS frame, round(sqrt(avg(value * value)), 6) AS energy FROM f GROUP BY ALL HAVING count(*) = 10""")
def frame_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14 over all events."""
    samples = frames(spark, sf_dir).select("recording", F.col("frame").alias("pos"), F.col("energy").alias("value"))
    return speech.frame_energies(samples, 10).select("recording", "frame", F.round("energy", 6).alias("energy"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / len(embedding)), 6) AS rms FROM embeddings")
def wave_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ3 over all embeddings."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(speech.rms_of(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("rms"))


@query()
def voices_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML4, ML6: two clusters of voices for each label's vectors."""
    v = table(spark, sf_dir, "embeddings").withColumn("level", F.round(F.abs(F.element_at("embedding", 1)) + 0.01, 6).cast("double"))
    rows = v.select(F.col("label").alias("recording"), F.col("vec_id").alias("idx"), F.col("level").alias("rms"), F.lit("UNKNOWN").alias("role"), F.lit(0.3).alias("confidence"), F.lit("energy").alias("source"), F.col("embedding").alias("voice"))
    return speech.refined_by_voice(rows).drop("voice")


# --- lexicon and tickets -------------------------------------------------------


@query("""WITH t AS (SELECT role AS category, lower(regexp_extract(text, '^[A-Za-z]+')) AS term, conv_id AS a, turn AS b FROM conversations),
d AS (SELECT category, term, a, b, count(*) AS n FROM t WHERE term <> '' GROUP BY ALL)
SELECT category, term, sum(n)::BIGINT AS count, string_agg('ticket' || a || '#' || b, ',' ORDER BY a, b) AS sources FROM d GROUP BY category, term""")
def lexicon_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3, TK3 over all conversations: first words by role, with their places."""
    t = table(spark, sf_dir, "conversations")
    terms = t.select(F.col("role").alias("category"), F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("term"), F.concat(F.lit("ticket"), F.col("conv_id"), F.lit("#"), F.col("turn")).alias("source")).filter("term <> ''")
    return lexicon.grouped(terms).withColumn("sources", F.array_join("sources", ","))


LEXICON_ENTRIES = ["检查汇控柜丹东线111开关电气位置指示确在分闸位置", "合上丹东线111-1刀闸", "将测控屏丹东线111开关操作方式把手由“就地”切至“远方”位置"]
DEVICES = [("丹东线111-1刀闸", 1), ("丹东线111开关", 1), ("汇控柜丹东线111开关", 1), ("测控屏丹东线111开关操作方式把手", 1), ("丹东线111开关操作方式把手", 1)]


@query(values(DEVICES, "term", "count"))
def lexicon_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX2-EX4, SC22 against fixed expectations."""
    entries = spark.createDataFrame([("ticket1", str(i + 1), t) for i, t in enumerate(LEXICON_ENTRIES)], "ticket string, seq string, entry string")
    heads = spark.createDataFrame([("ticket1", "站", "任务")], "ticket string, substation string, mission string")
    return lexicon.grouped(lexicon.all_terms(heads, entries)).filter("category = 'devices'").select("term", "count")


SHAPES = [("a", '{"id":"x","entries":{"2":"拉开","1":"检查"}}'), ("b", '{"1":"合上","k":"退出"}'), ("c", '["投入","核对"]'), ("d", '{"entries":["送电"]}')]


@query(values([("a", 1, 0, "检查"), ("a", 2, 1, "拉开"), ("b", 1, 0, "合上"), ("b", 2, 1, "退出"), ("c", 1, 0, "投入"), ("c", 2, 1, "核对"), ("d", 1, 0, "送电")], "source", "seq", "pos", "raw"))
def ticket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, TK5, SC25: the accepted shapes against fixed expectations."""
    return tickets.items(tickets.parsed(spark.createDataFrame(SHAPES, "source string, text string"))).select("source", "seq", "pos", "raw")


# --- evaluation and reports ----------------------------------------------------


@query(f"""WITH {TURNS_SQL},
p AS (SELECT i.ticket_id, i.pos, norm AS a, heard AS b FROM i JOIN u ON u.ticket_id = i.ticket_id AND u.idx = i.pos + 1)
SELECT ticket_id, pos, round(CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(a, b) / length(a) END, 6) AS cer,
  len(list_filter([CASE WHEN regexp_extract_all(a, '[0-9]+') <> regexp_extract_all(b, '[0-9]+') THEN 1 END], lambda x: x IS NOT NULL)) > 0 AS digits_differ FROM p""")
def evaluation_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC17, SC18, SC19 over all answered turns."""
    items, said = turns(spark, sf_dir)
    p = items.join(said.withColumn("pos", F.col("idx") - 1), ["ticket_id", "pos"]).withColumnRenamed("norm", "a").withColumnRenamed("heard", "b")
    kinds = T.error_kinds(F.col("a"), F.col("b"))
    return p.select("ticket_id", "pos", F.round(T.error_rate(F.col("a"), F.col("b")), 6).alias("cer"), F.exists(kinds, lambda k: k.startswith(T.NUMBER_ERROR)).alias("digits_differ"))


@query("""SELECT l_returnflag AS label, count(*) AS clips, round(sum(l_quantity), 2) AS total_audio_seconds, round(sum(l_tax), 2) AS total_infer_seconds, round(sum(l_tax) / sum(l_quantity), 4) AS rtf,
round(avg(l_discount), 4) AS mean_cer_raw, round(avg(l_discount), 4) AS mean_cer_norm, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END), 4) AS align_accuracy FROM lineitem GROUP BY l_returnflag""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG9, AG10, PRJ4 over all line items."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("audio_seconds"), F.col("l_tax").alias("infer_seconds"), F.col("l_discount").alias("cer_raw"), F.col("l_discount").alias("cer_norm"), (F.col("l_linestatus") == "O").alias("aligned"))
    return evaluation.summary(rows)


@query("SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders GROUP BY o_orderpriority")
def evaluation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12 over all orders."""
    return evaluation.state_pivot(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", list("FOP"))


_SIDE = "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders WHERE o_totalprice {} 100000 GROUP BY o_orderpriority"


@query(f"WITH a AS ({_SIDE.format('<')}), b AS ({_SIDE.format('>=')}) SELECT o_orderpriority, " + ", ".join(f"a.{s} AS before_{s}, b.{s} AS after_{s}, b.{s} - a.{s} AS change_{s}" for s in "FOP") + " FROM a JOIN b USING (o_orderpriority)")
def evaluation_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10, SNK6 over all orders, cheap ones against the rest."""
    o = table(spark, sf_dir, "orders")
    side = lambda rows: evaluation.state_pivot(rows, ["o_orderpriority"], "o_orderstatus", list("FOP"))
    return evaluation.compared(side(o.filter("o_totalprice < 100000")), side(o.filter("o_totalprice >= 100000")), ["o_orderpriority"], list("FOP"))


@query("SELECT r_name, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: a table per group."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return reports.markdown_table(n, "r_name", "n_nationkey", ["n_nationkey", "n_name"])


@query("SELECT user_id, count(*) AS segments, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS alerts FROM events GROUP BY user_id")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG2, FLT5 over all events; two event types stand for alerts."""
    kind = F.when(F.col("event_type").isin("click", "purchase"), "FAILED").otherwise("VERIFIED")
    return reports.totals(table(spark, sf_dir, "events").select("user_id", kind.alias("event")), "user_id")

# --- whole runs ---------------------------------------------------------------


def conversation_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as runs: segments from the lengths of the utterances, events from the best item near each, and the items."""
    items, said = turns(spark, sf_dir)
    n = F.length("heard")
    role = F.when(n % 3 == 0, "OPERATOR").when(n % 3 == 1, "CALLER")
    segments = said.select(
        "ticket_id", "idx", (F.col("idx") * 1000).cast("bigint").alias("start_ms"), (F.col("idx") * 1000 + n).cast("bigint").alias("end_ms"), (n / 100).alias("rms"), F.lit(1.0).alias("ratio"),
        role.alias("role"), F.lit(0.5).alias("confidence"), F.lit("energy").alias("source"), F.col("heard").alias("text"), F.col("heard").alias("raw_text"), (n / 1024).alias("infer_seconds"),
    )
    kinds = StructType.fromDDL(alignment.EVENTS)
    none = {c: F.array().cast(kinds[c].dataType).alias(c) for c in ("reasons", "conflicts", "slots")}
    score = F.floor(F.col("score") * 1000) / 1000
    kind = F.when(F.col("chatter"), "FLAGGED").when(score >= 0.82, "VERIFIED").otherwise("REPEAT")
    best = match_best_in_window(spark, sf_dir)
    events = best.select(
        "ticket_id", "idx", kind.alias("kind"), F.when(~F.col("chatter"), F.col("pos").cast("int")).alias("seq"), score.alias("score"), F.when(score >= 0.82, "PASS").otherwise("REVIEW").alias("verdict"),
        F.lit("m").alias("message"), F.lit("h").alias("heard"), F.col("chatter").alias("is_alert"), score.alias("sentence_similarity"), *none.values(), F.col("pos").alias("at"),
    )
    return segments, events, items


RUN_SQL = f"""
{TURNS_SQL},
p AS (SELECT ticket_id, idx, pos, round(greatest(0.0, 1.0 - levenshtein(norm, heard) / greatest(length(norm), length(heard), 1)), 6) AS score
      FROM u JOIN i USING (ticket_id) WHERE pos BETWEEN idx - 2 AND idx + 2),
b AS (SELECT ticket_id, idx, arg_max(pos, (score, -pos)) AS pos, max(score) < 0.45 AS chatter, floor(max(score) * 1000) / 1000 AS score FROM p GROUP BY ticket_id, idx)"""


@query(f"""WITH {RUN_SQL}
SELECT u.ticket_id, row_number() OVER (PARTITION BY u.ticket_id ORDER BY u.idx) AS "index", u.idx * 1000 AS start_ms, u.idx * 1000 + length(heard) AS end_ms, length(heard) AS duration_ms, round(length(heard) / 100, 6) AS rms,
       ['OPERATOR', 'CALLER', 'UNKNOWN'][length(heard) % 3 + 1] AS role, ['操作人', '唱票人', '未定'][length(heard) % 3 + 1] AS role_label, round(length(heard) / 1024, 4) AS infer_seconds, md5(heard) AS asr_md5,
       CASE WHEN b.idx IS NULL THEN NULL WHEN chatter THEN 'FLAGGED' WHEN score >= 0.82 THEN 'VERIFIED' ELSE 'REPEAT' END AS event, CASE WHEN NOT chatter THEN pos END AS matched_seq, round(score, 4) AS score,
       CASE WHEN b.idx IS NULL THEN NULL WHEN score >= 0.82 THEN 'PASS' ELSE 'REVIEW' END AS verdict, 0 AS slots
FROM u LEFT JOIN b ON u.ticket_id = b.ticket_id AND u.idx = b.idx""")
def report_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1, JN7: the segments' rows of all conversations."""
    segments, events, _ = conversation_runs(spark, sf_dir)
    whole = "ticket_id index start_ms end_ms duration_ms rms role role_label infer_seconds event matched_seq score verdict".split()
    return reports.segment_rows(events, segments).select(*whole, F.md5("asr_text").alias("asr_md5"), F.size("slots").alias("slots"))


@query(f"""WITH {RUN_SQL},
s AS (SELECT ticket_id, count(*) AS n, sum(length(heard) / 1024) AS infer FROM u GROUP BY ticket_id),
a AS (SELECT ticket_id, count(*) FILTER (WHERE chatter) AS alerts FROM b GROUP BY ticket_id),
v AS (SELECT DISTINCT ticket_id, pos FROM b WHERE NOT chatter),
c AS (SELECT i.ticket_id, count(*) AS items, count(v.pos) AS verified, md5(arg_min(norm, i.pos)) AS first_md5 FROM i LEFT JOIN v ON i.ticket_id = v.ticket_id AND i.pos = v.pos GROUP BY i.ticket_id)
SELECT ticket_id, coalesce(n, 0) AS segment_count, len_rows AS segments, round(coalesce(infer, 0), 3) AS total_infer_seconds, round(coalesce(infer, 0) / 64, 4) AS rtf, items, verified, items - verified AS unconfirmed, coalesce(alerts, 0) AS alert_count, first_md5
FROM c LEFT JOIN (SELECT *, n AS len_rows FROM s) USING (ticket_id) LEFT JOIN a USING (ticket_id)""".replace("len_rows AS segments", "coalesce(len_rows, 0) AS segments"))
def report_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, AG2, AGN5, FLT5: the reports of all conversations that have items."""
    segments, events, items = conversation_runs(spark, sf_dir)
    texts = items.select("ticket_id", F.col("pos").cast("int").alias("pos"), F.col("norm").alias("raw"))
    met = events.filter("not is_alert").select("ticket_id", F.col("at").cast("int").alias("pos"), F.lit(True).alias("met")).distinct()
    none = F.array().cast("array<string>")
    states = texts.join(met, ["ticket_id", "pos"], "left").select(
        "ticket_id", F.col("pos").alias("seq"), "pos", F.when(F.col("met"), "VERIFIED").otherwise("UNCONFIRMED").alias("state"), F.lit(False).alias("called"), F.lit(0).alias("attempts"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("heard"), none.alias("reasons"), none.alias("conflicts"),
    )
    tickets_ = texts.select("ticket_id").distinct().select("ticket_id", F.lit(64.0).alias("audio_seconds"), *(F.lit(c).alias(c) for c in reports.METADATA))
    docs = reports.documents(tickets_, segments, reports.segment_rows(events, segments), alignment.report(states, events, texts))
    of = lambda state: F.coalesce(F.element_at("summary.state_counts", state), F.lit(0))
    return docs.select(
        "ticket_id", "summary.segment_count", F.size("segments").alias("segments"), "summary.total_infer_seconds", "summary.rtf", F.size("items").alias("items"), of("VERIFIED").alias("verified"), of("UNCONFIRMED").alias("unconfirmed"),
        "summary.alert_count", F.md5(F.get("items", 0)["text"]).alias("first_md5"),
    )


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
