"""Reports: JSON and Markdown of runs, lexicon files, and reading reports back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvox.functions.text import escaped_cell
from tallyvox.operators.speech import label_of, real_time_factor

#: Names of roles and the columns of reports.
ROLE_LABELS = {"OPERATOR": "操作人", "CALLER": "唱票人", "UNKNOWN": "未定"}
SEGMENT = "index start_ms end_ms duration_ms rms rms_ratio role role_label role_confidence role_source asr_text asr_raw infer_seconds event message matched_seq score verdict sentence_similarity reasons conflicts slots".split()
ITEM = "seq text state called attempts score heard reasons conflicts".split()
METADATA = "audio ticket substation mission number asset_list asr segmenter".split()


def segment_rows(events: DataFrame, segments: DataFrame) -> DataFrame:
    """ticket_id and SEGMENT: a flat row per segment (ticket_id, idx, start_ms, end_ms, rms, ratio, role, confidence, source, text, raw_text, infer_seconds) with what came of it.

    index counts a ticket's segments from 1. Where nothing matched, the match's columns are null and its lists empty.
    """
    told = events.select("ticket_id", "idx", F.col("kind").alias("event"), "message", F.col("seq").alias("matched_seq"), F.round("score", 4).alias("score"), "verdict", F.round("sentence_similarity", 4).alias("sentence_similarity"), "reasons", "conflicts", "slots")
    numbered = segments.withColumn("index", F.row_number().over(Window.partitionBy("ticket_id").orderBy("idx")))
    role = F.coalesce("role", F.lit("UNKNOWN"))
    rows = numbered.select(
        "ticket_id", "idx", "index", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.round("rms", 6).alias("rms"), F.round("ratio", 4).alias("rms_ratio"),
        role.alias("role"), label_of(role, ROLE_LABELS).alias("role_label"), F.round("confidence", 4).alias("role_confidence"), F.col("source").alias("role_source"),
        F.col("text").alias("asr_text"), F.col("raw_text").alias("asr_raw"), F.round("infer_seconds", 4).alias("infer_seconds"),
    )
    rows = rows.join(told, ["ticket_id", "idx"], "left")
    filled = {c: F.coalesce(c, F.array().cast(told.schema[c].dataType)).alias(c) for c in ("reasons", "conflicts", "slots")}
    return rows.select("ticket_id", *(filled.get(c, c) for c in SEGMENT))


def documents(tickets: DataFrame, segments: DataFrame, rows: DataFrame, report: DataFrame) -> DataFrame:
    """One row per ticket: ticket_id, metadata, summary, segments, items, alerts. A ticket's segments and items are few.

    tickets: ticket_id, audio_seconds and METADATA (`number` is what is written on the ticket); segments: ticket_id, infer_seconds;
    rows: segment_rows(); report: alignment.report(). Without audio the real-time factor is 0.
    """
    listed = rows.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.struct(*SEGMENT))).alias("segments"))
    infer = segments.groupBy("ticket_id").agg(F.sum("infer_seconds").alias("_infer"))
    whole = tickets.join(report, "ticket_id", "left").join(listed, "ticket_id", "left").join(infer, "ticket_id", "left")
    seconds = F.coalesce("_infer", F.lit(0.0))
    summary = F.struct(
        F.round("audio_seconds", 3).alias("audio_seconds"), F.coalesce("_n", F.lit(0)).alias("segment_count"), F.round(seconds, 3).alias("total_infer_seconds"),
        F.round(real_time_factor(seconds, F.col("audio_seconds")), 4).alias("rtf"), "state_counts", F.size(F.coalesce("alerts", F.array())).alias("alert_count"),
    )
    return whole.select(
        "ticket_id",
        F.struct(*(F.col(c).alias("ticket_id" if c == "number" else c) for c in METADATA)).alias("metadata"),
        summary.alias("summary"),
        F.coalesce("segments", F.array().cast(listed.schema["segments"].dataType)).alias("segments"),
        F.transform("items", lambda x: F.struct(*(x[c].alias(c) for c in ITEM))).alias("items"),
        F.transform("alerts", lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "seq", "message", "heard")))).alias("alerts"),
    )


def document_json(docs: DataFrame) -> DataFrame:
    """ticket_id, json of documents(); null fields are written."""
    return docs.select("ticket_id", F.to_json(F.struct(*[c for c in docs.columns if c != "ticket_id"]), {"ignoreNullFields": "false"}).alias("json"))


def _number(x) -> Column:
    """A rounded number as people write it; empty for null."""
    return F.coalesce(F.regexp_replace(x.cast("decimal(30,4)").cast("string"), "(\\.\\d+?)0+$", "$1"), F.lit(""))


def _text(x) -> Column:
    return F.coalesce(escaped_cell(x.cast("string")), F.lit(""))


def _counts(counts: Column) -> Column:
    """A map of counts on one line."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string"))), ", "), F.lit("}"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _lines(*parts: Column) -> Column:
    """Lines and arrays of lines as one text; null parts are left out."""
    one = [p if isinstance(p, tuple) else (F.array(p),) for p in parts]
    return F.concat(F.array_join(F.filter(F.concat(*(p[0] for p in one)), lambda x: x.isNotNull()), "\n"), F.lit("\n"))


def document_markdown(docs: DataFrame, title: str = "整票离线校验报告") -> DataFrame:
    """ticket_id, markdown of documents()."""
    m, s, two = lambda c: F.coalesce(F.col(f"metadata.{c}").cast("string"), F.lit("")), lambda c: F.col(f"summary.{c}"), lambda ms: F.format_string("%.2f", ms / 1000)
    named = lambda label, value: F.concat(F.lit(f"- {label}："), value)
    or_else = lambda x, other: F.when(F.coalesce(x, F.lit(0)) == 0, other).otherwise(x.cast("string"))
    item = lambda x: _row(x["seq"].cast("string"), x["state"], _text(x["text"]), _text(x["heard"]), _number(x["score"]), _text(F.array_join(x["reasons"], "；")))
    segment = lambda x: _row(x["index"].cast("string"), F.concat(two(x["start_ms"]), F.lit("~"), two(x["end_ms"])), x["role_label"], _text(x["asr_text"]), F.coalesce(x["event"], F.lit("")), or_else(x["matched_seq"], ""), _number(x["score"]))
    alert = lambda x: F.concat(F.lit("- `"), x["kind"], F.lit("` 第 "), or_else(x["seq"], "-"), F.lit(" 条："), x["message"], F.lit("；识别「"), F.coalesce(x["heard"], F.lit("")), F.lit("」"))
    alerts = F.when(s("alert_count") > 0, F.concat(F.array(F.lit(""), F.lit("## 告警"), F.lit("")), F.transform("alerts", alert))).otherwise(F.array().cast("array<string>"))
    text = _lines(
        F.lit(f"# {title}"), F.lit(""),
        named("任务", m("mission")), named("票号", m("ticket_id")), named("音频", F.concat(F.lit("`"), m("audio"), F.lit("`"))), named("识别", m("asr")), named("切分", m("segmenter")),
        F.concat(F.lit("- 时长："), F.format_string("%.1f", s("audio_seconds")), F.lit("s，语音段："), s("segment_count").cast("string"), F.lit("，RTF："), _number(s("rtf"))),
        F.concat(F.lit("- 条目状态："), F.coalesce(_counts(s("state_counts")), F.lit("{}")), F.lit("，告警："), s("alert_count").cast("string")),
        F.lit(""), F.lit("## 逐条结论"), F.lit(""), F.lit("| 序号 | 状态 | 票面 | 最佳识别 | 得分 | 依据 |"), F.lit("|---:|---|---|---|---:|---|"),
        (F.coalesce(F.transform("items", item), F.array().cast("array<string>")),),
        F.lit(""), F.lit("## 逐段识别与对齐"), F.lit(""), F.lit("| # | 起止(s) | 角色 | ASR 文本 | 事件 | 对应条目 | 得分 |"), F.lit("|---:|---:|---|---|---|---:|---:|"),
        (F.transform("segments", segment),),
        (alerts,),
    )
    return docs.select("ticket_id", text.alias("markdown"))


def write_runs(docs: DataFrame, path: str, title: str = "整票离线校验报告") -> None:
    """JSON and Markdown of documents() under path/json and path/markdown, a folder for each ticket, through the path's file system."""
    for name, texts in (("json", document_json(docs)), ("markdown", document_markdown(docs, title))):
        texts.withColumnRenamed(name, "value").write.mode("overwrite").partitionBy("ticket_id").option("lineSep", "\n").text(f"{path.rstrip('/')}/{name}")


def inspect_markdown(rows: DataFrame, files: DataFrame, settings: str = "") -> DataFrame:
    """run, markdown: how the files of a run were cut and by whom they are spoken. A run is read by people, so its files are few.

    rows: run, file, index, start_ms, end_ms, duration_ms, rms_ratio, role_label, confidence, source, text; files: run, file, seconds, how.
    """
    two = lambda x: F.format_string("%.2f", x)
    line = _row(F.col("index").cast("string"), F.concat(two(F.col("start_ms") / 1000), F.lit("~"), two(F.col("end_ms") / 1000)), F.format_string("%.1f", F.col("duration_ms") / 1000), F.concat(F.lit("x"), two(F.col("rms_ratio"))), F.col("role_label"), two(F.col("confidence")), F.col("source"), F.coalesce("text", F.lit("")))
    of_file = rows.groupBy("run", "file").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("index", line.alias("line")))).alias("lines"))
    head = F.array(F.concat(F.lit("## "), F.col("file")), F.lit(""), F.concat(F.lit("时长 "), F.format_string("%.1f", "seconds"), F.lit("s，"), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" 段，"), F.col("how")), F.lit(""), F.lit("| # | 起止(s) | 时长(s) | 能量倍率 | 角色 | 置信 | 依据 | 识别文本 |"), F.lit("|---|---|---|---|---|---|---|---|"))
    body = F.coalesce(F.transform("lines", lambda x: x["line"]), F.array().cast("array<string>"))
    blocks = files.join(of_file, ["run", "file"], "left").select("run", "file", F.coalesce("n", F.lit(0)).alias("n"), F.array_join(F.concat(head, body), "\n").alias("block"))
    whole = blocks.groupBy("run").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("segments"), F.array_sort(F.collect_list(F.struct("file", "block"))).alias("blocks"))
    roles = rows.groupBy("run", "role_label").agg(F.count(F.lit(1)).alias("k")).groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role_label", "k")))).alias("roles"))
    text = _lines(
        F.lit("# P2 分段与角色判定核对报告"), F.lit(""), F.lit(f"- {settings}" if settings else None).cast("string"),
        F.concat(F.lit("- 文件数 "), F.col("files").cast("string"), F.lit("，语音段 "), F.col("segments").cast("string"), F.lit("，角色分布 "), F.coalesce(_counts(F.col("roles")), F.lit("{}"))), F.lit(""),
        (F.transform("blocks", lambda b: F.concat(b["block"], F.lit("\n"))),),
    )
    return whole.join(roles, "run", "left").select("run", text.alias("markdown"))


def baseline_markdown(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """label, markdown: the block of one pass. A pass is read by people, so its clips are few.

    summary: evaluation.summary() by label with evaluation.verdicts() joined; rows: label, file, seq, reference, hypothesis, cer_norm, verdict, score, best_seq, error_kinds, reasons.
    """
    percent = lambda c: F.concat(F.format_string("%.1f", F.col(c) * 100), F.lit("%"))
    some = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", " if c == "error_kinds" else "; "))
    has = F.col("reference").isNotNull()
    detail = F.array_compact(F.array(
        F.concat(F.lit("- `"), "file", F.lit("` (票面第 "), F.coalesce(F.col("seq").cast("string"), F.lit("-")), F.lit(" 条)")),
        F.concat(F.lit("  - 票面: "), "reference"), F.concat(F.lit("  - 识别: "), F.coalesce("hypothesis", F.lit(""))),
        F.when(has, F.concat(F.lit("  - 归一化字错率 "), percent("cer_norm"), F.lit(" | 判定 "), "verdict", F.lit(" ("), F.format_string("%.3f", "score"), F.lit(") | 对齐到第 "), F.coalesce(F.col("best_seq").cast("string"), F.lit("-")), F.lit(" 条"))),
        F.when(has, F.concat(F.lit("  - 错误类型: "), some("error_kinds"))), F.when(has, F.concat(F.lit("  - 判定依据: "), some("reasons"))),
    ))
    clips = rows.groupBy("label").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file", detail.alias("x")))), lambda c: c["x"])).alias("lines"))
    number = lambda c: _number(F.col(c))
    text = _lines(
        F.concat(F.lit("## "), "label"), F.lit(""),
        F.concat(F.lit("- 片段数: "), F.col("clips").cast("string"), F.lit("  音频总时长: "), number("total_audio_seconds"), F.lit("s  推理总耗时: "), number("total_infer_seconds"), F.lit("s  RTF: "), number("rtf")),
        F.concat(F.lit("- 字错率(原始): "), percent("mean_cer_raw"), F.lit("   字错率(归一化后): "), percent("mean_cer_norm")), F.concat(F.lit("- 条目对齐准确率: "), percent("align_accuracy")), F.concat(F.lit("- 判定分布: "), _counts(F.col("verdicts"))),
        F.lit(""), F.lit("### 逐条明细"), F.lit(""), (F.coalesce("lines", F.array().cast("array<string>")),),
    )
    return summary.join(clips, "label", "left").select("label", text.alias("markdown"))


def totals(rows: DataFrame, by: str = "ticket_id") -> DataFrame:
    alert = F.count_if(F.col("event").isin("FAILED", "SKIP_WARNING", "FLAGGED"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("segments"), alert.alias("alerts"))


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """keys and the whole row as one JSON document."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("json"))


def markdown_table(df: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """by, markdown: a table of each group's rows in order. Groups are reports, so their rows are few."""
    cells = [F.coalesce(escaped_cell(F.col(c).cast("string")), F.lit("")) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n" + "|" + " --- |" * len(columns)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return df.groupBy(by).agg(F.concat_ws("\n", F.lit(head), F.array_join(lines, "\n")).alias("markdown"))


def write_documents(df: DataFrame, column: str, path: str) -> None:
    """One text file for each row's document."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """source, ticket, total_items, state counts and alerts of report files, of alignments or of runs; counts that aren't there are 0."""
    kind = "ticket string, total_items int, state_counts map<string, int>, alerts array<struct<kind: string>>, metadata struct<ticket: string>, summary struct<state_counts: map<string, int>>, items array<struct<seq: int>>"
    found = spark.read.schema(kind).option("multiLine", True).json(path).withColumn("source", F.col("_metadata.file_path"))
    found = found.withColumn("ticket", F.coalesce("ticket", "metadata.ticket")).withColumn("state_counts", F.coalesce("state_counts", "summary.state_counts")).withColumn("total_items", F.coalesce("total_items", F.size("items")))
    counts = [F.coalesce(F.element_at("state_counts", s), F.lit(0)).alias(s) for s in ("VERIFIED", "FLAGGED", "FAILED", "UNCONFIRMED")]
    return found.select("source", "ticket", "total_items", *counts, F.coalesce(F.size("alerts"), F.lit(0)).alias("alerts"))


def lexicon_tree(lexicon: DataFrame, station: str, source: str, tickets: int, entries: int, categories: list[str]) -> dict:
    """A station's lexicon as one tree; its size is that of a vocabulary."""
    rows = lexicon.orderBy(-F.length("term"), "term").collect()
    of = {c: [{"term": r["term"], "count": r["count"], "sources": list(r["sources"])} for r in rows if r["category"] == c] for c in categories}
    return {"schema_version": 1, "station": station, "source": source, "ticket_count": tickets, "entry_count": entries, "categories": of}


def write_lexicon(tree: dict, terms: list[str], yaml_path: str, asset_path: str, header: str = "# generated; one term a line\n") -> None:
    from pathlib import Path

    import yaml

    for path in (yaml_path, asset_path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(yaml_path).write_text(yaml.safe_dump(tree, allow_unicode=True, sort_keys=False, width=120), encoding="utf-8", newline="\n")
    Path(asset_path).write_text(header + "\n".join(terms) + "\n", encoding="utf-8", newline="\n")
