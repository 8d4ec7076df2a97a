"""Whole recordings against their tickets, their reports, and settings from files."""

import json
import struct

import pandas as pd
import pytest

from tallyvox import settings as S
from tallyvox.functions.phonetic import Dialect, encoder_for, load_dialect
from tallyvox.functions.plain import normalised
from tallyvox.operators import evaluation, verification
from tallyvox.operators.matching import Matcher
from tallyvox.operators.slots import Extractor
from tallyvox.plans import fixtures
from tallyvox.sources import audio, reports

T = fixtures.TICKET


@pytest.fixture(scope="module")
def run(spark):
    class Canned:
        """A transcriber that reads what was said from the segment itself."""

        def load(self):
            return lambda batch: pd.DataFrame({"text": batch["said"], "raw_text": "<|zh|>" + batch["said"], "infer_seconds": 0.01, "audio_seconds": 1.0})

    said = [(T[0], 1.0), ("拉开|110kV桥200开关", 3.0), ("今天天气真好啊", 1.0)]
    rows = [("sample", i + 1, 1000 * i, 1000 * i + 900, rms, [0.1], text) for i, (text, rms) in enumerate(said)]
    segments = spark.createDataFrame(rows, "ticket_id string, idx bigint, start_ms bigint, end_ms bigint, rms double, wave array<float>, said string")
    tickets = spark.createDataFrame([(t, f"{t}.wav", f"{t}.json", "站", "任务", "7", None, "canned", "split", 2.0) for t in ("sample", "silent")], "ticket_id string, audio string, ticket string, substation string, mission string, number string, asset_list string, asr string, segmenter string, audio_seconds double")
    items = fixtures.ticket_items(spark)
    items = items.unionByName(spark.createDataFrame([("silent", 1, 0, "检查", "检查")], items.schema))
    made = verification.verified(verification.heard(segments, Canned()).drop("said"), tickets, items, Matcher(Extractor(normalised), encoder_for(spark)))
    yield made
    made.release()


def test_documents_of_a_run(run):
    docs = {r.ticket_id: json.loads(r.json) for r in reports.document_json(run.documents).collect()}
    doc, silent = docs["sample"], docs["silent"]
    assert list(doc) == ["metadata", "summary", "segments", "items", "alerts"]
    assert doc["metadata"]["ticket_id"] == "7" and doc["metadata"]["asset_list"] is None
    assert doc["summary"]["segment_count"] == 3 and doc["summary"]["total_infer_seconds"] == 0.03 and doc["summary"]["rtf"] == 0.015
    assert sum(doc["summary"]["state_counts"].values()) == 9 and doc["summary"]["state_counts"]["VERIFIED"] == 1 and list(doc["summary"]["state_counts"])[0] == "VERIFIED"
    one, two, three = doc["segments"]
    assert list(one) == reports.SEGMENT and [s["index"] for s in doc["segments"]] == [1, 2, 3]
    assert (one["event"], one["matched_seq"], one["verdict"], one["duration_ms"], one["asr_raw"]) == ("VERIFIED", 1, "PASS", 900, "<|zh|>" + T[0])
    assert one["sentence_similarity"] == 1.0 and one["slots"] and all(s["outcome"] == "HIT" and s["conflicting_value"] is None for s in one["slots"])
    assert two["role"] == "OPERATOR" and two["role_label"] == "操作人" and two["event"] == "FAILED" and two["conflicts"]
    assert any(s["outcome"] == "CONFLICT" and s["conflicting_value"] for s in two["slots"])
    assert three["event"] == "CHATTER" and three["matched_seq"] is None
    assert [i["text"] for i in doc["items"]] == T and list(doc["items"][0]) == reports.ITEM
    assert [a["kind"] for a in doc["alerts"]] == ["FAILED"] and doc["summary"]["alert_count"] == 1
    assert silent["segments"] == [] and silent["summary"]["segment_count"] == 0 and silent["summary"]["state_counts"] == {"UNCONFIRMED": 1} and silent["summary"]["rtf"] == 0


def test_written_runs_are_read_back(spark, run, tmp_path):
    reports.write_runs(run.documents, str(tmp_path))
    back = {r.ticket: r for r in reports.read_reports(spark, f"{tmp_path}/json").collect()}
    assert back["sample.json"].total_items == 9 and back["sample.json"].VERIFIED == 1 and back["sample.json"].alerts == 1 and back["silent.json"].UNCONFIRMED == 1
    text = {r.ticket_id: r.markdown for r in reports.document_markdown(run.documents).collect()}
    lines = text["sample"].split("\n")
    assert lines[0] == "# 整票离线校验报告" and "- 任务：任务" in lines and "- 时长：2.0s，语音段：3，RTF：0.015" in lines
    assert any(line.startswith("| 1 | VERIFIED | 检查110kV") for line in lines) and any("0.00~0.90" in line and "| VERIFIED | 1 | 1.0 |" in line for line in lines)
    assert any("拉开\\|110kV桥200开关" in line for line in lines) and any(line.startswith("- `FAILED` 第 ") for line in lines)
    assert "## 告警" not in text["silent"]


def test_run_equals_its_parts(run):
    """One pass gives the events and states that two passes give."""
    assert run.events.count() == 3 and run.states.filter("ticket_id = 'sample'").count() == 9
    assert {r.kind for r in run.events.collect()} == {"VERIFIED", "FAILED", "CHATTER"}


def test_inspection_and_baseline_blocks(spark):
    files = spark.createDataFrame([("r", "a.wav", 2.0, "split"), ("r", "b.wav", 1.0, "whole")], "run string, file string, seconds double, how string")
    rows = spark.createDataFrame([("r", "a.wav", 2, 500, 900, 400, 1.5, "操作人", 0.9, "energy", "x"), ("r", "a.wav", 1, 0, 400, 400, 0.5, "唱票人", 0.8, "energy", None)], "run string, file string, index int, start_ms int, end_ms int, duration_ms int, rms_ratio double, role_label string, confidence double, source string, text string")
    text = reports.inspect_markdown(rows, files).first().markdown
    assert "- 文件数 2，语音段 2，角色分布 {'唱票人': 1, '操作人': 1}" in text and text.index("0.00~0.40") < text.index("0.50~0.90") and "时长 1.0s，0 段，whole" in text
    clips = spark.createDataFrame([("p", "1.wav", 1, "拉开桥100", "拉开桥200", "FAIL", 0.5, 1, ["num"], [], 2.0, 0.5, True), ("p", "2.wav", None, None, "y", None, None, None, None, None, 1.0, 0.5, None)], "label string, file string, seq int, reference string, hypothesis string, verdict string, score double, best_seq int, kinds array<string>, reasons array<string>, audio_seconds double, infer_seconds double, aligned boolean")
    told = evaluation.evaluated(clips)
    block = reports.baseline_markdown(evaluation.summary(told).join(evaluation.verdicts(told), "label", "left"), told).first().markdown
    assert "- 判定分布: {'FAIL': 1}" in block and "- 片段数: 2  音频总时长: 3.0s  推理总耗时: 1.0s  RTF: 0.3333" in block
    assert "| 判定 FAIL (0.500) | 对齐到第 1 条" in block and block.index("`1.wav`") < block.index("`2.wav`") and "判定依据" not in block


def test_words_and_dialect_from_files(tmp_path):
    (tmp_path / "words.yaml").write_text("positions: {values: [左位, 右位]}\nactions: {values: [拨至]}\ndevice_suffixes: [水泵]\ndevice_prefix_chars: 甲乙\n", encoding="utf-8")
    words = S.load_vocabulary("words.yaml", tmp_path)
    assert words.positions == ("左位", "右位") and words.objects == () and words.prefix_chars == "甲乙"
    found = {(s[0], s[1]) for s in Extractor(normalised, words=words).extract(normalised("将甲3水泵由左位切至右位，拨至"))}
    assert {("device", "甲3水泵"), ("src_position", "左位"), ("dst_position", "右位"), ("action", "拨至")} <= found
    (tmp_path / "none.yaml").write_text("", encoding="utf-8")
    assert {s[0] for s in Extractor(normalised, words=S.load_vocabulary("none.yaml", tmp_path)).extract("将开关拉开")} == {"residual"}
    (tmp_path / "d.yaml").write_text('enabled: true\ninitials: [["z", "zh"]]\nfinals: []\nsyllables: [["fu", "hu"]]\ndigit_readings: {"1": ["yi", "yao"]}\n', encoding="utf-8")
    d = load_dialect("d.yaml", tmp_path)
    assert d.folded("zhi") == "zi" and d.folded("hu") == "fu" and d.folded("ling") == "ling" and d.digits["1"] == frozenset(["1", "yi", "yao"]) and Dialect().folded("ling") == "lin"
    (tmp_path / "h.yaml").write_text("heteronym: true\n")
    with pytest.raises(ValueError, match="heteronym"):
        load_dialect("h.yaml", tmp_path)


def wav(tag, bits, channels, rate, data, junk=b""):
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if tag == audio.EXTENSIBLE:
        fmt += struct.pack("<HHIH14s", 22, bits, 0, audio.FLOAT, b"\0" * 14)
    extra = b"LIST" + struct.pack("<I", len(junk)) + junk + b"\0" * (len(junk) % 2) if junk else b""
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_float_wav_and_probe(spark, tmp_path):
    data = struct.pack("<f", 0.25) * 16000
    made = {"f": wav(audio.FLOAT, 32, 1, 8000, data), "x": wav(audio.EXTENSIBLE, 32, 2, 16000, data, b"odd"), "bad": b"RIFF1234WAVEfmt ", "mu": wav(7, 8, 1, 8000, b"\0" * 80)}
    for name, content in made.items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    short = lambda df: {r.path.rsplit("/", 1)[1][:-4]: r for r in df.collect()}
    seen, heard = short(audio.probed(files)), short(audio.decoded(files))
    assert (seen["f"].rate, seen["f"].channels, seen["f"].seconds) == (8000, 1, 2.0) and (seen["x"].rate, seen["x"].channels, seen["x"].seconds) == (16000, 2, 0.5)
    assert seen["bad"].rate is None and "no data chunk" in seen["bad"].status and "format 7" in seen["mu"].status
    assert len(heard["f"].wave) == 32000 and heard["f"].wave[9] == pytest.approx(0.25) and heard["x"].seconds == 0.5 and heard["mu"].wave is None
