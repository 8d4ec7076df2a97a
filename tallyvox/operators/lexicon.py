"""A station's lexicon from its tickets: term extraction, grouping and ordering as DataFrame operators.

entries: ticket (name), seq (as written), entry (text); tickets: ticket, substation, mission.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.text import canonical_voltage, clean_term

# Vocabularies, patterns and affixes of the extraction.
ACTIONS = "检查 核对 确认 验明 合上 拉开 投入 停用 切至 送电 停电 复归".split()
STATES = "冷备用 热备用 运行 检修 分闸 合闸 远方 就地 并列 解列 投入 停用 合好 拉开 正确 无异常信号 无电压 具备操作条件".split()
PANELS = "桥保护测控 111保护测控 110kV备投屏 110kV电压并列屏 汇控柜 测控屏 保护屏 主控屏".split()
HANDLES = "操作方式把手 电压并列切换把手 远方就地把手 切换把手 把手".split()
END_MARKERS = ["电气位置指示", "机械位置指示", "电压指示", "确在", "确已", "无异常信号", "线路侧三相", "由“", '由"', "由远方", "由就地", "由解列", "由并列"]
ASSET_SUFFIXES = "接地刀闸 隔离开关 空气开关 开关 刀闸 保护压板 投入压板 出口压板 压板 把手 保护装置 母线".split()
BAYS = ["(?i)(?:110kV)?#\\d+母线(?:PT)?", "(?i)(?:110kV)?丹东线(?:线路)?(?:111)?", "(?i)(?:丹东线111|#\\d+PT)间隔"]
CODE = "(?i)(?<![A-Za-z0-9])(\\d+-\\d+[A-Za-z]+\\d+|\\d+[A-Za-z]+\\d+|\\d+-[A-Za-z]?\\d+|#\\d+PT|P\\d+)(?![A-Za-z0-9])"
DEVICE_CODE = "(?<!\\d)(\\d{3})(?=(?:开关|刀闸|间隔))"
VOLTAGE = "\\d+(?:\\.\\d+)?\\s*[kK][vV]"
LEADING = "^(?:检查|核对|确认|验明|合上|拉开|投入|停用|将)"
NOT_ASSETS = ["现场", "送电区域内", "系统"]
GENERIC = "开关 刀闸 压板 把手 保护装置 母线 汇控柜 测控屏".split()
CATEGORIES = ["substations", "missions", "voltage_levels", "lines_and_bays", "devices", "device_codes", "protection_plates", "panels", "handles", "actions", "positions_and_states"]
ASSET_CATEGORIES = ["lines_and_bays", "devices", "device_codes", "protection_plates", "handles"]


def with_target(entries: DataFrame, to: str = "target") -> DataFrame:
    """entries with the device, plate or handle that each is about; null if there is none.

    Step by step as columns of their own, since each is used many times by the next.
    """
    df = entries.withColumn("_text", F.regexp_replace(F.btrim("entry", F.lit("。；; ")), LEADING, ""))
    df = df.withColumn("_panel", F.regexp_extract("_text", "^(测控屏|汇控柜)", 1))
    df = df.withColumn("_text", F.concat("_panel", F.regexp_replace(F.expr("substring(_text, length(_panel) + 1)"), LEADING, "")))
    ends = [F.nullif(F.instr("_text", m), F.lit(0)) for m in END_MARKERS]
    df = df.withColumn("_end", F.coalesce(F.least(*ends) - 1, F.length("_text")))
    df = df.withColumn("_found", F.regexp_replace(F.btrim(F.expr("substring(_text, 1, _end)"), F.lit(" ，,、")), "(?:两只|一只|三只)$", ""))
    found = F.col("_found")
    fits = reduce(lambda a, b: a | b, (found.contains(s) for s in ASSET_SUFFIXES)) | found.rlike(CODE) | found.rlike(DEVICE_CODE)
    return df.withColumn(to, F.when((found != "") & ~found.isin(*NOT_ASSETS) & fits, found)).drop("_text", "_panel", "_end", "_found")


def entry_terms(entries: DataFrame) -> DataFrame:
    """category, term, source of every find in every entry; vocabulary words once an entry, patterns at each match."""
    entry = F.col("entry")
    of = lambda category, terms: F.transform(terms, lambda t: F.struct(F.lit(category).alias("category"), t.alias("term")))
    words = lambda category, vocabulary: of(category, F.filter(F.array(*map(F.lit, vocabulary)), lambda w: entry.contains(w)))
    every = lambda category, pattern, group=0: of(category, F.regexp_extract_all(entry, F.lit(pattern), F.lit(group)))
    t, core = F.col("_target"), F.col("_core")
    some = lambda category, *xs: of(category, F.array_compact(F.array(*xs)))
    finds = F.concat(
        words("actions", ACTIONS), words("positions_and_states", STATES), words("panels", PANELS), words("handles", HANDLES),
        *(every("lines_and_bays", p) for p in BAYS),
        of("device_codes", F.transform(F.regexp_extract_all(entry, F.lit(CODE), F.lit(1)), F.upper)), every("device_codes", DEVICE_CODE, 1),
        some("devices", t, F.when(core != t, core)), some("protection_plates", F.when(t.contains("压板"), t)),
        of("voltage_levels", F.transform(F.regexp_extract_all(entry, F.lit(VOLTAGE), F.lit(0)), canonical_voltage)),
    )
    named = with_target(entries, "_target").withColumn("_core", F.regexp_replace("_target", "^(?:汇控柜|测控屏)", ""))
    return named.select(F.concat("ticket", F.lit("#"), F.col("seq").cast("string")).alias("source"), F.explode(finds).alias("x")).select("x.category", "x.term", "source")


def all_terms(tickets: DataFrame, entries: DataFrame) -> DataFrame:
    heads = tickets.select(F.col("ticket").alias("source"), F.explode(F.array(F.struct(F.lit("substations").alias("category"), F.col("substation").alias("term")), F.struct(F.lit("missions").alias("category"), F.col("mission").alias("term")))).alias("x"))
    found = heads.select("x.category", "x.term", "source").unionByName(entry_terms(entries))
    return found.withColumn("term", clean_term(F.coalesce("term", F.lit("")))).filter("term <> ''")


def source_key(source: Column) -> Column:
    """Sources in order of their ticket's and entry's number; others last."""
    part = lambda i: F.regexp_extract(source, "^ticket(\\d+)(?:#(\\d+))?$", i)
    other = F.lit(10**9)
    number = lambda i, default: F.coalesce(part(i).try_cast("int"), default)
    return F.struct(number(1, other).alias("a"), F.when(part(1) == "", other).otherwise(number(2, F.lit(0))).alias("b"), source.alias("source"))


def grouped(terms: DataFrame) -> DataFrame:
    """category, term, count, sources (distinct, in order); sort by -length(term), term within a category."""
    sources = F.transform(F.array_sort(F.collect_set(source_key(F.col("source")))), lambda s: s["source"])
    return terms.groupBy("category", "term").agg(F.count(F.lit(1)).alias("count"), sources.alias("sources"))


def station(lexicon: DataFrame) -> DataFrame:
    """The one substation's name, or an empty string if there isn't exactly one."""
    subs = lexicon.filter("category = 'substations'").agg(F.count_distinct("term").alias("n"), F.min("term").alias("term"))
    return subs.select(F.when(F.col("n") == 1, F.col("term")).otherwise("").alias("station"))


def asset_terms(lexicon: DataFrame) -> DataFrame:
    """The terms that stand for one asset, longest first."""
    t = F.col("term")
    code = (F.length(t) >= 3) & ~t.startswith("#") & ~t.rlike("^\\d+$")
    specific = ~t.isin(*GENERIC) & (F.length(t) >= 4) & ~t.startswith("#")
    wanted = F.col("category").isin(*ASSET_CATEGORIES) & F.when(F.col("category") == "device_codes", code).otherwise(specific)
    return lexicon.filter(wanted).select("term").distinct().orderBy(-F.length("term"), "term")
