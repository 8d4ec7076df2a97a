"""Small literal inputs: an adversarial ticket, utterances with what they must give, and text pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The sample ticket, utterances and normalisation pairs.
TICKET = [
    "检查110kV系统符合解环条件",
    "将测控屏110kV桥100开关操作方式把手由“远方”切至“就地”位置",
    "拉开110kV桥100开关",
    "检查测控屏110kV桥100开关电气位置指示确已拉开",
    "将测控屏110kV桥100开关操作方式把手由“就地”切至“远方”位置",
    "检查110kV系统解环后负荷转移指示正确",
    "检查110kV桥100开关机械位置指示确已拉开",
    "将110kV电压并列把手由“并列”切至“解列”位置",
    "检查110kVI段母线电压三相指示正确",
]
NORMAL = {
    "110kVI段": "110kv1段", "Ⅱ段": "2段", "三相": "3相", "由“远方”切至“就地”": "由远方切至就地", "一百一十千伏": "110kv", "幺幺零千伏": "110kv",
    "三十五千伏": "35kv", "十千伏": "10kv", "二百二十千伏": "220kv", "〇": "0", "二百五": "205", "10万": "110000", "XVIII段": "x8段", "一亿零五": "100000005", "ＡＢ　１": "ab1",
}


def ticket_items(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    from tallyvox.functions.text import normalise

    rows = [("sample", i + 1, i, raw) for i, raw in enumerate(TICKET)]
    return spark.createDataFrame(rows, "ticket_id string, seq int, pos int, raw string").withColumn("norm", normalise(F.col("raw")))


def utterances(spark: SparkSession, said: list[tuple[str, str]], ticket: str = "sample") -> DataFrame:
    """ticket_id, idx, role, text, heard of (text, role) in order."""
    from pyspark.sql import functions as F

    from tallyvox.functions.text import normalise

    rows = [(ticket, i, role, text) for i, (text, role) in enumerate(said)]
    return spark.createDataFrame(rows, "ticket_id string, idx bigint, role string, text string").withColumn("heard", normalise(F.col("text")))
