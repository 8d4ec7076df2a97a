import random

import pytest
from pyspark.sql import functions as F

from tallyvox.functions import text as T
from tallyvox.functions.plain import normalised
from tallyvox.plans import fixtures


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normal_pairs(spark):
    df = spark.createDataFrame(list(fixtures.NORMAL.items()), "a string, b string")
    assert all(r.n == r.b for r in df.select("b", T.normalise(F.col("a")).alias("n")).collect())
    assert all(normalised(a) == b for a, b in fixtures.NORMAL.items())


def test_columns_and_strings_agree(spark):
    draw, signs = random.Random(2), "零〇0一幺十百千万亿二两五IVXⅡ段母kKvVmw千伏安，。 -#a1２Ｋ三相　\n"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 14))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.n == normalised(r.t) for r in df.select("t", T.normalise(F.col("t")).alias("n")).collect())


def test_three_spellings_meet(spark):
    spellings = ["检查测控屏110kV桥100开关", "检查测控屏一百一十千伏桥一百开关", "检查测控屏幺幺零千伏桥幺零零开关"]
    assert len({one(spark, T.normalise(F.lit(s))) for s in spellings}) == 1


def test_normalise_is_idempotent(spark):
    for t in fixtures.TICKET:
        n = normalised(t)
        assert normalised(n) == n


def test_null_and_empty(spark):
    assert one(spark, T.normalise(F.lit(None).cast("string"))) == "" == one(spark, T.normalise(F.lit("")))


@pytest.mark.parametrize("ref, hyp, rate", [("", "", 0.0), ("", "x", 1.0), ("ab", "ab", 0.0), ("ab", "abcdef", 2.0), ("桥100", "桥200", 0.25)])
def test_error_rate(spark, ref, hyp, rate):
    assert one(spark, T.error_rate(F.lit(ref), F.lit(hyp))) == rate


@pytest.mark.parametrize(
    "ref, hyp, kinds",
    [("拉开桥100", "合上桥200", ["数字(100 -> 200)", "方向/动作词(拉开)", "方向/动作词(合上)"]), ("a", "b", ["其它用字差异"]), ("a", "a", []), ("1", "", ["数字(1 -> 无)"])],
)
def test_error_kinds(spark, ref, hyp, kinds):
    assert one(spark, T.error_kinds(F.lit(ref), F.lit(hyp))) == kinds


def test_small_functions(spark):
    assert one(spark, T.without_tags(F.lit("<|zh|><|NEUTRAL|> 拉开　"))) == "拉开"
    assert one(spark, T.escaped_cell(F.lit("a|b\nc"))) == "a\\|b c"
    assert one(spark, T.clean_term(F.lit(" “桥  100”。"))) == "桥 100"
    assert one(spark, T.canonical_voltage(F.lit("110 KV"))) == "110kV"
    assert one(spark, T.sequence_number(F.lit(" 7 "), F.lit(1))) == 7 and one(spark, T.sequence_number(F.lit("x"), F.lit(3))) == 3
    assert one(spark, T.digits(F.lit("11klp3"))) == "113" and one(spark, T.skeleton(F.lit("桥100开关"))) == "桥开关"
