"""Exact medians of groups of any size: no buffer, task or driver holds a group.

Where every group has at most LIMIT values, Spark's own median is taken, whose buffer holds a group. Where not, the middle ranks are narrowed down in
passes over the rows: a bounded sketch gives STEPS + 1 quantiles of the values still in question, those next to the rank become the new bounds, and exact counts
below, at and between them tell where the rank lies, whatever the sketch's error. So a pass leaves some 3 of STEPS parts of a group. Values that equal a bound are
counted, not kept, so ties don't hold a pass up. What is left, LIMIT values at most, is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.tables import free_name, matched, written

LIMIT, STEPS, ACCURACY = 10_000, 256, 10_000


def medians(rows: DataFrame, by: Sequence[str], value: str, to: str = "median", limit: int = LIMIT) -> DataFrame:
    """by and the median of each group's values: the middle one, or the mean of both; nulls don't count, and a group without values has none. An empty by: one row.

    NaN is larger than any number. Other columns don't matter.
    """
    v, key = free_name(rows, "_value"), free_name(rows, "_all")
    known = rows.select(*by, F.lit(0).alias(key), F.col(value).cast("double").alias(v))
    keys = [*by, key]
    largest = known.groupBy(*keys).agg(F.count(v).alias(v)).agg(F.max(v)).first()[0] or 0
    if largest <= limit:
        return known.groupBy(*by).agg(F.median(v).alias(to))
    groups = known.groupBy(*keys).agg(F.count(v).alias("n"))
    known = known.filter(F.col(v).isNotNull())
    # a target is a rank in a group: between the exclusive bounds lo and hi are `inside` values, of which `below` smaller ones are known
    middle = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    targets = groups.filter("n > 0").select(*keys, F.explode(middle).alias("k"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"), F.lit(None).cast("double").alias("found"))
    spark = rows.sparkSession
    targets = written(spark, targets, "ranks")
    while not (wide := targets.filter(F.col("found").isNull() & (F.col("inside") > limit))).isEmpty():
        narrowed = written(spark, narrow(inside_of(known, wide, keys, v), wide, keys, v), "narrowed")
        targets = written(spark, targets.filter(F.col("found").isNotNull() | (F.col("inside") <= limit)).unionByName(narrowed), "ranks")
    left = targets.filter("found is null")
    sorted_values = inside_of(known, left, keys, v).groupBy(*keys, "k", "below").agg(F.array_sort(F.collect_list(v)).alias("values"))  # `limit` at most
    found = sorted_values.select(*keys, F.get("values", (F.col("k") - F.col("below")).cast("int")).alias("found")).unionByName(targets.filter("found is not null").select(*keys, "found"))
    means = found.groupBy(*keys).agg(F.avg("found").alias(to))
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}")) for c in keys]
    return groups.alias("g").join(means.alias("m"), same, "left").select(*(F.col(f"g.{c}") for c in by), F.col(f"m.{to}"))


def inside_of(known: DataFrame, targets: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """The values of each target that are still in question. A null key is a group as well."""
    joined = matched(marked(known, keys), marked(targets, keys).drop(*keys), ["_key"], "inner")
    return joined.filter((F.col("lo").isNull() | (F.col(v) > F.col("lo"))) & (F.col("hi").isNull() | (F.col(v) < F.col("hi"))))


def marked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_key", F.to_json(F.struct(*keys)))


def narrow(inner: DataFrame, targets: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """targets with closer bounds, or found."""
    spark = inner.sparkSession
    quantiles = F.percentile_approx(v, [i / STEPS for i in range(STEPS + 1)], ACCURACY)
    steps = inner.groupBy("_key", "k", "lo", "hi", "below", "inside").agg(quantiles.alias("q"))
    step = F.floor((F.col("k") - F.col("below")) * STEPS / F.col("inside")).cast("int")
    near = steps.select("_key", "k", "lo", "hi", "below", "inside", F.get("q", F.greatest(step - 1, F.lit(0))).alias("a"), F.get("q", F.least(step + 2, F.lit(STEPS))).alias("b"))
    bounds = written(spark, near.select("_key", "k", "a", "b"), "bounds")
    x, a, b = F.col(v), F.col("a"), F.col("b")
    count = lambda where, to: F.count(F.when(where, 1)).alias(to)
    counted = matched(inner, bounds, ["_key", "k"], "inner").groupBy(*keys, "k", "lo", "hi", "below", "inside", "a", "b").agg(count(x < a, "less"), count(x == a, "at_a"), count((x > a) & (x < b), "between"), count((x == b) & (a < b), "at_b"))
    rank, upto_a = F.col("k") - F.col("below"), F.col("less") + F.col("at_a")
    upto_b = upto_a + F.col("between")
    past = upto_b + F.col("at_b")
    where = F.when(rank < F.col("less"), 0).when(rank < upto_a, 1).when(rank < upto_b, 2).when(rank < past, 3).otherwise(4)
    pick = lambda *values: F.element_at(F.array(*values), F.col("where") + 1)
    known = counted.withColumn("where", where)
    return known.select(
        *keys, "k", pick("lo", "lo", "a", "lo", "b").alias("lo"), pick("a", "hi", "b", "hi", "hi").alias("hi"),
        (F.col("below") + pick(F.lit(0), F.lit(0), upto_a, F.lit(0), past)).alias("below"), pick("less", "inside", "between", "inside", F.col("inside") - past).alias("inside"),
        F.when(F.col("where") == 1, a).when(F.col("where") == 3, b).alias("found"),
    )
