"""Checklist tickets from JSON files: nested, flat or a plain list of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.functions.text import normalise, sequence_number


def stem(path: Column) -> Column:
    """A path's file name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1))


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """source, text: whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def parsed(texts: DataFrame) -> DataFrame:
    """source, substation, mission, ticket_id, entries: array of (key, value) in written order.

    Accepted are an object with `entries` (an object or a list), a flat object, and a list; anything else is an error when read.
    """
    pairs = "map<string,string>"
    tree, listed = F.from_json("text", pairs), F.from_json("text", "array<string>")
    inner = F.element_at(tree, "entries")
    of_list = lambda xs: F.transform(xs, lambda x, i: F.struct((i + 1).cast("string").alias("key"), x.alias("value")))
    of_map = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    is_list = lambda x: F.ltrim(x).startswith("[")
    entries = (
        F.when(is_list(F.col("text")), of_list(listed))
        .when(inner.isNotNull() & is_list(inner), of_list(F.from_json(inner, "array<string>")))
        .when(inner.isNotNull(), of_map(F.from_json(inner, pairs)))
        .when(F.ltrim("text").startswith("{") & tree.isNotNull(), of_map(tree))
    )
    checked = F.when(entries.isNull(), F.raise_error(F.concat(F.lit("no ticket: "), F.coalesce("source", F.lit("?"))))).otherwise(entries)
    head = lambda k: F.coalesce(F.when(inner.isNotNull(), F.element_at(tree, k)), F.lit(""))
    return texts.select("source", head("substation").alias("substation"), head("mission").alias("mission"), head("id").alias("ticket_id"), checked.alias("entries"))


def items(tickets: DataFrame, key: str = "source") -> DataFrame:
    """key, seq, pos, raw, norm: one row per entry, in order of seq, then as written."""
    each = tickets.select(key, F.posexplode("entries").alias("i", "e"))
    numbered = each.select(key, sequence_number(F.col("e.key"), F.col("i") + 1).alias("seq"), "i", F.coalesce("e.value", F.lit("")).alias("raw"))
    ordered = numbered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "i", "raw"))).alias("x"))  # a ticket has few entries
    flat = ordered.select(key, F.posexplode("x").alias("pos", "x"))
    return flat.select(key, "x.seq", "pos", "x.raw", normalise(F.col("x.raw")).alias("norm"))


def by_seq(items_: DataFrame, seq: int) -> DataFrame:
    """The first item of each ticket with this number."""
    return items_.filter(F.col("seq") == seq).groupBy(*[c for c in items_.columns if c not in ("pos", "raw", "norm")]).agg(F.min_by(F.struct("pos", "raw", "norm"), "pos").alias("x")).select("*", "x.*").drop("x")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """ticket (file stem), number and the parsed columns of every JSON file of a folder; sort by number, ticket."""
    found = parsed(raw_texts(spark, f"{path.rstrip('/')}/*.json")).withColumn("ticket", stem(F.col("source")))
    return found.withColumn("number", F.coalesce(F.regexp_extract("ticket", "(\\d+)$", 1).try_cast("int"), F.lit(10**9)))


def lexicon_entries(tickets: DataFrame) -> DataFrame:
    """ticket, seq, entry, for the lexicon."""
    return tickets.select("ticket", F.explode("entries").alias("e")).select("ticket", F.col("e.key").alias("seq"), F.col("e.value").alias("entry"))


def assets(texts: DataFrame) -> DataFrame:
    """term of an asset list (column `value`, a line each): normalised, without blank and # lines, distinct; longest first."""
    line = F.btrim("value", F.lit(" \t\r\n"))
    terms = texts.filter((line != "") & ~F.col("value").startswith("#")).select(normalise(line).alias("term")).filter("term <> ''").distinct()
    return terms.orderBy(-F.length("term"), "term")


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """An asset list file; a missing one is empty."""
    from pyspark.errors import AnalysisException

    try:
        return assets(spark.read.text(path))
    except AnalysisException:
        return assets(spark.createDataFrame([], "value string"))
