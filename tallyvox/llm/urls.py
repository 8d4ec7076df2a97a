"""URL filtering by association rules, DataFrame and SQL functions only.

URLs that a given host-and-path rule judges are the labelled ones. FP-growth mines
combinations of URL tokens together with the verdict; rules from tokens to a verdict are kept
if their confidence, support and lift suffice and no rule of some of their tokens, with the same verdict, is as
sure. Tokens that the given rules name themselves are not mined: the labels come from those rules,
so such tokens would only say them again, and beyond where they hold. The kept rules form an inverted index under each one's rarest token. A URL that no given rule
fits is looked up there by its tokens; of the rules whose tokens it has all, the surest wins
(then the better supported, the longer one, and `block` before `allow`). Without one, it is allowed.

Tokens are the labels of the host but for its first ones that are numbers, the directories of the path, and the keys of the query; numbers
are left out. URLs with the same tokens are looked up once.

A null URL, or one without `://`, has an empty host and path and no tokens.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.tables import matched, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUPPORT, CONFIDENCE, LIFT = 0.002, 0.9, 1.2
WIDE = 10  # tokens of one basket that FP-growth combines at once; others are split by their rarest tokens first
#: Fixed values of the contract: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and query of a URL; empty for a null URL or one without ://."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    return host, path, query


def tokens(host: Column, path: Column, query: Column) -> Column:
    """The distinct tokens of a URL, sorted; pure numbers and a page's name are left out."""
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: (x != "") & ~x.rlike("^[0-9]+([.][a-z]+)?$")), lambda x: F.concat(F.lit(kind), x))
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(named("h:", F.split(host, "[.]")), named("p:", F.split(path, "/")), named("q:", keys))))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest given rule that fits, as host and path in one, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


RULE = "id bigint, antecedent array<string>, members array<array<string>>, says string, confidence double, support double, anchor string"


def single_tokens(rows: DataFrame, least: int) -> DataFrame:
    """token, says, n_says, n, leader of the tokens that stand `least` times with a verdict; rows: id, tokens, verdict.

    The leader is the smallest of the tokens that stand in exactly the same rows (told by two 64-bit sums over the
    rows' numbers); null if every row of the token has the same verdict.
    """
    spread = F.xxhash64("id")
    counted = rows.select("id", "verdict", F.explode("tokens").alias("token")).groupBy("token", "verdict").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(spread).alias("x"), F.bit_xor(F.xxhash64(spread, F.lit(1))).alias("y"))
    every = F.collect_list(F.struct("verdict", "n"))  # as many as there are verdicts
    tokens_of = counted.groupBy("token").agg(every.alias("by"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter(F.exists("by", lambda v: v["n"] >= least))
    tokens_of = written(rows.sparkSession, tokens_of, "tokens")
    leaders = tokens_of.filter("size(by) > 1").groupBy("n", "x", "y").agg(F.min("token").alias("leader"))
    led = tokens_of.join(leaders, ["n", "x", "y"], "left").withColumn("leader", F.when(F.size("by") > 1, F.col("leader")))
    found = led.select("token", "n", "leader", F.explode("by").alias("v")).select("token", F.col("v.verdict").alias("says"), F.col("v.n").alias("n_says"), "n", "leader")
    return written(rows.sparkSession, found, "tokens")


def least_shared(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, by (verdict and n), n in all of those that stand `least` times with a verdict; counts: keys, verdict, n."""
    every = F.collect_list(F.struct("verdict", "n"))  # as many as there are verdicts
    return counts.groupBy(*keys).agg(every.alias("by"), F.sum("n").alias("n")).filter(F.exists("by", lambda v: v["n"] >= least))


def split_by_first(rows: DataFrame, prefixes: DataFrame, reach: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every row once for each of its tokens, with the later ones it can still be combined with.

    rows: no, rest, verdict; prefixes: no, prefix (the tokens that all rows of the number have had); reach: no, token, n (the rows
    of the number with the token). Returns the combinations of prefix and two more tokens (prefix, by, n) and rows, prefixes and reach
    of the next step. A pair isn't followed if its rows have one verdict, or are all the rows of either of its tokens: no longer
    combination with it is then surer than one of fewer tokens.
    """
    spark = rows.sparkSession
    firsts = rows.select("no", "verdict", "rest", F.posexplode("rest").alias("at", "first")).select("no", "first", "verdict", F.expr("slice(rest, at + 2, size(rest))").alias("rest")).filter("size(rest) > 0")
    firsts = written(spark, firsts, "firsts")
    counts = firsts.select("no", "first", "verdict", F.explode("rest").alias("second")).groupBy("no", "first", "second", "verdict").agg(F.count(F.lit(1)).alias("n"))
    shared = written(spark, least_shared(counts, ["no", "first", "second"], least), "pairs")
    found = matched(shared, prefixes, ["no"], "inner").select(F.concat("prefix", F.array("first", "second")).alias("prefix"), "by", "n")
    one, two = reach.select("no", F.col("token").alias("first"), F.col("n").alias("n_first")), reach.select("no", F.col("token").alias("second"), F.col("n").alias("n_second"))
    open_ = matched(matched(shared.filter("size(by) > 1"), one, ["no", "first"], "inner"), two, ["no", "second"], "inner").filter("n < n_first and n < n_second").select("no", "first", "second", "n")
    open_ = written(spark, open_, "open")
    heads = written(spark, open_.groupBy("no", "first").agg(F.collect_list("second").alias("near")).withColumn("next", F.monotonically_increasing_id()), "heads")
    rows = matched(firsts, heads, ["no", "first"], "inner").select(F.col("next").alias("no"), F.array_intersect("rest", "near").alias("rest"), "verdict").filter("size(rest) > 1")
    next_ = heads.select("no", "first", "next")
    prefixes = matched(next_, prefixes, ["no"], "inner").select(F.col("next").alias("no"), F.concat("prefix", F.array("first")).alias("prefix"))
    reach = matched(open_, next_, ["no", "first"], "inner").select(F.col("next").alias("no"), F.col("second").alias("token"), "n")
    return found, written(spark, rows, "rows"), written(spark, prefixes, "prefixes"), written(spark, reach, "reach")


def grown(rows: DataFrame, prefixes: DataFrame, least: int) -> DataFrame:
    """prefix, by, n of the combinations of a prefix and two or more of its rows' tokens, by FP-growth; each number's rows are counted apart."""
    spark = rows.sparkSession
    mark = lambda x: F.concat(F.col("no").cast("string"), F.lit("|"), x)
    marked = written(spark, rows.select(F.concat(F.transform("rest", lambda t: mark(F.concat(F.lit("t"), t))), F.array(mark(F.concat(F.lit("="), "verdict")))).alias("items")), "baskets")
    n = marked.count()
    if not n:
        return spark.createDataFrame([], "prefix array<string>, by array<struct<verdict:string,n:bigint>>, n bigint")
    # the support is a share of the baskets, so that it comes out at `least` of them
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n), minConfidence=1.0, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(marked)
    split = F.transform("items", lambda x: F.substring(x, F.instr(x, "|") + 1, F.length(x)))
    sets = model.freqItemsets.filter("size(items) > 1").select(F.substring_index(F.col("items")[0], "|", 1).cast("bigint").alias("no"), split.alias("items"), "freq")
    sets = sets.select("no", "freq", F.array_sort(F.transform(F.filter("items", lambda x: x.startswith("t")), lambda x: F.substring(x, 2, F.length(x)))).alias("more"), F.get(F.filter("items", lambda x: x.startswith("=")), F.lit(0)).alias("says"))
    sets = written(spark, sets.filter("size(more) > 1"), "itemsets")
    alone = sets.filter("says is null").select("no", "more", F.col("freq").alias("n"))
    by = F.array(F.struct(F.substring("says", 2, F.length("says")).alias("verdict"), F.col("freq").alias("n"))).alias("by")
    found = sets.filter("says is not null").select("no", "more", by).join(alone, ["no", "more"])
    return matched(found, prefixes, ["no"], "inner").select(F.concat("prefix", "more").alias("prefix"), "by", "n")


def combinations(baskets: DataFrame, sizes: DataFrame, least: int, wide: int) -> DataFrame:
    """antecedent (two or more leaders, sorted), says, n_says, n of the combinations that stand `least` times with a verdict.

    sizes: leader, n. As long as a basket holds more than `wide` tokens, all are split by their first token, rarest first, which
    leaves out only what can't be part of a rule that is kept; FP-growth mines the rest. Counts are of all baskets.
    """
    spark = baskets.sparkSession
    digits = 19
    named = F.concat(F.lpad(F.col("n").cast("string"), digits, "0"), "leader")  # sorts the rarest first
    sizes = written(spark, sizes.select("leader", "n", named.alias("token")), "sizes")
    rows = matched(baskets.select("id", "verdict", F.explode("leaders").alias("leader")), sizes, ["leader"], "inner").groupBy("id", "verdict").agg(F.array_sort(F.collect_list("token")).alias("rest"))
    rows = written(spark, rows.filter("size(rest) > 1").select(F.lit(0).cast("bigint").alias("no"), "rest", "verdict"), "rows")
    prefixes, reach = spark.createDataFrame([(0, [])], "no bigint, prefix array<string>"), sizes.select(F.lit(0).cast("bigint").alias("no"), "token", "n")
    every = []
    while (rows.agg(F.max(F.size("rest"))).first()[0] or 0) > wide:
        found, rows, prefixes, reach = split_by_first(rows, prefixes, reach, least)
        every.append(written(spark, found, "found"))
    every.append(grown(rows, prefixes, least))
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    bare = F.array_sort(F.transform("prefix", lambda x: F.substring(x, digits + 1, F.length(x))))
    return out.select(bare.alias("antecedent"), "n", F.explode("by").alias("v")).filter(F.col("v.n") >= least).select("antecedent", F.col("v.verdict").alias("says"), F.col("v.n").alias("n_says"), "n")


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, wide: int = WIDE) -> DataFrame:
    """Pruned rules from labelled (tokens, verdict), see RULE: a URL fits if of each of `members` it has a token; one row for each anchor.

    Combinations are pruned before they are mined: a token whose rows all have one verdict can't be part of a longer rule
    that is surer, and tokens that always stand together are one. Baskets of more than `wide` of the remaining tokens
    don't change the result: all are then split by their rarest tokens, and what is left out can't give a rule that is kept. So work grows with the
    combinations that stand often enough, have both verdicts and are narrower than each of their parts, and FP-growth never meets
    more than 2^wide sets of a basket.
    """
    spark = labelled.sparkSession
    rows = written(spark, labelled.select(F.monotonically_increasing_id().alias("id"), F.array_distinct("tokens").alias("tokens"), "verdict"), "labelled")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], RULE)
    least = max(1, math.ceil(support * total - 1e-9))
    prior = written(spark, rows.groupBy(F.col("verdict").alias("says")).agg((F.count(F.lit(1)) / total).alias("prior")), "verdicts")  # as many as there are verdicts
    singles = single_tokens(rows, least)
    leaders = written(spark, singles.filter("leader is not null").select("token", "leader").distinct(), "leaders")
    shared = matched(rows.select("id", "verdict", F.explode("tokens").alias("token")), leaders, ["token"], "inner")
    baskets = written(spark, shared.groupBy("id", "verdict").agg(F.collect_set("leader").alias("leaders")), "baskets")
    both = combinations(baskets, singles.filter("token = leader").select("leader", "n").distinct(), least, wide)
    one = singles.filter((F.col("n_says") >= least)).select(F.array("token").alias("antecedent"), "says", "n_says", "n")
    sure = F.when((F.col("n_says") / F.col("n") >= confidence) & (F.col("n_says") / F.col("n") / F.col("prior") >= lift), F.col("n_says") / F.col("n"))
    sets = one.unionByName(both).join(F.broadcast(prior), "says").select("antecedent", "says", sure.alias("confidence"), (F.col("n_says") / total).alias("support"), "n")
    sets = written(spark, sets, "itemsets")
    # a rule is redundant if one of fewer of its tokens is as sure; upwards by length, each from those one shorter. If one of those is
    # missing it was left out as of one verdict or as wide as a part of it, and so the longer rule is redundant too
    kept, longest = sets.filter("size(antecedent) = 1 and confidence is not null"), sets.agg(F.max(F.size("antecedent"))).first()[0] or 0
    best = sets.filter("size(antecedent) = 1").select("antecedent", "says", F.col("confidence").alias("best"))
    for size in range(2, longest + 1):
        own = sets.filter(F.size("antecedent") == size)
        less = own.select(F.col("antecedent").alias("whole"), "says", F.explode("antecedent").alias("gone")).select("whole", "says", F.array_remove("whole", F.col("gone")).alias("antecedent"))
        under = less.join(best, ["antecedent", "says"]).groupBy(F.col("whole").alias("antecedent"), "says").agg(F.max("best").alias("under"), F.count(F.lit(1)).alias("parts")).filter(F.col("parts") == size).drop("parts")
        own = written(spark, own.join(under, ["antecedent", "says"]), "rules")
        kept = kept.unionByName(own.filter("confidence > coalesce(under, 0)").drop("under"))
        best = own.select("antecedent", "says", F.greatest("confidence", "under").alias("best"))
    kept = written(spark, kept.withColumn("id", F.monotonically_increasing_id()), "rules")
    of = leaders.groupBy("leader").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    parts = kept.select("id", F.size("antecedent").alias("size"), F.posexplode("antecedent").alias("at", "leader"))
    sizes = singles.select(F.col("token").alias("leader"), "n").distinct()
    # a rule of one token stands for that token alone, since the others of its kind have rules of their own
    parts = parts.join(of, "leader", "left").join(sizes, "leader").withColumn("tokens", F.when((F.col("size") == 1) | F.col("tokens").isNull(), F.array("leader")).otherwise(F.col("tokens")))
    rarest = parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"]).alias("members"), F.min(F.struct("n", "leader", "tokens"))["tokens"].alias("anchors"))
    return written(spark, kept.join(rarest, "id").select("id", "antecedent", "members", "says", "confidence", "support", F.explode("anchors").alias("anchor")), "rules")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the association rule, if one decided); one row per row of pages."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.struct(*(c.alias(n) for c, n in zip(parts(F.col("url")), ("host", "path", "query")))).alias("u"))
    rows = rows.select("page_id", "u.host", "u.path", tokens(F.col("u.host"), F.col("u.path"), F.col("u.query")).alias("tokens"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = written(spark, rows.select("page_id", "host", "path", "tokens", rule.alias("rule"), verdict.alias("given")), "urls")
    named = sorted({"h:" + x for _, h, _ in rules for x in h.split(".")} | {"p:" + x for _, _, p in rules for x in p.split("/") if x})
    rows = rows.withColumn("tokens", F.array_except("tokens", F.array(*map(F.lit, named)))) if named else rows
    index = mined(rows.filter("given is not null").select("tokens", F.col("given").alias("verdict")), support, confidence)
    key = F.concat_ws(" ", "tokens").alias("key")
    sets = written(spark, rows.filter("rule is null and size(tokens) > 0").select(key, "tokens").distinct().withColumn("no", F.monotonically_increasing_id()), "sets")
    # of a URL with many tokens only those travel that are an anchor
    hits = written(spark, matched(sets.select("no", F.explode("tokens").alias("anchor")), index.select("anchor", "id"), ["anchor"], "inner").select("no", "id").distinct(), "hits")
    found = matched(sets.join(hits, "no"), index.drop("anchor").distinct(), ["id"], "inner").filter(F.forall("members", lambda m: F.arrays_overlap(m, "tokens")))
    surest = F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), "says")).alias("best")
    verdicts = written(spark, found.groupBy("key").agg(surest).select("key", F.col("best.says").alias("says"), F.col("best.confidence").alias("confidence")), "verdicts")
    out = matched(rows.withColumn("key", F.when(F.col("rule").isNull(), key)), verdicts, ["key"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "says", F.lit(default)).alias("verdict"), F.when(F.col("given").isNull(), F.col("confidence")).alias("confidence"))
