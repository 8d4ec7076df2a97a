"""Chat formatting: tool-call linking, DataFrame and SQL functions only.

Calls and results are hash-joined by identifier, calls are put in topological order of what they
come after, their arguments are validated against schemas, and each linked pair is
serialised as canonical JSON: keys sorted at every depth, no spaces, numbers without trailing zeros.

An identifier that stands on several calls (or results) counts once: the row with the smallest
content is taken, and `copies` says how many there were. Calls without a result are
`no_result`, results without a call `no_call`; rows without an identifier link with nothing
and are kept one by one as `no_id`.

Arguments are read as JSON with their types. Null arguments, ones that are no JSON object and ones with a
key that stands twice in one object are a problem of the call, not an error, and are serialised as null; what follows the first
JSON value is not read. A schema's parameter is a name, or names joined by dots for a value inside objects; of objects that no
schema names the keys aren't checked. A JSON null counts as missing.

The level of a call is the number of calls in the longest chain before it, across conversations. Calls in or after a cycle have no
level and are `cyclic`. Identifiers that no call has put nothing in order. Chains in which each call comes after one other are resolved
by doubling, so rounds grow with their logarithm; calls that come after several others are peeled off in rounds, one for
each such call on the longest way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.tables import matched, written

#: Tool schemas: (tool, parameter, kind, required); kinds are string, integer, number, boolean, object and array.
SCHEMAS = (
    ("ask", "chars", "integer", True), ("ask", "place", "object", True), ("ask", "place.conv", "integer", True), ("ask", "place.turn", "integer", False), ("ask", "text", "string", True),
    ("follow_up", "after", "string", True), ("follow_up", "chars", "integer", True), ("follow_up", "place", "object", True), ("follow_up", "place.conv", "integer", True), ("follow_up", "place.turn", "integer", False), ("follow_up", "text", "string", True),
)
#: Which types of the variant reader make up a kind.
KINDS = {"string": "^STRING$", "integer": "^BIGINT$|^DECIMAL[(][0-9]+,0[)]$", "number": "^BIGINT$|^DECIMAL|^DOUBLE$|^FLOAT$", "boolean": "^BOOLEAN$", "object": "^OBJECT<", "array": "^ARRAY<"}


def quoted(x: Column) -> Column:
    """A JSON string; null for null."""
    text = F.to_json(F.array(x))
    return F.when(x.isNotNull(), F.substring(text, 2, F.length(text) - 2))


def arguments_of(text: Column) -> Column:
    """The arguments as a variant; null unless they are one JSON object without repeated keys."""
    value = F.try_parse_json(text)
    return F.when(F.schema_of_variant(value).startswith("OBJECT<"), value)


def problems(arguments: Column, text: Column, params: Column) -> Column:
    """What is wrong with a call's arguments (a variant, and their text), as a sorted list of words."""
    inside = lambda value: value.try_cast("map<string, variant>")
    value = lambda p: F.aggregate(F.split(p["param"], "[.]"), arguments, lambda v, name: F.element_at(inside(v), name))
    kind = lambda p: F.coalesce(F.schema_of_variant(value(p)), F.lit("VOID"))
    missing = F.transform(F.filter(params, lambda p: p["required"] & (kind(p) == "VOID")), lambda p: F.concat(F.lit("missing "), p["param"]))

    def off(p: Column) -> Column:
        wrong = F.lit(False)
        for name, types in KINDS.items():
            wrong = F.when(p["kind"] == name, ~kind(p).rlike(types)).otherwise(wrong)
        return (kind(p) != "VOID") & wrong

    mistyped = F.transform(F.filter(params, off), lambda p: F.concat(F.lit("mistyped "), p["param"]))
    unknown = F.transform(F.array_except(F.map_keys(inside(arguments)), F.transform(params, lambda p: F.substring_index(p["param"], ".", 1))), lambda k: F.concat(F.lit("unknown "), k))
    keys = F.map_keys(F.from_json(text, "map<string,string>"))  # also those of an object that isn't read since a key is repeated
    repeated = F.transform(F.filter(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x == k)) > 1), lambda k: F.concat(F.lit("repeated "), k))
    unread = F.when(F.size(repeated) > 0, F.array_sort(repeated)).when(keys.isNotNull(), F.array(F.lit("repeated key inside"))).otherwise(F.array(F.lit("no object")))
    return F.when(params.isNull(), F.array(F.lit("unknown tool"))).when(arguments.isNull(), unread).otherwise(F.array_sort(F.concat(missing, mistyped, unknown)))


def ordered(calls: DataFrame) -> DataFrame:
    """call_id, level, cyclic for calls (call_id, after: array of identifiers), one row for each call_id."""
    spark = calls.sparkSession
    ids = calls.select("call_id")
    before = calls.select("call_id", F.explode(F.array_distinct("after")).alias("before")).filter("before is not null")
    links = written(spark, before.join(ids.withColumnRenamed("call_id", "before"), "before").select("call_id", "before"), "links")
    # each call points to where its chain begins: a call after none, or after several others
    single = F.when(F.col("n") == 1, F.col("one"))
    at = ids.join(links.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("one")), "call_id", "left")
    at = written(spark, at.select("call_id", F.coalesce(single, "call_id").alias("at"), F.when(F.col("n") == 1, 1).otherwise(0).cast("bigint").alias("steps"), F.coalesce(F.col("n") != 1, F.lit(True)).alias("there"), (F.coalesce("n", F.lit(0)) > 1).alias("joins")), "chains")
    reach, most = 1, at.count()
    while reach <= most and not at.filter("not there").isEmpty():
        ahead = at.select(F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("there").alias("arrived"))
        moved = at.filter("not there").join(ahead, "at").select("call_id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("arrived").alias("there"), "joins")
        at, reach = written(spark, at.filter("there").unionByName(moved), "chains"), reach * 2
    # what has not arrived after that many steps goes round in a cycle
    base = at.filter("there and steps = 0 and not joins").select("call_id", F.lit(0).cast("bigint").alias("level"))
    joining = links.join(at.filter("joins").select("call_id"), "call_id")
    ways = written(spark, joining.join(at.select(F.col("call_id").alias("before"), "at", F.col("steps") + 1, "there").toDF("before", "at", "steps", "there"), "before").select("call_id", "at", "steps", "there"), "ways")
    known, left = base, ways
    while not left.isEmpty():
        tried = left.join(known.select(F.col("call_id").alias("at"), "level"), "at", "left").withColumn("level", F.when(F.col("there"), F.col("level")))
        done = tried.groupBy("call_id").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.col("level") + F.col("steps")).alias("level")).filter("open = 0").select("call_id", "level")
        done = written(spark, done, "peeled")
        if done.isEmpty():
            break
        known = known.unionByName(done)
        left = written(spark, left.join(done.select("call_id"), "call_id", "left_anti"), "ways")
    level = at.filter("there").join(known.select(F.col("call_id").alias("at"), F.col("level").alias("under")), "at").select("call_id", (F.col("under") + F.col("steps")).alias("level"))
    return ids.join(level, "call_id", "left").select("call_id", "level", F.col("level").isNull().alias("cyclic"))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls and their results, one row for each identifier.

    calls: conv_id, turn, call_id, tool, arguments (JSON), after (array of identifiers);
    results: conv_id, turn, call_id, content; schemas: tool, param, kind, required.
    Out: conv_id, turn, call_id, result_turn, status, level, cyclic, valid, problems, copies, json.
    """
    spark = calls.sparkSession
    calls, results = written(spark, calls, "calls"), written(spark, results, "results")
    pick = lambda *cols: F.min(F.struct(*cols)).alias("x")
    own = calls.filter("call_id is not null").groupBy("call_id").agg(pick("turn", "tool", "arguments", "after", "conv_id"), F.count(F.lit(1)).alias("n_calls")).select("call_id", "x.*", "n_calls")
    own = written(spark, own, "calls")
    back = results.filter("call_id is not null").groupBy("call_id").agg(pick("turn", "content", "conv_id"), F.count(F.lit(1)).alias("n_results"))
    back = back.select("call_id", F.col("x.turn").alias("result_turn"), "x.content", F.col("x.conv_id").alias("result_conv"), "n_results")
    params = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("param", "kind", "required"))).alias("params"))  # as many rows as there are tools
    params = written(spark, params, "schemas")
    order = ordered(own)
    both = own.join(back, "call_id", "full").join(order, "call_id", "left")
    both = matched(both, params, ["tool"], "left")
    called = F.col("n_calls").isNotNull()
    both = both.withColumn("args", arguments_of(F.col("arguments")))
    both = both.withColumn("found", F.when(called, problems(F.col("args"), F.col("arguments"), F.col("params"))))
    valid = F.when(called, F.size("found") == 0)
    text = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("args"), F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")),
        F.lit(',"name":'), F.coalesce(quoted(F.col("tool")), F.lit("null")), F.lit(',"result":'), F.coalesce(quoted(F.col("content")), F.lit("null")), F.lit("}"),
    )
    status = F.when(~called, "no_call").when(F.col("n_results").isNull(), "no_result").otherwise("linked")
    out = both.select(
        F.coalesce("conv_id", "result_conv").alias("conv_id"), "turn", "call_id", "result_turn", status.alias("status"), "level", "cyclic", valid.alias("valid"),
        F.array_join("found", ";").alias("problems"), (F.coalesce("n_calls", F.lit(0)) + F.coalesce("n_results", F.lit(0))).alias("copies"), text.alias("json"),
    )
    loose = calls.filter("call_id is null").select("conv_id", "turn", F.lit(None).cast("bigint").alias("result_turn")).union(results.filter("call_id is null").select("conv_id", F.lit(None).cast("bigint"), F.col("turn")))
    nothing = loose.select("conv_id", "turn", "result_turn", F.lit("no_id").alias("status"), F.lit(1).cast("bigint").alias("copies"))
    return out.unionByName(nothing, allowMissingColumns=True)


def from_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    A user's turn is a call made after the one two turns before: of the tool `ask` in the first two turns, then of `follow_up`. An assistant's turn is
    the result for the call of the turn before. Other roles are neither.
    """
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    name = lambda t: F.concat(conv.cast("string"), F.lit("-"), t.cast("string"))
    first = turn < 2
    after = F.when(first, "").otherwise(F.concat(F.lit('"after":'), quoted(name(turn - 2)), F.lit(",")))
    place = F.concat(F.lit('{"turn":'), turn.cast("string"), F.lit(',"conv":'), conv.cast("string"), F.lit("}"))
    arguments = F.concat(F.lit('{"text":'), F.coalesce(quoted(F.col("text")), F.lit("null")), F.lit(","), after, F.lit('"place":'), place, F.lit(',"chars":'), F.coalesce(F.length("text"), F.lit(0)).cast("string"), F.lit("}"))
    calls = rows.filter("role = 'user'").select(conv.alias("conv_id"), turn.alias("turn"), name(turn).alias("call_id"), F.when(first, "ask").otherwise("follow_up").alias("tool"), arguments.alias("arguments"), F.array(name(turn - 2)).alias("after"))
    results = rows.filter("role = 'assistant'").select(conv.alias("conv_id"), turn.alias("turn"), name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def schema_table(spark, schemas=SCHEMAS) -> DataFrame:
    """The schemas as a table, from SQL values."""
    values = ", ".join(f"('{t}', '{p}', '{k}', {str(r).lower()})" for t, p, k, r in schemas)
    return spark.sql(f"SELECT * FROM VALUES {values} AS s(tool, param, kind, required)")
