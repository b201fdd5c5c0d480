"""Chat formatting: tool calls linked with their results.

Calls and results are joined by identifier; a call may come after several others (``after``,
an array of identifiers).  Levels order the calls topologically: a call's level is one more
than the highest level before it.  Runs of calls with one predecessor each are jumped over by
pointer doubling, so a chain of n calls takes log2(n) joins; calls with several predecessors
follow in Kahn's rounds, one for each layer of such calls.  No conversation is gathered in a
task.  Arguments are validated against the tool's schema with their JSON types, and everything
is written as canonical JSON (keys sorted at every depth, no blanks), one row per call, ordered
within a conversation by (level, turn).

:func:`formatted` gives whole conversations: turns of other roles (system, tool, none) are
rows of their own, by their role's name, not linked.

Defined results: rows of a repeated identifier that differ are rows of their own, numbered
from the smallest arguments or content: the first keeps the identifier, the n-th gets #n
behind it, and equal numbers are linked; calls after the identifier follow its first; rows
that are alike in all columns are one; a result without a call and a call without a result
are rows too (``linked`` false); unknown and null predecessors do not count (a call with no
other starts at level 0); calls on a cycle, and all that come after one, have level null;
arguments that are null, no JSON object, followed by more text, or that repeat a key are
invalid, as are unknown keys and values of another type; what is no JSON stands in the
result as a string; null identifiers link with nothing and are left out, as are turns
without a conversation or number; texts may be of any length and stay whole; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stored, words

#: The schema of the one tool that the query derives from conversations: type, whether
#: required, and the bounds of a string's length or a number's value.
SCHEMAS = {"reply": {"prompt": ("string", True, 1, 4000), "words": ("integer", True, 1, 2000)}}
#: The types of a schema and how Spark names them.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of calls (call_id, after: an identifier or an array of them)."""
    several = calls.schema["after"].dataType.typeName() == "array"
    ids = stored(calls.select("call_id", (F.col("after") if several else F.array("after")).alias("after")), "order")
    edges = ids.select("call_id", F.explode(F.array_distinct("after")).alias("before"))
    edges = stored(edges.join(ids.select(F.col("call_id").alias("before")).distinct(), "before"), "edges")
    count = edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("before").alias("before"))
    # a call with one predecessor points to it; all others are their own ends
    jump = ids.select("call_id").join(count, "call_id", "left")
    jump = stored(jump.select("call_id", F.expr("CASE WHEN n = 1 THEN before ELSE call_id END").alias("top"), F.expr("CASE WHEN n = 1 THEN 1L ELSE 0L END").alias("steps"), F.expr("NOT (n <=> 1L)").alias("over"), F.coalesce("n", F.lit(0)).alias("n")), "jumps")
    reach, total = 1, jump.count()
    while reach <= total and jump.filter("NOT over").limit(1).count():
        far = jump.select(F.col("call_id").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("over").alias("done"))
        jump = stored(jump.join(far, "top").select("call_id", F.col("next").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), F.col("done").alias("over"), "n"), "jumps")
        reach *= 2
    ends = stored(jump.filter("over AND n <> 1").select(F.col("call_id").alias("top"), "n", F.expr("CASE WHEN n = 0 THEN 0L END").alias("level")), "ends")
    known = ends.filter("level IS NOT NULL").select("top", "level")
    open_ = ends.filter("level IS NULL").select("top")
    way = jump.filter("over").select(F.col("call_id").alias("before"), F.col("top").alias("end"), (F.col("steps") + 1).alias("steps"))
    if open_.limit(1).count():
        # Kahn's rounds over the calls with several predecessors, each with its ends and the steps to them
        need = edges.withColumnRenamed("call_id", "top").join(open_, "top").join(way, "before", "left").select("top", "end", "steps")
        need = stored(need, "needs")
        while True:
            there = known.select(F.col("top").alias("end"), "level")
            step = need.join(there, "end", "left").groupBy("top").agg(F.max(F.expr("level IS NULL")).alias("waits"), F.max(F.expr("level + steps")).alias("level"))
            ready = stored(step.filter("NOT waits").select("top", "level"), "ready")
            if not ready.limit(1).count():
                break
            known = known.union(ready)
            need = stored(need.join(ready.select("top"), "top", "left_anti"), "needs")
    out = jump.join(known, "top", "left")
    return out.select("call_id", F.expr("CASE WHEN over THEN level + steps END").alias("level"))


def parsed(rows: DataFrame, arguments: str = "arguments") -> DataFrame:
    """``rows`` with ``_value``, a whole JSON value as a variant, or null for anything else."""
    # in brackets, as text behind a value is ignored by the parser but is an error within an array
    whole = rows.withColumn("_whole", F.expr(f"try_parse_json(concat('[', {arguments}, ']'))"))
    value = "CASE WHEN try_variant_get(_whole, '$[1]', 'variant') IS NULL THEN try_variant_get(_whole, '$[0]', 'variant') END"
    return whole.withColumn("_value", F.expr(value)).drop("_whole")


def fits(arguments: str, value: str, name: str, schemas: dict) -> Column:
    """Whether the JSON ``arguments``, parsed to ``value``, are an object as the schema of the tool ``name`` asks for."""
    held = F.lit(False)
    for tool, fields in schemas.items():
        keys = ", ".join("'" + k.replace("'", "\\'") + "'" for k in fields)
        ok = F.expr(f"schema_of_variant({value}) LIKE 'OBJECT%' AND size(array_except(json_object_keys({arguments}), array({keys}))) = 0")
        for key, (kind, required, least, most) in fields.items():
            at = f"try_variant_get({value}, '$[\"{key}\"]', '{{0}}')"
            typed = F.expr(f"schema_of_variant({at.format('variant')})").rlike(f"^{TYPES[kind]}$")
            if kind == "string":
                typed = typed & F.length(F.expr(at.format("string"))).between(least, most)
            elif kind in ("integer", "number"):
                typed = typed & F.expr(at.format("double")).between(least, most)
            there = F.array_contains(F.expr(f"json_object_keys({arguments})"), key)
            ok = ok & F.when(there, F.coalesce(typed, F.lit(False))).otherwise(not required)
        held = F.when(F.col(name) == tool, ok).otherwise(held)
    return F.coalesce(held, F.lit(False))


def numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The different rows of each identifier, which gets #n from the second on."""
    place = F.row_number().over(Window.partitionBy("call_id").orderBy(*columns))
    n = rows.filter("call_id IS NOT NULL").select("call_id", *columns).distinct().withColumn("_n", place)
    return n.withColumn("call_id", F.expr("CASE WHEN _n = 1 THEN call_id ELSE concat(call_id, '#', _n) END")).drop("_n")


def formatted(conversations: DataFrame) -> DataFrame:
    """All turns of conversations, in the columns of :func:`linked`."""
    other = conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND coalesce(role NOT IN ('user', 'assistant'), true)")
    ident = F.concat_ws("-", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    text = F.coalesce("text", F.lit(""))
    rows = numbered(other.select("conv_id", "turn", ident.alias("call_id"), text.alias("content"), F.col("role").alias("name")), ["content", "conv_id", "turn", "name"])
    none, no = F.lit(None).cast("string"), F.lit(False)
    rows = rows.withColumns({"level": F.lit(None).cast("long"), "valid": no, "linked": no})
    body = F.struct(none.alias("arguments"), "content", F.col("call_id").alias("id"), "level", "linked", "name", "valid")
    rows = rows.withColumn("json", F.to_json(body, {"ignoreNullFields": "false"}))
    out = linked(*calls_of(conversations))
    return out.unionByName(rows.select(*out.columns))


def linked(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per (numbered) identifier from ``calls`` (conv_id, turn, call_id, after, name, arguments)
    and ``results`` (conv_id, turn, call_id, content): conv_id, turn, call_id, level, valid, linked, json."""
    one = stored(numbered(calls, ["arguments", "conv_id", "turn", "after", "name"]), "calls")
    said = numbered(results, ["content", "conv_id", "turn"]).select("call_id", F.struct("content", "conv_id", "turn").alias("r"))
    out = one.withColumn("is_call", F.lit(True)).join(levels(one), "call_id").join(said, "call_id", "full_outer")
    out = parsed(out)
    valid = F.col("is_call").isNotNull() & fits("arguments", "_value", "name", schemas)
    out = out.withColumns({"valid": valid, "linked": F.col("is_call").isNotNull() & F.col("r").isNotNull()})
    held = F.expr("coalesce(_value, CAST(arguments AS VARIANT))").alias("arguments")
    body = F.struct(held, F.col("r.content").alias("content"), F.col("call_id").alias("id"), "level", "linked", "name", "valid")
    return out.select(
        F.coalesce("conv_id", "r.conv_id").alias("conv_id"), F.coalesce("turn", "r.turn").alias("turn"), "call_id", "level", "valid", "linked",
        F.to_json(body, {"ignoreNullFields": "false"}).alias("json"),
    )


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that lie in plain conversations: a user's turn calls ``reply``, after
    the user's turn two places before, and the assistant's next turn is the result."""
    ident = lambda shift: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - shift).cast("string"))
    known = conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    text = F.coalesce("text", F.lit(""))
    arguments = F.to_json(F.struct(text.alias("prompt"), F.size(words(text, SPACES)).alias("words")))
    calls = known.filter("role = 'user'").select("conv_id", "turn", ident(0).alias("call_id"), F.array(ident(2)).alias("after"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = known.filter("role = 'assistant'").select("conv_id", "turn", ident(1).alias("call_id"), text.alias("content"))
    return calls, results
