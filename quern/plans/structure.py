"""Facts from the structure of functions: closures that handle requests, and the conditions under which code goes on.

Defined cases: rows without a function belong to none; a closure without calls has no check and no access; a guard
without identifiers depends on what its condition calls alone; rows that repeat count as often; empty tables give
no rows.  Closures must nest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import spans
from quern.plans import producer


def closure_handlers(closures: DataFrame, calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """function, closure, line, end_line, principal_check and resource_access (line, text) of closures that handle requests.

    ``closures``: function, closure (an id), start, end (tokens), line, end_line, escapes, request (has a parameter of a
    request's type); ``calls``: function, pos (a token), and the columns that ``producer.resource_access`` reads but for function.
    Of nested handlers the outermost counts; the calls of closures inside a handler aren't its own.
    """
    handlers = spans.outermost(closures.where("escapes and request"), ["function"], "start", "end")
    held = spans.innermost(calls, closures, ["function"], "pos", "start", "end", "closure", "__closure").where("__closure is not null")
    own = held.join(handlers.select("function", F.col("closure").alias("__closure")), ["function", "__closure"], "left_semi")
    # a handler stands for the function that its calls belong to
    own = own.withColumn("function", F.to_json(F.struct("function", F.col("__closure").alias("closure"))))
    principal = producer.principal_checks(own)
    accesses = producer.resource_access(own, aliases).groupBy("function").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("resource_access"))
    named = handlers.withColumn("__key", F.to_json(F.struct("function", "closure")))
    facts = named.join(principal.withColumnRenamed("function", "__key"), "__key", "left").join(accesses.withColumnRenamed("function", "__key"), "__key", "left")
    return facts.select("function", "closure", "line", "end_line", F.coalesce("principal_check", F.lit(False)).alias("principal_check"), F.coalesce("resource_access", F.array()).alias("resource_access"))


def guard_chains(guards: DataFrame, assignments: DataFrame, functions: DataFrame) -> DataFrame:
    """function, n, line, condition, returns, kind and depends_on: the conditions that end a function before a line, in order.

    ``guards``: function, ord, line, kind (if or switch-case), has_return, returns, parts: an array of (line, text, idents,
    calls), one for an if and one for each value of a case.  ``assignments``: function, ord, line, names, calls (those of their
    right side).  ``functions``: function, start_line, end_line, target_line (null or 0: the end).

    A guard depends on what its condition calls and on what was called where each of its variables was assigned last,
    at or before the condition: a variable that is assigned anew means its latest value.
    """
    returning = F.when(F.col("kind") == "if", F.col("has_return")).otherwise(F.coalesce("returns", F.lit("")) != "")
    limits = functions.select("function", "start_line", F.when(F.coalesce("target_line", F.lit(0)) > 0, F.col("target_line")).otherwise(F.col("end_line")).alias("__limit"))
    inside = guards.where(returning).join(limits, "function").where(F.col("line").between(F.col("start_line"), F.col("__limit")))
    inside = inside.withColumn("__g", F.struct("line", "ord")).select("function", "__g", "line", "ord", "kind", "returns", "parts")
    part = inside.select("function", "__g", F.posexplode("parts").alias("__p", "part"))
    ident = part.select("function", "__g", "__p", F.col("part.line").alias("at"), F.posexplode("part.idents").alias("__i", "name"))
    # of assignments of one line the first holds
    past = assignments.where(F.size("calls") > 0).select("function", F.explode("names").alias("name"), "line", F.struct((-F.col("ord")).alias("o"), "calls").alias("made")).where("name <> '_'")
    met = spans.latest_at(ident, past.withColumnRenamed("line", "at"), ["function", "name"], "at", "made", "made")
    from_names = met.groupBy("function", "__g", "__p").agg(F.array_sort(F.collect_list(F.struct("__i", F.col("made.calls").alias("calls")))).alias("__by"))
    called = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    by = F.flatten(F.transform(F.coalesce("__by", F.array().cast("array<struct<__i:int,calls:array<string>>>")), lambda x: called(x["calls"])))
    deps = F.filter(F.array_distinct(F.concat(called(F.col("part.calls")), by)), lambda x: x != "")
    each = part.join(from_names, ["function", "__g", "__p"], "left").groupBy("function", "__g").agg(F.array_sort(F.collect_list(F.struct("__p", F.col("part.text").alias("text"), deps.alias("deps")))).alias("__parts"))
    whole = inside.join(each, ["function", "__g"], "left")
    text = F.array_join(F.transform("__parts", lambda x: x["text"]), " | ")
    order = Window.partitionBy("function").orderBy("line", "ord")
    return whole.select(
        "function", F.row_number().over(order).alias("n"), "line", F.when(F.coalesce(text, F.lit("")) == "", "default").otherwise(text).alias("condition"), "returns", "kind",
        F.coalesce(F.flatten(F.transform("__parts", lambda x: x["deps"])), F.array().cast("array<string>")).alias("depends_on"))
