"""Look-ups that a recorded conversation asked for, replayed over all conversations at once.

A run is a conversation of at most ``ROUNDS`` turns.  An answer either finishes or asks for one to three look-ups; anything
else ends the run with what is wrong with it.  ``outcomes`` finds where each run ends; ``results`` routes the look-ups
of all turns before to their tools in one plan: every tool is a join by equality (a line, a symbol's grams, a function),
so the cost is that of what is found, however many runs there are; what many runs ask for is looked up once.

Requests are untyped JSON: a number must be a JSON integer, a name a JSON string, or the look-up is an error, not a crash.

Defined cases: a run without answers has no outcome; a turn that repeats is answered once; unknown tools, files and
functions, and ranges outside a file are errors; what passes a cap is ``truncated``; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import matching
from quern.plans.binding import _at, _is, _text

#: Turns of a run, look-ups of a turn, lines and characters of a reading, hits of a search, characters of a symbol and a field.
ROUNDS, REQUESTS, MAX_LINES, MAX_CHARS, MAX_HITS, MAX_SYMBOL, MAX_FIELD = 6, 3, 240, 18_000, 100, 200, 120
READS, EDGES = ("read_lines", "read_function"), ("get_callers", "get_callees")
TOOLS = (*READS, *EDGES, "search_symbol", "find_field_uses", "get_taint_path")

_HIT = "struct<file: string, line: int, text: string, function_ids: array<string>>"


def _parsed(responses: DataFrame) -> DataFrame:
    """run, turn, requests (array of variant) and how the answer ends the run, if it does."""
    v = F.col("v")
    requests = F.when(_is(_at(v, "$.requests"), "ARRAY"), F.try_variant_get(_at(v, "$.requests"), "$", "array<variant>"))
    action = _text(_at(v, "$.action"))
    good = (F.size("requests") >= 1) & (F.size("requests") <= REQUESTS) & F.forall("requests", lambda r: _is(r, "OBJECT"))
    once = responses.dropDuplicates(["run", "turn"]).select("run", "turn", F.try_parse_json("response").alias("v"), "error")
    ends = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("model_error: "), "error")).when(~_is(v, "OBJECT"), "invalid_response")
        .when(F.col("action") == "finish", "finished").when(~F.coalesce((F.col("action") == "query") & good, F.lit(False)), "invalid_query_protocol"))
    return once.withColumn("action", action).withColumn("requests", requests).select("run", "turn", "requests", ends.alias("ends"))


def outcomes(responses: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """run, turns (that were answered) and outcome: finished, what was wrong, investigation_budget_exhausted, or pending where answers end early.

    ``responses``: run, turn (from 1), response (JSON), error (null, or of the model).
    """
    ended = _parsed(responses).where(F.col("turn") <= rounds).groupBy("run").agg(F.min(F.when(F.col("ends").isNotNull(), F.struct("turn", "ends"))).alias("e"), F.max("turn").alias("last"))
    late = F.when(F.col("last") >= rounds, "investigation_budget_exhausted").otherwise("pending")
    return ended.select("run", F.coalesce("e.turn", "last").alias("turns"), F.coalesce("e.ends", late).alias("outcome"))


def requests_of(responses: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """run, turn, ord, tool and arguments of the look-ups before each run's end, with ``error`` where they can't be done."""
    parsed = _parsed(responses).where(F.col("turn") <= rounds)
    end = parsed.where("ends is not null").groupBy("run").agg(F.min("turn").alias("__end"))
    open_ = parsed.join(end, "run", "left").where(F.col("__end").isNull() | (F.col("turn") < F.col("__end")))
    each = open_.select("run", "turn", F.posexplode("requests").alias("ord", "r"))
    r = F.col("r")
    text = lambda name: _text(_at(r, f"$.{name}"))
    number = lambda name: F.when(_is(_at(r, f"$.{name}"), "BIGINT"), F.try_variant_get(r, f"$.{name}", "int"))
    tool, prefix, kind = text("tool"), _at(r, "$.path_prefix"), _at(r, "$.type_id")
    some = each.select("run", "turn", "ord", tool.alias("tool"), text("file").alias("file"), number("start_line").alias("start"), number("end_line").alias("end"), text("symbol").alias("symbol"), text("field").alias("field"), F.coalesce(text("path_prefix"), F.lit("")).alias("prefix"), text("type_id").alias("type_id"), text("function_id").alias("function_id"),
                       (prefix.isNotNull() & ~_is(prefix, "STRING")).alias("__odd_prefix"), (kind.isNotNull() & ~_is(kind, "VOID") & ~F.coalesce(F.length(_text(kind)).between(1, 240), F.lit(False))).alias("__odd_type"))
    symbol = F.coalesce(F.length("symbol").between(1, MAX_SYMBOL), F.lit(False))
    field = F.coalesce(F.col("field").rlike(r"^[\p{L}_][\p{L}\p{N}_]*$") & (F.length("field") <= MAX_FIELD), F.lit(False))
    safe = ~F.col("__odd_prefix") & ~F.startswith("prefix", F.lit("/")) & ~F.col("prefix").rlike(r"(^|/)\.\.(/|$)")
    error = (
        F.when(F.col("tool") == "read_lines", F.when(F.col("file").isNull() | F.col("start").isNull() | F.col("end").isNull(), "invalid range"))
        .when(F.col("tool") == "search_symbol", F.when(~symbol, "invalid symbol"))
        .when(F.col("tool") == "find_field_uses", F.when(~field, "invalid field").when(~safe, "invalid path prefix").when(F.col("__odd_type"), "invalid type_id"))
        .when(F.col("function_id").isNull(), "unknown function_id"))
    return some.withColumn("error", error).drop("__odd_prefix", "__odd_type")


def _named(hits: DataFrame, functions: DataFrame) -> DataFrame:
    """Hits (key, file, line, text) with the functions that hold their line, by place and not by pairs of all."""
    at = functions.select("file", "function_id", F.explode(F.sequence("line", "end_line")).alias("line"))
    held = at.groupBy("file", "line").agg(F.array_sort(F.collect_set("function_id")).alias("function_ids"))
    return hits.join(held.hint("merge"), ["file", "line"], "left").withColumn("function_ids", F.coalesce("function_ids", F.array().cast("array<string>")))


#: What a tool goes by; all others go by a function.
ARGUMENTS = {"read_lines": ("file", "start", "end"), "search_symbol": ("symbol",), "find_field_uses": ("field", "prefix", "type_id")}


def _look(requests: DataFrame) -> DataFrame:
    """``requests`` with ``__look``: a text that is the same for look-ups of the same tool and arguments."""
    named, by = F.coalesce("tool", F.lit("")), {}
    for c in ("file", "start", "end", "symbol", "field", "prefix", "type_id"):
        by[c] = F.when(named.isin(*[t for t, args in ARGUMENTS.items() if c in args]), F.col(c))
    by["function_id"] = F.when(~named.isin(*ARGUMENTS), F.col("function_id"))
    good = F.struct("tool", *[c.alias(name) for name, c in by.items()])
    return requests.withColumn("__look", F.to_json(F.struct("error", F.when(F.col("error").isNull(), good).alias("asks"))))


def results(requests: DataFrame, lines: DataFrame, functions: DataFrame, uses: DataFrame, edges: DataFrame, taints: DataFrame, shown: dict[str, Column] | None = None) -> DataFrame:
    """run, turn, ord, tool, matches (file, line, text, function_ids; in order), truncated and error of every look-up.

    ``lines``: file, n, line; ``functions``: function_id, file, name, line, end_line; ``uses``: file, ord, name, line, type_id,
    expression; ``edges``: caller, callee (function ids; null where unresolved), file, line; ``taints``: function_id, ord, path.
    ``shown``: columns of ``matches`` to return in its place, where not all of it is wanted.

    What many ask for is looked up once: tools meet their tables by the distinct look-ups, and only answers go to those who asked.
    Tables of lines, and what is made of them, are joined by sorting, as the files they come from tell little of their size.
    """
    asking, requests = _look(requests), _look(requests).dropDuplicates(["__look"])
    key = ["__look"]
    asked = requests.where(F.col("error").isNull())
    sizes = lines.groupBy("file").agg(F.max("n").alias("__lines"))
    spans_ = functions.select("function_id", F.col("file").alias("__file"), F.col("line").alias("__start"), F.col("end_line").alias("__end"))

    # reading: at most MAX_LINES lines, and as many as MAX_CHARS hold
    whole = asked.where(F.col("tool") == "read_lines").select(*key, "tool", "file", "start", "end").unionByName(
        asked.where(F.col("tool") == "read_function").join(spans_, "function_id").select(*key, "tool", F.col("__file").alias("file"), F.col("__start").alias("start"), F.col("__end").alias("end")))
    ranged = whole.join(sizes.hint("merge"), "file", "left").withColumn("last", F.least("end", F.col("start") + MAX_LINES - 1))
    inside = F.coalesce((F.col("start") >= 1) & (F.col("start") <= F.col("last")) & (F.col("last") <= F.col("__lines")), F.lit(False))
    outside = ranged.where(~inside).select(*key, F.when(F.col("__lines").isNull(), "unknown file").otherwise("line range outside source").alias("late"))
    each = ranged.where(inside).withColumn("n", F.explode(F.sequence("start", "last"))).join(lines.hint("merge"), ["file", "n"])
    order = Window.partitionBy(*key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.sum(F.length("line") + 1).over(order) - 1 <= MAX_CHARS
    read = each.withColumn("__fits", fits).withColumn("truncated", F.min("__fits").over(Window.partitionBy(*key)) == F.lit(False)).withColumn("truncated", F.col("truncated") | (F.col("last") < F.col("end")))
    read = read.where(F.col("__fits") | (F.col("n") == F.col("start"))).select(*key, "file", F.col("n").alias("line"), F.substring("line", 1, MAX_CHARS).alias("text"), "truncated", F.struct(F.lit(""), F.col("n").cast("long").alias("n")).alias("place"))

    def first(hits: DataFrame, by: list[str], *place: Column) -> DataFrame:
        """The first MAX_HITS hits of each look-up, or of what look-ups have in common."""
        numbered = hits.withColumn("place", F.struct(*place)).withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("place", "text"))).where(F.col("__r") <= MAX_HITS + 1)
        more = F.max("__r").over(Window.partitionBy(*by)) > MAX_HITS
        return numbered.withColumn("truncated", more).where(F.col("__r") <= MAX_HITS).select(*by, "file", "line", "text", "truncated", F.struct(F.lit(""), F.col("__r").cast("long").alias("n")).alias("place"))

    searched = asked.where(F.col("tool") == "search_symbol").select(*key, "symbol")
    pairs = matching.contained(lines, "line", searched, "symbol")
    found = lines.join(pairs.hint("merge"), F.col("line") == F.col("__text")).select(F.col("__pattern").alias("symbol"), "file", F.col("n").alias("line"), F.col("line").alias("text"))
    found = searched.join(first(found, ["symbol"], F.col("file"), F.col("line")), "symbol").drop("symbol")
    wanted = asked.where(F.col("tool") == "find_field_uses").select(*key, F.col("field").alias("name"), "prefix", F.col("type_id").alias("__type"))
    used = uses.withColumnRenamed("ord", "__ord").join(wanted, "name").where(F.startswith("file", F.col("prefix")) & (F.col("__type").isNull() | (F.col("type_id") == F.col("__type"))))
    used = first(used.select(*key, "file", "__ord", "line", F.col("expression").alias("text")), key, F.col("file"), F.col("__ord"))
    edge = edges.select("caller", "callee", F.col("file"), F.col("line"))
    called = asked.where(F.col("tool") == "get_callers").join(edge.select(F.col("callee").alias("function_id"), F.col("caller").alias("text"), F.col("file").alias("at"), F.col("line").alias("l")), "function_id")
    calling = asked.where(F.col("tool") == "get_callees").join(edge.select(F.col("caller").alias("function_id"), F.coalesce("callee", F.lit("")).alias("text"), F.col("file").alias("at"), F.col("line").alias("l")), "function_id")
    linked = first(called.unionByName(calling).select(*key, F.col("at").alias("file"), F.col("l").alias("line"), "text"), key, F.col("file"), F.col("line"))
    traced = asked.where(F.col("tool") == "get_taint_path").join(taints.select("function_id", F.col("ord").alias("n"), "path"), "function_id").select(*key, F.lit("").alias("file"), F.lit(0).alias("line"), F.col("path").alias("text"), F.lit(False).alias("truncated"), F.struct(F.lit(""), F.col("n").cast("long").alias("n")).alias("place"))
    hits = read
    for more in (found, used, linked, traced):
        hits = hits.unionByName(more)
    hit = F.struct("place", F.struct("file", "line", "text", "function_ids").alias("hit"))
    per = _named(hits, functions).groupBy(*key).agg(F.array_sort(F.collect_list(hit)).alias("__hits"), F.bool_or("truncated").alias("truncated"))
    named = F.coalesce("tool", F.lit(""))
    known = asked.where(F.col("function_id").isNotNull() & ~named.isin("read_lines", "search_symbol", "find_field_uses")).join(functions.select("function_id").distinct().hint("merge"), "function_id", "left_anti").select(*key, F.lit("unknown function_id").alias("late"))
    odd = asked.where(~named.isin(*TOOLS)).join(functions.select("function_id").distinct().hint("merge"), "function_id", "left_semi").select(*key, F.lit("tool not allowed").alias("late"))
    late = outside.unionByName(known).unionByName(odd).dropDuplicates(key)
    out = requests.select(*key, "error").join(per, key, "left").join(late, key, "left")
    matches = F.coalesce(F.transform("__hits", lambda h: h["hit"]), F.array().cast(f"array<{_HIT}>"))
    answers = out.select(*key, matches.alias("matches"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("error", "late").alias("error"))
    shown = {"matches": F.col("matches")} if shown is None else shown
    answers = answers.select(*key, *[c.alias(name) for name, c in shown.items()], "truncated", "error")
    return asking.select("run", "turn", "ord", "tool", *key).join(answers.hint("merge"), key).select("run", "turn", "ord", "tool", *shown, "truncated", "error")
