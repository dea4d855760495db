"""Evidence of candidates: references into a source snapshot, claims, verdicts, order of work.

Defined cases: a reference with a null text, file or line equals nothing in the snapshot, unless a function's docstring says
otherwise; candidates without a response are unknown; claims that repeat prove no more than one; of equal places in an order
the smaller id comes first; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scalars

#: Kinds of claims.
CLAIM_KINDS = ("input", "operation", "impact", "protection", "contradiction")


def valid_references(refs: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """References whose quoted lines are those of the snapshot, but for leading white space.

    ``refs``: key columns, file, start_line, end_line, text.  ``lines``: file, n, line.  A reference is
    compared line by line: its lines meet the snapshot's by (file, line number).
    """
    each = refs.select(*key, "file", "start_line", "end_line", F.posexplode(F.split("text", "\n")).alias("i", "quoted"), F.size(F.split("text", "\n")).alias("n_lines"))
    each = each.withColumn("n", F.col("start_line") + F.col("i"))
    met = each.join(lines, ["file", "n"], "left")
    bare = lambda c: F.regexp_replace(c, r"^\s+", "")
    same = (bare("quoted") == bare("line")).eqNullSafe(True)
    group = [*key, "file", "start_line", "end_line"]
    judged = met.groupBy(*group).agg(F.bool_and(same).alias("same"), F.bool_or(F.trim("quoted") != "").alias("some"), F.max("n_lines").alias("n_lines"))
    good = judged.where(F.col("same") & F.col("some") & (F.col("n_lines") == F.col("end_line") - F.col("start_line") + 1)).select(*group)
    return refs.join(good, group, "left_semi")


#: What is said of a further reference that doesn't match, and what is asked because of it.
MISMATCH = "secondary_source_reference_mismatch"
REBOUND = "function_id_rebound_to_cited_operation"
ASK_PATH = "Verify the cross-function source path: a secondary citation did not match the snapshot."


def referenced(candidates: DataFrame, refs: DataFrame, lines: DataFrame) -> DataFrame:
    """Candidates (candidate, questions) with evidence, reference_warnings (index, reason) and one question more where a reference is doubtful.

    ``refs``: candidate, position (from 0), file, start_line, end_line, text (null: not quoted).  The first reference must
    hold, or its candidate drops; further ones that don't are left out of the evidence and named in a warning.  A
    reference without a quote holds if its lines are there and not all blank.
    """
    place = ["candidate", "position", "file", "start_line", "end_line"]
    quoted = valid_references(refs.where("text is not null"), lines, ["candidate", "position"]).select(*place)
    ranged = refs.where("text is null and start_line >= 1 and start_line <= end_line")
    # the lines of a file are numbered without gaps, so a range is whole if its last line is there
    ends = ranged.join(lines.select("file", F.col("n").alias("end_line")), ["file", "end_line"], "left_semi")
    some = lines.where(F.col("line").rlike(r"\S")).select("file", F.col("n").alias("said"))
    both = ends.select(*place).withColumn("at", F.col("end_line")).unionByName(some.withColumn("at", F.col("said")), allowMissingColumns=True)
    # the last line with text up to the end lies in the range
    ahead = Window.partitionBy("file").orderBy("at", F.col("said").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = both.withColumn("__last", F.last("said", ignorenulls=True).over(ahead)).where("candidate is not null and __last >= start_line").select(*place)
    good = quoted.unionByName(whole).distinct().withColumn("__good", F.lit(True))
    judged = refs.select(*place).join(good, place, "left").groupBy("candidate").agg(
        F.array_sort(F.collect_list(F.when(F.col("__good"), F.struct("position", "file", "start_line", "end_line")))).alias("evidence"),
        F.array_sort(F.collect_list(F.when(F.col("__good").isNull(), F.struct(F.col("position").alias("index"), F.lit(MISMATCH).alias("reason"))))).alias("reference_warnings"),
        F.bool_or((F.col("position") == 0) & F.coalesce("__good", F.lit(False))).alias("__first"))
    out = candidates.join(judged.where("__first").drop("__first"), "candidate")
    asked = F.coalesce("questions", F.array().cast("array<string>"))
    return out.withColumn("evidence", F.transform("evidence", lambda e: e.dropFields("position"))).withColumn("questions", F.when(F.size("reference_warnings") > 0, F.concat(asked, F.array(F.lit(ASK_PATH)))).otherwise(asked))


def rebound_warnings(bound_: DataFrame) -> DataFrame:
    """``bound_candidates`` with reference_warnings (reason, original, resolved) for those that went to another function."""
    told = F.struct(F.lit(REBOUND).alias("reason"), F.col("rebound_from").alias("original_function_id"), F.col("function_id").alias("resolved_function_id"))
    return bound_.withColumn("reference_warnings", F.array_compact(F.array(F.when(F.col("rebound_from").isNotNull(), told))))


def bound_candidates(candidates: DataFrame, functions: DataFrame) -> DataFrame:
    """Candidates with function_id: their own where it encloses the primary reference, else the only one that does, else dropped.

    ``candidates``: candidate, function_id, file, start_line, end_line; ``functions``: function_id, file, line, end_line.
    """
    f = functions.select(F.col("function_id").alias("fid"), "file", F.col("line").alias("f_line"), F.col("end_line").alias("f_end"))
    inside = candidates.join(f, "file").where((F.col("f_line") <= F.col("start_line")) & (F.col("end_line") <= F.col("f_end")))
    per = inside.groupBy(*candidates.columns).agg(F.bool_or(F.col("fid") == F.col("function_id")).alias("own"), F.count("*").alias("n"), F.min("fid").alias("only"))
    return per.where(F.col("own") | (F.col("n") == 1)).select(
        *[c for c in candidates.columns if c != "function_id"], F.when(F.col("own"), F.col("function_id")).otherwise(F.col("only")).alias("function_id"),
        F.when(~F.col("own"), F.col("function_id")).alias("rebound_from"))


def verdicts(candidates: DataFrame, responses: DataFrame, claims: DataFrame, claim_refs: DataFrame) -> DataFrame:
    """candidate, status, reason: what recorded responses establish.

    ``candidates``: candidate, file, sink_line; ``responses``: candidate, answered (the id it names), status,
    reason, unresolved (number of); ``claims``: candidate, claim, kind, statement; ``claim_refs``: candidate,
    claim, file, start_line, end_line, valid.
    """
    refs = claim_refs.groupBy("candidate", "claim").agg(F.bool_and("valid").alias("refs_valid"))
    anchor = claim_refs.join(candidates.select("candidate", F.col("file").alias("c_file"), "sink_line"), "candidate").where((F.col("file") == F.col("c_file")) & F.col("sink_line").between(F.col("start_line"), F.col("end_line"))).select("candidate", "claim").distinct().withColumn("covers", F.lit(True))
    j = claims.join(refs, ["candidate", "claim"], "left").join(anchor, ["candidate", "claim"], "left")
    good = F.col("kind").isin(*CLAIM_KINDS) & (F.coalesce(F.trim("statement"), F.lit("")) != "") & F.coalesce("refs_valid", F.lit(False))
    has = lambda k: F.bool_or(F.col("kind") == k)
    per = j.groupBy("candidate").agg(
        F.bool_and(good).alias("valid"), (has("input") & has("operation") & has("impact")).alias("full"),
        (has("protection") | has("contradiction")).alias("against"), F.bool_or((F.col("kind") == "operation") & F.coalesce("covers", F.lit(False))).alias("anchored"))
    r = candidates.select("candidate").join(responses, "candidate", "left").join(per, "candidate", "left")
    no = F.lit(False)
    required = F.when(F.col("status") == "supported", F.coalesce("full", no)).otherwise(F.coalesce("against", no)) & F.coalesce("anchored", no)
    known = F.col("status").isin("supported", "refuted", "unknown") & (F.coalesce(F.trim("reason"), F.lit("")) != "") & (F.col("answered") == F.col("candidate"))
    enough = F.coalesce("valid", no) & (F.col("unresolved") == 0) & required
    bad = ~F.coalesce(known, no)
    weak = (F.col("status") != "unknown") & ~F.coalesce(enough, no)
    status = F.when(bad | weak, "unknown").otherwise(F.col("status"))
    reason = F.when(bad, "invalid_verdict").when(weak, "insufficient_or_invalid_evidence").otherwise(F.col("reason"))
    return r.select("candidate", status.alias("status"), reason.alias("reason"))


def candidate_id(c: dict[str, Column], semantic: Column) -> Column:
    """24 digits from function, category, lines, path (an array) and, of semantic candidates, the hypothesis."""
    text, number = scalars.json_text, scalars.json_number
    parts = [text(c["function"]), text(c["category"]), number(c["source_line"]), number(c["sink_line"]), scalars.json_texts(c["path"]), text(F.when(semantic, c["hypothesis"]))]
    return scalars.content_id(parts)


def group_id(finding_id: Column, function: Column, sink_line: Column, category: Column) -> Column:
    """24 digits from function, sink line and category; candidates without a place are groups of their own."""
    text = scalars.json_text
    placed = scalars.content_id([text(function), scalars.json_number(sink_line), text(F.coalesce(category, F.lit("other_security")))])
    return F.when((F.coalesce(function, F.lit("")) == "") | sink_line.isNull(), scalars.content_id([text(F.lit("unlocated")), text(finding_id)])).otherwise(placed)


def merged(candidates: DataFrame) -> DataFrame:
    """One row for each finding_id: the first by ``ord``, with the origins of all, in order."""
    kept = [c for c in candidates.columns if c not in ("finding_id", "origins", "ord")]
    return candidates.groupBy("finding_id").agg(
        F.min_by(F.struct(*kept), "ord").alias("r"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "origins"))), lambda x: x["origins"])).alias("origins")
    ).select("finding_id", "r.*", "origins")


def triage_queue(candidates: DataFrame) -> DataFrame:
    """Candidates in order: those that need review, by file, line and id; ``place`` from 1 in each repository."""
    order = Window.partitionBy("repo").orderBy((~F.col("needs_review")), "file", "line", "finding_id")
    return candidates.withColumn("place", F.row_number().over(order))


def partial(units: DataFrame, budget_left: int) -> DataFrame:
    """repo, partial: whether a unit of it is pending or failed, or no calls are left."""
    return units.groupBy("repo").agg((F.bool_or(F.col("status").isin("pending", "error", "partial")) | F.lit(budget_left <= 0)).alias("partial"))


def schedule(work: DataFrame, budget: int) -> DataFrame:
    """Round-robin over groups: each group's items in order, one a round, within the budget of calls.

    ``work``: run, grp, group_ord, item, item_ord, semantic (first), representative (before members).  The
    order of a run is a sort by (round, kind, group), so no sequential loop is needed.
    """
    in_group = Window.partitionBy("run", "grp").orderBy(F.desc("semantic"), F.desc("representative"), "item_ord", "item")
    rounds = work.withColumn("round", F.row_number().over(in_group))
    in_run = Window.partitionBy("run").orderBy("round", F.desc("semantic"), "group_ord", "grp", "item_ord", "item")
    return rounds.withColumn("turn", F.row_number().over(in_run)).withColumn("status", F.when(F.col("turn") <= budget, "done").otherwise("pending"))
