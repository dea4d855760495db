"""Three-way verdicts over recorded experiment output, and their stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scalars
from quern.operators import texts

REPRODUCED, REFUTED, UNREPRODUCED = "已复现", "不成立", "未能复现"

#: What the output of a run says of its build, and signs that tests ran.
BUILD_FAILED = r"\[build failed\]|\[setup failed\]|cannot find package"
TESTS_RAN = r"(?m)^(=== RUN|--- (PASS|FAIL)|ok\s|PASS|FAIL\s)"


def build_failed(output: Column, rc: Column, timed_out: Column) -> Column:
    return output.rlike(BUILD_FAILED) | ((rc != 0) & ~timed_out & ~output.rlike(TESTS_RAN))


def outcome(output: Column, rc: Column, timed_out: Column) -> Column:
    """timed_out, build_failed, test_failed or passed."""
    return F.when(timed_out, "timed_out").when(build_failed(output, rc, timed_out), "build_failed").when(rc != 0, "test_failed").otherwise("passed")


def arms(runs: DataFrame) -> DataFrame:
    """unit_id with structs benign and malicious: reached, blocked_at, result."""
    found = texts.markers(texts.lines_of(runs, ["unit_id"], "output"), ["unit_id"])
    body = F.struct("reached", "blocked_at", scalars.stable(F.col("result")).alias("result"))
    side = lambda name: F.max_by(body, F.when(F.col("arm") == name, 1))
    return found.groupBy("unit_id").agg(side("benign").alias("benign"), side("malicious").alias("malicious"))


def _reached(arm: str, first_sink: Column) -> Column:
    """A rejecting status is not reached; a block at or after the first sink line is."""
    a = F.col(arm)
    late = (a["reached"] == "no") & (a["blocked_at"] != "none") & (scalars.line_of(a["blocked_at"]) >= first_sink)
    return F.when(scalars.rejected_status(a["result"]).isNotNull(), "no").when(late, "yes").otherwise(a["reached"])


def judged(runs: DataFrame, specs: DataFrame, guards: DataFrame, sinks: DataFrame) -> DataFrame:
    """unit_id, verdict, rule.

    ``runs``: unit_id, output, timed_out, build_failed; ``specs``: unit_id, bug_if (key, op, value);
    ``guards``: unit_id, location; ``sinks``: unit_id, line.
    """
    guard = guards.groupBy("unit_id").agg(F.collect_set("location").alias("guards"))
    first = sinks.groupBy("unit_id").agg(F.min("line").alias("first_sink"))
    j = runs.join(arms(runs), "unit_id", "left").join(specs.select("unit_id", "bug_if"), "unit_id", "left").join(guard, "unit_id", "left").join(first, "unit_id", "left")
    # read the states before markers are adjusted
    missing = F.col("benign.reached").isNull() | F.col("malicious.reached").isNull()
    j = j.withColumns({"b": _reached("benign", F.col("first_sink")), "m": _reached("malicious", F.col("first_sink"))})
    result = lambda arm: F.col(f"{arm}.result")
    holds = lambda arm: scalars.compares(scalars.scalar(F.try_element_at(result(arm), F.col("bug_if.key"))), F.col("bug_if.op"), scalars.scalar(F.col("bug_if.value")))
    known_guard = F.array_contains("guards", F.col("malicious.blocked_at")).eqNullSafe(True) & (F.col("malicious.blocked_at") != "none")
    rule = (
        F.when(F.col("timed_out"), "timeout").when(F.col("build_failed"), "build_failed").when(missing, "markers_missing")
        .when(F.col("b") != "yes", "benign_not_reached")
        .when((F.col("m") == "no") & known_guard, "blocked_by_known_guard").when(F.col("m") == "no", "malicious_not_reached")
        .when(~scalars.measurably_differ(result("benign"), result("malicious")), "arms_indistinguishable")
        .when(holds("malicious").isNull() | holds("benign").isNull(), "bug_if_not_evaluable")
        .when(holds("malicious") & ~holds("benign"), "bug_if_holds_on_malicious_only")
        .when(holds("malicious") & holds("benign"), "benign_also_bug").otherwise("no_bug_observed")
    )
    return j.withColumn("rule", rule).select("unit_id", verdict(F.col("rule")).alias("verdict"), "rule")


def verdict(rule: Column) -> Column:
    return F.when(rule == "bug_if_holds_on_malicious_only", REPRODUCED).when(rule == "blocked_by_known_guard", REFUTED).otherwise(UNREPRODUCED)


def with_prerequisites(units: DataFrame, evidence: DataFrame, judged_: DataFrame) -> DataFrame:
    """Verdicts of all units: what is missing before an experiment comes first.

    ``evidence``: unit_id, buildable, needs_infra.
    """
    j = units.select("unit_id").join(evidence, "unit_id", "left").join(judged_, "unit_id", "left")
    rule = (
        F.when(F.col("buildable").isNull(), "evidence_missing").when(~F.col("buildable"), "package_unbuildable")
        .when(F.col("needs_infra"), "package_needs_infra").when(F.col("rule").isNull(), "no_experiment").otherwise(F.col("rule"))
    )
    return j.withColumn("rule", rule).select("unit_id", verdict(F.col("rule")).alias("verdict"), "rule")


def unstable(first: DataFrame, second: DataFrame) -> DataFrame:
    """Units whose verdict or rule differs between two runs, or that one run lacks."""
    second = second.select("unit_id", F.col("verdict").alias("verdict2"), F.col("rule").alias("rule2"))
    same = F.col("verdict").eqNullSafe(F.col("verdict2")) & F.col("rule").eqNullSafe(F.col("rule2"))
    return first.select("unit_id", "verdict", "rule").join(second, "unit_id", "full").where(~same)


def counts(verdicts: DataFrame, by: str) -> DataFrame:
    """Verdicts of each kind by a column."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.groupBy(by).agg(n(REPRODUCED).alias("reproduced"), n(REFUTED).alias("refuted"), n(UNREPRODUCED).alias("unreproduced"), F.count("*").alias("total"))
