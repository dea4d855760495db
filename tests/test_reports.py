"""Reports, prepared records and facts of calls: files written, odd and empty rows."""

import json

import pytest
from pyspark.sql import functions as F

from quern.plans import gates, judge, prepare, producer, reports
from quern.sources import sinks

HUNKS = "k string, n int, file string, start int, header string"
LINES = "k string, file string, n int, line string"
UNITS = "repo string, unit_id int, place int, category string, source_types array<string>, verdict string, rule string"
CALLS = "function string, file string, ord int, line int, prefix string, name string, text string, args array<struct<text:string,roots:array<string>>>"
ALIASES = "file string, alias string, path string"


def test_a_method_comes_before_a_function_and_a_type_of_its_name(spark):
    text = ["type Run struct {", "}", "func Run(x int) {", "}", "func (r *R) Run() {", *["  x()"] * 30, "}"]
    lines = spark.createDataFrame([("k", "a.go", i, x) for i, x in enumerate(text, 1)], LINES)
    hunks = spark.createDataFrame([("k", 3, "a.go", 6, "func Run("), ("k", 1, "a.go", 2, "type Run struct {"), ("k", 5, "a.go", 2, "func None()"), ("k", 6, "b.go", 2, "func Run("), ("k", 7, "a.go", 1, None)], HUNKS)
    got = {r.n: r.source_context.split("\n") for r in prepare.contexts(hunks, lines, ["k"]).collect()}
    assert got == {1: text[4:29], 5: text[:16]}


def test_files_of_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", 1, "v", "r"), ("a_b", 2, "v", "r"), ("a_b", 3, "v", "r"), (None, 4, "v", "r")], "repo string, unit_id int, verdict string, rule string")
    files = {(r.repo, r.file) for r in sinks.collision_safe(rows, "repo").collect()}
    names = [f for _, f in files if f is not None]
    assert len(files) == 3 and len(set(names)) == len(names) and sinks.collision_safe(rows, "repo").count() == 4
    paths = sinks.audit({"units": rows, "none": rows.where("false")}, f"{tmp_path}/audit")
    assert spark.read.parquet(paths["units"]).count() == 4 and spark.read.parquet(paths["none"]).count() == 0
    sinks.candidates(spark.createDataFrame([("x", 2), ("y", 9)], "value string, total int"), 7, {"sources": 3}, 1, f"{tmp_path}/c")
    assert [r.value for r in spark.read.json(f"{tmp_path}/c/candidates").orderBy(F.desc("total")).collect()] == ["y", "x"]
    scan = json.loads(spark.read.json(f"{tmp_path}/c/scan").toJSON().first())
    assert scan == {"records_scanned": 7, "existing_patterns": {"sources": 3}, "already_covered_dropped": 1}
    sinks.units(rows.select("repo", "unit_id"), rows, f"{tmp_path}/u")
    assert spark.read.json(f"{tmp_path}/u/verdicts").count() == 4
    sinks.validation_summary(rows.select("unit_id"), f"{tmp_path}/v", "unit_id")
    assert spark.read.json(f"{tmp_path}/v").count() == 4


def test_odd_units(spark):
    rows = [("r", 1, 1, None, None, judge.REPRODUCED, "x"), ("r", 1, 1, None, None, judge.REPRODUCED, "x"), ("r", 2, None, "access_control", ["read_message"], judge.REPRODUCED, "x"), (None, 3, 1, "c", ["?"], judge.REFUTED, None), ("r", 4, 1, "c", ["scan"], None, None)]
    units = spark.createDataFrame(rows, UNITS)
    assert [(r.unit_id, r.section, r.n) for r in reports.items(units).orderBy("n").collect()] == [(1, "local", 1), (1, "local", 2), (2, "auth", 3)]
    assert [tuple(r) for r in reports.appendix(units).collect()] == [(None, 3, judge.REFUTED, None)]
    assert reports.items(units.where("false")).count() == reports.appendix(units.where("false")).count() == 0


def test_odd_calls(spark):
    calls = spark.createDataFrame([("f", None, 1, 1, "os", "GetId", None, None), ("f", "a", 2, 2, None, "len", "t", []), (None, "a", 3, 3, "", "Get", "y" * 500, [("userId", ["entry"]), (None, None)]), ("f", "a", 4, 4, "x", None, "t", [("r.ID", None)])], CALLS)
    aliases = spark.createDataFrame([("a", "os", "os")] * 2 + [(None, "os", "os")], ALIASES)
    assert {tuple(r) for r in producer.call_types(calls, aliases).collect()} == {("f", "os.GetId", "method", ""), (None, "Get", "method", "")}
    assert [(r.function, r.line, len(r.text)) for r in producer.resource_access(calls, aliases).collect()] == [(None, 3, 120)]
    assert {tuple(r) for r in producer.principal_checks(calls).collect()} == {("f", False), (None, False)}
    assert producer.call_types(calls.where("false"), aliases).count() == 0 and producer.resource_access(calls, aliases.where("false")).count() == 1


@pytest.mark.parametrize("floor, kept", [("none", 5), ("low", 3), ("high", 1)])
def test_missing_severities_are_low_and_unknown_ones_none(spark, floor, kept):
    rows = spark.createDataFrame([(s, 1.0, "c") for s in ("high", "low", None, "odd", "none")], "severity string, confidence double, category string")
    assert gates.filtered_findings(rows, floor=floor).count() == kept


def test_lines_and_contexts_are_never_broadcast(spark, sf_dir):
    """Their plans begin at a file of keys, far smaller than the lines made of it."""
    from quern.plans.queries import QUERIES

    for name in ("source_contexts", "prepared_records", "line_windows"):
        assert "Broadcast" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString(), name
