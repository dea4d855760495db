"""The whole way from a producer's output and recorded answers to scored findings, as one plan.

Every step is an operator of this package; nothing is collected, so one call covers any number of
repositories.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import confidence, cvss
from quern.plans import rules as R
from quern.sources import facts

_SCHEMAS = {
    "extraction": "function string, purpose string",
    "inputs": "function string, ord int, line int, origin string, desc string",
    "sinks": "function string, ord int, line int, kind string, desc string",
    "checks": "function string, ord int, line int, category string, desc string",
    "templates": "template_id string, rank int, category string, pattern_names array<string>",
    "sources": "function string, source string, start_line int",
}


@dataclass(frozen=True)
class Recorded:
    """What models and look-ups outside said of functions; ``extraction`` None: all functions were looked at."""

    extraction: DataFrame | None
    inputs: DataFrame
    sinks: DataFrame
    checks: DataFrame
    templates: DataFrame
    sources: DataFrame

    @classmethod
    def nothing(cls, spark: SparkSession) -> "Recorded":
        return cls(**{n: spark.createDataFrame([], s) if n != "extraction" else None for n, s in _SCHEMAS.items()})


def flow_sets(points: DataFrame) -> DataFrame:
    """Of each function the sets that scores need: source_types, sink_types, lines, source_lines, checks."""
    at = lambda kind, c: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col(c))))
    check = F.struct("category", "line")
    return points.groupBy("function").agg(
        at("source", "type").alias("source_types"), at("sink", "type").alias("sink_types"), F.array_sort(F.collect_set("line")).alias("lines"),
        at("source", "line").alias("source_lines"), F.array_sort(F.collect_set(F.when(F.col("kind") == "sanitizer", check))).alias("checks"))


def detected(analysis: DataFrame, recorded: Recorded, rules: R.Rules) -> DataFrame:
    """Findings with template, pattern, evidence, confidence, CVSS and severity.

    Defined cases: functions without points have no findings; an analysis or a record without rows
    gives none; points that repeat count once.
    """
    tables = facts.merged_tables(analysis)
    points = tables["flow_points"].select("function", "kind", "ord", "line", "type", "category", "pattern")
    sources, sinks = R.merged_sources(points, recorded.inputs), R.merged_sinks(points, recorded.sinks, rules)
    checks = R.merged_checks(points, recorded.checks, tables["check_lines"].select("function", "line"), None, rules)
    extraction = recorded.extraction if recorded.extraction is not None else points.select("function").distinct()
    found = R.span_findings(sources, sinks, checks, extraction, rules)
    if "R1" in rules:
        found = found.unionByName(R.size_findings(sources, checks, tables["size_sinks"], tables["range_checks"].select("function", "line", "var")))
    found = R.bound(R.ordered_dedup(found), recorded.templates)
    flows = flow_sets(points)
    known = recorded.templates.select("template_id", "pattern_names", F.col("category").alias("template_category"))
    return cvss.scored(confidence.scored(found, flows, recorded.sources, known), flows)
