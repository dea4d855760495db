"""Finding rules composed of the operators: spans without a protecting step, and their kin.

Tables, all keyed by ``function`` ("file:Recv.Name"):

* flow_points: kind (source, sink, sanitizer), ord, line, type, category, pattern
* extraction: purpose; inputs: ord, line, origin, desc; sinks: ord, line, kind, desc;
  checks: ord, line, category, desc
* check_lines: line; size_sinks and range_checks: line, type, var, pattern
* taint_facts: sink_line, sink_type, sink_desc, source_line, source_desc, provenance, path
* templates: template_id, rank, category, pattern_names

Defined cases: rows with a null function meet no others; facts that repeat add no finding to a rule that collapses
(span, R2, R4), whose earliest sink stays, of equals the one with the least source line, then type; functions without facts
have no findings; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import aggregates, spans
from quern.plans import seeds

#: Phrases that reports use.
WEAK_CHECK = "弱校验 "
NO_STRONG_CHECK = "函数内未见该用途的强校验"
CALL, CALL_HOLDS, CALL_END = "调用 ", "（含 ", " 强校验）"
EVIDENCE = "L%d %s → L%d %s，跨度内无 %s 检查"

KNOWN = ("v2", "R1", "R2", "R3", "R4", "R5", "F1", "F2", "F3", "F4", "G1", "X1", "X2", "X3", "X4")


@dataclass(frozen=True)
class Rules:
    """Which rules and refinements take part; unknown names are refused."""

    on: frozenset[str] = field(default_factory=lambda: frozenset({"v2"}))
    retain: bool = False

    def __post_init__(self):
        unknown = sorted(set(self.on) - set(KNOWN))
        if unknown:
            raise ValueError(f"unknown rules: {', '.join(unknown)}")

    def __contains__(self, name: str) -> bool:
        return name in self.on

    @classmethod
    def of(cls, text: str, retain: bool = False) -> "Rules":
        return cls(frozenset(x.strip() for x in text.split(",") if x.strip()), retain)


FINDING = (
    "function", "category", "source_line", "source_type", "source_desc", "sink_line", "sink_type", "sink_desc", "rule_id",
    "template_id", "source_provenance", "taint_path", "purpose_inferred", "aligned_ratio", "peers_present", "chain_generic",
)
_KINDS = {"source_line": "int", "sink_line": "int", "taint_path": "array<string>", "purpose_inferred": "boolean", "aligned_ratio": "double", "peers_present": "int", "chain_generic": "boolean"}


def _finding(df: DataFrame, **columns: Column) -> DataFrame:
    get = lambda c: columns.get(c, F.col(c) if c in df.columns else F.lit(None))
    return df.select(*[get(c).cast(_KINDS.get(c, "string")).alias(c) for c in FINDING])


def merged_sources(flow_points: DataFrame, inputs: DataFrame) -> DataFrame:
    spark = flow_points.sparkSession
    strong = flow_points.where("kind = 'source' and line > 0 and type is not null").select("function", "line", "type", F.col("pattern").alias("desc"), "ord")
    origins = F.broadcast(seeds.mapping(spark, seeds.ORIGIN_TYPES, "origin", "type"))
    weak = inputs.where("line > 0").join(origins, "origin").select("function", "line", "type", "desc", "ord")
    return spans.merged_facts(strong, weak, ["function"], "line", "type", "desc")


def merged_sinks(flow_points: DataFrame, sinks: DataFrame, rules: Rules) -> DataFrame:
    spark = flow_points.sparkSession
    strong = flow_points.where("kind = 'sink' and line > 0 and type is not null").select("function", "line", "type", F.col("pattern").alias("desc"), "ord")
    kinds = seeds.KIND_TYPES | (seeds.SHAPE_KIND_TYPES if "X2" in rules else {})
    weak = sinks.where("line > 0").withColumnRenamed("kind", "__kind").join(F.broadcast(seeds.mapping(spark, kinds, "__kind", "type")), "__kind").select("function", "line", "type", "desc", "ord")
    return spans.merged_facts(strong, weak, ["function"], "line", "type", "desc")


def merged_checks(flow_points: DataFrame, checks: DataFrame, check_lines: DataFrame | None, callee_checks: DataFrame | None, rules: Rules) -> DataFrame:
    """function, line, category, desc, strong: sanitizers and observed checks; with F4, the latter only beside lines that could hold one."""
    strong = flow_points.where("kind = 'sanitizer' and line > 0 and category is not null").select("function", "line", "category", F.col("pattern").alias("desc"), "ord")
    weak = checks.where("line > 0 and category is not null").select("function", "line", "category", "desc", "ord")
    merged = spans.merged_facts(strong, weak, ["function"], "line", "category", "desc", exclusive=False)
    if "X3" in rules and callee_checks is not None:
        merged = merged.unionByName(callee_checks.select("function", "line", "category", "desc", F.lit(True).alias("strong")))
    if "F4" in rules and check_lines is not None:
        near = spans.near_any(merged.where("not strong"), check_lines, ["function"], "line", 1)
        merged = merged.where("strong").unionByName(near)
    return merged


def span_findings(sources: DataFrame, sinks: DataFrame, checks: DataFrame, extraction: DataFrame, rules: Rules) -> DataFrame:
    """The span rule, up to collapse; with ``retain``, protected spans stay and nothing collapses."""
    spark = sources.sparkSession
    pairs = spans.span_join(sources, sinks, ["function"], "line")
    if not rules.retain:
        pairs = pairs.join(extraction.select("function").distinct(), "function", "left_semi")
    if "F3" in rules:
        pairs = pairs.where(~F.col("sink_type").isin(*seeds.GENERIC_SINKS))
    hints = F.broadcast(seeds.category_hints(spark).select("category", F.col("source_type").alias("hs"), F.col("sink_type").alias("hk")))
    shaped = pairs.where(F.col("sink_type").isin(*seeds.SHAPE_CATEGORIES)) if "X2" in rules else pairs.where("false")
    plain = pairs.where(~F.col("sink_type").isin(*seeds.SHAPE_CATEGORIES)) if "X2" in rules else pairs
    plain = plain.join(hints, (F.col("source_type") == F.col("hs")) & (F.col("hk").isNull() | (F.col("hk") == F.col("sink_type")))).drop("hs", "hk").withColumn("shaped", F.lit(False))
    shapes = F.broadcast(seeds.shape_categories(spark))
    both = plain.unionByName(shaped.join(shapes, "sink_type").withColumn("shaped", F.lit(True)))
    if not rules.retain:
        both = spans.unprotected(both, checks, ["function", "category"])
    if "F3" in rules:
        both = both.where(F.col("shaped") | ~F.col("category").isin(*seeds.SOURCE_ONLY))
    if not rules.retain:
        both = collapse(both)
    return _finding(both, rule_id=F.lit("v2_span"))


def collapse(spans_: DataFrame) -> DataFrame:
    """One span for each (category, sink), by the earliest source; of source-only categories the widest one."""
    wide = F.col("category").isin(*seeds.SOURCE_ONLY) & ~F.col("shaped")
    keyed = spans_.withColumn("__key", F.when(wide, F.lit(-1)).otherwise(F.col("sink_line")))
    rank = [F.when(wide, -F.abs(F.col("sink_line") - F.col("source_line"))).otherwise(0), F.col("source_line"), F.col("sink_line"), F.col("source_type"), F.col("sink_type")]
    return spans.collapsed(keyed, ["function", "category", "__key"], rank).drop("__key")


def source_only_findings(sources: DataFrame, sinks: DataFrame, checks: DataFrame) -> DataFrame:
    """Functions with sources but no sink: the categories that need none, unless any check of theirs exists."""
    spark = sources.sparkSession
    alone = sources.join(sinks.select("function").distinct(), "function", "left_anti")
    hints = F.broadcast(seeds.category_hints(spark).where("sink_type is null").select("category", F.col("source_type").alias("type")))
    found = alone.join(hints, "type").join(checks.select("function", "category").distinct(), ["function", "category"], "left_anti")
    first = spans.collapsed(found, ["function", "category"], [F.col("line"), F.col("type")])
    return _finding(first, source_line=F.col("line"), source_type=F.col("type"), source_desc=F.col("desc"), sink_line=F.col("line"), sink_type=F.lit("none"), sink_desc=F.lit(""), rule_id=F.lit("v2_span"))


def size_findings(sources: DataFrame, checks: DataFrame, size_sinks: DataFrame, range_checks: DataFrame) -> DataFrame:
    """Allocation sizes and indexes after an external source, without a check of the variable or of their kind between."""
    spark = sources.sparkSession
    kinds = F.broadcast(seeds.mapping(spark, seeds.SIZE_CATEGORIES, "type", "category"))
    first = sources.where(F.col("type").isin(*seeds.SIZE_SOURCES)).groupBy("function").agg(
        F.min(F.struct("line", "type", "desc")).alias("s"))
    sized = size_sinks.join(kinds, "type").join(first, "function").where(F.col("s.line") < F.col("line"))
    sized = sized.select("function", "line", "type", "var", "pattern", "category", F.col("s.line").alias("lo"), F.col("line").alias("hi"), F.col("s.type").alias("source_type"), F.col("s.desc").alias("source_desc"))
    open_ = spans.unprotected(sized, range_checks.select("function", "var", "line"), ["function", "var"], closed_low=True)
    guards = checks.where(F.col("category").isin(*seeds.SIZE_GUARDS)).select("function", "line")
    open_ = spans.unprotected(open_, guards, ["function"])
    one = spans.collapsed(open_, ["function", "category", "line"], [F.col("var"), F.col("pattern")])
    return _finding(one, source_line=F.col("lo"), sink_line=F.col("line"), sink_type=F.col("type"), sink_desc=F.concat_ws(" → ", F.coalesce("var", F.lit("")), F.substring("pattern", 1, 60)), rule_id=F.lit("R1"))


def taint_findings(facts: DataFrame, checks: DataFrame, range_checks: DataFrame | None, rules: Rules) -> DataFrame:
    """Tainted parameters in sinks, by category the earliest sink without a check from the source on."""
    spark = facts.sparkSession
    kinds = F.broadcast(seeds.mapping(spark, seeds.TAINT_CATEGORIES, "sink_type", "category"))
    read = F.col("sink_type") == "unbounded_read"
    wanted = (read if "R4" in rules else F.lit(False)) | (~read if "R2" in rules else F.lit(False))
    spans_ = facts.where(wanted).join(kinds, "sink_type").withColumns({"lo": F.col("source_line"), "hi": F.col("sink_line")})
    if not rules.retain:
        # a read is bounded by its reader alone, whatever checks surround it
        judged = spans.unprotected(spans_.where(~read), checks.select("function", "category", "line"), ["function", "category"], closed_low=True)
        if range_checks is not None:
            sizes = spans.unprotected(judged.where("sink_type = 'alloc_size'"), range_checks.select("function", "line"), ["function"], closed_low=True)
            judged = judged.where("sink_type <> 'alloc_size'").unionByName(sizes)
        spans_ = judged.unionByName(spans_.where(read))
        spans_ = spans.collapsed(spans_, ["function", "category"], [F.col("sink_line"), F.col("source_line"), F.col("sink_type")])
    return _finding(spans_, source_type=F.lit("param_external"), source_provenance=F.col("provenance"), taint_path=F.col("path"), rule_id=F.when(read, "R4").otherwise("R2"))


def with_protections(findings: DataFrame, checks: DataFrame, range_checks: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """Findings with protection_hypotheses (kind, line, what) of their function, where protected ones were retained: checks by line, then range checks, then sanitizers.

    ``checks``: function, line, category; ``range_checks``: function, line, var; ``sanitizers``: function, line, pattern.
    """
    some = lambda df, rank, kind, what: df.select("function", F.struct(F.lit(rank).alias("rank"), "line", F.col(what).alias("what"), F.lit(kind).alias("kind")).alias("p"))
    every = some(checks, 0, "check", "category").unionByName(some(range_checks, 1, "range_check", "var")).unionByName(some(sanitizers, 2, "sanitizer", "pattern"))
    per = every.groupBy("function").agg(F.array_sort(F.collect_list("p")).alias("__p"))
    told = F.transform(F.coalesce("__p", F.array()), lambda p: F.struct(p["kind"].alias("kind"), p["line"].alias("line"), p["what"].alias("what")))
    return findings.join(per, "function", "left").withColumn("protection_hypotheses", told).drop("__p")


def _matched(rows: DataFrame, text: str, patterns: list[tuple[str, dict]]) -> DataFrame:
    """Rows with the columns of each pattern (a regular expression; a rule, so few) that their text matches: no join."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(x), F.struct(*[F.lit(v).alias(n) for n, v in columns.items()])) for x, columns in patterns]))
    return rows.withColumn("__hit", F.explode(hits)).select(*rows.columns, "__hit.*")


def validator_findings(validators: DataFrame, purposes: DataFrame, check_facts: DataFrame, rules_table: dict | None = None, infer: bool = False) -> DataFrame:
    """Externally reachable validators whose body holds no strong check of the purpose they serve.

    ``validators``: function, name, last_result, line, end_line, source_line (first use of a tainted
    parameter, 0 if none), params (names of the tainted ones), provenance, path.  ``purposes``:
    function, purpose (from callers' sinks).  ``check_facts``: function, line, text.
    """
    table = rules_table or seeds.PURPOSES
    category = F.element_at(F.create_map(*[F.lit(x) for p, (c, *_) in table.items() for x in (p, c)]), F.col("purpose"))
    checks = [(x, {"purpose": p, "strong": strong}) for p, (_, _, _, s, w) in table.items() for strong, xs in ((True, s), (False, w)) for x in xs]
    named = F.col("name").rlike(seeds.VALIDATOR_NAME)
    fit = validators.where(named & (F.col("name").rlike(seeds.VALIDATOR_VERB) | F.col("last_result").isin("bool", "error")))
    direct = fit.join(purposes.select("function", "purpose").distinct(), "function").withColumn("inferred", F.lit(False))
    if infer:
        silent = fit.join(purposes.select("function").distinct(), "function", "left_anti").withColumn("__p", F.explode("params"))
        by_name = _matched(silent, "__p", [(n, {"purpose": p}) for p, (_, _, n, _, _) in table.items() if n is not None]).drop("__p").distinct()
        direct = direct.unionByName(by_name.withColumn("inferred", F.lit(True)))
    hits = _matched(check_facts, "text", checks).select("function", "purpose", "strong", "line", "text")
    open_ = direct.join(hits.where("strong").select("function", "purpose").distinct(), ["function", "purpose"], "left_anti")
    weak = hits.where("not strong").groupBy("function", "purpose").agg(F.min(F.struct("line", "text")).alias("w"))
    out = open_.withColumn("category", category).where("category is not null").join(weak, ["function", "purpose"], "left")
    source = F.when(F.col("source_line") > 0, F.col("source_line")).otherwise(F.coalesce("line", F.lit(1)))
    sink = F.when(F.col("w.line") > source, F.col("w.line")).otherwise(F.coalesce(F.when(F.col("end_line") > 0, F.col("end_line")), source + 1))
    desc = F.when(F.col("w").isNotNull(), F.concat(F.lit(WEAK_CHECK), F.substring("w.text", 1, 60))).otherwise(NO_STRONG_CHECK)
    return _finding(out, source_line=source, source_type=F.lit("param_external"), sink_line=sink, sink_type=F.lit("validator_contract"), sink_desc=desc, source_provenance=F.col("provenance"), taint_path=F.col("path"), purpose_inferred=F.col("inferred"), rule_id=F.lit("R3"))


def purposes_of(call_sites: DataFrame, sinks: DataFrame, resolved: DataFrame) -> DataFrame:
    """function, purpose of validators whose value or argument flows on to a sink of the caller.

    ``call_sites``: site, function, line, name; ``sinks``: function, type, roots; ``resolved``: site, fid.
    """
    spark = call_sites.sparkSession
    by_sink: dict[str, str] = {}
    for purpose in sorted(seeds.PURPOSES):
        for s in seeds.PURPOSES[purpose][1]:
            by_sink.setdefault(s, purpose)
    marks = call_sites.where(F.col("name").rlike(seeds.VALIDATOR_NAME)).select("site", "function", F.explode(F.array(F.concat(F.lit("vret:"), F.col("line")), F.concat(F.lit("varg:"), F.col("line")))).alias("root"))
    used = sinks.select("function", "type", F.explode("roots").alias("root")).join(marks, ["function", "root"]).join(F.broadcast(seeds.mapping(spark, by_sink, "type", "purpose")), "type")
    return used.select("site", "purpose").distinct().join(resolved, "site").select(F.col("fid").alias("function"), "purpose").distinct()


def callee_checks(call_sites: DataFrame, resolved: DataFrame, check_facts: DataFrame, names: DataFrame) -> DataFrame:
    """A call to a validator whose body holds a strong check is a check of that category at the call's line.

    ``names``: fid, name of functions; the rest as in ``purposes_of``.
    """
    strong = [(x, {"category": c}) for c, _, _, s, _ in seeds.PURPOSES.values() for x in s]
    validators = names.where(F.col("name").rlike(seeds.VALIDATOR_NAME)).select(F.col("fid").alias("function"))
    held = _matched(check_facts.join(validators, "function", "left_semi"), "text", strong).select(F.col("function").alias("fid"), "category").distinct()
    calls = call_sites.where(F.col("name").rlike(seeds.VALIDATOR_NAME))
    out = calls.join(resolved, "site").join(held, "fid")
    return out.select("function", "line", "category", F.concat(F.lit(CALL), "name", F.lit(CALL_HOLDS), "category", F.lit(CALL_END)).alias("desc")).distinct()


def peer_findings(members: DataFrame, group: list[str]) -> DataFrame:
    """Handlers with resource access but no check of the caller among siblings that mostly check.

    ``members``: function, checked, access_line, access_text and the ``group`` columns; one row each.
    """
    odd = aggregates.peer_outliers(members, group, F.col("checked"))
    return _finding(odd, category=F.lit("access_control"), source_line=F.col("access_line"), source_type=F.lit("request_identity"), source_desc=F.lit(""), sink_line=F.col("access_line"), sink_type=F.lit("resource_access"), sink_desc=F.col("access_text"), rule_id=F.lit("R5"), peers_present=F.col("checked_peers"))


def chain_facts(alignments: DataFrame, chains: DataFrame, check_lines: DataFrame, functions: DataFrame, least_steps: int = 2, least_share: float = 0.6) -> DataFrame:
    """Aligned segments that touch an absent missing step.

    ``alignments``: function, template, aligned, segment, steps (array of step_id, line), missing_status,
    note; ``chains``: template, category, generic, missing_id, step_ids (non-missing); ``functions``: function, line, end_line.
    """
    lines = check_lines.groupBy("function").agg(F.collect_set("line").alias("cls"))
    j = alignments.where("aligned and size(segment) = 2").join(chains, "template").join(functions, "function").join(lines, "function", "left")
    lo, hi = F.array_min("segment"), F.array_max("segment")
    j = j.withColumns({"s_lo": lo, "s_hi": hi}).where((F.col("s_lo") <= F.col("missing_id") + 1) & (F.col("s_hi") >= F.col("missing_id") - 1) & (F.col("missing_status") == "absent"))
    in_segment = F.filter("step_ids", lambda s: (s >= F.col("s_lo")) & (s <= F.col("s_hi")))
    beside = lambda n: F.col("cls").isNull() | F.exists("cls", lambda c: F.abs(c - n) <= 1)
    placed = F.filter("steps", lambda s: F.array_contains(F.col("of"), s["step_id"]) & s["line"].isNotNull() & s["line"].between(F.col("line"), F.col("end_line")) & beside(s["line"]))
    j = j.withColumn("of", in_segment).withColumn("hit", placed)
    share = F.size("hit") / F.size("of")
    j = j.where((F.size("of") > 0) & (F.size("hit") >= least_steps)).where(share >= least_share)
    at = F.array_sort(F.transform("hit", lambda s: s["line"]))
    j = j.withColumns({"first": F.element_at(at, 1), "last": F.element_at(at, -1), "ratio": F.round(share, 2)})
    sink = F.when(F.col("last") == F.col("first"), F.least(F.col("end_line"), F.col("first") + 1)).otherwise(F.col("last"))
    return j.select("function", "template", "category", "generic", F.col("ratio").alias("aligned_ratio"), F.col("first").alias("source_line"), sink.alias("sink_line"), "note")


def chain_findings(facts: DataFrame, alignments: DataFrame) -> DataFrame:
    """X4 facts with siblings counted, generic ones only with more evidence, the best for each (function, category)."""
    file = F.regexp_extract("function", r"^(.*):", 1)
    present = alignments.where("missing_status = 'present'").groupBy(file.alias("file"), "template").agg(F.count("*").cast("int").alias("peers"))
    boosted = facts.withColumn("file", file).join(present, ["file", "template"], "left").withColumn("peers", F.coalesce("peers", F.lit(0)))
    real = facts.where("not generic").select("function").distinct().withColumn("real", F.lit(True))
    kept = boosted.join(real, "function", "left").where(~F.col("generic") | (F.col("peers") > 0) | F.col("real"))
    best = spans.collapsed(kept, ["function", "category"], [F.desc("aligned_ratio"), F.col("generic"), F.desc("peers"), F.col("template")])
    return _finding(best, template_id=F.col("template"), source_type=F.lit("param_external"), source_provenance=F.lit("chain_align"), sink_type=F.lit("chain_exit"), sink_desc=F.col("note"), peers_present=F.col("peers"), chain_generic=F.col("generic"), rule_id=F.lit("X4"))


def ordered_dedup(findings: DataFrame) -> DataFrame:
    """R2 and R4 yield to a span with their (function, category, sink line); X4 yields to any other rule in (function, category)."""
    where = ["function", "category", "sink_line"]
    span = findings.where("rule_id = 'v2_span'").select(*where).distinct()
    taint = findings.where("rule_id in ('R2', 'R4')").join(span, where, "left_anti")
    others = findings.where("rule_id not in ('R2', 'R4', 'X4')").unionByName(taint.select(*findings.columns))
    chain = findings.where("rule_id = 'X4'").join(others.select("function", "category").distinct(), ["function", "category"], "left_anti")
    return others.unionByName(chain.select(*findings.columns))


def bound(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """Findings with the first template of their category, a pattern name and an evidence text."""
    first = templates.groupBy("category").agg(F.min_by(F.struct("template_id", "pattern_names"), F.struct("rank", "template_id")).alias("t"))
    out = findings.join(first, "category", "left")
    name = F.coalesce(F.get("t.pattern_names", F.lit(0)), F.concat_ws("_via_", "category", "sink_type"))
    evidence = F.format_string(EVIDENCE, "source_line", "source_type", "sink_line", "sink_type", "category")
    return out.select(*[F.coalesce("template_id", "t.template_id", F.lit("")).alias(c) if c == "template_id" else F.col(c) for c in findings.columns], name.alias("pattern_name"), evidence.alias("evidence"))


REPORT_ORDER = ("function", "source_line", "sink_line", "category", "rule_id")
