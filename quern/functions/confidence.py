"""Evidence-weighted confidence of findings.

Scores are sums of binary floating-point products, rounded at the third decimal by the
sum's exact binary value, which ``rounded`` does in double arithmetic alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans import seeds

#: Weights of the three dimensions and bounds of the levels.
WEIGHTS = {"code_evidence": 0.45, "ast_corroboration": 0.35, "template_support": 0.20}
LEVELS = ((0.75, "confirmed"), (0.5, "likely"))

#: Scores by the origin of taint, and of provenances by their older names.
ORIGIN_SCORES = {"net": 0.7, "wire": 0.6, "io": 0.5, "cb": 0.5, "llm": 0.5}
PROVENANCE_SCORES = {"direct": 0.7, "param_entry": 0.7, "param_1hop": 0.7, "param_nhop": 0.6, "name_dispatch": 0.5}
CONCEALED = "弱校验"


def rounded(value: Column, places: int) -> Column:
    """A non-negative double rounded half to even by its exact binary value.

    The value is split into two halves of its bits, so that their products with the scale, and
    with them the distance to the middle between two results, are exact.
    """
    scale = 10**places
    wide = value * 134217729.0
    high = wide - (wide - value)
    low = value - high
    down = F.floor(value * scale)
    beyond = (high * (2.0 * scale) - (2 * down + 1).cast("double")) + low * (2.0 * scale)
    up = (beyond > 0) | ((beyond == 0) & (down % 2 == 1))
    return (down + up.cast("int")).cast("double") / scale


def level(confidence: Column) -> Column:
    return F.when(confidence >= LEVELS[0][0], LEVELS[0][1]).when(confidence >= LEVELS[1][0], LEVELS[1][1]).otherwise("tentative")


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def line_references(text: Column) -> Column:
    """Numbers of the L<line> references of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\bL(\d{1,5})\b"), F.lit(1)), lambda x: x.cast("int"))


def code_spans(text: Column) -> Column:
    """Backquoted parts, then double-quoted ones of 6 characters or more; else the whole, if it looks like code."""
    ticks = F.regexp_extract_all(text, F.lit(r"`([^`]*)`"), F.lit(1))
    quotes = F.regexp_extract_all(text, F.lit(r'"([^"]*)"'), F.lit(1))
    spans = F.filter(F.transform(F.concat(ticks, quotes), lambda x: F.trim(x)), lambda x: F.length(x) >= 6)
    whole = F.trim(text)
    code = (F.length(whole) >= 6) & whole.rlike(r"[().={}<>]")
    return F.when(F.size(spans) > 0, spans).when(code, F.array(whole)).otherwise(F.array().cast("array<string>"))


def code_evidence(evidence: Column, source: Column, start_line: Column) -> tuple[Column, Column]:
    """(score, provenance) of what an evidence text cites of the function's source."""
    text = F.trim(F.coalesce(evidence, F.lit("")))
    refs = line_references(text)
    lo = F.greatest(F.lit(1), F.coalesce(start_line, F.lit(1)))
    hi = lo + F.length(source) - F.length(F.replace(source, F.lit("\n"), F.lit("")))
    inside = F.size(F.filter(refs, lambda n: (n >= lo) & (n <= hi)))
    flat = one_line(source)
    quoted = F.exists(code_spans(text), lambda s: (one_line(s) != "") & F.contains(flat, one_line(s)))
    good = F.when(F.size(refs) > 0, (inside == F.size(refs)) & (F.size(refs) >= 2)).otherwise(quoted)
    score = F.when(source.isNull(), 0.5).when(text == "", 0.0).when(good, 1.0).otherwise(0.4)
    name = F.when(source.isNull(), "source_unavailable").when(text == "", "no_evidence").when(good, "verified_citation").otherwise("unverified_citation")
    return score, name


def flow_corroboration(category: Column, has_flow: Column, source_types: Column, sink_types: Column, lines: Column, checks: Column) -> tuple[Column, Column]:
    """(score, provenance) of a span by the function's own flow facts.

    ``lines``: of all its points; ``checks``: array of (category, line) of its sanitizers.
    """
    hints = {c: (F.array(*map(F.lit, s)) if s else None, F.array(*map(F.lit, k)) if k else None) for c, (s, k) in seeds.CATEGORY_HINTS.items()}
    hit = {0: F.lit(False), 1: F.lit(False)}
    for side, types in ((0, source_types), (1, sink_types)):
        for c, pair in hints.items():
            if pair[side] is not None:
                hit[side] = F.when(category == c, F.arrays_overlap(types, pair[side])).otherwise(hit[side])
    known = category.isin(*[c for c, (s, k) in seeds.CATEGORY_HINTS.items() if s or k])
    src, snk = hit[0], hit[1]
    base = F.when(src & snk, 1.0).when(src, 0.7).when(snk, 0.6).otherwise(0.2)
    name = F.when(src & snk, "source_and_sink").when(src, "source_only").when(snk, "sink_only").otherwise("no_match")
    mine = F.filter(checks, lambda c: c["category"] == category)
    inside = F.exists(mine, lambda c: (c["line"] > F.array_min(lines)) & (c["line"] < F.array_max(lines))).eqNullSafe(True)
    score = F.when(~has_flow, 0.5).when(~known, 0.5).when(inside, 0.1).when(F.size(mine) > 0, F.least(base, F.lit(0.5))).otherwise(base)
    return score, F.when(~has_flow, "no_data_flow").when(~known, "no_ast_signal").when(inside, "sanitizer_on_path").when(F.size(mine) > 0, "sanitizer_off_path").otherwise(name)


def taint_score(provenance: Column, hops: Column) -> Column:
    """Score of how taint arrived: by origin, less for many hops and for dispatch by name."""
    parts = F.split(F.coalesce(provenance, F.lit("")), "_")
    score = F.coalesce(_lookup(ORIGIN_SCORES, F.element_at(parts, 1)), F.lit(0.5))
    score = score - F.when(F.array_contains(parts, "nhop"), 0.05).otherwise(0.0) - F.when(F.array_contains(parts, "dispatch"), 0.1).otherwise(0.0)
    score = score - F.when(hops > 4, 0.05 * (hops - 4)).otherwise(0.0)
    return F.coalesce(_lookup(PROVENANCE_SCORES, provenance), rounded(F.greatest(F.lit(0.3), score), 2))


def corroboration(f: dict[str, Column], span_score: Column) -> Column:
    """The second dimension by rule; ``span_score`` is that of spans.

    ``f``: rule_id, source_line, flow_source_lines, source_provenance, hops, purpose_inferred,
    sink_desc, aligned_ratio, peers_present.
    """
    chain = rounded(F.least(F.lit(0.7), 0.4 + 0.2 * F.coalesce(f["aligned_ratio"], F.lit(0.0)) + F.when(f["peers_present"] > 0, 0.1).otherwise(0.0)), 3)
    rule = f["rule_id"]
    return (
        F.when(rule == "R1", F.when(F.array_contains(f["flow_source_lines"], f["source_line"]), 1.0).otherwise(0.7))
        .when(rule.isin("R2", "R4"), taint_score(f["source_provenance"], f["hops"]))
        .when(rule == "R3", F.when(f["purpose_inferred"], 0.4).when(F.startswith(f["sink_desc"], F.lit(CONCEALED)), 0.7).otherwise(0.6))
        .when(rule == "R5", 0.6).when(rule == "X4", chain).otherwise(span_score)
    )


def template_support(rule: Column, generic: Column, has_templates: Column, resolved: Column, known_pattern: Column, same_category: Column) -> Column:
    """The third dimension: what the template knows of the finding."""
    base = F.when(known_pattern, 1.0).otherwise(0.7)
    base = F.when(same_category, base).otherwise(F.least(base, F.lit(0.5)))
    return F.when(rule == "X4", F.when(generic, 0.6).otherwise(0.8)).when(~has_templates, 0.5).when(~resolved, 0.3).otherwise(base)


def combined(code: Column, corroborated: Column, template: Column) -> Column:
    total = WEIGHTS["code_evidence"] * code + WEIGHTS["ast_corroboration"] * corroborated + WEIGHTS["template_support"] * template
    return rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 3)


def scored(findings: DataFrame, flows: DataFrame, sources: DataFrame, templates: DataFrame) -> DataFrame:
    """Findings with confidence, confidence_level and confidence_breakdown.

    ``flows``: function, source_types, sink_types, lines, source_lines, checks.  ``sources``: function,
    source, start_line.  ``templates``: template_id, pattern_names, template_category; may be empty.
    """
    any_templates = not templates.isEmpty()
    names = {"rule_id": "string", "chain_generic": "boolean", "source_provenance": "string", "taint_path": "array<string>", "purpose_inferred": "boolean", "aligned_ratio": "double", "peers_present": "int", "sink_desc": "string"}
    full = findings.withColumns({n: F.lit(None).cast(t) for n, t in names.items() if n not in findings.columns})
    joined = full.join(flows.withColumn("__flow", F.lit(True)), "function", "left").join(sources, "function", "left")
    joined = joined.join(templates.withColumn("__known", F.lit(True)), "template_id", "left")
    none = F.array().cast("array<string>")
    code, code_name = code_evidence(F.col("evidence"), F.col("source"), F.col("start_line"))
    span, span_name = flow_corroboration(F.col("category"), F.col("__flow").isNotNull(), F.coalesce("source_types", none), F.coalesce("sink_types", none), F.col("lines"), F.col("checks"))
    f = {n: F.col(n) for n in names} | {"source_line": F.col("source_line"), "flow_source_lines": F.col("source_lines"), "hops": F.coalesce(F.size("taint_path"), F.lit(0))}
    second = corroboration(f, span)
    third = template_support(
        F.coalesce("rule_id", F.lit("")), F.coalesce("chain_generic", F.lit(False)), F.lit(any_templates), F.col("__known").isNotNull(),
        F.coalesce(F.array_contains("pattern_names", F.coalesce("pattern_name", F.lit(""))), F.lit(False)),
        F.col("template_category").isNull() | (F.col("template_category") == "") | (F.col("template_category") == F.col("category")))
    joined = joined.withColumns({"__a": code, "__b": second, "__c": third, "__an": code_name, "__bn": F.when(F.coalesce("rule_id", F.lit("v2_span")) == "v2_span", span_name).otherwise(F.lower("rule_id"))})
    part = lambda score, weight, name: F.struct(score.alias("score"), F.lit(weight).alias("weight"), name.alias("provenance"))
    breakdown = F.struct(
        part(F.col("__a"), 0.45, F.col("__an")).alias("code_evidence"), part(F.col("__b"), 0.35, F.col("__bn")).alias("ast_corroboration"),
        part(F.col("__c"), 0.20, F.lit("template")).alias("template_support"))
    out = joined.withColumn("confidence", combined(F.col("__a"), F.col("__b"), F.col("__c"))).withColumn("confidence_breakdown", breakdown)
    return out.withColumn("confidence_level", level(F.col("confidence"))).select(*findings.columns, "confidence", "confidence_level", "confidence_breakdown")
