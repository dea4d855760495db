"""The rules on small fact tables with known outcomes."""

import random

import pytest
from pyspark.sql import functions as F

from quern.plans import rules as R
from quern.plans import seeds

POINTS = "function string, kind string, ord int, line int, type string, category string, pattern string"
INPUTS = "function string, ord int, line int, origin string, desc string"
SINKS = "function string, ord int, line int, kind string, desc string"
CHECKS = "function string, ord int, line int, category string, desc string"
F1 = "shop/basket.go:Basket.Store"


def facts(spark, sources=(), sinks=(), sanitizers=(), inputs=(), model_sinks=(), checks=(), f=F1):
    points = [(f, "source", i, n, t, None, t) for i, (n, t) in enumerate(sources)] + [(f, "sink", i, n, t, None, t) for i, (n, t) in enumerate(sinks)]
    points += [(f, "sanitizer", i, n, None, c, c) for i, (n, c) in enumerate(sanitizers)]
    return {
        "points": spark.createDataFrame(points, POINTS), "inputs": spark.createDataFrame([(f, i, n, o, "in") for i, (n, o) in enumerate(inputs)], INPUTS),
        "sinks": spark.createDataFrame([(f, i, n, k, "out") for i, (n, k) in enumerate(model_sinks)], SINKS),
        "checks": spark.createDataFrame([(f, i, n, c, "check") for i, (n, c) in enumerate(checks)], CHECKS),
        "extraction": spark.createDataFrame([(f, "x")], "function string, purpose string"),
    }


def spans(spark, rules="v2", extracted=True, check_lines=None, callee=None, retain=False, **kw):
    t, rules = facts(spark, **kw), R.Rules.of(rules, retain)
    sources, sinks = R.merged_sources(t["points"], t["inputs"]), R.merged_sinks(t["points"], t["sinks"], rules)
    checks = R.merged_checks(t["points"], t["checks"], check_lines, callee, rules)
    out = R.span_findings(sources, sinks, checks, t["extraction"] if extracted else t["extraction"].where("false"), rules)
    return [(r.category, r.source_line, r.sink_line) for r in out.orderBy("source_line", "sink_line", "category").collect()]


HTTP, WRITE = [(7, "http_request")], [(19, "file_write")]


def by_hand(sources, sinks, checks, generic=True):
    """The span rule of one function over all pairs: (category, source line, sink line)."""
    open_ = []
    for s, source in sources:
        for k, sink in sinks:
            if s == k or k < s <= k + 2 or (not generic and sink in seeds.GENERIC_SINKS):
                continue
            for category, (of_source, of_sink) in seeds.CATEGORY_HINTS.items():
                fits = source in of_source and (not of_sink or sink in of_sink)
                if fits and (generic or of_sink) and not any(c == category and min(s, k) < n < max(s, k) for n, c in checks):
                    open_.append((category, s, k))
    out = set()
    for category in {c for c, _, _ in open_}:
        mine = [(s, k) for c, s, k in open_ if c == category]
        if seeds.CATEGORY_HINTS[category][1]:
            out |= {(category, min(s for s, at in mine if at == k), k) for _, k in mine}
        else:
            out.add((category, *min(mine, key=lambda x: (-abs(x[0] - x[1]), x))))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


@pytest.mark.parametrize("seed", range(6))
def test_spans_are_all_pairs_by_hand(spark, seed):
    rnd = random.Random(seed)
    lines = rnd.sample(range(1, 40), 14)
    kinds = sorted({k for _, ks in seeds.CATEGORY_HINTS.values() for k in ks})
    sources = [(n, rnd.choice(["http_request", "read", "json_decode", "channel_recv"])) for n in lines[:4]]
    sinks = [(n, rnd.choice(kinds)) for n in lines[4:8]]
    checks = [(n, rnd.choice(["path_validation", "input_sanitization", "access_control", "bounds_check"])) for n in lines[8:]]
    for rules, generic in (("v2", True), ("v2,F3", False)):
        assert spans(spark, rules, sources=sources, sinks=sinks, sanitizers=checks) == by_hand(sources, sinks, checks, generic)


def test_facts_merge_and_snap(spark):
    t = facts(spark, sources=HTTP, sinks=WRITE, sanitizers=[(11, "path_validation")], inputs=[(9, "network"), (15, "network"), (4, "internal"), (0, "file")], model_sinks=[(18, "file_write"), (30, "log")], checks=[(13, "path_validation"), (16, "path_validation")])
    lines = lambda df: sorted(r.line for r in df.collect())
    assert lines(R.merged_sources(t["points"], t["inputs"])) == [7, 15]
    assert lines(R.merged_sinks(t["points"], t["sinks"], R.Rules())) == [19, 30]
    assert lines(R.merged_checks(t["points"], t["checks"], None, None, R.Rules())) == [11, 16]
    assert {r.line: r.desc for r in R.merged_sources(t["points"], t["inputs"]).collect()} == {7: "in", 15: "in"}


def test_ends_drift_and_extraction(spark):
    kw = dict(sources=HTTP, sinks=WRITE)
    has = lambda **more: "path_validation" in [c for c, _, _ in spans(spark, **kw, **more)]
    assert has() and not has(checks=[(12, "path_validation")]) and has(checks=[(25, "path_validation")])
    assert has(checks=[(7, "path_validation")]) and has(checks=[(19, "path_validation")])  # the ends don't protect
    assert spans(spark, extracted=False, **kw) == []
    assert spans(spark, sources=[(22, "http_request")], sinks=[(21, "file_write")]) == [] and spans(spark, sources=[(24, "http_request")], sinks=[(21, "file_write")])


def test_shapes_and_model_checks(spark):
    assert spans(spark, "v2,X2,F3", sources=HTTP, model_sinks=[(16, "redirect")]) == [("origin_validation", 7, 16)]
    near = spark.createDataFrame([(F1, 14)], "function string, line int")
    kw = dict(sources=HTTP, sinks=WRITE)
    assert "path_validation" not in [c for c, _, _ in spans(spark, "v2,F4", check_lines=near, checks=[(13, "path_validation")], **kw)]
    assert "path_validation" in [c for c, _, _ in spans(spark, "v2,F4", check_lines=near, checks=[(10, "path_validation")], **kw)]
    callee = spark.createDataFrame([(F1, 14, "path_validation", "call")], "function string, line int, category string, desc string")
    assert "path_validation" not in [c for c, _, _ in spans(spark, "v2,X3", callee=callee, **kw)]


def test_retain_keeps_protected_spans(spark):
    got = spans(spark, retain=True, extracted=False, sources=HTTP, sinks=WRITE, checks=[(12, "path_validation")])
    assert ("path_validation", 7, 19) in got


def test_unknown_rules_are_refused():
    with pytest.raises(ValueError):
        R.Rules.of("v2,R9")


def test_binding_names_and_evidence(spark):
    t = facts(spark, sources=HTTP, sinks=WRITE)
    out = R.span_findings(R.merged_sources(t["points"], t["inputs"]), R.merged_sinks(t["points"], t["sinks"], R.Rules()), R.merged_checks(t["points"], t["checks"], None, None, R.Rules()), t["extraction"], R.Rules())
    templates = spark.createDataFrame([("tmpl-a", 1, "other", ["o"]), ("tmpl-c", 3, "path_validation", ["late"]), ("tmpl-b", 2, "path_validation", ["dir_escape"])], "template_id string, rank int, category string, pattern_names array<string>")
    got = {r.category: r for r in R.bound(out, templates).collect()}
    assert (got["path_validation"].template_id, got["path_validation"].pattern_name) == ("tmpl-b", "dir_escape")
    assert got["path_validation"].evidence == "L7 http_request → L19 file_write，跨度内无 path_validation 检查"
    assert (got["access_control"].template_id, got["access_control"].pattern_name) == ("", "access_control_via_file_write")


def sizes(spark, points, checks=(), ranges=()):
    """Categories and lines of the sizes of random functions; ``points``: function, line, kind, variable."""
    sources = spark.createDataFrame([(f, n, "http_request", "", False) for f, n, k, _ in points if k == "source"], "function string, line int, type string, desc string, strong boolean")
    size = spark.createDataFrame([(f, n, k, v, "") for f, n, k, v in points if k != "source"], "function string, line int, type string, var string, pattern string")
    guards = spark.createDataFrame(list(ranges), "function string, line int, var string")
    observed = spark.createDataFrame(list(checks), "function string, line int, category string")
    return {(r.function, r.category, r.source_line, r.sink_line) for r in R.size_findings(sources, observed, size, guards).collect()}


def test_sizes_by_brute_force(spark):
    rnd = random.Random(31)
    names, kinds = [f"pkg/q{i}.go:Q{i}" for i in range(25)], {"alloc_size": "resource_limit", "index_access": "bounds_check"}
    points = list({(f, n): (f, n, rnd.choice(["source", *kinds]), rnd.choice("xyz")) for f in names for n in rnd.sample(range(1, 60), rnd.randint(0, 7))}.values())
    ranges = [(f, rnd.randint(1, 60), rnd.choice("xyz")) for f in names for _ in range(rnd.randint(0, 3))]
    checks = [(f, rnd.randint(1, 60), rnd.choice(list(kinds.values()))) for f in names for _ in range(rnd.randint(0, 1))]
    want = set()
    for f in names:
        first = min((n for g, n, k, _ in points if g == f and k == "source"), default=None)
        for g, n, k, v in points:
            if g != f or k == "source" or first is None or first >= n:
                continue
            # a range check counts from the source's line on, another guard behind it
            compared = any(h == f and w == v and first <= m < n for h, m, w in ranges)
            guarded = any(h == f and first < m < n and c in kinds.values() for h, m, c in checks)
            if not compared and not guarded:
                want.add((f, kinds[k], first, n))
    assert sizes(spark, points, checks, ranges) == want and len(want) > 10


FACTS = "function string, sink_line int, sink_type string, sink_desc string, source_line int, source_desc string, provenance string, path array<string>"
KINDS = {"file_read": ("path_validation", "R2"), "alloc_size": ("resource_limit", "R2"), "unbounded_read": ("resource_limit", "R4"), "redirect": ("origin_validation", "R2")}


def taint(spark, rows, rules="R2,R4", checks=(), ranges=(), retain=False):
    facts_ = spark.createDataFrame([(f, k, t, "", s, "", "net_direct", []) for f, k, t, s in rows], FACTS)
    observed = spark.createDataFrame(list(checks), "function string, line int, category string")
    guards = spark.createDataFrame(list(ranges), "function string, line int")
    return sorted((r.function, r.category, r.sink_line, r.rule_id) for r in R.taint_findings(facts_, observed, guards, R.Rules.of(rules, retain)).collect())


def test_tainted_parameters_by_brute_force(spark):
    rnd = random.Random(32)
    names = [f"svc/t{i}.go:T{i}" for i in range(30)]
    rows = [(f, s + rnd.randint(1, 20), rnd.choice(list(KINDS)), s) for f in names for s in [rnd.randint(3, 30)] for _ in range(rnd.randint(0, 5))]
    checks = [(f, rnd.randint(1, 50), rnd.choice([c for c, _ in KINDS.values()])) for f in names for _ in range(rnd.randint(0, 2))]
    ranges = [(f, rnd.randint(1, 50)) for f in names for _ in range(rnd.randint(0, 1))]

    def by_hand(only, retain):
        held = []
        for f, sink, kind, source in rows:
            category, rule = KINDS[kind]
            checked = any(g == f and c == category and source <= n < sink for g, n, c in checks)
            compared = kind == "alloc_size" and any(g == f and source <= n < sink for g, n in ranges)
            # what bounds a read is its reader alone
            if rule in only and (retain or rule == "R4" or not checked and not compared):
                held.append((f, category, sink, rule, source, kind))
        first = {}
        for f, category, sink, rule, source, kind in held:
            first[f, category] = min(first.get((f, category), (sink, source, kind, rule)), (sink, source, kind, rule))
        return sorted(h[:4] for h in held) if retain else sorted((f, c, sink, rule) for (f, c), (sink, _, _, rule) in first.items())

    for only, retain in (("R2,R4", False), ("R2", False), ("R4", False), ("R2,R4", True)):
        want = by_hand(only, retain)
        assert taint(spark, rows, only, checks, ranges, retain) == want and len(want) > 5


VALIDATORS = "function string, name string, last_result string, line int, end_line int, source_line int, params array<string>, provenance string, path array<string>"


def test_validators(spark):
    """A redirect target is held by a check of its second character, and not by one of its first alone."""
    v = spark.createDataFrame([
        ("nav/next.go:verifyNext", "verifyNext", "bool", 3, 19, 4, ["next"], "net_1hop", []), ("nav/next.go:verifyNextHop", "verifyNextHop", "bool", 31, 47, 0, ["next"], "net_1hop", []),
        ("shop/link.go:validateShopURL", "validateShopURL", "error", 8, 26, 9, ["shopURL"], "net_entry", []), ("shop/link.go:trimLink", "trimLink", "string", 28, 33, 29, ["link"], "net_entry", []),
    ], VALIDATORS)
    purposes = spark.createDataFrame([("nav/next.go:verifyNext", "redirect"), ("nav/next.go:verifyNextHop", "redirect")], "function string, purpose string")
    checks = spark.createDataFrame([
        ("nav/next.go:verifyNext", 11, 'strings.HasPrefix(next, "/")'), ("nav/next.go:verifyNextHop", 39, 'strings.HasPrefix(next, "//")'),
        ("nav/next.go:verifyNextHop", 36, 'strings.HasPrefix(next, "/")'), ("shop/link.go:validateShopURL", 14, "url.Parse(shopURL)"),
    ], "function string, line int, text string")
    got = {r.function: r for r in R.validator_findings(v, purposes, checks).collect()}
    assert set(got) == {"nav/next.go:verifyNext"}
    r = got["nav/next.go:verifyNext"]
    assert (r.category, r.source_line, r.sink_line, r.purpose_inferred) == ("origin_validation", 4, 11, False) and "HasPrefix" in r.sink_desc
    inferred = {r.function: r.purpose_inferred for r in R.validator_findings(v, purposes, checks, infer=True).collect()}
    assert inferred == {"nav/next.go:verifyNext": False, "shop/link.go:validateShopURL": True}


def test_peers(spark):
    m = spark.createDataFrame([(f"h.go:H.F{i}", "h.go", "H", i < 3, 10 + i, "db.Get(id)") for i in range(4)] + [(f"p.go:P.F{i}", "p.go", "P", False, 5, "x") for i in range(4)] + [("q.go:Q.A", "q.go", "Q", True, 1, "x"), ("q.go:Q.B", "q.go", "Q", False, 2, "x")], "function string, file string, recv string, checked boolean, access_line int, access_text string")
    assert [(r.function, r.sink_line) for r in R.peer_findings(m, ["file", "recv"]).collect()] == [("h.go:H.F3", 13)]


ALIGN = "function string, template string, aligned boolean, segment array<int>, steps array<struct<step_id:int,line:int>>, missing_status string, note string"


def test_chains(spark):
    chains = spark.createDataFrame([("T", "access_control", False, 3, [1, 2, 4, 5]), ("G", "access_control", True, 3, [1, 2, 4, 5])], "template string, category string, generic boolean, missing_id int, step_ids array<int>")
    functions = spark.createDataFrame([(f, 1, 50) for f in ("a.go:f", "a.go:g", "b.go:h")], "function string, line int, end_line int")
    lines = spark.createDataFrame([("a.go:f", n) for n in (10, 12, 20, 30)], "function string, line int")
    steps = [(1, 10), (2, 12), (4, 21), (5, 30)]

    def fact(segment, status="absent", f="a.go:f", template="T"):
        a = spark.createDataFrame([(f, template, True, segment, steps, status, "n")], ALIGN)
        return [(r.source_line, r.sink_line, r.aligned_ratio) for r in R.chain_facts(a, chains, lines, functions).collect()]

    assert fact([1, 5]) == [(10, 30, 1.0)] and fact([5, 3]) == [(21, 30, 1.0)]
    assert fact([1, 2]) == [(10, 12, 1.0)]  # next to the missing step
    assert fact([1, 1]) == [] and fact([5, 5]) == []
    assert fact([1, 5], "unknown") == [] and fact([1, 5], "present") == []
    assert fact([1, 5], f="b.go:h")  # no lines known: any line within
    both = spark.createDataFrame([("a.go:f", "G", True, [1, 5], steps, "absent", ""), ("b.go:h", "G", True, [1, 5], steps, "absent", ""), ("a.go:g", "G", True, [1, 5], steps, "present", "")], ALIGN)
    got = {r.function: r.peers_present for r in R.chain_findings(R.chain_facts(both, chains, lines, functions), both).collect()}
    assert got == {"a.go:f": 1}  # a sibling performs the step; the other generic fact has no more evidence


def test_rules_yield_in_order(spark):
    rows = [("f", "c1", 5, "v2_span"), ("f", "c1", 5, "R2"), ("f", "c2", 6, "R2"), ("f", "c2", 9, "X4"), ("f", "c3", 9, "X4"), ("f", "c1", 7, "R4"), ("g", "c1", 1, "X4")]
    df = spark.createDataFrame(rows, "function string, category string, sink_line int, rule_id string")
    got = {tuple(r) for r in R.ordered_dedup(df).collect()}
    assert got == set(rows) - {("f", "c1", 5, "R2"), ("f", "c2", 9, "X4")}


def test_scored_findings_end_to_end(spark):
    from quern.functions import confidence, cvss

    t = facts(spark, sources=HTTP, sinks=WRITE)
    rules = R.Rules()
    checks = R.merged_checks(t["points"], t["checks"], None, None, rules)
    out = R.span_findings(R.merged_sources(t["points"], t["inputs"]), R.merged_sinks(t["points"], t["sinks"], rules), checks, t["extraction"], rules)
    templates = spark.createDataFrame([("tmpl-b", 1, "path_validation", ["dir_escape"])], "template_id string, rank int, category string, pattern_names array<string>")
    found = R.bound(R.ordered_dedup(out), templates)
    flows = spark.createDataFrame([(F1, ["http_request"], ["file_write"], [7, 19], [7], [])], "function string, source_types array<string>, sink_types array<string>, lines array<int>, source_lines array<int>, checks array<struct<category:string,line:int>>")
    sources = spark.createDataFrame([(F1, "\n" * 60, 1)], "function string, source string, start_line int")
    known = templates.select("template_id", "pattern_names", F.col("category").alias("template_category"))
    got = {r.category: r for r in cvss.scored(confidence.scored(found, flows, sources, known), flows).collect()}
    pv = got["path_validation"]
    assert (pv.confidence, pv.confidence_level) == (1.0, "confirmed") and pv.confidence_breakdown.ast_corroboration.score == 1.0
    assert (pv.cvss_vector, pv.cvss_score, pv.severity) == ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N", 9.1, "critical")
    ac = got["access_control"]
    assert ac.confidence == pytest.approx(0.45 + 0.35 * 0.7 + 0.2 * 0.3, abs=1e-9)
