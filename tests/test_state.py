"""Verdicts, verification, knowledge base, texts, sources and state."""

import pytest
from pyspark.sql import functions as F

from quern.operators import graph, matching, spans, texts
from quern.plans import judge, kb, verify
from quern.sources import facts, sinks
from quern.streaming import incremental


def output(benign="REACHED=yes BLOCKED_AT=none", malicious="REACHED=yes BLOCKED_AT=none", b="n=1", m="n=9"):
    return f"=== RUN\n  ARM=benign {benign}\nARM=benign RESULT {b}\nARM=malicious {malicious}\nARM=malicious RESULT {m}\nARM=malicious OBSERVED=ok\nPASS"


GT5 = ("n", ">", "5")
CASES = [
    ("timeout", dict(timed_out=True), {}), ("build_failed", dict(build_failed=True), {}), ("markers_missing", dict(output="ARM=benign REACHED=yes"), {}),
    ("benign_not_reached", dict(output=output(benign="REACHED=no BLOCKED_AT=none")), {}), ("benign_not_reached", dict(output=output(b="status=404 n=1")), {}),
    ("blocked_by_known_guard", dict(output=output(malicious="REACHED=no BLOCKED_AT=a.go:5")), dict(guards=["a.go:5"])),
    ("malicious_not_reached", dict(output=output(malicious="REACHED=no BLOCKED_AT=a.go:6")), dict(guards=["a.go:5"])),
    ("bug_if_holds_on_malicious_only", dict(output=output(malicious="REACHED=no BLOCKED_AT=a.go:25")), dict(guards=["a.go:25"], sinks=[20])),
    ("arms_indistinguishable", dict(output=output(m="n=1 label=x elapsed_ms=7")), {}), ("bug_if_not_evaluable", dict(output=output(b="k=1 n=x", m="k=2 n=9")), {}),
    ("bug_if_holds_on_malicious_only", dict(output=output()), {}), ("benign_also_bug", dict(output=output(b="n=8")), {}), ("no_bug_observed", dict(output=output(m="n=3")), {}),
]


def test_verdicts(spark):
    runs = [(i, c.get("output", output()), c.get("timed_out", False), c.get("build_failed", False)) for i, (_, c, _) in enumerate(CASES)]
    guards = [(i, g) for i, (_, _, x) in enumerate(CASES) for g in x.get("guards", [])]
    lines = [(i, n) for i, (_, _, x) in enumerate(CASES) for n in x.get("sinks", [])]
    t = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    out = judge.judged(t(runs, "unit_id int, output string, timed_out boolean, build_failed boolean"), t([(i, GT5) for i in range(len(CASES))], "unit_id int, bug_if struct<key:string,op:string,value:string>"), t(guards, "unit_id int, location string"), t(lines, "unit_id int, line int"))
    rows = {r.unit_id: r for r in out.collect()}
    assert [rows[i].rule for i in range(len(CASES))] == [c[0] for c in CASES]
    kinds = {r.rule: r.verdict for r in rows.values()}
    assert kinds["blocked_by_known_guard"] == judge.REFUTED and kinds["bug_if_holds_on_malicious_only"] == judge.REPRODUCED and kinds["timeout"] == judge.UNREPRODUCED
    units = t([(i,) for i in range(17)], "unit_id int")
    evidence = t([(i, True, False) for i in range(14)] + [(14, False, False), (15, True, True)], "unit_id int, buildable boolean, needs_infra boolean")
    full = {r.unit_id: r.rule for r in judge.with_prerequisites(units, evidence, out).collect()}
    assert (full[0], full[13], full[14], full[15], full[16]) == ("timeout", "no_experiment", "package_unbuildable", "package_needs_infra", "evidence_missing")
    assert judge.unstable(out, out).isEmpty()
    assert judge.unstable(out, out.withColumn("rule", F.when(F.col("unit_id") == 3, "x").otherwise(F.col("rule"))).where("unit_id <> 4")).count() == 2
    assert judge.counts(out.withColumn("repo", F.lit("r")), "repo").first().total == len(CASES)


def test_run_outcomes(spark):
    c = lambda o, rc, t: spark.range(1).select(judge.outcome(F.lit(o), F.lit(rc), F.lit(t))).first()[0]
    assert (c("x", 0, True), c("a [build failed]", 1, False), c("--- FAIL: T", 1, False), c("ok", 0, False)) == ("timed_out", "build_failed", "test_failed", "passed")


def test_references_and_rebinding(spark):
    lines = spark.createDataFrame([("a.go", i + 1, x) for i, x in enumerate(["func f() {", "\tx := 1", "", "}", "func g() {", "}"])], "file string, n int, line string")
    refs = [(1, "a.go", 1, 2, "func f() {\nx := 1"), (2, "a.go", 1, 2, "func f() {\nx := 2"), (3, "a.go", 3, 3, ""), (4, "a.go", 6, 7, "}\n}"), (5, "a.go", 1, 2, "func f() {"), (6, "b.go", 1, 1, "func f() {")]
    got = verify.valid_references(spark.createDataFrame(refs, "id int, file string, start_line int, end_line int, text string"), lines, ["id"])
    assert [r.id for r in got.collect()] == [1]
    functions = spark.createDataFrame([("F", "a.go", 1, 4), ("G", "a.go", 5, 6), ("H", "b.go", 1, 9), ("I", "b.go", 2, 8)], "function_id string, file string, line int, end_line int")
    candidates = spark.createDataFrame([("own", "F", "a.go", 2, 3), ("moved", "F", "a.go", 5, 6), ("two", "F", "b.go", 3, 4), ("none", "F", "a.go", 3, 5)], "candidate string, function_id string, file string, start_line int, end_line int")
    got = {r.candidate: (r.function_id, r.rebound_from) for r in verify.bound_candidates(candidates, functions).collect()}
    assert got == {"own": ("F", None), "moved": ("G", "F")}


def test_verification_needs_anchored_complete_claims(spark):
    full = [("input", True, 1), ("operation", True, 20), ("impact", True, 1)]
    cases = {
        "good": ("supported", "r", 0, full), "unresolved": ("supported", "r", 1, full), "partial": ("supported", "r", 0, full[:2]),
        "unanchored": ("supported", "r", 0, [("input", True, 1), ("operation", True, 5), ("impact", True, 1)]), "badref": ("supported", "r", 0, [*full[:2], ("impact", False, 1)]),
        "refuted": ("refuted", "r", 0, [("protection", True, 1), ("operation", True, 20)]), "weak": ("refuted", "r", 0, [("operation", True, 20)]),
        "unknown": ("unknown", "why", 3, []), "noreason": ("supported", " ", 0, full), "kind": ("supported", "r", 0, [*full, ("gossip", True, 1)]),
    }
    t = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    candidates = t([(c, "a.go", 20) for c in [*cases, "silent"]], "candidate string, file string, sink_line int")
    responses = t([(c, c, s, r, u) for c, (s, r, u, _) in cases.items()], "candidate string, answered string, status string, reason string, unresolved int")
    claims = t([(c, i, k, "says") for c, x in cases.items() for i, (k, _, _) in enumerate(x[3])], "candidate string, claim int, kind string, statement string")
    refs = t([(c, i, "a.go", n, n + 2, ok) for c, x in cases.items() for i, (_, ok, n) in enumerate(x[3])], "candidate string, claim int, file string, start_line int, end_line int, valid boolean")
    got = {r.candidate: (r.status, r.reason) for r in verify.verdicts(candidates, responses, claims, refs).collect()}
    weak, bad = ("unknown", "insufficient_or_invalid_evidence"), ("unknown", "invalid_verdict")
    assert got == {"good": ("supported", "r"), "unresolved": weak, "partial": weak, "unanchored": weak, "badref": weak, "refuted": ("refuted", "r"), "weak": weak, "unknown": ("unknown", "why"), "noreason": bad, "kind": weak, "silent": bad}


def test_schedule_is_fair_and_budgeted(spark):
    work = [("r", g, go, f"{g}{i}", i, s, i == 0) for g, go, s in (("a", 1, False), ("b", 2, True)) for i in range(3)]
    out = verify.schedule(spark.createDataFrame(work, "run string, grp string, group_ord int, item string, item_ord int, semantic boolean, representative boolean"), 3).orderBy("turn").collect()
    assert [r["item"] for r in out] == ["b0", "a0", "b1", "a1", "b2", "a2"] and [r.status for r in out].count("done") == 3


def chain(i, domain="net", category="access_control", pattern="p", missing=2, steps=3, **more):
    return {"go_id": f"G{i}", "primary_domain": domain, "generic": False, "chain_type": more.get("kind", "data_flow"), "summary": f"s{i}", "pattern_name": pattern, "cwe_alignment": ["CWE-1"], "error": more.get("error"),
            "chain": [{"step_id": n, "action": f"act{n}", "is_missing_step": n == missing, "missing_step_category": category if n == missing else None, "evidence": {"apis": more.get("apis", ["http.Get"]), "functions": []}} for n in range(1, steps + 1)]}


def test_knowledge_base(spark, scratch_core, tmp_path):
    import json

    rows = [chain(1), chain(2, pattern="q", missing=1, apis=["http.Get", "os.Open"]), chain(3, domain="fs"), chain(4, error="bad"), chain(5, steps=1), chain(6, missing=9)]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    chains = facts.read_json(spark, str(tmp_path / "c.jsonl"), kb.CHAIN, lines=True)
    assert {r.go_id: r.errors for r in kb.faults(chains).collect() if r.errors} == {"G5": ["steps", "missing_step"], "G6": ["missing_step"]}
    good = kb.valid_chains(chains)
    t = kb.templates(good, scratch_core)
    got = {r.template_id: r for r in t.collect()}
    assert set(got) == {"tpl_001", "tpl_002"} and got["tpl_001"].primary_domain == "fs"
    net = got["tpl_002"]
    assert (net.chain_count, net.first_position, net.last_position, net.pattern_names, net.api_indicators, net.examples, net.summary) == (2, 1, 2, ["p", "q"], ["http.Get", "os.Open"], ["G1", "G2"], "s1; s2")
    index = {r.key: r.members for r in kb.indexes(t)["api"].collect()}
    assert index == {"http.Get": ["tpl_001", "tpl_002"], "os.Open": ["tpl_002"]}
    domains = spark.createDataFrame([("net", 0.2, 1), ("net", 0.8, 2), ("fs", None, 1)], "domain string, confidence double, ord int")
    ranked = kb.candidates(t, domains, spark.createDataFrame([("os.Open",)], "api string"), scratch_core).orderBy("rank").collect()
    assert [(r.template_id, round(r.score, 3), r.overlap) for r in ranked] == [("tpl_002", 0.65, 1), ("tpl_001", 0.25, 0)]
    sinks.knowledge_base(t, kb.indexes(t), str(tmp_path / "kb"))
    assert spark.read.parquet(str(tmp_path / "kb/templates")).count() == 2


@pytest.fixture(scope="module")
def scratch_core(spark):
    from quern.scratch import Scratch

    return Scratch(spark)


def test_role_retrieval(spark):
    functions = spark.createDataFrame([("f", "handler", "HandleUserDelete FindSourceByID")], "function string, role string, text string")
    chains = spark.createDataFrame([("A", "access_control", "net", False, ["user", "delete"]), ("B", "access_control", "db", False, ["user", "delete", "source"]), ("C", "x", "net", True, ["find"]), ("D", "x", "net", True, ["find", "user"])], "go_id string, category string, primary_domain string, generic boolean, bag array<string>")
    roles = spark.createDataFrame([("handler", "access_control", ["C"])], "role string, category string, generics array<string>")
    got = sorted((r.generic, r.go_id, r.score) for r in kb.for_roles(functions, chains, roles, ["net"]).collect())
    assert got == [(False, "B", 3.0), (True, "C", 1.5)]
    weights = spark.createDataFrame([("user", 0.25), ("delete", 4.0), ("find", 0.5)], "token string, idf double")
    got = sorted((r.generic, r.go_id, r.score) for r in kb.for_roles(functions, chains, roles, ["net"], weights).collect())
    assert got == [(False, "B", 5.25), (True, "C", 1.0)]


DIFF = """+++ b/pkg/a.go
@@ -1,3 +4,6 @@ func F() {
+x
@@ -30 +33 @@ func F() {
@@ -40 +43,2 @@ func G() {
+++ b/pkg/a_test.go
@@ -1 +1 @@ func T() {
+++ b/README.md
@@ -1 +1 @@"""
CODE = "package p\nfunc (r *Repo) Find(id string) {\n\tif x {\n\t\ty()\n\t}\n}\nvar a = 1\nfunc Top() { z() }\nfunc Last() {\n\tq(1)\n}"


def test_texts(spark):
    df = spark.createDataFrame([("d", DIFF)], "k string, text string")
    hunks = texts.diff_hunks(texts.lines_of(df, ["k"]), ["k"]).orderBy("n").collect()
    assert [(h.file, h.start, h.header) for h in hunks] == [("pkg/a.go", 4, "func F() {"), ("pkg/a.go", 43, "func G() {")]
    code = texts.lines_of(spark.createDataFrame([("c", CODE)], "k string, text string"), ["k"])
    assert [tuple(r)[1:] for r in texts.function_blocks(code, ["k"]).orderBy("first").collect()] == [("Repo", "Find", 2, 6), ("", "Top", 8, 8), ("", "Last", 9, 11)]
    points = spark.createDataFrame([("c", 10)], "k string, at int")
    assert texts.windows_around(code, points, ["k"], "at", 1, 5).first().text == "func Last() {\n\tq(1)\n}"
    c = lambda x: spark.range(1).select(x).first()[0]
    assert c(texts.called_names(F.lit("if f(x) { g(h(1)) }"))) == ["f", "g", "h"] and c(texts.calls_in(F.lit("a.b.C(d) e.F()"))) == ["b.C", "e.F"]


def test_unit_split_limits(spark):
    lines = texts.lines_of(spark.createDataFrame([("c", "\n".join(("func x" if i % 7 == 0 else "  y") for i in range(50)))], "k string, text string"), ["k"])
    got = [(r.first, r.last) for r in texts.unit_split(lines, ["k"], F.startswith("line", F.lit("func")), max_lines=10).orderBy("unit").collect()]
    assert got[0] == (1, 7) and got[-1][1] == 50 and all(b - a < 10 for a, b in got) and all(x[1] + 1 == y[0] for x, y in zip(got, got[1:]))


def test_graph_and_spans(spark, scratch_core):
    edges = spark.createDataFrame([("s", "a", False, "1"), ("a", "b", True, "2"), ("s", "b", False, "3"), ("b", "c", False, "4"), ("c", "a", False, "5"), ("c", "c", False, "6")], "caller string, callee string, dispatch boolean, label string")
    seeds = spark.createDataFrame([("s", 1, "seed"), ("c", 3, "weak")], "node string, origin int, label string")
    got = {r.node: (r.state.origin, r.state.dispatch, r.state.hops, r.state.path) for r in graph.reach(edges, seeds, 5, scratch_core).collect()}
    assert got == {"s": (1, False, 0, ["seed"]), "a": (1, False, 1, ["seed", "1"]), "b": (1, False, 1, ["seed", "3"]), "c": (1, False, 2, ["seed", "3", "4"])}
    assert {r.node for r in graph.reach(edges, seeds.where("node = 's'"), 1, scratch_core).collect()} == {"s", "a", "b"}
    rows = spark.createDataFrame([("x", "gated", "net/http"), ("y", "free", None), ("z", "shut", "os/exec")], "grp string, id string, gate string")
    imports = spark.createDataFrame([("x", "net/http/httptest"), ("z", "os")], "grp string, package string")
    assert {r.id for r in matching.gated(rows, imports, "grp", "gate").collect()} == {"gated", "free"}
    checks = spark.createDataFrame([("g", 5), ("g", 9)], "grp string, line int")
    span = spark.createDataFrame([("g", 5, 8), ("g", 4, 6), ("h", 1, 9)], "grp string, lo int, hi int")
    assert sorted(tuple(r) for r in spans.unprotected(span, checks, ["grp"]).collect()) == [("g", 5, 8), ("h", 1, 9)]
    assert sorted(tuple(r) for r in spans.unprotected(span, checks, ["grp"], closed_low=True).collect()) == [("h", 1, 9)]


def test_producer_json(spark, tmp_path):
    import json

    one = {"repo": "r", "dir": "pkg", "functions": [{"file": "a.go", "name": "F", "receiver": "", "line": 3, "calls": None}], "imports": {"a.go": {"stdlib": ["os"], "third_party": None}},
           "data_flow_indicators": [{"file": "a.go", "function": "F", "sources": [{"line": 4, "type": "read"}], "sinks": None}], "call_chains": [{"root_file": "a.go", "root_function": "F", "calls": []}] * 2,
           "param_flows": [{"file": "a.go", "function": "F", "line": 3, "params": [], "taint_sinks": [{"line": 5, "type": "file_read", "roots": ["src"]}], "check_lines": [4]}], "wire_types": [{"file": "a.go", "name": "T"}], "stdlib_signals": [{"package": "os", "apis": ["Open"]}]}
    two = {"repo": "r", "dir": "", "stdlib_signals": [{"package": "os", "apis": ["Open"]}]}
    for i, x in enumerate((one, two)):
        (tmp_path / f"{i}.json").write_text(json.dumps(x, indent=1))
    (tmp_path / "2.json").write_text("{broken")
    read = facts.read_json(spark, str(tmp_path), facts.ANALYSIS).cache()
    assert read.where("_corrupt_record is not null").count() == 1
    t = facts.merged_tables(read.where("_corrupt_record is null"))
    assert [r.file for r in t["functions"].collect()] == ["pkg/a.go"] and t["call_chains"].count() == 1 and t["signals"].count() == 1
    assert [(r.function, r.kind, r.line) for r in t["flow_points"].collect()] == [("pkg/a.go:F", "source", 4)]
    assert [(r.function, r.roots) for r in t["taint_sinks"].collect()] == [("pkg/a.go:F", ["src"])] and [r.dir for r in t["wire_types"].collect()] == ["pkg"]
    mods = facts.modules_of(spark.createDataFrame([("r", "sub/go.mod", "module example.com/x\n\ngo 1.23\n")], "repo string, path string, text string")).first()
    assert (mods.module, mods.rel_dir) == ("example.com/x", "sub")
    paths = spark.createDataFrame([(p,) for p in ("a/b.go", "vendor/x/y.go", "main.go", "a/b/c/d/e/f.go", "a/b_test.go", "c/testdata/z.go")], "p string")
    assert {r.folder for r in facts.package_folders(paths, "p").collect()} == {"a", ""}


def test_sinks_and_state(spark, tmp_path):
    done = spark.createDataFrame([(1, False), (2, True)], "id int, failed boolean")
    tasks = spark.createDataFrame([(i,) for i in range(4)], "id int")
    assert sorted(r.id for r in incremental.pending(tasks, done, ["id"], F.col("failed")).collect()) == [0, 2, 3]
    assert sorted(r.id for r in incremental.pending(tasks, done, ["id"], F.col("failed"), retry_failed=False).collect()) == [0, 3]
    old, new = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string"), spark.createDataFrame([(2, None, "z"), (3, "c", None)], "id int, v string, w string")
    assert sorted(tuple(r) for r in incremental.kept_when_empty(old, new, ["id"]).collect()) == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    assert sorted(r.id for r in incremental.upserted(old, new, ["id"]).collect()) == [1, 2, 3]
    log = spark.createDataFrame([('{"Authorization": "Bearer abc123", "n": 1}',)], "request string")
    sinks.append_log(log, str(tmp_path / "log"), ["request"])
    sinks.append_log(log, str(tmp_path / "log"), ["request"])
    saved = [r.value for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert len(saved) == 2 and not any("abc123" in s for s in saved)
    assert sinks.markdown(old, ["id", "v"], ["id"]) == "| id | v |\n|---|---|\n| 1 | a |\n| 2 | b |\n"
    hits, misses = incremental.cached(old, spark.range(0).selectExpr("'x' as cache_key", "'r' as reply"), ["v"])
    assert hits.isEmpty() and misses.count() == 2


def test_streams(spark, tmp_path):
    """Extension: windows over a stream of files, late rows dropped."""
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([(at(1), "a", 1.0), (at(2), "a", 2.0), (at(30), "a", 5.0)], "ts timestamp, k string, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = incremental.stream_windows(stream, "ts", ["k"], "5 minutes", "10 minutes", "value").writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.total) for r in spark.sql("select * from windows").collect()] == [(2, 3.0)]


def test_gates(spark):
    from quern.plans import gates

    t = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    functions = t([("r", f"a.go:{n}", "a.go", n) for n in ("HandleLogin", "quiet", "sinkOnly", "both")], "repo string, function string, file string, name string")
    points = t([("a.go:sinkOnly", "sink", "command_execution"), ("a.go:both", "source", "read"), ("a.go:both", "sink", "command_execution")], "function string, kind string, type string")
    calls = t([("a.go:HandleLogin", "http.HandleFunc"), ("a.go:both", "os.Open"), ("a.go:both", "Open")], "function string, callee string")
    imports = t([("a.go", ["os/exec"]), ("b.go", ["fmt"])], "file string, stdlib array<string>")
    scored = gates.prioritised(functions, points, calls, imports, t([("os.Open",)], "api string"))
    assert {r.name: r.score for r in scored.collect()} == {"HandleLogin": 2 + 2 + 1, "quiet": 2, "sinkOnly": 11 + 2, "both": 3 + 4 + 2}
    more = gates.with_facts(scored.where("name = 'quiet'"), functions, points)
    assert {r.name: r.score for r in more.collect()} == {"quiet": 2, "sinkOnly": 15, "both": 15}
    assert [r.name for r in gates.first_n(scored, 2).orderBy("place").collect()] == ["sinkOnly", "both"]
    assert [r.name for r in gates.first_n(functions, 2, t([("a.go:quiet",)], "function string")).orderBy("place").collect()] == ["quiet", "HandleLogin"]
    assert {r.name for r in gates.with_flow(functions, points).collect()} == {"sinkOnly", "both"}
    assert {r.name for r in gates.focused(functions.withColumn("receiver", F.lit("")), ["quiet"], ["a.go"]).collect()} == {"quiet"}
    c = lambda x: spark.range(1).select(x).first()[0]
    assert [c(gates.is_test_path(F.lit(p))) for p in ("a/b_test.go", "x/testutil/h.go", "latest/h.go", "test.go", "a/db_mock.go", "example/x.go")] == [True, True, False, False, True, True]
    lines = t([("a.go", 1, "func Run() {"), ("a.go", 2, " Run(x); Go()"), ("a_test.go", 3, "Run()"), ("vendor/v.go", 1, "Run()"), ("b.go", 9, "p.Run ()")], "file string, n int, line string")
    assert [(r.file, r.n) for r in gates.callers_in_text(lines, t([("Run",)], "name string")).orderBy("file").collect()] == [("a.go", 2), ("b.go", 9)]
    ids = t([("k", "1"), ("m", "2"), ("m", "3")], "function string, function_id string")
    assert {r.function: (r.function_id, r.ambiguous) for r in gates.mapped_ids(t([("k",), ("m",), ("n",)], "function string"), ids).collect()} == {"k": ("1", False), "m": (None, True), "n": (None, False)}
    adv = gates.advisories_with_commits(t([("G1", "Foo/Bar"), ("G2", "x/y")], "go_id string, repo string"), t([("foo/bar", "c1", 1), ("FOO/bar", "c2", 2), ("z/z", "c3", 1)], "repo string, commit string, ord int"))
    assert sorted((str(r.go_id), r.repo, r.commit) for r in adv.collect()) == [("G1", "Foo/Bar", "c2"), ("G2", "x/y", None), ("None", "z/z", "c3")]
    summary = gates.validation_summary(t([("G1", ["f", "g"]), ("G2", [])], "go_id string, functions array<string>"), t([("f", "c", 1), ("f", "d", 2)], "function string, category string, unit_id int"), t([(1, "yes")], "unit_id int, verdict string"))
    assert {r.go_id: (r.findings, r.categories, r.verdicts) for r in summary.collect()} == {"G1": (2, ["c", "d"], ["yes"]), "G2": (0, [], [])}
    empty = t([], "domain string, confidence double")
    inferred = gates.domains(empty, t([(["net", "fs"],), (["net"],)], "domain_hints array<string>"))
    assert {r.domain: round(r.confidence, 3) for r in inferred.collect()} == {"net": 1.0, "fs": 0.667}
    split = gates.split_imports(t([("r", "a.go", ["os", "github.com/x/go-y/v2"])], "repo string, file string, paths array<string>"))
    assert [(r.path, r.standard, r.alias) for r in split.orderBy("path").collect()] == [("github.com/x/go-y/v2", False, "y"), ("os", True, "os")]
