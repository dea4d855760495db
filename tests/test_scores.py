"""Hand-computed scores."""

import pytest
from pyspark.sql import functions as F

from quern.functions import confidence, cvss, scalars

def by_specification(m):
    """The base score of a dict of metrics, as the public specification writes it, in integers of 1/100000 at the end."""
    level = {"H": 0.56, "L": 0.22, "N": 0.0}
    changed = m["S"] == "C"
    iss = 1 - (1 - level[m["C"]]) * (1 - level[m["I"]]) * (1 - level[m["A"]])
    impact = 7.52 * (iss - 0.029) - 3.25 * (iss - 0.02) ** 15 if changed else 6.42 * iss
    privileges = {"N": 0.85, "L": 0.68 if changed else 0.62, "H": 0.5 if changed else 0.27}[m["PR"]]
    ease = 8.22 * {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}[m["AV"]] * {"L": 0.77, "H": 0.44}[m["AC"]] * privileges * {"N": 0.85, "R": 0.62}[m["UI"]]
    if impact <= 0:
        return 0.0
    whole = round(min((1.08 if changed else 1.0) * (impact + ease), 10) * 100_000)
    return whole / 100_000 if whole % 10_000 == 0 else (whole // 10_000 + 1) / 10


def test_all_vectors_by_a_second_formula(spark):
    m, error = cvss.parse_vector(F.col("v"))
    out = cvss.domain(spark).select(cvss.vector(F.struct(*cvss.METRICS)).alias("v")).select("v", m.alias("m"), error.alias("e"))
    rows = out.select("v", "m", "e", cvss.base_score(F.col("m")).alias("s"), cvss.vector(F.col("m")).alias("again")).withColumn("band", cvss.severity(F.col("s"))).collect()
    assert len(rows) == 2592
    for r in rows:
        assert r.s == by_specification(r.m.asDict()) and r.again == r.v and r.e is None
        assert r.band == ("none" if r.s == 0 else "low" if r.s < 4 else "medium" if r.s < 7 else "high" if r.s < 9 else "critical")


def test_default_scores(spark):
    none = F.lit(None)
    m, _ = cvss.resolved(none.cast("map<string,string>"), F.col("c"), none.cast("array<string>"), none.cast("array<string>"))
    rows = spark.createDataFrame([(c,) for c in [*cvss.DEFAULTS, "anything"]], "c string").select("c", m.alias("m")).select("c", "m", cvss.base_score(F.col("m")).alias("s")).collect()
    for r in rows:
        assert "/".join(f"{k}:{v}" for k, v in r.m.asDict().items()) == cvss.DEFAULTS.get(r.c, cvss.OTHER_DEFAULT) and r.s == by_specification(r.m.asDict())


@pytest.mark.parametrize("text,error", [
    ("CVSS:3.1/AV:N", "missing metrics"), ("CVSS:3.9/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", "bad prefix"), ("AV:N/AC:L", "bad prefix"),
    ("CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", "illegal value"), ("", "empty vector"), ("CVSS:3.1/AV:N/AV:L", "duplicate metric"),
    ("CVSS:3.1/AV:N/XX:L", "unknown metric"), ("CVSS:3.1/AVN", "bad segment"), ("cvss:3.1/av:n/ac:l/pr:n/ui:n/s:u/c:n/i:n/a:h", None),
])
def test_bad_vectors(spark, text, error):
    m, e = cvss.parse_vector(F.lit(text))
    row = spark.range(1).select(m.alias("m"), e.alias("e")).first()
    assert row.e == error and (row.m is None) == (error is not None)


def test_metrics_resolve_with_provenance(spark):
    rows = [
        (1, {"AV": "L", "C": "N", "I": "N", "A": "N"}, "input_sanitization", ["http_request"], []),
        (2, {}, "path_validation", [], ["file_write"]),
        (3, {"AV": "network", "AC": "LOW", "E": "U"}, "unknown_category", [], ["command_execution"]),
    ]
    df = spark.createDataFrame(rows, "i int, given map<string,string>, category string, src array<string>, snk array<string>")
    m, p = cvss.resolved(F.col("given"), F.col("category"), F.col("src"), F.col("snk"))
    got = {r.i: (r.m.asDict(), r.p.asDict()) for r in df.select("i", m.alias("m"), p.alias("p")).collect()}
    assert got[1][0]["AV"] == "N" and got[1][1]["AV"] == "ast_fact" and [got[1][0][k] for k in "CIA"] == ["L", "L", "N"] and got[1][1]["C"] == "all_none_override"
    assert got[2][0]["I"] == "H" and got[2][1]["I"] == "sink_upgrade"
    assert got[3][0] == {"AV": "N", "AC": "L", "PR": "N", "UI": "N", "S": "U", "C": "H", "I": "H", "A": "H"} and got[3][1]["AC"] == "llm"


@pytest.mark.parametrize("evidence,source,start,want", [
    (None, "a\nb", 1, (0.0, "no_evidence")), ("L1 x → L2 y", None, 1, (0.5, "source_unavailable")), ("L10 → L12", "a\nb\nc", 10, (1.0, "verified_citation")),
    ("L10 → L19", "a\nb\nc", 10, (0.4, "unverified_citation")), ("L10 only", "a\nb\nc", 10, (0.4, "unverified_citation")),
    ("see `os.Open(p)` here", "x\n\tos.Open(p)\n", 1, (1.0, "verified_citation")), ('uses "exec.Command" there', "nothing", 1, (0.4, "unverified_citation")),
    ("words without code", "words", 1, (0.4, "unverified_citation")), ("f(x) = y", "int f(x)  =\ty;", 1, (1.0, "verified_citation")),
])
def test_code_evidence(spark, evidence, source, start, want):
    s, n = confidence.code_evidence(F.lit(evidence), F.lit(source).cast("string"), F.lit(start))
    assert tuple(spark.range(1).select(s, n).first()) == want


@pytest.mark.parametrize("provenance,hops,want", [("net_direct", 0, 0.7), ("net_nhop", 3, 0.65), ("wire_nhop_dispatch", 2, 0.45), ("cb_nhop", 6, 0.35), ("llm_nhop_dispatch", 8, 0.3), ("param_nhop", 2, 0.6), ("name_dispatch", 1, 0.5), ("", 0, 0.5)])
def test_taint_score(spark, provenance, hops, want):
    assert spark.range(1).select(confidence.taint_score(F.lit(provenance), F.lit(hops))).first()[0] == pytest.approx(want, abs=1e-12)


def test_combined_rounds_as_binary_sums_do(spark):
    """Against Python's rounding of the same binary sums, over a grid of reachable scores."""
    code, flow, template = (0.0, 0.4, 0.5, 1.0), (0.1, 0.2, 0.3, 0.35, 0.4, 0.45, 0.5, 0.523, 0.55, 0.6, 0.65, 0.7, 1.0), (0.3, 0.5, 0.6, 0.7, 0.8, 1.0)
    grid = [(a, b, c) for a in code for b in flow for c in template]
    out = spark.createDataFrame(grid, "a double, b double, c double").select("a", "b", "c", confidence.combined(F.col("a"), F.col("b"), F.col("c")).alias("s"))
    assert [r for r in out.collect() if r.s != round(min(1.0, max(0.0, 0.45 * r.a + 0.35 * r.b + 0.2 * r.c)), 3)] == []


def test_names_and_tokens(spark):
    c = lambda x: spark.range(1).select(x).first()[0]
    assert c(scalars.name_tokens(F.lit("FindSourceByID"))) == ["find", "source"]
    assert c(scalars.alias_of(F.lit("github.com/x/go-yaml.v3/v2"))) == "yaml"
    assert c(scalars.is_standard_package(F.lit("net/http"))) and not c(scalars.is_standard_package(F.lit("golang.org/x/net"))) and not c(scalars.is_standard_package(F.lit("github.com/a/b")))
    assert c(scalars.bare_name(F.lit("a/b.go:T.M"))) == "M" and c(scalars.line_of(F.lit("a.go:17"))) == 17 and c(scalars.line_of(F.lit("none"))) is None
    urls = lambda *u: F.array(*map(F.lit, u))
    assert tuple(c(scalars.patch_commit(urls("https://example.com", "https://go.googlesource.com/net/+/1234567", "https://github.com/Foo/Bar/commit/abcdef1"))))[:2] == ("github.com/Foo/Bar", "abcdef1")
    assert tuple(c(scalars.patch_commit(urls("https://go.googlesource.com/net/+/1234567"))))[:2] == ("github.com/golang/go", "1234567") and c(scalars.patch_commit(urls("x"))) is None
    assert c(scalars.repository(F.lit("github.com/a/b/v2/c"), F.lit(None).cast("string"))) == "github.com/a/b" and c(scalars.repository(F.lit("golang.org/x/net"), F.lit(None).cast("string"))) == "github.com/golang/go"
    import hashlib
    import json

    want = json.dumps(["a\"b\n", 3, ["é", "x"], None], ensure_ascii=False)
    got = scalars.content_id([scalars.json_text(F.lit("a\"b\n")), scalars.json_number(F.lit(3)), scalars.json_texts(urls("é", "x")), scalars.json_text(F.lit(None).cast("string"))])
    assert c(got) == hashlib.sha256(want.encode()).hexdigest()[:24]
    assert c(scalars.provenance(F.lit(1), F.lit(2), F.lit(True), F.lit(False))) == "wire_nhop_dispatch"
    assert c(scalars.json_or_inner(F.lit("Sure!\n```json\n{\"a\": 1}\n```"), "a int"))["a"] == 1
    assert c(scalars.json_or_inner(F.lit("no json"), "a int")) is None
