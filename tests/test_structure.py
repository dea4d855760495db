"""Nested intervals, guards, sinks and bindings against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval, spans
from quern.plans import binding, sink_rules, structure
from quern.scratch import Scratch


@pytest.fixture(scope="module")
def scratch(spark):
    with Scratch(spark) as s:
        yield s


def nested(rnd, low, high, depth=0):
    """Random intervals that nest in [low, high]."""
    out = []
    while low < high and rnd.random() < 0.8:
        a = rnd.randint(low, high)
        z = rnd.randint(a, high)
        out.append((a, z))
        out += nested(rnd, a + 1, z - 1, depth + 1) if depth < 4 else []
        low = z + 1
    return out


def test_innermost_and_outermost(spark):
    rnd, ranges = random.Random(1), []
    for g in "pqr":
        ranges += [(g, a, z, f"{g}{k}") for k, (a, z) in enumerate(nested(rnd, 1, 80))]
    points = [(g, rnd.randint(0, 81), k) for k, g in enumerate(random.Random(2).choices(["p", "q", "r", "none"], k=200))]
    p, r = spark.createDataFrame(points, "g string, at int, k int"), spark.createDataFrame(ranges, "g string, a int, z int, id string")
    got = {x.k: x["in"] for x in spans.innermost(p, r, ["g"], "at", "a", "z", "id", "in").collect()}
    want = {k: max(((a, -z, i) for h, a, z, i in ranges if h == g and a <= at <= z), default=(0, 0, None))[2] for g, at, k in points}
    assert got == want and len(got) == len(points) and len(set(got.values())) > 8
    outer = {x.id for x in spans.outermost(r, ["g"], "a", "z").collect()}
    assert outer == {i for g, a, z, i in ranges if not any(h == g and b <= a and z <= y and (b, y) != (a, z) for h, b, y, _ in ranges)}


PART = "array<struct<line:int,text:string,idents:array<string>,calls:array<string>>>"


def test_guards_look_at_the_latest_assignment(spark):
    guards = [
        ("f", 1, 10, "if", True, "err", [(10, "err != nil", ["err", "nil"], [])]), ("f", 2, 20, "if", True, "", [(20, "ok(u) && err != nil", ["ok", "u", "err"], ["ok", ""])]),
        ("f", 3, 15, "if", False, "", [(15, "x", ["x"], [])]), ("f", 4, 30, "switch-case", True, "403", [(30, "a", ["u"], ["load"]), (31, "b", ["u"], [])]),
        ("f", 5, 35, "switch-case", True, "", [(35, "c", [], [])]), ("f", 6, 36, "switch-case", True, "404", []), ("f", 7, 90, "if", True, "", [(90, "late", [], [])]),
    ]
    assigned = [("f", 1, 9, ["err", "_"], ["open"]), ("f", 2, 18, ["u", "err"], ["load", "load2"]), ("f", 3, 18, ["err"], ["second"]), ("f", 4, 12, ["err"], []), ("f", 5, 25, ["u"], ["again"]), ("g", 1, 1, ["err"], ["other"])]
    functions = [("f", 1, 95, 40)]
    made = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    out = structure.guard_chains(made(guards, f"function string, ord int, line int, kind string, has_return boolean, returns string, parts {PART}"), made(assigned, "function string, ord int, line int, names array<string>, calls array<string>"), made(functions, "function string, start_line int, end_line int, target_line int"))
    got = [(r.n, r.line, r.condition, r.depends_on) for r in out.orderBy("n").collect()]
    assert got == [(1, 10, "err != nil", ["open"]), (2, 20, "ok(u) && err != nil", ["ok", "load", "load2"]), (3, 30, "a | b", ["load", "again", "again"]), (4, 36, "default", [])]
    assert structure.guard_chains(made(guards, f"function string, ord int, line int, kind string, has_return boolean, returns string, parts {PART}"), made([], "function string, ord int, line int, names array<string>, calls array<string>"), made([("f", 1, 95, 0)], "function string, start_line int, end_line int, target_line int")).count() == 5


def test_handlers_own_what_isn_t_in_closures_inside(spark):
    closures = spark.createDataFrame([("f", "h", 10, 50, 1, 9, True, True), ("f", "inner", 20, 30, 2, 4, False, False), ("f", "second", 32, 40, 5, 6, True, True), ("f", "plain", 60, 70, 11, 12, True, False), ("f", "deep", 62, 68, 11, 12, True, True)], "function string, closure string, start int, end int, line int, end_line int, escapes boolean, request boolean")
    call = lambda pos, name: ("f", pos, "a.go", pos, "repo", name, f"repo.{name}(r.ID)", [("r.ID", ["entry"])])
    calls = spark.createDataFrame([call(12, "GetItem"), call(25, "CurrentUser"), call(35, "FindItem"), call(64, "CurrentUser"), call(5, "LoadItem")], "function string, pos int, file string, line int, prefix string, name string, text string, args array<struct<text:string,roots:array<string>>>")
    out = structure.closure_handlers(closures, calls, spark.createDataFrame([], "file string, alias string, path string"))
    got = {r.closure: (r.principal_check, [x.line for x in r.resource_access]) for r in out.collect()}
    assert got == {"h": (False, [12]), "deep": (True, [])}


def split_by_hand(text, args):
    scheme = text.find("://")
    if scheme < 0:
        return None
    auth, path, arg, host, inside, k = set(), set(), 0, False, False, 0
    while k < len(text):
        inside = inside or k > scheme + 2 and text[k] in "/?"
        if text[k] == "%":
            if text[k + 1 : k + 2] == "%":
                k += 1
            else:
                first = k < scheme or not inside and (not host or text[k - 1] == ":")
                if k >= scheme and not inside:
                    inside, host = host and text[k - 1] != ":", True
                if arg < len(args):
                    (auth if first else path).update(args[arg])
                arg += 1
        k += 1
    return sorted(auth), sorted(path)


def test_formats_by_hand(spark):
    rnd = random.Random(3)
    rows = [(k, "".join(rnd.choices(["%s", "%d", "%%", "/", "?", ":", "h", "://", "http://", "%"], k=rnd.randint(0, 9))), [rnd.sample("abcd", rnd.randint(0, 2)) for _ in range(rnd.randint(0, 6))]) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, f string, args array<array<string>>")
    got = {r.k: r.s and (r.s.auth, r.s.path) for r in df.select("k", sink_rules.format_split(F.col("f"), F.col("args")).alias("s")).collect()}
    assert got == {k: split_by_hand(f, a) for k, f, a in rows}


def test_concatenations(spark):
    rows = [(1, [("http://", None), (None, ["a"]), (":8/x", None), (None, ["b"])]), (2, [(None, ["a"]), ("http://", None)]), (3, [("h", None), (None, ["a"])]), (4, [("http://h/", None), (None, ["a"]), (None, None)]), (5, [("see ", None), ("ftp://", None), (None, ["a"]), (None, ["b"])])]
    df = spark.createDataFrame(rows, "k int, p array<struct<literal:string,roots:array<string>>>")
    got = {r.k: r.s and (r.s.auth, r.s.path) for r in df.select("k", sink_rules.concat_split(F.col("p")).alias("s")).collect()}
    assert got == {1: (["a"], ["b"]), 2: None, 3: None, 4: ([], ["a"]), 5: (["a", "b"], [])}


def test_identifiers_stand_for_their_definitions(spark, scratch):
    v = [("f", "u", "ident", "url", None, None, None), ("f", "d1", "format", None, "http://%s/%s", [["a"], ["b"]], None), ("f", "d2", "ident", "base", None, None, None), ("f", "d3", "concat", None, None, None, [("https://", None), (None, ["c"])]), ("f", "loop", "ident", "loop", None, None, None), ("f", "o", "other", None, None, None, None), ("f", "q", "ident", "q", None, None, None)]
    d = [("f", "url", "d1", False, None), ("f", "url", "d2", False, None), ("f", "url", None, True, ["z"]), ("f", "base", "d3", False, None), ("f", "loop", "loop", False, None), ("f", "q", "o", False, None), ("f", "q", None, True, None)]
    out = sink_rules.built(spark.createDataFrame(v, "function string, value string, kind string, name string, format string, args array<array<string>>, parts array<struct<literal:string,roots:array<string>>>"), spark.createDataFrame(d, "function string, name string, value string, append boolean, roots array<string>"), scratch)
    got = {r.value: (r.url and (r.url.auth, r.url.path), r.built) for r in out.collect()}
    assert got == {"u": ((["a", "c"], ["b", "z"]), True), "d1": ((["a"], ["b"]), True), "d2": ((["c"], []), True), "d3": ((["c"], []), True), "loop": (None, False), "o": (None, False), "q": (None, True)}


def test_destinations(spark):
    rows = spark.createDataFrame([("f", 3, "Host", "c.Host = h", ["param:0", "entry"]), ("f", 4, "Path", "u.Path = h", ["entry"]), ("f", 5, "URL", "c.URL = h", [])], "function string, line int, field string, text string, roots array<string>")
    assert [tuple(r) for r in sink_rules.destination_sinks(rows).collect()] == [("f", 3, "http_request", "c.Host = h", ["entry", "param:0"])]


def test_an_answer_binds_whole_or_not(spark):
    fact = lambda **x: {"line": 5, "kind": "sql", **x}
    entry = lambda i, sinks=(), **x: {"function_id": i, "purpose": "", "semantic_inputs": [], "semantic_sinks": list(sinks), "observed_checks": [], **x}
    batches = {
        "good": [entry("a", [fact()]), {k: v for k, v in entry("b").items() if k != "function_id"} | {"function": "b"}], "twice": [entry("a"), entry("a")], "unknown": [entry("a"), entry("z")], "nameless": [entry("a"), {"purpose": ""}], "number": [entry("a"), 7], "null id": [entry("a"), {"function_id": None, "function": "b"}],
        "text": "text", "object": {}, "empty": [], "bool line": [entry("a", [fact(line=True)]), entry("b", [fact(line=5.0)])], "kinds": [entry("a", [fact(kind="x")]), entry("b", [fact(desc=3)])], "shape": [entry("a", purpose=None), entry("b", semantic_sinks={})], "far": [entry("a", [fact(line=99)]), entry("b", [fact(line=99)])],
    }
    answers = spark.createDataFrame([(k, json.dumps(v)) for k, v in batches.items()] + [("broken", "[{")], "batch string, response string")
    asked = spark.createDataFrame([(b, i, lo, hi) for b in [*batches, "broken", "silent"] for i, lo, hi in (("a", 1, 50), ("b", None, None), ("a", 1, 50))], "batch string, function_id string, low int, high int")
    got = {}
    for r in binding.bound(answers, asked).collect():
        got.setdefault(r.batch, {})[r.function_id] = r.reason
        assert (r.item is None) == (r.reason is not None)
    both = lambda x: {"a": x, "b": x}
    odd, bad, wrong = both("duplicate_or_unknown_id"), both("invalid_response"), both("invalid_fact_schema")
    assert got == {"good": both(None), "twice": odd, "unknown": odd, "nameless": odd, "number": odd, "null id": odd, "text": bad, "object": bad, "empty": both("missing_id"), "bool line": wrong, "kinds": wrong, "shape": wrong, "far": {"a": "invalid_fact_schema", "b": None}, "broken": bad, "silent": bad}


@pytest.mark.parametrize("seed,common,growth", [(1, 2, 2), (2, 1, 5), (3, 64, 16)])
def test_nearest_items_by_all_pairs(spark, scratch, seed, common, growth):
    rnd = random.Random(seed)
    token = lambda: f"t{int(rnd.paretovariate(0.7)) % 60}"
    bag = lambda n, most: [(i, t) for i in range(n) for t in {token() for _ in range(rnd.randint(0, most))}]
    q, d = bag(40, 25), bag(30, 12)
    weights = {f"t{i}": rnd.choice([0.0, 0.25, 1.0, 3.5]) for i in range(55)}
    made = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    for itself in (True, False):
        out = retrieval.top_k(made([*q, q[0], (None, "t1"), (1, None)], "query int, token string"), made(d, "item int, token string"), made(list(weights.items()), "token string, idf double"), 3, scratch, common, growth, itself=itself)
        got = {(r["query"], r["place"]): (r["item"], r["shared"], r["score"]) for r in out.collect()}
        want = {}
        for i in {x for x, _ in q}:
            mine = {t for x, t in q if x == i}
            scored = [(-round(sum(weights[t] for t in s), 4), j, len(s)) for j in {y for y, _ in d} if (s := {t for y, t in d if y == j} & mine & weights.keys()) and (itself or i != j)]
            want |= {(i, p + 1): (j, n, -score) for p, (score, j, n) in enumerate(sorted(scored)[:3])}
        assert got == want


def test_nothing_near(spark, scratch):
    none = lambda ddl: spark.createDataFrame([], ddl)
    assert retrieval.top_k(none("query int, token string"), none("item int, token string"), none("token string, idf double"), 3, scratch).collect() == []
