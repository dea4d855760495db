"""Look-ups on a small snapshot: caps, odd requests, and where conversations end."""

import json

import pytest

from quern.plans import tools

RUN = "run int, turn int, response string, error string"


def ask(*requests):
    return json.dumps({"action": "query", "requests": list(requests)})


@pytest.fixture(scope="module")
def snapshot(spark):
    lines = [("a.go", n, f"line {n} of a") for n in range(1, 301)] + [("b.go", 1, "x" * 20_000), ("b.go", 2, "short")] + [("c.go", n, "y" * 100) for n in range(1, 200)] + [("d.go", n, "hit me") for n in range(1, 121)]
    functions = [("f1", "a.go", "F", 5, 9), ("f2", "a.go", "G", 8, 20), ("f3", "d.go", "H", 1, 120)]
    uses = [("a.go", k, "Size", 8 + k, "T" if k % 2 else None, f"e{k}") for k in range(4)] + [("sub/b.go", 0, "Size", 2, "T", "far")]
    edges = [("f1", "f2", "a.go", 6), ("f3", "f2", "d.go", 3), ("f1", None, "a.go", 7)]
    return {
        "lines": spark.createDataFrame(lines, "file string, n int, line string"), "functions": spark.createDataFrame(functions, "function_id string, file string, name string, line int, end_line int"),
        "uses": spark.createDataFrame(uses, "file string, ord int, name string, line int, type_id string, expression string"), "edges": spark.createDataFrame(edges, "caller string, callee string, file string, line int"),
        "taints": spark.createDataFrame([("f2", 1, "second"), ("f2", 0, "first")], "function_id string, ord int, path string"),
    }


def replies(spark, snapshot, *requests):
    rows = [(k, 1, ask(r), None) for k, r in enumerate(requests)]
    out = tools.results(tools.requests_of(spark.createDataFrame(rows, RUN)), **snapshot).collect()
    return [r for _, r in sorted((r.run, r) for r in out)]


def test_reading(spark, snapshot):
    read = lambda file, a, z: {"tool": "read_lines", "file": file, "start_line": a, "end_line": z}
    got = replies(spark, snapshot, read("a.go", 7, 9), read("a.go", 1, 300), read("a.go", 290, 301), read("b.go", 1, 2), read("c.go", 1, 199), read("e.go", 1, 1), read("a.go", 5, 4), read("a.go", "7", 9), read("a.go", 7.0, 9), {"tool": "read_function", "function_id": "f2"}, {"tool": "read_function", "function_id": "nope"})
    assert [(len(r.matches), r.truncated, r.error) for r in got] == [(3, False, None), (240, True, None), (0, False, "line range outside source"), (1, True, None), (178, True, None), (0, False, "unknown file"), (0, False, "line range outside source"), (0, False, "invalid range"), (0, False, "invalid range"), (13, False, None), (0, False, "unknown function_id")]
    assert [(m.line, m.text, m.function_ids) for m in got[0].matches] == [(7, "line 7 of a", ["f1"]), (8, "line 8 of a", ["f1", "f2"]), (9, "line 9 of a", ["f1", "f2"])]
    assert len(got[3].matches[0].text) == tools.MAX_CHARS


def test_searches_and_links(spark, snapshot):
    use = lambda **x: {"tool": "find_field_uses", "field": "Size", **x}
    got = replies(spark, snapshot, {"tool": "search_symbol", "symbol": "hit"}, {"tool": "search_symbol", "symbol": "line 30 "}, {"tool": "search_symbol", "symbol": ""}, {"tool": "search_symbol", "symbol": 5}, use(), use(type_id="T"), use(path_prefix="sub/", type_id=None), use(path_prefix="a/../b"), use(path_prefix=3), use(type_id=""), {"tool": "find_field_uses", "field": "a b"}, {"tool": "get_callers", "function_id": "f2"}, {"tool": "get_callees", "function_id": "f1"}, {"tool": "get_taint_path", "function_id": "f2"}, {"tool": "shell", "function_id": "f2"}, {"tool": None, "function_id": "f9"}, {})
    assert [(len(r.matches), r.truncated, r.error) for r in got] == [
        (100, True, None), (1, False, None), (0, False, "invalid symbol"), (0, False, "invalid symbol"), (5, False, None), (3, False, None), (1, False, None), (0, False, "invalid path prefix"), (0, False, "invalid path prefix"), (0, False, "invalid type_id"), (0, False, "invalid field"),
        (2, False, None), (2, False, None), (2, False, None), (0, False, "tool not allowed"), (0, False, "unknown function_id"), (0, False, "unknown function_id")]
    assert [m.text for m in got[11].matches] == ["f1", "f3"] and [m.text for m in got[12].matches] == ["f2", ""] and [m.text for m in got[13].matches] == ["first", "second"]
    assert [m.line for m in got[0].matches] == list(range(1, 101))


def test_where_runs_end(spark):
    one, finish = ask({"tool": "x"}), '{"action":"finish"}'
    runs = {"finished": [one, finish, one], "model_error: late": [one, ("late", None)], "invalid_response": ["[1]"], "invalid_query_protocol": [ask(*[{}] * 4)], "investigation_budget_exhausted": [one] * 7, "pending": [one, one]}
    rows = [(k, t + 1, *(a[::-1] if isinstance(a, tuple) else (a, None))) for k, answers in enumerate(runs.values()) for t, a in enumerate(answers)]
    responses = spark.createDataFrame([*rows, rows[0], (50, 1, ask(1), None), (51, 1, '{"action":5}', None), (52, 1, "no", None)], RUN)
    got = {r.run: (r.turns, r.outcome) for r in tools.outcomes(responses).collect()}
    assert got == {0: (2, "finished"), 1: (2, "model_error: late"), 2: (1, "invalid_response"), 3: (1, "invalid_query_protocol"), 4: (6, "investigation_budget_exhausted"), 5: (2, "pending"), 50: (1, "invalid_query_protocol"), 51: (1, "invalid_query_protocol"), 52: (1, "invalid_response")}
    asked = tools.requests_of(responses).groupBy("run").count().collect()
    assert {r["run"]: r["count"] for r in asked} == {0: 1, 1: 1, 4: 6, 5: 2}


def test_what_many_runs_ask_for_is_looked_up_once(spark, snapshot):
    """Sixty runs that ask the same meet no use, edge or line sixty times."""
    from tests.work import shuffled

    use, calls = {"tool": "find_field_uses", "field": "Size", "path_prefix": "sub/"}, {"tool": "get_callees", "function_id": "f3"}
    asks = [use, calls, {"tool": "read_lines", "file": "a.go", "start_line": 1, "end_line": 200}]
    rows = [(k, 1, json.dumps({"action": "query", "requests": asks}), None) for k in range(60)]
    big = dict(snapshot)
    big["uses"] = spark.range(300).selectExpr("concat('sub/', id) AS file", "0 AS ord", "'Size' AS name", "1 AS line", "'T' AS type_id", "'' AS expression")
    big["edges"] = spark.range(300).selectExpr("'f3' AS caller", "'f2' AS callee", "concat(id, '.go') AS file", "1 AS line")
    requests = tools.requests_of(spark.createDataFrame(rows, RUN)).localCheckpoint()
    got = []
    assert shuffled(spark, lambda: got.extend(tools.results(requests, **big).collect())) < 4000
    assert len(got) == 180 and {(r.tool, len(r.matches), r.truncated) for r in got} == {("find_field_uses", 100, True), ("get_callees", 100, True), ("read_lines", 200, False)}
