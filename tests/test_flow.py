"""Taint inside functions against a plain fixpoint over random rows of expressions."""

import random

import pytest

from quern.plans import flow
from quern.scratch import Scratch

UNITS = "function string, unit long, line int, kind string, targets array<string>"
EXPRESSIONS = "function string, unit long, start int, end int, kind string, name string"
SEEDS = "function string, name string, root string"


@pytest.fixture(scope="module")
def scratch(spark):
    with Scratch(spark) as s:
        yield s


def tree(rnd, depth=0):
    """A random expression: (kind, name, children)."""
    kind = rnd.choice(["ident"] * 4 + (["call", "cross", "source", "body", "stop", "outbound", "limit", "decompress", "assert", "plain", "plain"] if depth < 3 else []))
    name = {"ident": lambda: rnd.choice("abcde"), "call": lambda: f"f{rnd.randrange(6)}", "cross": lambda: str(rnd.randrange(3)), "source": lambda: rnd.choice(["src", "io"])}.get(kind, lambda: None)()
    return kind, name, [] if kind == "ident" else [tree(rnd, depth + 1) for _ in range(rnd.choice([1, 1, 2]))]


def rows_of(node, at, out):
    """Intervals of an expression's parts from token ``at`` on; the token behind."""
    kind, name, children = node
    first, at = at, at + 1
    for child in children:
        at = rows_of(child, at, out)
    if kind != "plain":
        out.append((first, at - 1, kind, name))
    return at


def roots(node, env, returned, wire):
    """Roots of an expression; ``wire`` gives those of an assertion that finds none, or is None before that is asked."""
    kind, name, children = node
    if kind == "stop":
        return set()
    if kind == "outbound":
        return {"resp"}
    out = set().union(*[roots(c, env, returned, wire) for c in children]) if children else set()
    if kind == "ident":
        return set(env.get(name, ()))
    if kind in ("limit", "decompress"):
        return out - {"lim"} | {"lim" if kind == "limit" else "decomp"}
    if kind == "assert" and wire is not None and id(node) in wire:
        out |= {"wire"}
    return out | ({"body"} if kind == "body" else {name} if kind == "source" else {f"call:{name}"} if kind == "cross" else returned.get(name, set()) & set(flow.ORIGINS) if kind == "call" else set())


def asserts_in(node):
    return ([node] if node[0] == "assert" else []) + [a for c in node[2] for a in asserts_in(c)] if node[0] not in ("stop", "outbound") else []


def by_hand(functions, seeds, objects):
    env = {f: {} for f in functions}
    for f, name, root in seeds:
        env[f].setdefault(name, set()).add(root)
    held = {(f, n) for f, n in objects if env[f].get(n)}
    returned, wire = {}, None
    while True:
        before = repr((sorted((f, sorted((n, sorted(r)) for n, r in e.items())) for f, e in env.items()), sorted((f, sorted(r)) for f, r in returned.items())))
        for f, units in functions.items():
            for _, kind, targets, expression in units:
                found = roots(expression, env[f], returned, wire)
                if kind == "return":
                    returned.setdefault(f, set()).update(found)
                for t in targets or ():
                    if t != "_" and not (kind == "multi" and t in flow.NO_VALUE):
                        env[f].setdefault(t, set()).update(found & {"lim"} if (f, t) in held else found)
        after = repr((sorted((f, sorted((n, sorted(r)) for n, r in e.items())) for f, e in env.items()), sorted((f, sorted(r)) for f, r in returned.items())))
        if before == after:
            if wire is not None:
                return env, {(f, u[0]): sorted(roots(u[3], env[f], returned, wire)) for f, units in functions.items() for u in units}, returned
            wire = {id(a) for f, units in functions.items() for u in units for a in asserts_in(u[3]) if not set().union(*[roots(c, env[f], returned, None) for c in a[2]])}


def test_roots_by_hand(spark, scratch):
    rnd, functions = random.Random(4), {}
    for i in range(40):
        units = []
        for u in range(rnd.randint(1, 9)):
            kind = rnd.choice(["assign", "assign", "multi", "return", "operand", "range"])
            targets = {"assign": rnd.sample("abcde", 1), "range": rnd.sample("abcde_", 2), "multi": [rnd.choice("abcde"), "err"]}.get(kind)
            units.append((u, kind, targets, tree(rnd)))
        functions[f"f{i}"] = units
    functions = {f: functions[f] for f in functions}
    seeds = [(f, rnd.choice("abcde"), rnd.choice(["param:0", "param:1", "entry", "varg:3"])) for f in functions if rnd.random() < 0.6]
    objects = [(f, rnd.choice("abcde")) for f in functions]
    expressions = []
    for f, units in functions.items():
        for u, _, _, expression in units:
            out = []
            rows_of(expression, 1, out)
            expressions += [(f, u, *r) for r in out]
    built = flow.Flow(
        spark.createDataFrame([(f, u, u, k, t) for f, units in functions.items() for u, k, t, _ in units], UNITS), spark.createDataFrame(expressions, EXPRESSIONS),
        spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(objects, "function string, name string"), scratch)
    env, want, returned = by_hand(functions, seeds, objects)
    assert {(r.function, r.unit): r.roots for r in built.roots().collect()} == want
    assert {(r.function, r.name, r.root) for r in built.variables().collect()} == {(f, n, r) for f, e in env.items() for n, rs in e.items() for r in rs if n != "_"}
    got = {r.function: (set(r.origins), set(r.ret_params)) for r in built.returns().collect()}
    assert got == {f: ({r for r in rs if r in flow.ORIGINS}, {int(r[6:]) for r in rs if r.startswith("param:")}) for f, rs in returned.items()}


def test_a_loop_and_a_reassignment_keep_what_was(spark, scratch):
    units = [("f", 1, 1, "assign", ["a"]), ("f", 2, 2, "assign", ["b"]), ("f", 3, 3, "assign", ["c"]), ("f", 4, 4, "assign", ["a"]), ("f", 5, 5, "operand", None)]
    expressions = [("f", 1, 1, 1, "ident", "c"), ("f", 2, 1, 1, "ident", "a"), ("f", 3, 1, 1, "ident", "b"), ("f", 3, 2, 2, "source", "io"), ("f", 4, 1, 3, "stop", None), ("f", 4, 2, 2, "ident", "b"), ("f", 5, 1, 1, "ident", "a")]
    out = flow.Flow(spark.createDataFrame(units, UNITS), spark.createDataFrame(expressions, EXPRESSIONS), spark.createDataFrame([], SEEDS), spark.createDataFrame([], "function string, name string"), scratch)
    assert {r.unit: r.roots for r in out.roots().collect()} == {1: ["io"], 2: ["io"], 3: ["io"], 4: [], 5: ["io"]}


def test_seeds_of_parameters_closures_and_validators(spark, scratch):
    p = spark.createDataFrame([("f", 0, "w", "http.ResponseWriter", True, False), ("f", 1, "r", "*http.Request", True, True), ("f", 2, "x", "string", False, False), ("f", 3, "_", "int", False, False), ("f", 4, "q", "*http.Response", False, False)], "function string, index int, name string, type string, object boolean, request boolean")
    c = spark.createDataFrame([("f", "y", False, False, True), ("f", "z", False, False, False), ("f", "s", True, True, True), ("f", "o", True, False, True)], "function string, name string, object boolean, request boolean, escapes boolean")
    v = spark.createDataFrame([("f", 9, ["x", "r", None, ""], "ok"), ("f", 11, None, None)], "function string, line int, args array<string>, result string")
    got = {(r.name, r.root) for r in flow.seeds_of(p, c, v).collect()}
    assert got == {("w", "param:0"), ("r", "entry"), ("x", "param:2"), ("q", "resp"), ("y", "cb"), ("s", "entry"), ("x", "varg:9"), ("ok", "vret:9")}


def test_sizes_follow_assignments(spark, scratch):
    units = spark.createDataFrame([("f", 1, "assign", ["n"]), ("f", 2, "assign", ["m"]), ("g", 1, "assign", ["n"])], "function string, unit long, kind string, targets array<string>")
    idents = spark.createDataFrame([("f", 1, "k"), ("f", 2, "n"), ("f", 2, "z"), ("g", 1, "k"), ("f", 11, "z"), ("f", 12, "n"), ("f", 13, "m"), ("f", 13, "n"), ("f", 14, "z"), ("g", 11, "n")], "function string, unit long, name string")
    held = flow.tracked(units, idents, spark.createDataFrame([("f", "k"), ("f", "_")], "function string, name string"), scratch)
    assert {(r.function, r.name) for r in held.collect()} == {("f", "k"), ("f", "n"), ("f", "m")}
    uses = spark.createDataFrame([("f", 11, 5, 1, "make", 30, "make(z, n)"), ("f", 12, 5, 2, "make", 30, "make(z, n)"), ("f", 13, 6, 1, "compare", 20, "n < m"), ("f", 14, 7, 1, "index", 40, "p[z]"), ("g", 11, 8, 1, "compare", 3, "n > 1")], "function string, unit long, call long, arg int, kind string, line int, text string")
    sinks, checks = flow.size_flows(uses, idents, held)
    assert [tuple(r) for r in sinks.collect()] == [("f", 30, "alloc_size", "n", "make(z, n)")] and [tuple(r) for r in checks.collect()] == [("f", 20, "m", "n < m")]


def test_no_rows(spark, scratch):
    empty = flow.Flow(spark.createDataFrame([], UNITS), spark.createDataFrame([], EXPRESSIONS), spark.createDataFrame([], SEEDS), spark.createDataFrame([], "function string, name string"), scratch)
    assert empty.roots().collect() == [] == empty.returns().collect() == empty.variables().collect()
