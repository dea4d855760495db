"""Taint against a plain fixpoint over random call graphs, and small cases of each root."""

import json
import random

import pytest

from quern.plans import taint
from quern.scratch import Scratch
from tests.work import shuffled


def fn(file, function, params=0, sinks=(), calls=(), **more):
    named = [{"index": i, "name": f"v{i}", "type": "string", "first_use": 3} for i in range(params)]
    sites = [site(*c) for c in calls]
    return {"file": file, "function": function, "line": 2, "end_line": 90, "params": named, "taint_sinks": [{"line": n, "type": t, "pattern": t, "roots": list(r)} for n, t, r in sinks], "call_sites": sites, "callees": sites, **more}


def site(line, name, recv, *args):
    return {"line": line, "name": name, "pkg": None, "recv": recv, "nargs": len(args), "args": [{"index": i, "roots": list(r)} for i, r in enumerate(args)]}


def random_graph(rnd, size=14, roots_of=("entry", "wire", "io", "cb", "param:0", "param:1", "call:20", "call:21")):
    out = []
    for i in range(size):
        method = rnd.random() < 0.5
        roots = lambda: rnd.sample(roots_of, rnd.choice([0, 1, 1, 2]))
        target = lambda: (lambda j: (f"g{j % 5}", "x") if j % 2 else (f"f{j}", None))(rnd.randrange(size))
        name = f"T{i}.g{i % 5}" if method else f"f{i}"
        out.append(fn(
            "one.go", name, 2, sinks=[(50, "file_read", roots()), (60, "command_execution", roots())], calls=[(10 + k, *target(), roots(), roots()) for k in range(rnd.randint(0, 3))],
            ret_calls=[site(20 + k, *target(), roots(), roots()) for k in range(rnd.randint(0, 2))], return_roots=roots(), ret_params=rnd.sample([0, 1], rnd.randint(0, 2)), **({"recv_type": f"T{i}"} if method else {})))
    return out


def targets_of(functions, call):
    """Candidates of a call in one folder without packages: a plain function, or methods of the name."""
    fits = [f for f in functions if f["function"].rsplit(".", 1)[-1] == call["name"] and bool(f.get("recv_type")) == bool(call["recv"]) and len(f["params"]) == call["nargs"]]
    kinds = {tuple(p["type"] for p in f["params"]) for f in fits}
    return [] if call["recv"] and len(fits) > 5 and len(kinds) > 1 else sorted(f["function"] for f in fits)


def by_hand(functions, max_hops):
    """Each value's least (hops, path) of each (origin, dispatch), computing all from all until nothing changes."""
    by, best = {f["function"]: f for f in functions}, {}

    def front(key, roots, own):
        out = {}
        for root in roots or ():
            kind, _, n = root.partition(":")
            own_front = {(taint.ROOT_ORIGIN[root], False): (0, ())} if root in taint.ROOT_ORIGIN else best.get(("p", key, int(n)), {}) if kind == "param" and own else best.get(("c", key, int(n), own), {}) if kind == "call" else {}
            for cell, claim in own_front.items():
                out[cell] = min(out.get(cell, claim), claim)
        return out

    def offer(to, claims, by_name, step):
        for (origin, dispatch), (hops, path) in claims.items():
            if hops < max_hops:
                cell, claim = (origin, dispatch or by_name), (hops + 1, (*path, step))
                to[cell] = min(to.get(cell, claim), claim)

    for _ in range(100):
        new = {}
        for key, f in by.items():
            for call in f["call_sites"]:
                for t in targets_of(functions, call):
                    for a in call["args"]:
                        if t != key:
                            offer(new.setdefault(("p", t, a["index"]), {}), front(key, a["roots"], True), bool(call["recv"]), f"one.go:{key}@L{call['line']}")
            for call in f.get("ret_calls") or []:
                targets, passed = targets_of(functions, call), {a["index"]: a["roots"] for a in call["args"]}
                for own in (True, False):
                    fronts = []
                    for t in targets:
                        merged = front(t, by[t].get("return_roots"), False)
                        for i in by[t].get("ret_params") or []:
                            for cell, claim in front(key, passed.get(i), own).items():
                                merged[cell] = min(merged.get(cell, claim), claim)
                        fronts.append(merged)
                    step = f"one.go:{key}@L{call['line']} ← one.go:{targets[0]}" if targets else ""
                    to = new.setdefault(("c", key, call["line"], own), {})
                    if not call["recv"]:
                        for claims in fronts:
                            offer(to, claims, False, step)
                    elif fronts and all(fronts):
                        rank = lambda item: (*item[0], item[1][0])
                        bar = max(min(map(rank, claims.items())) for claims in fronts)
                        for claims in fronts:
                            offer(to, {c: s for c, s in claims.items() if rank((c, s)) >= bar}, True, step)
        new = {v: c for v, c in new.items() if c}
        if new == best:
            break
        best.clear()
        best.update(new)
    else:
        raise AssertionError("no fixpoint")
    out = {}
    for key, f in by.items():
        for sink in f["taint_sinks"]:
            found = []
            for root in sink["roots"]:
                for (origin, dispatch), (hops, path) in front(key, [root], True).items():
                    found.append((origin, dispatch, hops, not root.startswith("param:"), int(root[6:]) if root.startswith("param:") else 0, path))
            if found:
                origin, dispatch, hops, direct, _, path = min(found)
                far = ("direct" if direct else "entry") if not hops else "1hop" if hops == 1 else "nhop"
                out[f"one.go:{key}", sink["line"]] = (f"{taint.ORIGIN_NAMES[origin]}_{far}" + "_dispatch" * dispatch, path)
    return out


CONTEXT = {"modules": "repo string, module string, base string", "wire_types": "repo string, dir string, type_base string", "triaged": "repo string, function string, index int"}


@pytest.fixture(scope="module")
def scratch(spark):
    with Scratch(spark) as s:
        yield s


def found(spark, scratch, repos, retain=False, max_hops=8, dispatch=True, **context):
    """Sinks of each repo's functions."""
    rows = [(repo, json.dumps(f)) for repo, functions in repos.items() for f in functions]
    functions = taint.flows_of(spark.createDataFrame(rows, "repo string, facts string").repartition(3))
    tables = [spark.createDataFrame(context.get(n, []), ddl) for n, ddl in CONTEXT.items()]
    return taint.tainted_sinks(functions, *tables, scratch, max_hops, dispatch, retain).collect()


@pytest.mark.parametrize("max_hops", [8, 2])
def test_claims_are_the_fixpoint_by_hand(spark, scratch, max_hops):
    some = ("io", "param:0", "param:0", "param:1", "call:20", "call:20", "call:21", "cb", "entry")
    repos = {f"r{seed}": random_graph(random.Random(seed), 14, some) if seed % 2 else random_graph(random.Random(seed)) for seed in range(30)}
    out = found(spark, scratch, repos, max_hops=max_hops)
    got = {(r.repo, r.function, r.sink_line): (r.provenance, tuple(r.path)) for r in out}
    want = {(repo, *place): claim for repo, functions in repos.items() for place, claim in by_hand(functions, max_hops).items()}
    assert got == want and len(out) == len(got)
    names = {p for p, _ in got.values()}
    assert any("dispatch" in p for p in names) and any("nhop" in p for p in names)


def provenances(spark, scratch, functions, **options):
    return {r.function: r.provenance for r in found(spark, scratch, {"r": functions}, **options)}


def test_more_input_loses_nothing_at_the_cap(spark, scratch):
    """A near weak claim goes on where a far strong one ends."""
    relay = [fn("n.go", "near", calls=[(4, "X", None, ["io"])]), fn("n.go", "X", 1, calls=[(5, "Y", None, ["param:0"])]), fn("n.go", "Y", 1, sinks=[(9, "file_read", ["param:0"])])]
    far = [fn("n.go", f"hop{i}", 1, calls=[(4, f"hop{i + 1}" if i < 6 else "X", None, ["entry" if i == 0 else "param:0"])]) for i in range(7)]
    far.append(fn("n.go", "zero", calls=[(3, "hop0", None, ["entry"])]))
    assert provenances(spark, scratch, relay) == {"n.go:Y": "io_nhop"}
    assert provenances(spark, scratch, [*relay, *far], max_hops=7)["n.go:Y"] == "io_nhop"
    assert provenances(spark, scratch, [*relay, *far])["n.go:Y"] == "net_nhop"


def test_readers_and_roots_that_carry_nothing(spark, scratch):
    functions = [
        fn("r.go", "unpack", sinks=[(9, "unbounded_read", ["body", "decomp"])]), fn("r.go", "sip", sinks=[(9, "unbounded_read", ["src", "lim"])]),
        fn("r.go", "relay", sinks=[(9, "http_request", ["src", "varg:3", None, "param:x", "call:"])]), fn("r.go", "quiet", sinks=[(9, "file_read", ["resp", "vret:4"])]),
    ]
    assert provenances(spark, scratch, functions) == {"r.go:unpack": "net_direct", "r.go:relay": "net_direct"}
    assert provenances(spark, scratch, functions, retain=True)["r.go:sip"] == "net_direct"


def test_wire_types_callbacks_and_triage(spark, scratch):
    order = fn("w.go", "accept", 1, sinks=[(9, "url_path", ["param:0"])])
    order["params"][0] |= {"type": "Order", "type_base": "Order"}
    called = fn("w.go", "inner", 1, sinks=[(9, "url_path", ["param:0"])])
    called["params"][0] |= {"type": "Order", "type_base": "Order"}
    other = fn("sub/o.go", "Take", 1, sinks=[(9, "url_path", ["param:0"])])
    other["params"][0] |= {"type": "api.Order", "type_base": "Order", "type_pkg": "host/m/api"}
    rest = [fn("w.go", "outer", calls=[(4, "inner", None, [])]), fn("c.go", "hook", 1, sinks=[(9, "file_read", ["param:0"])]), fn("c.go", "setup", callback_refs=[site(5, "hook", None)]), fn("c.go", "idle", 1, sinks=[(9, "file_read", ["param:0"])])]
    rest[0]["callees"] = [site(4, "inner", None, [])]
    out = provenances(spark, scratch, [order, called, other, *rest], wire_types=[("r", "", "Order"), ("r", "lib/api", "Order")], triaged=[("r", "c.go:idle", 0), ("r", "c.go:nobody", 0)], modules=[("r", "host/m", "lib"), ("r", "host", "")])
    assert out == {"w.go:accept": "wire_entry", "sub/o.go:Take": "wire_entry", "c.go:hook": "cb_entry", "c.go:idle": "llm_entry"}


def test_packages_and_receivers(spark, scratch):
    target = fn("lib/a.go", "Open", 1, sinks=[(9, "file_read", ["param:0"])])
    there = {**site(4, "Open", None, ["entry"]), "pkg": "host/m"}
    caller = fn("cmd/b.go", "run")
    caller["call_sites"] = [there]
    own = fn("cmd/b.go", "K.save", 1, recv_type="K", sinks=[(9, "file_read", ["param:0"])])
    selfish = fn("cmd/b.go", "K.all", recv_type="K", calls=[(6, "save", "self", ["io"])])
    assert provenances(spark, scratch, [target, caller, own, selfish], modules=[("r", "host/m", "lib")]) == {"lib/a.go:Open": "net_1hop", "cmd/b.go:K.save": "io_1hop"}
    assert provenances(spark, scratch, [target, caller]) == {}


def test_limits_of_hops_and_dispatch(spark, scratch):
    chain = [fn("h.go", f"hop{i}", 1, calls=[(4, f"hop{i + 1}", None, ["entry" if i == 0 else "param:0"])] if i < 4 else [], sinks=[(9, "file_read", ["param:0"])] if i == 4 else []) for i in range(5)]
    many = [fn("m.go", f"K{i}.Put", 1, recv_type=f"K{i}", sinks=[(9, "file_read", ["param:0"])]) for i in range(8)]
    start = fn("m.go", "start", calls=[(4, "Put", "x", ["entry"])])
    mixed = json.loads(json.dumps([*many, start]))
    mixed[0]["params"][0]["type"] = "int"  # eight methods of two signatures are no interface
    out = found(spark, scratch, {"chain": chain, "many": [*many, start], "mixed": mixed})
    assert [(r.repo, r.provenance) for r in out if r.repo == "chain"] == [("chain", "net_nhop")]
    assert len([r for r in out if r.repo == "many"]) == 8 and not [r for r in out if r.repo == "mixed"]
    out = found(spark, scratch, {"chain": chain, "many": [*many, start]}, max_hops=3, dispatch=False)
    assert out == []


def test_repositories_are_apart_and_order_does_not_matter(spark, scratch):
    graph = random_graph(random.Random(3))
    out = found(spark, scratch, {"one": graph, "two/x": graph[::-1], "three": [fn("a.go", "alone")]})
    by = {r: sorted((x.function, x.sink_line, x.provenance, tuple(x.path)) for x in out if x.repo == r) for r in ("one", "two/x", "three")}
    assert by["one"] == by["two/x"] and by["one"] and not by["three"]


def test_parameters_and_no_rows(spark, scratch):
    chain = [fn("h.go", "a", 2, calls=[(4, "b", None, ["entry"], ["param:1"])]), fn("h.go", "b", 2)]
    tables = [spark.createDataFrame([], ddl) for ddl in CONTEXT.values()]
    functions = taint.flows_of(spark.createDataFrame([("r", json.dumps(f)) for f in chain], "repo string, facts string"))
    assert [tuple(r) for r in taint.tainted_parameters(functions, *tables, scratch).collect()] == [("r", "h.go:b", 0, 0, False, 1, "net_1hop", ["h.go:a@L4"])]
    nothing = taint.flows_of(spark.createDataFrame([], "repo string, facts string"))
    assert taint.tainted_sinks(nothing, *tables, scratch).collect() == [] == taint.tainted_parameters(nothing, *tables, scratch).collect()


def test_calls_times_candidates_are_not_written_out(spark, scratch):
    """300 calls of a name that 300 methods have: what each passes and what each returns goes through what they ask for."""
    methods = [fn("m.go", f"K{i}.Put", 1, recv_type=f"K{i}", return_roots=["io"], ret_params=[0] if i % 2 else [], sinks=[(9, "file_read", ["param:0"])]) for i in range(300)]
    callers = [fn("m.go", f"call{i}", calls=[(4, "Put", "x", ["entry"])], ret_calls=[site(5, "Put", "x", ["entry"]), site(6, "Put", "x", [])], sinks=[(9, "file_read", ["call:5"])]) for i in range(300)]
    out = []
    assert shuffled(spark, lambda: out.extend(found(spark, scratch, {"r": [*methods, *callers]}))) < 60_000
    got = {(r.function, r.provenance, *r.path) for r in out}
    assert len(out) == 600 and {g for g in got if ".Put" in g[0]} == {(f"m.go:K{i}.Put", "net_1hop_dispatch", "m.go:call0@L4") for i in range(300)}
    # methods that return only what they read bar the caller's stronger claim
    assert {g for g in got if "call" in g[0]} == {(f"m.go:call{i}", "io_1hop_dispatch", f"m.go:call{i}@L5 ← m.go:K0.Put") for i in range(300)}
