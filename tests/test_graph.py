import random
import re

import pytest

import __spark_entry__ as entry
from pkgrisk.operators import graph as g
from pkgrisk.session import Scratch
from pkgrisk.sources.landed import GRAPH_SCHEMA, graph_tables


def test_reachable_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r.root, r.node) for r in g.reachable(edges).collect()}
    cycle = {(x, y) for x in "abc" for y in "abcd"}
    assert got == cycle
    packages = spark.createDataFrame([("a",), ("d",), ("zz",)], "package string")
    counts = {r.package: r.transitive_dependencies for r in g.transitive_dependency_counts(edges, packages).collect()}
    assert counts == {"a": 4, "d": 0, "zz": 0}


def walk(graph, root, kind):
    """The closure by plain work-list, one root and dependency type."""
    pkgs, nodes = graph["pkgs"], graph["nodes"]

    def expand(pkg, initial):
        out, todo = set(initial), list(initial)
        while todo:
            for a in pkgs[pkg]["features"].get(todo.pop(), []):
                if ":" not in a and "/" not in a and a not in out:
                    out.add(a)
                    todo.append(a)
        return out

    def hops(pkg, on, kind):
        for lib, dep, kinds in nodes[pkg]["deps"]:
            if kind not in kinds:
                continue
            named = [d for d in pkgs[pkg]["deps"] if (d["rename"] or d["name"]) == lib]
            decl = next((d for d in named if d["kind"] == kind), named[0] if named else None)
            if decl is None:
                yield dep, set()
                continue
            acts = [a for f in on for a in pkgs[pkg]["features"].get(f, [])]
            if decl["optional"] and not (
                lib in on or any(a == f"dep:{lib}" or a.startswith(f"{lib}/") or a == lib for a in acts)
            ):
                continue
            feats = set(decl["features"]) | ({"default"} if decl["uses_default"] else set())
            feats |= {a.split("/", 1)[1] for a in acts if a.startswith((f"{lib}/", f"{lib}?/"))}
            yield dep, feats

    seen, todo = {}, list(hops(root, expand(root, nodes[root]["features"]), kind))
    while todo:
        pkg, feats = todo.pop()
        if pkg in seen and feats <= seen[pkg]:
            continue
        seen[pkg] = seen.get(pkg, set()) | feats
        todo += list(hops(pkg, expand(pkg, seen[pkg]), "normal"))
    return set(seen)


def random_graph(seed, size=14):
    rng = random.Random(seed)
    pkgs, nodes = {}, {}
    names = ["default", "std", "x", "y", "z"]
    for i in range(size):
        libs = rng.sample("abcde", rng.randint(0, 4))
        deps, edges = [], []
        for lib in libs:
            kinds = rng.sample(["normal", "dev", "build"], rng.randint(1, 2))
            edges.append((lib, str(rng.randrange(size)), kinds))
            for kind in kinds:
                if rng.random() < 0.8:
                    deps.append({
                        "name": "real" if rng.random() < 0.3 else lib, "rename": lib, "kind": kind,
                        "optional": rng.random() < 0.6, "uses_default": rng.random() < 0.5,
                        "features": rng.sample(names, rng.randint(0, 2)),
                    })
        choices = names + [f"dep:{x}" for x in libs] + [f"{x}/{f}" for x in libs for f in names] + \
            [f"{x}?/{f}" for x in libs for f in names] + list(libs)
        features = {f: rng.sample(choices, min(len(choices), rng.randint(0, 3))) for f in names}
        pkgs[str(i)] = {"features": features, "deps": deps}
        nodes[str(i)] = {"features": rng.sample(names, rng.randint(0, 2)), "deps": edges}
    return {"pkgs": pkgs, "nodes": nodes}


def as_tables(spark, graph):
    pkgs, nodes = graph["pkgs"], graph["nodes"]
    features = [(p, f, a) for p, d in pkgs.items() for f, acts in d["features"].items() for a in acts]
    deps = [
        (p, i, d["name"], d["rename"], d["kind"], d["optional"], d["uses_default"], d["features"])
        for p, x in pkgs.items() for i, d in enumerate(x["deps"])
    ]
    edges = [(p, lib, dep, kinds) for p, n in nodes.items() for lib, dep, kinds in n["deps"]]
    on = [(p, f) for p, n in nodes.items() for f in n["features"]]
    return (
        spark.createDataFrame(features, "pkg_id string, feature string, activation string"),
        spark.createDataFrame(
            deps,
            "pkg_id string, ord int, name string, rename string, kind string, optional boolean, "
            "uses_default_features boolean, features array<string>",
        ),
        spark.createDataFrame(edges, "pkg_id string, dep_lib_name string, dep_pkg_id string, kinds array<string>"),
        spark.createDataFrame(on, "pkg_id string, feature string"),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closure_against_a_work_list(spark, seed):
    """Optional, weak, renamed and undeclared dependencies, cycles, feature growth."""
    graph = random_graph(seed)
    roots = spark.createDataFrame([(p,) for p in graph["pkgs"]], "pkg_id string")
    got = {(r.root, r.type, r.pkg_id) for r in g.closure_facts(roots, *as_tables(spark, graph)).collect()}
    want = {
        (p, t, q) for p in graph["pkgs"] for t, kind in g.KINDS.items() for q in walk(graph, p, kind)
    }
    assert got == want


def test_roots(spark):
    schema = "pkg_id string, name string, version string, is_member boolean, is_root boolean"
    rows = [("1", "a", "1.0.0", True, False), ("2", "b", "1.0.0", True, False), ("3", "c", "1.0.0", False, False)]
    packages = spark.createDataFrame(rows, schema)

    def ids(df):
        return {r.pkg_id for r in df.collect()}

    assert ids(g.select_roots(packages)) == {"1", "2"}
    assert ids(g.select_roots(packages, names=["b"])) == {"2"}
    with pytest.raises(ValueError, match="package 'c' not found in workspace"):
        g.select_roots(packages, names=["c"])
    rooted = spark.createDataFrame([("1", "a", "1.0.0", True, True), *rows[1:]], schema)
    assert ids(g.select_roots(rooted)) == {"1"}
    assert ids(g.select_roots(rooted, workspace=True)) == {"1", "2"}


def test_hyphenated_names(spark):
    edges = spark.createDataFrame([("p", "a_b", "q", ["normal"])], "pkg_id string, dep_lib_name string, dep_pkg_id string, kinds array<string>")
    deps = as_tables(spark, random_graph(1))[1].limit(0).unionByName(
        spark.createDataFrame(
            [("p", 0, "a-b", None, "normal", False, True, ["x"])],
            "pkg_id string, ord int, name string, rename string, kind string, optional boolean, "
            "uses_default_features boolean, features array<string>",
        )
    )
    assert not g.edge_declarations(edges, deps).head().declared
    assert g.edge_declarations(edges, deps, normalize_names=True).head().declared


def test_graph_document(spark):
    body = """{"packages":[{"id":"r","name":"root","version":"0.1.0","features":{"default":["std"],"std":[]},
      "targets":[{"kind":["example"]}],"dependencies":[{"name":"x","rename":null,"kind":null,"optional":false,"uses_default_features":true,"features":[]}]},
      {"id":"x","name":"x","version":"1.0.0","features":{},"targets":[],"dependencies":[]}],
      "workspace_members":["r"],"resolve":{"root":"r","nodes":[
      {"id":"r","features":["default"],"dependencies":["x"],"deps":[{"name":"x","pkg":"x","dep_kinds":[{"kind":null}]}]},
      {"id":"x","features":[],"dependencies":[],"deps":[]}]}}"""
    from pyspark.sql import functions as F

    doc = spark.createDataFrame([(body,)], "b string").select(F.from_json("b", GRAPH_SCHEMA).alias("d")).select("d.*")
    t = graph_tables(doc)
    roots = g.select_roots(t["packages"])
    closure = g.closure_facts(roots, t["package_features"], t["package_deps"], t["resolve_edges"], t["resolve_features"], types=("standard",))
    assert [tuple(r) for r in g.closure_requests(closure, t["packages"]).collect()] == [("x", "1.0.0")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dep_declaration", "dep_features", "optional_active"])
def test_rows_of_packages_are_never_broadcast(spark, name):
    """A list made per package is estimated by the file it comes from, however many rows it gives."""
    plan = _plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "Join" in plan and "Broadcast" not in plan


def test_closure_broadcasts_nothing(spark):
    name = "closure_features"
    plan = _plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "Join" in plan and "Broadcast" not in plan


def test_pairs_are_not_shuffled(spark):
    """Rows of a state meet their roots as bits; what is made of them stays where it is."""
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    plan = _plan(g.reachable(edges)).split("Initial Plan")[-1]
    assert "Generate" in plan and not {"Exchange", "Join"} & set(re.findall(r"Exchange|Join", plan[: plan.index("Generate")]))


def test_features_without_effect_take_no_part(spark, monkeypatch):
    """Nothing follows from std and alloc, so no root carries them; roots' own features are no facts of the rounds."""
    found, derive = [], g.derive
    monkeypatch.setattr(g, "derive", lambda *a, **b: found.append(derive(*a, **b)) or found[-1])
    features = spark.createDataFrame(
        [(p, *f) for p in "abc" for f in (("default", "std"), ("std", "alloc"), ("opt", "dep:d"))], "pkg_id string, feature string, activation string"
    )
    deps = spark.createDataFrame(
        [(p, i, n, None, "normal", n == "d", True, ["opt"] if p == "a" else []) for p in "abc" for i, n in enumerate("nd")],
        "pkg_id string, ord int, name string, rename string, kind string, optional boolean, uses_default_features boolean, features array<string>",
    )
    edges = spark.createDataFrame(
        [("a", "n", "b", ["normal"]), ("b", "n", "c", ["normal"]), ("b", "d", "d", ["normal"])], "pkg_id string, dep_lib_name string, dep_pkg_id string, kinds array<string>"
    )
    on = spark.createDataFrame([("a", "default")], "pkg_id string, feature string")
    roots = spark.createDataFrame([("a",)], "pkg_id string")
    rows = g.closure_facts(roots, features, deps, edges, on, types=("standard",)).collect()
    assert {tuple(r) for r in rows} == {("a", "standard", p) for p in "bcd"}
    state = found[-1].state.join(found[-1].atoms, "id")
    held = {tuple(r.atom.split(g._SEP)) for r in state.collect()}
    assert {h for h in held if h[1] == "V"} == {("", "V", p) for p in "bcd"}
    assert held - {("", "V", p) for p in "bcd"} <= {("", "F", "b", "opt")}


def test_atoms_that_bring_one_other_give_way_to_it(spark, monkeypatch):
    """Rounds are as many as the longest way between atoms that are asked for or needed in pairs; rings keep their place."""
    rules = [(f"p{i}", f"f{i}.0") for i in range(4)] + [(f"f{i}.{k}", f"f{i}.{k + 1}" if k < 2 else f"p{i + 1}") for i in range(4) for k in range(3)]
    rules += [("p1", "x"), ("x", "y"), ("y", "x"), ("p2", "left"), ("left", "leftmost"), ("f0.1", "right"), ("both", "p9"), ("p4", "dead"), ("dead", "gone")]
    single = spark.createDataFrame(rules, "src string, dst string")
    both = spark.createDataFrame([("leftmost", "right", "both")], "left string, right string, dst string")
    seeds = spark.createDataFrame([("r", "p0"), ("r", "dead"), ("s", "f3.1"), ("t", "right"), ("t", "p2")], "root string, atom string")
    rounds, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: rounds.append(name) or save(self, df, name))

    def found(asked=None):
        rounds.clear()
        pairs = {(r.root, r.atom) for r in g.as_pairs(g.derive(seeds, single, both, asked=asked)).collect()}
        return {p for p in pairs if p[1].startswith("p")}, sum(name.startswith("round-") for name in rounds)

    (want, before), (got, now) = found(), found(lambda atom: atom.startswith("p"))
    assert got == want and ("t", "p9") in got and ("r", "p9") in got and ("s", "p4") in got
    assert now <= 9 < 15 <= before
