"""The two whole appraisals, from requests and from a dependency graph in a file, against the registered query over everything."""

import json

import pytest

import __spark_entry__ as entry
from pkgrisk.operators.resolve import failures, parse_requests
from pkgrisk.plans.appraise import Sources, appraise_graph, appraise_packages
from pkgrisk.plans.policy_queries import _FLAGSHIP
from pkgrisk.plans.shadow import Shadow, now
from pkgrisk.sources.landed import read_graph

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shadow(spark):
    return Shadow(spark, FOLDER)


@pytest.fixture(scope="module")
def everything(spark):
    rows = entry.queries()["package_risk"](spark, FOLDER).collect()
    return {(r.name, r.version): (r.score, r.risk) for r in rows}


def test_requests(spark, shadow, everything):
    chosen = sorted(everything)[:3]
    asked = [f"{name}@{version}" for name, version in chosen[:2]] + [chosen[2][0], chosen[2][0], "Customer#00000000", f"{chosen[0][0]}@99.0.0", "b@x"]
    requests = parse_requests(spark.createDataFrame([(a,) for a in asked], "request string"))
    judged, resolved = appraise_packages(requests.filter("error is null"), shadow.registry, Sources(), _FLAGSHIP, now())
    got = {(r.name, r.version): (r.score, r.risk) for r in judged.select("name", "version", "appraisal.score", "appraisal.risk").collect()}
    assert got == {key: everything[key] for key in chosen}
    failed = {r.name: r.status for r in failures(resolved, requests).collect() if r.name != chosen[0][0]}
    assert failed["Customer#00000000"] == "CrateNotFound" and len(failed) == 2
    assert "VersionNotFound" in {r.status for r in failures(resolved, requests).collect()}


def test_graph_from_a_file(spark, shadow, everything, tmp_path):
    (root, rv), (used, uv), (built, bv), (other, ov) = sorted(everything)[:4]

    def package(name, version, *needs):
        return {
            "id": f"{name} {version}", "name": name, "version": version, "features": {}, "targets": [{"kind": ["lib"]}],
            "dependencies": [{"name": n, "rename": None, "kind": k, "optional": False, "uses_default_features": True, "features": []} for n, k in needs],
        }

    def node(name, version, *needs):
        deps = [{"name": n, "pkg": f"{n} {v}", "dep_kinds": [{"kind": k}]} for n, v, k in needs]
        return {"id": f"{name} {version}", "features": [], "dependencies": [d["pkg"] for d in deps], "deps": deps}

    graph = {
        "packages": [package(root, rv, (used, None), (built, "build")), package(used, uv), package(built, bv), package(other, ov)],
        "workspace_members": [f"{root} {rv}"],
        "resolve": {"root": f"{root} {rv}", "nodes": [node(root, rv, (used, uv, None), (built, bv, "build")), node(used, uv), node(built, bv), node(other, ov)]},
    }
    (tmp_path / "graph.json").write_text(json.dumps(graph, indent=1))
    tables = read_graph(spark, str(tmp_path / "graph.json"))
    assert {(r.name, r.is_root, r.is_member) for r in tables["packages"].collect()} == {(root, True, True)} | {(n, False, False) for n in (used, built, other)}
    for types, reached in (((), {root, used, built}), (("standard",), {root, used})):
        judged, resolved = appraise_graph(tables, shadow.registry, Sources(), _FLAGSHIP, now(), types=types)
        got = {r.name: (r.score, r.risk) for r in judged.select("name", "appraisal.score", "appraisal.risk").collect()}
        assert got.keys() - {root} == reached - {root}
        assert all(got[n] == everything[n, v] for n, v in sorted(everything)[:4] if n in got)
        assert {r.status for r in resolved.collect()} == {"Found"}
    (tmp_path / "graph.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_graph(spark, str(tmp_path / "graph.json"))["packages"].collect()
