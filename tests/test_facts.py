import json

import pytest
from pyspark.sql import functions as F

from pkgrisk.operators.advisories import advisory_facts, cvss_base_score, severity
from pkgrisk.operators.coverage import coverage_facts
from pkgrisk.operators.docs import broken_links, docs_facts, example_count

ADVISORY = (
    "id string, package string, informational string, severity string, cvss string, "
    "patched array<string>, unaffected array<string>"
)
CRITICAL = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"


@pytest.mark.parametrize(
    "vector, score, band",
    [
        (CRITICAL, 9.8, "critical"),
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:H", 7.5, "high"),
        ("CVSS:3.0/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1, "medium"),
        ("CVSS:3.1/AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:L/A:N", 4.2, "medium"),
        ("CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:L/I:N/A:N", 3.3, "low"),
        ("CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:C/C:H/I:H/A:H", 9.9, "critical"),
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0, "none"),
        ("CVSS:3.1/AV:N", None, None),
        ("junk", None, None),
    ],
)
def test_cvss(spark, vector, score, band):
    c = cvss_base_score(F.col("v"))
    row = spark.createDataFrame([(vector,)], "v string").select(c.alias("s"), severity(c).alias("b")).head()
    assert (row.s, row.b) == (score, band)


def test_advisory_facts(spark):
    rows = [
        ("1", "p", None, None, CRITICAL, [">=1.2.0"], ["<1.0.0"]),
        ("2", "p", "unmaintained", None, CRITICAL, [], []),
        ("3", "p", None, "high", None, [">=1.0.5, <1.1.0", ">=1.1.3"], []),
        ("4", "p", "other", None, CRITICAL, [], []),
        ("5", "p", None, None, None, [], []),
        ("6", "q", None, "low", None, [], []),
    ]
    packages = spark.createDataFrame(
        [("p", "0.9.0"), ("p", "1.1.0"), ("p", "1.0.7"), ("p", "1.2.0-rc.1"), ("p", "2.0.0"), ("none", "1.0.0")],
        "name string, version string",
    )
    got = {}
    for r in advisory_facts(spark.createDataFrame(rows, ADVISORY), packages).collect():
        v = r.advisories.per_version
        got[r.name, r.version] = (v.critical_vulnerability_count, v.high_vulnerability_count, v.unmaintained_warning_count)
        t = r.advisories.total
        want = (1, 1, 1) if r.name == "p" else (0, 0, 0)
        assert (t.critical_vulnerability_count, t.high_vulnerability_count, t.unmaintained_warning_count) == want
        assert t.low_vulnerability_count == 0 and t.yanked_warning_count == 0
    assert got == {
        ("p", "0.9.0"): (0, 1, 1), ("p", "1.1.0"): (1, 1, 1), ("p", "1.0.7"): (1, 0, 1),
        ("p", "1.2.0-rc.1"): (1, 0, 1), ("p", "2.0.0"): (0, 0, 1), ("none", "1.0.0"): (0, 0, 0),
    }


def test_coverage(spark):
    rows = [
        ("a", "main", 404, ""), ("a", "master", 200, "<t>72.5%</t>"),
        ("b", "main", 200, "<t>80%</t><t>10%</t>"), ("b", "master", 200, "<t>1%</t>"),
        ("c", "main", 200, "<t>unknown</t>"), ("d", "main", 500, ""), ("d", "master", 200, "5%"),
        ("e", "main", 404, ""), ("e", "master", 404, ""),
    ]
    df = spark.createDataFrame(rows, "repo string, branch string, http_status int, body string")
    got = {r.repo: (r.status, r.coverage and r.coverage[0]) for r in coverage_facts(df).collect()}
    assert got == {
        "a": ("Found", 72.5), "b": ("Found", 80.0), "c": ("Unavailable", None), "d": ("Error", None), "e": ("Unavailable", None),
    }


def item(name, docs=None, visibility="public", links=None, inner="struct"):
    return {"name": name, "visibility": visibility, "docs": docs, "links": links or {}, "inner": {inner: {}}}


def document(index, version=57, root=0):
    return json.dumps({"format_version": version, "root": root, "index": index})


def test_docs(spark):
    bodies = {
        "pin-project-lite": document({
            "0": item("pin_project_lite", "front page"),
            "1": item("A", "has\n```\nx\n```\nand\n```\ny\n```"),
            "2": item("B"),
            "3": item("C", "   \n"),
            "4": item("D", "docs", visibility="default"),
            "5": item("E", "docs", inner="use"),
            "6": item("F", "see [`Gone`] and [`Here`]", links={"`Here`": 1}),
        }),
        "old": document({}, version=49),
        "empty": document({}),
        "broken": "{",
        "nothing": "{}",
    }
    df = spark.createDataFrame([(k, "1.0.0", v) for k, v in bodies.items()], "package string, version string, body string")
    got = {r.name: r for r in docs_facts(df).collect()}
    d = got["pin-project-lite"].docs
    assert (d.public_api_elements, d.undocumented_elements, d.examples_in_docs, d.broken_doc_links) == (5, 2, 2, 1)
    assert d.has_crate_level_docs and d.doc_coverage_percentage == 60.0
    assert got["empty"].docs.doc_coverage_percentage == 100.0
    assert got["old"].reason == "unsupported format version 49"
    assert got["broken"].status == "Unavailable" and got["nothing"].reason == "missing 'format_version' field"


@pytest.mark.parametrize(
    "text, links, broken",
    [
        ("[`Foo`]", [], 1), ("[`Foo`]", ["Foo"], 0), ("[`Foo`]", ["`Foo`"], 0), ("[`foo()`]", ["foo"], 0),
        ("[`ab`]", [], 0), ("[`abc`](http://x)", [], 0), ("[`http://abc`]", [], 0), ("[`a::Bcd`]", ["Bcd"], 0),
        ("[`abc`][target]", ["target"], 0), ("[`abc`][other]", ["target"], 1), ("[`abc`][`def`]", ["`def`"], 0),
        ("[`abc`]\n\n[`abc`]: a::Real", ["a::Real"], 0), ("[`abc`]: first\n[`abc`]: second", ["first"], 2),
        ("```\n[`abc`]\n```", [], 0), ("[`abc`] [`abc`]", [], 2),
    ],
)
def test_broken_links(spark, text, links, broken):
    df = spark.createDataFrame([(text, {k: "1" for k in links})], "d string, l map<string,string>")
    assert df.select(broken_links(F.col("d"), F.col("l")).alias("n")).head().n == broken


def test_fences(spark):
    df = spark.createDataFrame([("```\na\n```\n  ```rust\nb",)], "d string")
    assert df.select(example_count(F.col("d")).alias("n")).head().n == 1


def test_requirements_are_dealt_out_before_they_are_read(spark):
    """A small file is one or two tasks; its requirements are read by as many as a shuffle has."""
    advisories = spark.createDataFrame([], "package string, informational string, severity string, cvss string, patched array<string>, unaffected array<string>").union(
        spark.createDataFrame([("a", None, "high", None, [">=2.0.0"], None)], "package string, informational string, severity string, cvss string, patched array<string>, unaffected array<string>")
    )
    packages = spark.createDataFrame([("a", "1.0.0"), ("a", "2.0.0")], "name string, version string")
    facts = advisory_facts(advisories, packages)
    assert "RoundRobinPartitioning" in facts._jdf.queryExecution().executedPlan().toString()
    got = {r.version: r.advisories.per_version.high_vulnerability_count for r in facts.collect()}
    assert got == {"1.0.0": 1, "2.0.0": 0}
