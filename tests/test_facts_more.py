"""Packages in and outside their repositories, and failures of every kind."""

import json

from pyspark.sql import functions as F

from pkgrisk.operators.codebase import located_codebase
from pkgrisk.operators.docs import docs_facts, docs_facts_of_lines
from pkgrisk.operators.facts import merge_facts
from pkgrisk.operators.resolve import failures, parse_requests
from pkgrisk.sources.landed import read_docs_lines


def test_a_package_its_repository_does_not_hold(spark):
    packages = spark.createDataFrame([("a", "1.0.0", "r1"), ("b", "1.0.0", "r1"), ("c", "1.0.0", "r2"), ("d", "1.0.0", None)], "name string, version string, repo string")
    code = spark.createDataFrame([("r1", "a", 5)], "repo string, name string, n int").select("repo", "name", F.struct("n").alias("codebase"))
    rows = {r.name: r for r in merge_facts(packages, {"codebase": located_codebase(packages, code)}).collect()}
    assert (rows["a"].codebase_status, rows["a"].codebase_reason, rows["a"].codebase.n) == ("Found", None, 5)
    assert (rows["b"].codebase_status, rows["b"].codebase_reason) == ("Unavailable", "crate 'b' not found in repository 'r1'")
    assert {(rows[n].codebase_status, rows[n].codebase_reason) for n in "cd"} == {("Unavailable", "not queried")}
    assert rows["a"].docs_reason == "not queried"


def test_unreadable_requests_are_failures(spark):
    parsed = parse_requests(spark.createDataFrame([("a@1.0.0",), ("b@x",), ("b@x",), ("c",)], "request string"))
    resolved = spark.createDataFrame(
        [("a", "1.0.0", "VersionNotFound", None), ("c", None, "Found", None)], "name string, version string, status string, suggestions array<string>"
    )
    got = {(r.name, r.status, r.message) for r in failures(resolved, parsed).collect()}
    assert got == {
        ("a", "VersionNotFound", "Could not find information on version 1.0.0 of crate `a`"),
        ("b", "InvalidRequest", "cannot parse version 'x' in request 'b@x'"),
    }


def test_documents_of_any_size_and_shape(spark):
    large = {str(i): {"name": "x", "visibility": "public", "docs": "d" * 1_000_000, "links": None, "inner": {"struct": {"deep": [[1]]}}} for i in range(140)}
    bodies = {
        "large": json.dumps({"format_version": 57, "root": 0, "index": large}),
        "list": "[1]", "cut": '{"format_version": 57, "index": {"1": ', "none": None, "old": '{"format_version": 3}', "plain": "{}",
        "odd": json.dumps({"format_version": 57, "root": 0, "index": {"1": {"name": 5, "visibility": {"restricted": {}}, "docs": None, "inner": {"use": {}}}, "2": {"visibility": "public", "links": [1]}}}),
    }
    df = spark.createDataFrame([(k, "1", v) for k, v in bodies.items()], "package string, version string, body string")
    got = {r.name: r for r in docs_facts(df).collect()}
    assert got["large"].docs.public_api_elements == 140 and got["large"].docs.undocumented_elements == 0
    assert got["odd"].docs.public_api_elements == 1
    assert [got[k].reason for k in ("cut", "none", "old")] == ["malformed JSON", "malformed JSON", "unsupported format version 3"]
    assert got["plain"].reason == "missing 'format_version' field" and got["list"].status == "Unavailable"


def test_each_source_has_its_own_limit(spark, tmp_path):
    from datetime import timedelta

    from pkgrisk.operators.freshness import policy_limits, refresh_plan_by_source, snapshot_store
    from pkgrisk.sources.policy import default_policy

    schema = "source string, key string, fetched_at timestamp_ntz, payload string, no_data_reason string"

    def rows(*entries):
        return spark.createDataFrame([(s, k, None, p, None, day) for s, k, day, p in entries], schema + ", day int").withColumn(
            "fetched_at", F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(day)")
        ).drop("day")

    old = rows(("hosting", "a", 0, "x"), ("hosting", "b", 9, "x"), ("coverage", "a", 9, "x"), ("unknown", "a", 10, "x"))
    store = snapshot_store(spark, str(tmp_path / "one"), schema, buckets=3)
    store.upsert(old)
    store.upsert(rows(("hosting", "a", 10, "y")))
    saved = store.entries()
    assert saved.filter("source = 'hosting' and key = 'a'").head().payload == "y" and saved.count() == 4
    limits = policy_limits(default_policy()) | {"coverage": timedelta(days=1)}
    got = refresh_plan_by_source(old, saved, F.expr("TIMESTAMP_NTZ'2024-01-11'"), limits).collect()
    assert {tuple(r) for r in got} == {("coverage", "a"), ("unknown", "a")}


def test_documents_by_line(spark, tmp_path):
    def item(name, docs, visibility="public", links=None, inner="struct"):
        return {"name": name, "visibility": visibility, "docs": docs, "links": links or {}, "inner": {inner: {}}}

    documents = {
        "a-b": (57, {"0": item("a_b", "front [`Gone`]"), "1": item("x", "```\n1\n```"), "2": item("y", " "), "3": item("z", "d", "default"), "4": item("u", "d", inner="use")}),
        "other-root": (50, {"7": item("other_root", "not the root")}), "old": (49, {"0": item("old", "x")}), "empty": (51, {}),
        "no-version": (None, {"0": item("q", "x")}), "text": ("x", {}),
    }
    whole = [(n, "1.0.0", json.dumps({"format_version": v, "root": 0, "index": i})) for n, (v, i) in documents.items()]
    lines = [(n, "1.0.0", json.dumps(r)) for n, (v, i) in documents.items() for r in ({"format_version": v, "root": 0}, *({"id": k, "item": x} for k, x in i.items()))]
    kind = "package string, version string, body string"
    want = {tuple(r) for r in docs_facts(spark.createDataFrame(whole, kind)).collect()}
    got = docs_facts_of_lines(spark.createDataFrame(lines[::-1] + [("a-b", "1.0.0", " ")], kind))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(documents)
    bad = docs_facts_of_lines(spark.createDataFrame([*lines, ("a-b", "1.0.0", "{"), ("gone", "1.0.0", None)], kind)).collect()
    assert {r.name: r.reason for r in bad if r.name in ("a-b", "gone")} == dict.fromkeys(("a-b", "gone"), "malformed JSON")
    assert docs_facts_of_lines(spark.createDataFrame([], kind)).isEmpty()


def test_a_large_document_is_read_by_many_tasks(spark, tmp_path):
    with (tmp_path / "big.jsonl").open("w") as file:
        file.write('{"format_version": 57, "root": "0"}\n')
        for i in range(20_000):
            file.write(json.dumps({"id": str(i), "item": {"name": "big", "visibility": "public", "docs": "d" * 1000, "inner": {"struct": {}}}}) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        lines = read_docs_lines(spark, str(tmp_path / "big.jsonl"))
        assert lines.rdd.getNumPartitions() >= 8
        row = docs_facts_of_lines(lines.select(F.lit("big").alias("package"), F.lit("1.0.0").alias("version"), "body")).head()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (row.docs.public_api_elements, row.docs.undocumented_elements, row.docs.has_crate_level_docs) == (20_000, 0, True)
