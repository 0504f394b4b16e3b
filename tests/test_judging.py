import csv
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pkgrisk.operators import freshness as fr
from pkgrisk.operators import reports as rep
from pkgrisk.operators import rules
from pkgrisk.operators.facts import merge_facts
from pkgrisk.operators.metrics import CATEGORIES, METRICS, default_metrics, metrics_long, metrics_wide
from pkgrisk.sources.policy import Allowed, Policy, Rule, default_policy


def now():
    return F.expr("TIMESTAMP '2024-06-01 00:00:00'")


def judge(spark, gate=(), rated=(), **thresholds):
    policy = Policy(
        high_risk=tuple(Rule(f"g{i}", e) for i, e in enumerate(gate)),
        eval=tuple(Rule(f"r{i}", e, points=p) for i, (e, p) in enumerate(rated)),
        **thresholds,
    )
    df = spark.createDataFrame([("a", "1.0.0", None)], "name string, version string, gone int")
    return rules.appraise(df, policy, now()).head().appraisal


@pytest.mark.parametrize(
    "good, bad, score, risk",
    [(10, 5, 66.7, "MEDIUM"), (1, 10, 9.1, "HIGH"), (7, 3, 70.0, "LOW"), (3, 7, 30.0, "MEDIUM"), (29, 71, 29.0, "HIGH")],
)
def test_score_and_thresholds(spark, good, bad, score, risk):
    a = judge(spark, rated=[("true", good), ("false", bad)])
    assert (round(a.score, 1), a.risk, a.awarded, a.available) == (score, risk, good, good + bad)


def test_failed_rules_are_neutral_but_gates_are_not(spark):
    a = judge(spark, rated=[("gone > 1", 5), ("nothing.there > 1", 5), ("1 + 1", 5)])
    assert (a.risk, a.score, a.available) == ("LOW", 100.0, 0)
    assert [o.disposition for o in a.outcomes] == ["FAILED"] * 3
    assert "did not return a boolean" in a.outcomes[2].message
    for gate in ("false", "gone > 1", "nothing.there"):
        a = judge(spark, gate=["true", gate], rated=[("true", 1)])
        assert (a.risk, a.score, a.available, a.awarded, len(a.outcomes)) == ("HIGH", 0.0, 0, 0, 2)
    assert judge(spark, gate=["true"]).risk == "LOW"
    assert judge(spark, rated=[("gone <=> null", None)]).awarded == 1


def test_metric_registry():
    names = [m.name for m in METRICS]
    assert len(names) == 140 == len(set(names))
    assert all(m.description and m.category in CATEGORIES and m.default for m in METRICS)


def test_default_policy_is_valid(spark):
    rules.validate_policy(spark, default_policy(), now())
    assert default_metrics(spark).count() == 1


@pytest.mark.parametrize(
    "expression", ["no_such_metric > 100", "crate.downloads + 'x'", "usage.total_downloads", "this is not ! sql"]
)
def test_bad_rules_are_found(spark, expression):
    with pytest.raises(ValueError, match="expression 'bad' failed"):
        rules.validate_policy(spark, Policy(eval=(Rule("ok", "true"), Rule("bad", expression))), now())


def test_should_appraise():
    assert not rules.should_appraise(Policy(), False)
    assert rules.should_appraise(Policy(), True) and rules.should_appraise(default_policy(), False)


@pytest.mark.parametrize(
    "risk, version, allowed, medium, stopped",
    [
        ("HIGH", "1.0.200", "=1.0.200", False, False), ("HIGH", "1.0.200", "=999.0.0", False, True),
        ("MEDIUM", "1.0.0", None, False, False), ("MEDIUM", "1.0.0", None, True, True),
        ("LOW", "1.0.0", None, True, False), ("HIGH", "2.1.0", "^2.0", True, False), ("HIGH", "1.0.0", "*", False, False),
    ],
)
def test_gate(spark, risk, version, allowed, medium, stopped):
    df = spark.createDataFrame([("serde", version, (risk,))], "name string, version string, appraisal struct<risk: string>")
    table = rules.allow_table(spark, () if allowed is None else (Allowed("serde", allowed), Allowed("other", "*")))
    assert (rules.rejected(df, table, medium).count() > 0) == stopped
    if stopped:
        with pytest.raises(ValueError, match="flagged as"):
            rules.check_gate(df, table, medium)


def test_merge_marks_what_was_not_asked(spark):
    packages = spark.createDataFrame([("a", "1.0.0"), ("b", "1.0.0")], "name string, version string")
    docs = spark.createDataFrame([("a", "1.0.0", "Found", None, (1,))], "name string, version string, status string, reason string, docs struct<broken_doc_links: bigint>")
    rows = {r.name: r for r in merge_facts(packages, {"docs": docs}).collect()}
    assert rows["a"].docs_status == "Found" and rows["b"].docs_reason == "not queried"
    assert rows["a"].hosting_status == "Unavailable"


REPORT = tuple(
    m for n in (
        "crate.name", "crate.version", "crate.keywords", "stability.crate_created_at", "usage.total_downloads",
        "community.repo_stars", "trust.code_coverage_percentage", "trust.ci_workflows",
    ) for m in METRICS if m.name == n
)


def three_packages(spark):
    def row(name, version, keywords, stars, downloads, coverage, ci, appraisal):
        at = dt.datetime(2023, 1, 15, 10, 30)
        return (name, version, (name, version, keywords), (at,), (downloads,), (stars,), (coverage, ci), appraisal)

    outcome = [("high_stars", "High stars", "TRUE", None)]
    return spark.createDataFrame(
        [
            row("tokio", "1.35.0", ["async", "runtime"], 20000, 50000000, 85.5, True, ("LOW", 100.0, 1, 1, outcome)),
            row("serde", "1.0.195", ["serialization"], 8000, 100000000, 92.3, True,
                ("HIGH", 0.0, 1, 0, [("low_stars", "Low star count", "FALSE", None)])),
            row("anyhow", "1.0.75", ["error", "handling"], 4500, 30000000, 78.9, False, None),
        ],
        "name string, version string, crate struct<name: string, version: string, keywords: array<string>>, "
        "stability struct<crate_created_at: timestamp>, usage struct<total_downloads: bigint>, "
        "community struct<repo_stars: bigint>, trust struct<code_coverage_percentage: double, ci_workflows: boolean>, "
        "appraisal struct<risk: string, score: double, available: int, awarded: int, "
        "outcomes: array<struct<name: string, description: string, disposition: string, message: string>>>",
    )


def test_matrix_report(spark):
    df = three_packages(spark)
    names = ["tokio v1.35.0", "serde v1.0.195", "anyhow v1.0.75"]
    rows = [tuple(r) for r in rep.matrix_report(metrics_long(df, REPORT), rep.appraisal_texts(df), names).collect()]
    assert rows == [
        ("Appraisals", "LOW RISK (score = 100, awarded points = 1, available points = 1)",
         "HIGH RISK (score = 0, awarded points = 0, available points = 1)", ""),
        ("Reasons", "✔️ high_stars", "❌ low_stars", ""),
        ("crate.name", "tokio", "serde", "anyhow"),
        ("crate.version", "1.35.0", "1.0.195", "1.0.75"),
        ("crate.keywords", "async, runtime", "serialization", "error, handling"),
        ("stability.crate_created_at", "2023-01-15", "2023-01-15", "2023-01-15"),
        ("usage.total_downloads", "50000000", "100000000", "30000000"),
        ("community.repo_stars", "20000", "8000", "4500"),
        ("trust.code_coverage_percentage", "85.50", "92.30", "78.90"),
        ("trust.ci_workflows", "true", "true", "false"),
    ]


def test_json_report(spark):
    got = {r.name: r.json for r in rep.json_report(three_packages(spark), REPORT).collect()}
    assert json.loads(got["tokio"])["appraisal"] == {
        "reasons": ["high_stars"], "result": "LOW RISK (score = 100, awarded points = 1, available points = 1)",
    }
    anyhow = json.loads(got["anyhow"])
    assert "appraisal" not in anyhow and list(anyhow) == ["metrics", "name", "version"]
    assert anyhow["metrics"]["crate.keywords"] == ["error", "handling"]
    assert anyhow["metrics"]["trust.code_coverage_percentage"] == 78.9
    assert anyhow["metrics"]["stability.crate_created_at"] == "2023-01-15"


def test_order_summary_and_matrix_limit(spark):
    df = three_packages(spark)
    assert [r.name for r in rep.in_report_order(df).collect()] == ["anyhow", "serde", "tokio"]
    assert {r.risk: r.packages for r in rep.risk_summary(df).collect()} == {"LOW": 1, "HIGH": 1, "NOT_EVALUATED": 1}
    assert [r.name for r in rep.risk_listing(df).collect()] == ["serde", "tokio", "anyhow"]
    assert rep.present_metrics(metrics_long(df, REPORT)).count() == len(REPORT)
    names = [f"{r.name} v{r.version}" for r in df.collect()]
    whole = rep.matrix_report(metrics_long(df, REPORT), None, names).collect()
    parts = [m.collect() for m in rep.matrix_reports(metrics_long(df, REPORT), None, names, block=2)]
    assert [len(p[0]) for p in parts] == [3, 2]
    assert {r.Metric: tuple(r)[1:3] for r in whole} == {r.Metric: tuple(r)[1:] for r in parts[0]}
    with pytest.raises(Exception, match="not listed"):
        rep.matrix_report(metrics_long(df, REPORT), None, names[:2]).collect()


def test_matrix_blocks(spark, tmp_path):
    df = three_packages(spark)
    ordered = [f"{r.name} v{r.version}" for r in rep.in_report_order(df).collect()]
    want = [tuple(r) for r in rep.matrix_report(metrics_long(df, REPORT), rep.appraisal_texts(df), ordered).collect()]
    long = metrics_long(df, REPORT)
    # Missing and repeated values do no harm.
    long = long.filter("name <> 'serde' OR metric <> 'crate.name'").unionByName(long.filter("metric = 'crate.version'"))
    want = [tuple("" if m[0] == "crate.name" and c == "serde" else c for c in m) for m in want]
    blocks = rep.matrix_blocks(long, rep.appraisal_texts(df), 2)
    rows = {}
    for r in blocks.orderBy("block", "section", "metric_ord").collect():
        rows.setdefault(r.block, []).append((r.Metric, *r.cells))
    assert rows[0] == [("Metric", *ordered[:2])] + [m[:3] for m in want]
    assert rows[1] == [("Metric", *ordered[2:])] + [(m[0], m[3]) for m in want]
    rep.write_matrix(blocks, str(tmp_path / "matrix"))
    for block, expected in rows.items():
        (path,) = (tmp_path / "matrix" / f"block={block}").glob("*.txt")
        assert list(csv.reader(path.open(newline=""))) == [list(r) for r in expected]
    assert rep.matrix_blocks(long.limit(0)).isEmpty()


def test_matrix_of_many_packages(spark):
    long = spark.range(50_000).selectExpr(
        "concat('p', lpad(id, 6, '0')) AS name", "'1.0.0' AS version", "0 AS category_ord", "'Metadata' AS category", "0 AS metric_ord", "'m' AS metric", "cast(id as string) AS value"
    )
    rows = {(r.block, r.Metric): r.cells for r in rep.matrix_blocks(long).collect()}
    assert len(rows) == 100
    assert [v for b in range(50) for v in rows[b, "m"]] == [str(i) for i in range(50_000)]


def test_score_text_rounds_to_even(spark):
    df = spark.createDataFrame([(66.5,), (67.5,), (66.6,)], "s double")
    texts = df.select(
        rep.status_text(F.struct(F.lit("LOW").alias("risk"), F.col("s").alias("score"), F.lit(1).alias("awarded"), F.lit(2).alias("available"))).alias("t")
    ).collect()
    assert [t.t.split(",")[0] for t in texts] == ["LOW RISK (score = 66", "LOW RISK (score = 68", "LOW RISK (score = 67"]


def test_wide_metrics_of_missing_sources_are_null(spark):
    df = spark.createDataFrame([("a", "1.0.0")], "name string, version string")
    row = metrics_wide(df).head()
    assert row.crate.name == "a" and row.activity.open_issues is None and row.crate.features is None


def test_freshness(spark):
    ttl = dt.timedelta(days=7)
    rows = [
        ("fresh", dt.datetime(2024, 5, 30), None), ("limit", dt.datetime(2024, 5, 25), None),
        ("future", dt.datetime(2024, 7, 1), None), ("none", dt.datetime(2024, 5, 30), "gone"), ("miss", None, None),
    ]
    df = spark.createDataFrame(rows, "key string, fetched_at timestamp, no_data_reason string")
    state = fr.entry_state(F.col("fetched_at"), F.col("no_data_reason"), now(), ttl)
    assert {r.key: r.s for r in df.select("key", state.alias("s")).collect()} == {
        "fresh": "Data", "limit": "Miss", "future": "Data", "none": "NoData", "miss": "Miss",
    }
    ignored = fr.entry_state(F.col("fetched_at"), F.col("no_data_reason"), now(), ttl, ignore=True)
    assert {r.s for r in df.select(ignored.alias("s")).collect()} == {"Miss"}
    stale = {r.key: r.s for r in df.select("key", fr.snapshot_is_stale(F.col("fetched_at"), now(), ttl).alias("s")).collect()}
    assert stale["limit"] is False


def test_refresh_whole_repositories(spark):
    schema = "source string, key string, fetched_at timestamp, payload string, no_data_reason string"
    at = dt.datetime(2024, 5, 31)
    snaps = spark.createDataFrame([("s", "a", at, "x", None), ("s", "b", at, "x", None)], schema)
    packages = spark.createDataFrame([("r1", "a"), ("r1", "c"), ("r2", "b")], "repo string, key string")
    plan = fr.refresh_plan_by_repo(packages, snaps, now(), dt.timedelta(days=7)).collect()
    assert {(r.repo, r.key) for r in plan} == {("r1", "a"), ("r1", "c")}
    newer = spark.createDataFrame([("s", "a", dt.datetime(2024, 6, 1), "y", None)], schema)
    assert {r.key: r.payload for r in fr.upsert(snaps, newer).collect()} == {"a": "y", "b": "x"}
