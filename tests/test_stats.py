import datetime as dt

import pytest
from pyspark.sql import functions as F

from pkgrisk.functions.stats import age_stats, window_counts
from pkgrisk.operators.codebase import commit_stats, contributors, workflow_flags
from pkgrisk.operators.hosting import ages_wide, hosting_facts, issue_ages, issue_counts, lookback

NOW = "TIMESTAMP '2024-06-01 00:00:00'"
DAY = 86400.0


def ages(spark, seconds):
    df = spark.createDataFrame([("r", s) for s in seconds], "repo string, s double")
    row = age_stats(df, ["repo"], F.col("s")).head()
    return None if row is None else tuple(row)[1:]


@pytest.mark.parametrize(
    "days, expected",
    [
        ([5, 10, 20], (11, 10, 20, 20, 20)),
        ([42], (42, 42, 42, 42, 42)),
        ([1, 2, 3, 4, 5], (3, 3, 4, 5, 5)),
        (list(range(1, 11)), (5, 6, 8, 9, 10)),
        ([1, 2, 3, 4], (2, 3, 3, 4, 4)),
        ([1.9, 1.9], (1, 1, 1, 1, 1)),
    ],
)
def test_nearest_rank(spark, days, expected):
    assert ages(spark, [d * DAY for d in days]) == expected


def test_unusable_ages_drop_out(spark):
    assert ages(spark, [float("nan"), float("inf"), -100.0, DAY]) == (1, 1, 1, 1, 1)
    assert ages(spark, [float("nan"), -1.0]) is None


def test_windows_are_inclusive(spark):
    now = dt.datetime(2024, 6, 1)
    rows = [(now - dt.timedelta(days=d),) for d in (90, 91, 180, 365, 366, -5)]
    df = spark.createDataFrame(rows, "ts timestamp")
    row = df.agg(*window_counts(F.col("ts"), F.expr(NOW), "x")).head()
    assert tuple(row) == (2, 4, 5, 6)


def issue(days_open, days_closed=None, state="open", pr=False, merged=None):
    now = dt.datetime(2024, 6, 1)

    def at(d):
        return None if d is None else now - dt.timedelta(days=d)

    return ("r", at(days_open), at(days_closed), state, (at(merged),) if pr else None)


ISSUE = "repo string, created_at timestamp, closed_at timestamp, state string, pull_request struct<merged_at: timestamp>"


def test_mixed_issues(spark):
    df = spark.createDataFrame(
        [
            issue(10),
            issue(200, 100, "closed"),
            issue(5, pr=True),
            issue(400, 395, "closed", pr=True, merged=395),
            issue(3, 2, "closed", pr=True),
        ],
        ISSUE,
    )
    c = issue_counts(df, F.expr(NOW)).head()
    assert (c.open_issues, c.open_prs, c.issues_opened_total, c.issues_closed_total) == (1, 1, 2, 1)
    assert (c.prs_opened_total, c.prs_merged_total, c.prs_closed_total) == (3, 1, 2)
    assert (c.issues_closed_last_90_days, c.issues_closed_last_180_days) == (0, 1)
    a = ages_wide(issue_ages(df, F.expr(NOW))).head()
    assert a.open_issue_age.avg == 10 and a.open_pr_age.p95 == 5
    assert a.closed_issue_age.p50 == 100 and a.closed_issue_age_last_90_days.p50 == 0
    assert a.closed_issue_age_last_180_days.p50 == 100
    assert a.merged_pr_age.avg == 5 and a.merged_pr_age_last_365_days.avg == 0


def test_lookback_limits(spark):
    df = spark.createDataFrame([issue(d) for d in range(10)], ISSUE)
    assert lookback(df, F.expr(NOW)).count() == 10
    assert lookback(df, F.expr(NOW), days=4).count() == 5


def test_hosting_facts(spark):
    repos = spark.createDataFrame(
        [("r", "codeberg.org", 7, None, 99, -4), ("q", "elsewhere.org", 1, 1, 1, 1)],
        "repo string, host string, stargazers_count bigint, forks_count bigint, subscribers_count bigint, watchers_count bigint",
    )
    facts = {r.repo: r for r in hosting_facts(repos, spark.createDataFrame([issue(1)], ISSUE), F.expr(NOW)).collect()}
    assert facts["r"].hosting.stars == 7 and facts["r"].hosting.forks == 0 and facts["r"].hosting.subscribers == 0
    assert facts["q"].hosting is None and facts["q"].reason == "unsupported hosting provider: elsewhere.org"


def test_commits_follow_the_log_order(spark):
    rows = [("r", 0, 1000, "a", "x"), ("r", 1, 5000, "a", "y"), ("r", 2, 2000, "a", "x")]
    df = spark.createDataFrame(rows, "repo string, seq bigint, author_at bigint, author_name string, author_email string")
    row = commit_stats(df, 5000 + 90 * 86400).select(
        "commit_count", "commits_last_90_days", F.unix_seconds("first_commit_at").alias("f"), F.unix_seconds("last_commit_at").alias("l")
    ).head()
    assert tuple(row) == (3, 1, 2000, 1000)
    assert contributors(df).head().contributors == 2


def test_workflows(spark):
    rows = [
        ("a", ".github/workflows/ci.yml", "run: cargo CLIPPY"),
        ("b", ".github/workflows/notes.md", "miri clippy"),
        ("c", "ci.yml", "miri"),
        ("d", ".github/workflows/.yml", "miri"),
    ]
    got = {r.repo: tuple(r)[1:] for r in workflow_flags(spark.createDataFrame(rows, "repo string, path string, content string")).collect()}
    assert got == {"a": (True, False, True), "b": (True, False, False), "d": (True, False, False)}
