"""Commit history, workflow files, source files and package targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.source_text import line_statistics
from pkgrisk.functions.stats import SECONDS_PER_DAY, WINDOW_DAYS

# Folder and tool names of the analysis.
WORKFLOW_FOLDER = ".github/workflows/"
WORKFLOW_TOOLS = {"miri": "miri_usage", "clippy": "clippy_usage"}


def commit_stats(commits: DataFrame, now_unix: int, days: Sequence[int] = WINDOW_DAYS) -> DataFrame:
    """Counts and first / last commit per repository.

    ``author_at`` is a unix time.  First and last follow the log position
    ``seq`` (newest first), not the times.
    """
    at = F.col("author_at")
    return commits.groupBy("repo").agg(
        F.count("*").alias("commit_count"),
        *[
            F.count_if(at >= F.lit(now_unix - d * SECONDS_PER_DAY)).alias(f"commits_last_{d}_days")
            for d in days
        ],
        F.timestamp_seconds(F.max_by(at, "seq")).alias("first_commit_at"),
        F.timestamp_seconds(F.min_by(at, "seq")).alias("last_commit_at"),
    )


def contributors(commits: DataFrame) -> DataFrame:
    """Distinct (name, email) pairs per repository."""
    return commits.groupBy("repo").agg(
        F.count_distinct(F.struct("author_name", "author_email")).alias("contributors")
    )


def workflow_flags(files: DataFrame, tools: dict[str, str] = WORKFLOW_TOOLS) -> DataFrame:
    """``repo, ci_workflows`` and one flag per tool named in a YAML workflow."""
    inside = files.filter(F.col("path").startswith(WORKFLOW_FOLDER))
    yaml = F.col("path").rlike(r"[^/]\.(yml|yaml)$")
    text = F.lower(F.col("content"))
    return inside.groupBy("repo").agg(
        F.lit(True).alias("ci_workflows"),
        *[F.bool_or(yaml & F.contains(text, F.lit(t))).alias(name) for t, name in tools.items()],
    )


def source_files(files: DataFrame) -> DataFrame:
    """Files below ``src/`` that are analysed: all of them, of any size and depth."""
    path = F.col("path")
    return files.filter(path.startswith("src/") & path.rlike(r"[^/]\.rs$"))


def source_stats(files: DataFrame, key: str = "package") -> DataFrame:
    """Line statistics summed per package; files are read where they are."""
    per_file = files.select(key, line_statistics(F.col("content")).alias("s"))
    return per_file.groupBy(key).agg(
        F.count("*").alias("source_files"),
        F.count_if(F.col("s.has_errors")).alias("source_files_with_errors"),
        *[
            F.sum(f"s.{c}").alias(c)
            for c in ("production_lines", "test_lines", "comment_lines", "unsafe_count")
        ],
    )


def example_targets(targets: Column) -> Column:
    return F.size(F.filter(targets, lambda t: F.array_contains(t["kind"], "example"))).cast("bigint")


def in_repository(packages: DataFrame, repo_packages: DataFrame) -> DataFrame:
    """``status, reason``: a package must be found in the repository it names."""
    found = repo_packages.select("repo", "name").distinct().withColumn("_there", F.lit(True))
    missing = F.col("_there").isNull()
    return packages.join(found, ["repo", "name"], "left").select(
        *packages.columns,
        F.when(missing, "Unavailable").otherwise("Found").alias("status"),
        F.when(
            missing,
            F.format_string("crate '%s' not found in repository '%s'", F.col("name"), F.col("repo")),
        ).alias("reason"),
    )


def located_codebase(packages: DataFrame, codebase: DataFrame) -> DataFrame:
    """``name, version, status, reason, codebase`` of the packages whose repository was analysed.

    ``packages(name, version, repo)``, ``codebase(repo, name, codebase)``.  A
    package that its repository does not hold is Unavailable.
    """
    analysed = packages.select("name", "version", "repo").join(codebase.select("repo").distinct(), "repo", "left_semi")
    return (
        in_repository(analysed, codebase)
        .join(codebase.select("repo", "name", "codebase"), ["repo", "name"], "left")
        .select("name", "version", "status", "reason", "codebase")
    )


def codebase_facts(
    repo_packages: DataFrame,
    commits: DataFrame,
    workflows: DataFrame,
    files: DataFrame,
    reachable_counts: DataFrame,
    now_unix: int,
) -> DataFrame:
    """``repo, name, codebase struct`` for the packages found in each repository.

    ``repo_packages(repo, name, package, targets)``; ``package`` keys the source
    files and ``reachable_counts(package, transitive_dependencies)``.
    """
    zero = F.lit(0).cast("bigint")
    epoch = F.timestamp_seconds(F.lit(0))
    history = (
        repo_packages.select("repo").distinct()
        .join(commit_stats(commits, now_unix), "repo", "left")
        .join(contributors(commits), "repo", "left")
        .join(workflow_flags(workflows), "repo", "left")
    )
    counts = ["commit_count", *[f"commits_last_{d}_days" for d in WINDOW_DAYS], "contributors"]
    sums = ["source_files", "source_files_with_errors", "production_lines", "test_lines", "comment_lines",
            "unsafe_count", "transitive_dependencies"]
    payload = F.struct(
        *[F.coalesce(c, zero).alias(c) for c in counts + sums],
        *[F.coalesce(c, epoch).alias(c) for c in ("first_commit_at", "last_commit_at")],
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("ci_workflows", *WORKFLOW_TOOLS.values())],
        F.coalesce(example_targets(F.col("targets")), zero).alias("example_count"),
    )
    return (
        repo_packages.join(history, "repo", "left")
        .join(source_stats(source_files(files)), "package", "left")
        .join(reachable_counts, "package", "left")
        .select("repo", "name", payload.alias("codebase"))
    )
