"""Code coverage from badge images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Branches in order of preference and the badge text.
BRANCHES = ("main", "master")
PERCENT = r"(\d+(?:\.\d+)?)%"
UNKNOWN = ">unknown<"


def badge_percentage(http_status: Column, body: Column) -> Column:
    """Percentage on the badge; NULL if there is none."""
    readable = http_status.between(200, 299) & ~F.contains(body, F.lit(UNKNOWN))
    return F.when(readable, F.regexp_extract(body, PERCENT, 1).try_cast("double"))


def badge_failed(http_status: Column) -> Column:
    """Neither an answer nor a plain "not there"."""
    return ~http_status.between(200, 299) & ~http_status.between(400, 499)


def coverage_facts(badges: DataFrame) -> DataFrame:
    """``repo, status, reason, coverage``: the first preferred branch that answers."""
    one = badges.select(
        "repo",
        "branch",
        badge_percentage(F.col("http_status"), F.col("body")).alias("pct"),
        badge_failed(F.col("http_status")).alias("failed"),
        "http_status",
    ).filter(F.col("failed") | F.col("pct").isNotNull())
    rank = F.lit(None).cast("int")
    for i, branch in enumerate(BRANCHES):
        rank = F.when(F.col("branch") == branch, i).otherwise(rank)
    best = (
        one.withColumn("rank", rank)
        .filter(F.col("rank").isNotNull())
        .groupBy("repo")
        .agg(F.min_by(F.struct("pct", "failed", "http_status"), "rank").alias("b"))
    )
    status = (
        F.when(F.col("b").isNull(), "Unavailable").when(F.col("b.failed"), "Error").otherwise("Found")
    )
    return (
        badges.select("repo").distinct()
        .join(best, "repo", "left")
        .select(
            "repo",
            status.alias("status"),
            F.when(F.col("b").isNull(), "no coverage data")
            .when(F.col("b.failed"), F.concat(F.lit("unexpected HTTP status "), F.col("b.http_status").cast("string")))
            .alias("reason"),
            F.when(
                F.col("b.pct").isNotNull(),
                F.struct(F.col("b.pct").alias("code_coverage_percentage")),
            ).alias("coverage"),
        )
    )
