"""Snapshots of fetched facts: which are fresh and what to fetch again."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.sources.kept import SnapshotStore
from pkgrisk.sources.policy import Policy

# Entry states.
DATA, NO_DATA, MISS = "Data", "NoData", "Miss"


def entry_state(fetched_at: Column, no_data_reason: Column, now: Column, ttl: timedelta, ignore: bool = False) -> Column:
    """An entry expires when its age reaches the limit; one from the future is fresh.

    "Known to have no data" is an answer like any other.
    """
    if ignore:
        return F.lit(MISS)
    age = F.timestamp_diff("SECOND", fetched_at, now)
    expired = age >= int(ttl.total_seconds())
    return (
        F.when(fetched_at.isNull() | expired, MISS)
        .when(no_data_reason.isNotNull(), NO_DATA)
        .otherwise(DATA)
    )


def snapshot_is_stale(snapshot_at: Column, now: Column, ttl: timedelta) -> Column:
    """A registry snapshot may be exactly as old as the limit."""
    return F.timestamp_diff("SECOND", snapshot_at, now) > int(ttl.total_seconds())


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Newest row per (source, key); ties by payload, so the result is stable."""
    rest = [c for c in snapshots.columns if c not in ("source", "key")]
    order = F.struct("fetched_at", F.coalesce("payload", F.lit("")))
    return (
        snapshots.groupBy("source", "key")
        .agg(F.max_by(F.struct(*rest), order).alias("_s"))
        .select("source", "key", "_s.*")
    )


def upsert(snapshots: DataFrame, fetched: DataFrame) -> DataFrame:
    return latest_snapshots(snapshots.unionByName(fetched))


def refresh_plan(requested: DataFrame, snapshots: DataFrame, now: Column, ttl: timedelta, ignore: bool = False) -> DataFrame:
    """Requested ``source, key`` pairs without a fresh entry."""
    state = entry_state(F.col("fetched_at"), F.col("no_data_reason"), now, ttl, ignore)
    fresh = latest_snapshots(snapshots).filter(state != MISS).select("source", "key")
    return requested.select("source", "key").distinct().join(fresh, ["source", "key"], "left_anti")


def policy_limits(policy: Policy) -> dict[str, timedelta]:
    """How old the entries of each source may get."""
    return {
        "crates": policy.crates_cache_ttl,
        "hosting": policy.hosting_cache_ttl,
        "codebase": policy.codebase_cache_ttl,
        "coverage": policy.coverage_cache_ttl,
        "advisories": policy.advisories_cache_ttl,
    }


def refresh_plan_by_source(requested: DataFrame, snapshots: DataFrame, now: Column, limits: dict[str, timedelta]) -> DataFrame:
    """Requested ``source, key`` pairs without a fresh entry, by each source's own limit; a source without one is never fresh."""
    state = F.lit(MISS)
    for source, limit in limits.items():
        own = entry_state(F.col("fetched_at"), F.col("no_data_reason"), now, limit)
        state = F.when(F.col("source") == source, own).otherwise(state)
    fresh = latest_snapshots(snapshots).filter(state != MISS).select("source", "key")
    return requested.select("source", "key").distinct().join(fresh, ["source", "key"], "left_anti")


def snapshot_store(spark: SparkSession, path: str, schema: str, buckets: int = 64) -> SnapshotStore:
    """Kept entries that hold the latest row of each source and key; new ones rewrite only their own buckets.

    A bucket is one part of a few files: choose as many as make it a task's work.
    """
    return SnapshotStore(spark, path, schema, latest_snapshots, buckets)


def refresh_plan_by_repo(packages: DataFrame, snapshots: DataFrame, now: Column, ttl: timedelta, ignore: bool = False) -> DataFrame:
    """``repo, key``: one stale package of a repository makes all of them stale."""
    state = entry_state(F.col("fetched_at"), F.col("no_data_reason"), now, ttl, ignore)
    fresh = latest_snapshots(snapshots).filter(state != MISS).select("key").distinct().withColumn("_fresh", F.lit(True))
    marked = packages.select("repo", "key").distinct().join(fresh, "key", "left")
    stale_repos = marked.filter(F.col("_fresh").isNull()).select("repo").distinct()
    return marked.select("repo", "key").join(stale_repos, "repo", "left_semi")
