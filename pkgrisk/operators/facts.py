"""Merging the sources of facts into one wide row per package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.operators.resolve import FOUND

# Fixed value: reason of a source that was not asked.
NOT_QUERIED = "not queried"
PROVIDERS = ("hosting", "advisories", "codebase", "coverage", "docs")


def for_packages(packages: DataFrame, per_repo: DataFrame, payload: str) -> DataFrame:
    """Fan a repository-grain source out to ``packages(name, version, repo)``."""
    return packages.join(per_repo, "repo").select("name", "version", "status", "reason", payload)


def merge_facts(packages: DataFrame, providers: dict[str, DataFrame]) -> DataFrame:
    """Left join every source on (name, version).

    A source brings ``name, version``, its payload struct (named like the
    source) and optionally ``status, reason``.  What it has no row for is
    Unavailable, "not queried".
    """
    out, columns = packages, [F.col(f"`{c}`") for c in packages.columns]
    for name in PROVIDERS:
        df = providers.get(name)
        status, reason = f"{name}_status", f"{name}_reason"
        if df is None:
            columns += [F.lit("Unavailable").alias(status), F.lit(NOT_QUERIED).alias(reason)]
            continue
        known = df.select(
            "name",
            "version",
            name,
            (F.col("status") if "status" in df.columns else F.lit(FOUND)).alias(status),
            (F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")).alias(reason),
        )
        out = out.join(known, ["name", "version"], "left")
        absent = F.col(status).isNull()
        columns += [
            F.col(name),
            F.coalesce(status, F.lit("Unavailable")).alias(status),
            F.when(absent, F.lit(NOT_QUERIED)).otherwise(F.col(reason)).alias(reason),
        ]
    return out.select(*columns)
