"""Aggregations over the registry tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.stats import WINDOW_DAYS, window_counts
from pkgrisk.session import Scratch

RECENT_MONTHS = 3  # fixed value: month buckets that make "the last 90 days"
_MONTHS = "array<struct<month: date, downloads: bigint>>"


@dataclass(frozen=True)
class Registry:
    """The tables of ``sources.dump`` an appraisal reads."""

    crates: DataFrame
    versions: DataFrame
    version_downloads: DataFrame
    dependencies: DataFrame
    crate_downloads: DataFrame
    crate_owners: DataFrame
    users: DataFrame
    teams: DataFrame
    crates_categories: DataFrame
    categories: DataFrame
    crates_keywords: DataFrame
    keywords: DataFrame


def only(df: DataFrame, wanted: DataFrame | None, key: str) -> DataFrame:
    """Keep the rows of the wanted keys; no restriction if there is none."""
    return df if wanted is None else df.join(wanted.select(key), key, "left_semi")


def dependent_versions(dependencies: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct ``crate_id, version_id``: versions that depend on a wanted package."""
    return only(dependencies.select("crate_id", "version_id"), wanted, "crate_id").distinct()


def dependents(dependencies: DataFrame, versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """``crate_id, dependents``: distinct packages with a version that depends on it.

    Every wanted package has a row.  The (package, owner) pairs are made distinct
    before the count, so a package everyone depends on is spread over its owners.
    """
    owner = versions.select(F.col("id").alias("version_id"), F.col("crate_id").alias("owner"))
    pairs = only(dependencies.select("crate_id", "version_id"), wanted, "crate_id").join(owner, "version_id")
    counted = pairs.groupBy("crate_id").agg(F.count_distinct("owner").alias("dependents"))
    return wanted.select("crate_id").join(counted, "crate_id", "left").select(
        "crate_id", F.coalesce("dependents", F.lit(0)).alias("dependents")
    )


def version_recency(versions: DataFrame, now: Column, days: Sequence[int] = WINDOW_DAYS) -> DataFrame:
    return versions.groupBy("crate_id").agg(
        *window_counts(F.col("created_at"), now, "versions", days, total=False)
    )


def monthly_by_version(version_downloads: DataFrame) -> DataFrame:
    return (
        version_downloads.groupBy("version_id", F.trunc("date", "MM").alias("month"))
        .agg(F.sum("downloads").cast("bigint").alias("downloads"))
    )


def monthly_by_crate(version_months: DataFrame, versions: DataFrame) -> DataFrame:
    """Month sums of all versions of a package, from the per-version months."""
    of = versions.select(F.col("id").alias("version_id"), "crate_id")
    return (
        version_months.join(of, "version_id")
        .groupBy("crate_id", "month")
        .agg(F.sum("downloads").cast("bigint").alias("downloads"))
    )


def as_series(months: DataFrame, key: str) -> DataFrame:
    """One sorted month array per key; as long as there are months, however hot the key."""
    return months.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("month", "downloads"))).alias("monthly_downloads")
    )


def recent_downloads(series: Column) -> Column:
    """Sum of the last month buckets that exist, sparse months included."""
    last = F.slice(series, F.greatest(F.size(series) - (RECENT_MONTHS - 1), F.lit(1)), F.lit(RECENT_MONTHS))
    return F.aggregate(last, F.lit(0).cast("bigint"), lambda total, m: total + m["downloads"])


def total_downloads(wanted: DataFrame, crate_downloads: DataFrame) -> DataFrame:
    return wanted.select("crate_id").join(crate_downloads, "crate_id", "left").select(
        "crate_id", F.coalesce("downloads", F.lit(0)).alias("downloads")
    )


def owners(crate_owners: DataFrame, users: DataFrame, teams: DataFrame) -> DataFrame:
    """``crate_id, kind, login, display_name``; unresolved owners drop out."""
    people = users.select(F.col("id").alias("owner_id"), F.col("gh_login").alias("login"), "name")
    groups = teams.select(F.col("id").alias("owner_id"), "login", "name")

    def side(code: int, kind: str, who: DataFrame) -> DataFrame:
        return (
            crate_owners.filter(F.col("owner_kind") == code)
            .join(who, "owner_id")
            .select("crate_id", F.lit(kind).alias("kind"), "login", F.nullif("name", F.lit("")).alias("display_name"))
        )

    return side(0, "user", people).unionByName(side(1, "team", groups))


def owner_lists(owner_rows: DataFrame) -> DataFrame:
    return owner_rows.groupBy("crate_id").agg(
        F.sort_array(F.collect_list(F.struct("login", "kind", "display_name"))).alias("owners")
    )


def label_lists(bridge: DataFrame, labels: DataFrame, bridge_key: str, label: str, name: str) -> DataFrame:
    """Sorted category or keyword texts per package; unresolved ids drop out."""
    dim = labels.select(F.col("id").alias(bridge_key), label)
    return bridge.join(dim, bridge_key).groupBy("crate_id").agg(
        F.sort_array(F.collect_list(label)).alias(name)
    )


def feature_names(features: Column) -> Column:
    return F.sort_array(F.map_keys(features))


def docs_link(documentation: Column, name: Column, version: Column) -> Column:
    return F.when(
        F.coalesce(documentation, F.lit("")) != "", documentation
    ).otherwise(F.concat(F.lit("https://docs.rs/"), name, F.lit("/"), version))


def registry_facts(registry: Registry, packages: DataFrame, now: Column, version_months: DataFrame | None = None) -> DataFrame:
    """``name, version, registry`` for ``packages(name, version, crate_id, version_id)``.

    Every part reads only the requested packages (semi joins on the id list).
    Months, dependents and version counts are summed up to one row a package
    first; they, owners and labels become rows of one union under one aggregate
    by package, which never holds a row per dependent, version or month.  ``packages`` is read many times, so hand in a written
    table.  ``version_months`` are month sums that are kept already; the daily
    downloads are then not read at all.
    """
    hits = packages.select("name", "version", "crate_id", "version_id")
    ids = hits.select("crate_id").distinct()
    r, scratch = registry, Scratch(packages.sparkSession, "registry")
    versions = scratch.save(only(r.versions.select("id", "crate_id", "created_at"), ids, "crate_id"), "versions")
    of = versions.select(F.col("id").alias("version_id"), "crate_id")
    # The largest table is read once: both series come from these sums.
    months = monthly_by_version(only(r.version_downloads, of, "version_id")) if version_months is None else version_months
    months = scratch.save(months.join(of, "version_id"), "months")
    per_version = as_series(only(months, hits.select("version_id"), "version_id"), "version_id")

    # Rows of every kind, each with the columns of its own kind, meet in one aggregate.
    owner_of = r.versions.select(F.col("id").alias("version_id"), F.col("crate_id").alias("owner_id"))
    using = only(r.dependencies.select("crate_id", "version_id"), ids, "crate_id").join(owner_of, "version_id")
    by_crate = months.groupBy("crate_id", "month").agg(F.sum("downloads").cast("bigint").alias("sum"))
    categories = r.categories.select(F.col("id").alias("category_id"), F.col("slug").alias("category"))
    keywords = r.keywords.select(F.col("id").alias("keyword_id"), "keyword")
    rows = (
        ids,
        only(r.crates, ids.select(F.col("crate_id").alias("id")), "id").select(
            F.col("id").alias("crate_id"), F.struct("created_at", "updated_at", "repository").alias("crate")
        ),
        only(r.crate_downloads, ids, "crate_id").select("crate_id", "downloads"),
        using.groupBy("crate_id").agg(F.count_distinct("owner_id").alias("dependents")),
        version_recency(versions, now),
        as_series(by_crate.withColumnRenamed("sum", "downloads"), "crate_id"),
        owners(only(r.crate_owners, ids, "crate_id"), r.users, r.teams).select(
            "crate_id", F.struct("login", "kind", "display_name").alias("owner")
        ),
        only(r.crates_categories, ids, "crate_id").join(categories, "category_id").select("crate_id", "category"),
        only(r.crates_keywords, ids, "crate_id").join(keywords, "keyword_id").select("crate_id", "keyword"),
    )
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)

    def listed(name: str) -> Column:
        return F.sort_array(F.collect_list(name))

    overall = every.groupBy("crate_id").agg(
        F.any_value("crate", ignoreNulls=F.lit(True)).alias("crate"),
        F.coalesce(F.max("downloads"), F.lit(0)).alias("downloads"),
        F.coalesce(F.max("dependents"), F.lit(0)).alias("dependents"),
        *[F.coalesce(F.max(f"versions_last_{d}_days"), F.lit(0)).alias(f"versions_last_{d}_days") for d in WINDOW_DAYS],
        F.coalesce(F.any_value("monthly_downloads", ignoreNulls=F.lit(True)), F.array().cast(_MONTHS)).alias("monthly_downloads"),
        listed("owner").alias("owners"),
        listed("category").alias("categories"),
        listed("keyword").alias("keywords"),
    ).select(
        "crate_id",
        F.struct(
            "crate.created_at",
            "crate.updated_at",
            "crate.repository",
            "downloads",
            "dependents",
            *[f"versions_last_{d}_days" for d in WINDOW_DAYS],
            "monthly_downloads",
            "owners",
            "categories",
            "keywords",
        ).alias("overall"),
    )
    chosen = (
        r.versions.withColumnRenamed("id", "version_id")
        .join(hits.select("version_id").distinct(), "version_id", "left_semi")
        .join(per_version, "version_id", "left")
        .select(
            "version_id",
            F.struct(
                "description",
                "license",
                "homepage",
                "documentation",
                "rust_version",
                "edition",
                "features",
                "created_at",
                "updated_at",
                "yanked",
                "downloads",
                F.coalesce("monthly_downloads", F.array().cast(_MONTHS)).alias("monthly_downloads"),
            ).alias("version_facts"),
        )
    )
    return (
        hits.join(overall, "crate_id")
        .join(chosen, "version_id")
        .select(
            "name",
            "version",
            F.struct("version_facts", "overall").alias("registry"),
        )
    )
