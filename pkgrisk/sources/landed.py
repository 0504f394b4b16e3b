"""Readers for the other landed sources: JSON, text and binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADVISORY_SCHEMA = (
    "id string, package string, informational string, severity string, cvss string, "
    "patched array<string>, unaffected array<string>"
)
REPOSITORY_SCHEMA = (
    "repo string, host string, stargazers_count bigint, stars_count bigint, forks_count bigint, "
    "subscribers_count bigint, watchers_count bigint"
)
ISSUE_SCHEMA = (
    "repo string, created_at timestamp, closed_at timestamp, state string, "
    "pull_request struct<merged_at: timestamp>"
)
GRAPH_SCHEMA = (
    "packages array<struct<id: string, name: string, version: string, "
    "features: map<string, array<string>>, "
    "targets: array<struct<kind: array<string>>>, "
    "dependencies: array<struct<name: string, rename: string, kind: string, optional: boolean, "
    "uses_default_features: boolean, features: array<string>>>>>, "
    "workspace_members array<string>, "
    "resolve struct<root: string, nodes: array<struct<id: string, features: array<string>, "
    "dependencies: array<string>, "
    "deps: array<struct<name: string, pkg: string, dep_kinds: array<struct<kind: string>>>>>>>"
)


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ADVISORY_SCHEMA).option("mode", "FAILFAST").json(path)


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    """Either spelling of the star counter."""
    df = spark.read.schema(REPOSITORY_SCHEMA).option("mode", "FAILFAST").json(path)
    return df.withColumn("stargazers_count", F.coalesce("stargazers_count", "stars_count")).drop("stars_count")


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues and pull requests; a row is a pull request iff ``pull_request`` is there."""
    return spark.read.schema(ISSUE_SCHEMA).option("mode", "FAILFAST").json(path)


def commit_times(lines: DataFrame) -> DataFrame:
    """``repo, seq, value`` log lines to ``repo, seq, author_at``; other lines drop out."""
    return lines.withColumn("author_at", F.trim("value").try_cast("bigint")).filter(
        F.col("author_at").isNotNull()
    ).drop("value")


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files, one author time per line, newest first, named after their repo.

    Files are split.  ``seq`` orders the lines of a file: where its split
    starts, then the line within the task that reads the split.
    """
    lines = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("repo"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")
        ).alias("seq"),
        "value",
    )
    return commit_times(lines)


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, length, content`` below ``root``, any depth; files that are no text drop out."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return files.select(
        F.substring_index(F.col("path"), root.rstrip("/") + "/", -1).alias("path"),
        "length",
        F.try_validate_utf8(F.col("content").cast("string")).alias("content"),
    ).filter(F.col("content").isNotNull())


def read_docs_json(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, body``; gating and decoding are in ``operators.docs``."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("body")
    )


def read_docs_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, body`` of documents landed one item a line; large files are split over tasks."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("body"))


def read_badges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("repo string, branch string, http_status int, body string").json(path)


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A resolved dependency graph as tables, see ``operators.graph``."""
    return graph_tables(
        spark.read.schema(GRAPH_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    )


def graph_tables(doc: DataFrame) -> dict[str, DataFrame]:
    pkg = doc.select(
        "workspace_members", F.col("resolve.root").alias("root"), F.explode("packages").alias("p")
    )
    node = doc.select(F.explode("resolve.nodes").alias("n"))
    packages = pkg.select(
        F.col("p.id").alias("pkg_id"),
        F.col("p.name").alias("name"),
        F.col("p.version").alias("version"),
        F.array_contains("workspace_members", F.col("p.id")).alias("is_member"),
        F.coalesce(F.col("root") == F.col("p.id"), F.lit(False)).alias("is_root"),
        F.coalesce(F.col("p.targets"), F.array()).alias("targets"),
    )
    features = pkg.select(
        F.col("p.id").alias("pkg_id"), F.explode("p.features").alias("feature", "activations")
    ).select("pkg_id", "feature", F.explode("activations").alias("activation"))
    deps = pkg.select(F.col("p.id").alias("pkg_id"), F.posexplode("p.dependencies").alias("ord", "d")).select(
        "pkg_id",
        "ord",
        "d.name",
        "d.rename",
        F.coalesce(F.col("d.kind"), F.lit("normal")).alias("kind"),
        F.coalesce(F.col("d.optional"), F.lit(False)).alias("optional"),
        F.coalesce(F.col("d.uses_default_features"), F.lit(True)).alias("uses_default_features"),
        F.coalesce(F.col("d.features"), F.array()).alias("features"),
    )
    edges = node.select(F.col("n.id").alias("pkg_id"), F.explode("n.deps").alias("d")).select(
        "pkg_id",
        F.col("d.name").alias("dep_lib_name"),
        F.col("d.pkg").alias("dep_pkg_id"),
        F.transform("d.dep_kinds", lambda k: F.coalesce(k["kind"], F.lit("normal"))).alias("kinds"),
    )
    resolve_features = node.select(F.col("n.id").alias("pkg_id"), F.explode("n.features").alias("feature"))
    links = node.select(F.col("n.id").alias("src"), F.explode("n.dependencies").alias("dst"))
    return {
        "packages": packages,
        "package_features": features,
        "package_deps": deps,
        "resolve_edges": edges,
        "resolve_features": resolve_features,
        "links": links,
    }
