"""The metric registry and its wide and long forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.functions.stats import AGE_FIELDS, WINDOW_DAYS
from pkgrisk.operators.advisories import COUNTERS, INFORMATIONAL
from pkgrisk.operators.registry import docs_link, feature_names, recent_downloads

# Category names in report order.
CATEGORIES = (
    "Metadata", "Stability", "Usage", "Community", "Activity", "Documentation",
    "Trustworthiness", "Codebase", "Advisories",
)

TEXT, COUNT, REAL, FLAG, TIME, LIST = "string", "bigint", "double", "boolean", "timestamp", "array<string>"
_DEFAULTS = {TEXT: "''", COUNT: "0L", REAL: "0.0D", FLAG: "false", TIME: "timestamp_seconds(0)",
             LIST: "cast(array() as array<string>)"}


@dataclass(frozen=True)
class Metric:
    """``source`` is a SQL expression over a merged facts row."""

    name: str
    description: str
    category: str
    kind: str
    source: str

    @property
    def prefix(self) -> str:
        return self.name.split(".", 1)[0]

    @property
    def field(self) -> str:
        return self.name.split(".", 1)[1]

    @property
    def default(self) -> str:
        return _DEFAULTS[self.kind]


_V, _O = "registry.version_facts", "registry.overall"


def _metric(name: str, category: str, kind: str, source: str, description: str) -> Metric:
    return Metric(name, description, category, kind, source)


def _age_metrics(series: str, source: str, what: str) -> list[Metric]:
    words = {"avg": "Average", "p50": "Median", "p75": "75th percentile", "p90": "90th percentile", "p95": "95th percentile"}
    return [
        _metric(f"activity.{series}_{f}", "Activity", COUNT, f"hosting.{source}.{f}", f"{words[f]} {what}, in days")
        for f in AGE_FIELDS
    ]


def _windowed(family: str, what: str) -> list[Metric]:
    out = [
        _metric(f"activity.{family}_last_{d}_days", "Activity", COUNT, f"hosting.{family}_last_{d}_days",
                f"{what} in the last {d} days")
        for d in WINDOW_DAYS
    ]
    out.append(_metric(f"activity.{family}_total", "Activity", COUNT, f"hosting.{family}_total", f"{what}, all time"))
    return out


def _all_ages(series: str, what: str) -> list[Metric]:
    out = _age_metrics(series, series, what)
    for d in WINDOW_DAYS:
        out += _age_metrics(f"{series}_last_{d}_days", f"{series}_last_{d}_days", f"{what}, last {d} days")
    return out


def _advisory_metrics(prefix: str, source: str, where: str) -> list[Metric]:
    out = []
    for c, counter in COUNTERS.items():
        noun = f"{c}_warnings" if c in INFORMATIONAL else f"{c}_severity_vulnerabilities"
        out.append(
            _metric(f"advisories.{prefix}_{noun}", "Advisories", COUNT, f"advisories.{source}.{counter}",
                    f"Number of {noun.replace('_', ' ')} {where}")
        )
    return out


# Metric names, categories and order.
METRICS: tuple[Metric, ...] = (
    _metric("crate.name", "Metadata", TEXT, "name", "Package name"),
    _metric("crate.version", "Metadata", TEXT, "version", "Package version"),
    _metric("crate.description", "Metadata", TEXT, f"{_V}.description", "What the package is for"),
    _metric("crate.license", "Metadata", TEXT, f"{_V}.license", "License expression"),
    _metric("crate.categories", "Metadata", LIST, f"{_O}.categories", "Registry categories"),
    _metric("crate.keywords", "Metadata", LIST, f"{_O}.keywords", "Registry keywords"),
    _metric("crate.features", "Metadata", LIST, "{features}", "Names of the optional features"),
    _metric("crate.repository", "Metadata", TEXT, f"nullif({_O}.repository, '')", "Source repository"),
    _metric("crate.homepage", "Metadata", TEXT, f"nullif({_V}.homepage, '')", "Home page"),
    _metric("crate.minimum_rust", "Metadata", TEXT, f"{_V}.rust_version", "Oldest supported compiler"),
    _metric("crate.rust_edition", "Metadata", TEXT, f"{_V}.edition", "Language edition"),
    _metric("docs.documentation", "Documentation", TEXT, "{docs_link}", "Documentation link"),
    _metric("docs.public_api_elements", "Documentation", COUNT, "docs.public_api_elements", "Public items"),
    _metric("docs.undocumented_public_api_elements", "Documentation", COUNT, "docs.undocumented_elements",
            "Public items without documentation"),
    _metric("docs.public_api_coverage_percentage", "Documentation", REAL, "docs.doc_coverage_percentage",
            "Share of public items with documentation"),
    _metric("docs.crate_level_docs_present", "Documentation", FLAG, "docs.has_crate_level_docs",
            "Is there a front page"),
    _metric("docs.broken_links", "Documentation", COUNT, "docs.broken_doc_links", "Links that lead nowhere"),
    _metric("docs.examples_in_docs", "Documentation", COUNT, "docs.examples_in_docs", "Code examples in the documentation"),
    _metric("docs.standalone_examples", "Documentation", COUNT, "codebase.example_count", "Example programs"),
    _metric("usage.total_downloads", "Usage", COUNT, f"{_O}.downloads", "Downloads of all versions"),
    _metric("usage.total_downloads_last_90_days", "Usage", COUNT, "{recent_all}", "Recent downloads of all versions"),
    _metric("usage.version_downloads", "Usage", COUNT, f"{_V}.downloads", "Downloads of this version"),
    _metric("usage.version_downloads_last_90_days", "Usage", COUNT, "{recent_one}", "Recent downloads of this version"),
    _metric("usage.dependent_crates", "Usage", COUNT, f"{_O}.dependents", "Packages that depend on this one"),
    _metric("stability.crate_created_at", "Stability", TIME, f"{_O}.created_at", "First publication"),
    _metric("stability.crate_updated_at", "Stability", TIME, f"{_O}.updated_at", "Last change of the package"),
    _metric("stability.version_created_at", "Stability", TIME, f"{_V}.created_at", "Publication of this version"),
    _metric("stability.version_updated_at", "Stability", TIME, f"{_V}.updated_at", "Last change of this version"),
    _metric("stability.yanked", "Stability", FLAG, f"{_V}.yanked", "Was this version withdrawn"),
    *[
        _metric(f"stability.versions_last_{d}_days", "Stability", COUNT, f"{_O}.versions_last_{d}_days",
                f"Versions published in the last {d} days")
        for d in WINDOW_DAYS
    ],
    _metric("crate.owners", "Metadata", LIST, f"{_O}.owners.login", "Owner logins"),
    _metric("community.repo_stars", "Community", COUNT, "hosting.stars", "Repository stars"),
    _metric("community.repo_forks", "Community", COUNT, "hosting.forks", "Repository forks"),
    _metric("community.repo_subscribers", "Community", COUNT, "hosting.subscribers", "Repository subscribers"),
    _metric("community.repo_contributors", "Community", COUNT, "codebase.contributors", "Commit authors"),
    *[
        _metric(f"activity.commits_last_{d}_days", "Activity", COUNT, f"codebase.commits_last_{d}_days",
                f"Commits in the last {d} days")
        for d in WINDOW_DAYS
    ],
    _metric("activity.commit_count", "Activity", COUNT, "codebase.commit_count", "Commits"),
    _metric("activity.first_commit_at", "Activity", TIME, "codebase.first_commit_at", "First commit"),
    _metric("activity.last_commit_at", "Activity", TIME, "codebase.last_commit_at", "Latest commit"),
    _metric("activity.open_issues", "Activity", COUNT, "hosting.open_issues", "Open issues"),
    *_age_metrics("open_issue_age", "open_issue_age", "age of open issues"),
    *_windowed("issues_opened", "Issues opened"),
    *_windowed("issues_closed", "Issues closed"),
    *_all_ages("closed_issue_age", "time to close an issue"),
    _metric("activity.open_prs", "Activity", COUNT, "hosting.open_prs", "Open pull requests"),
    *_age_metrics("open_pr_age", "open_pr_age", "age of open pull requests"),
    *_windowed("prs_opened", "Pull requests opened"),
    *_windowed("prs_merged", "Pull requests merged"),
    *_windowed("prs_closed", "Pull requests closed"),
    *_all_ages("merged_pr_age", "time to merge a pull request"),
    *_advisory_metrics("total", "total", "over all versions"),
    *_advisory_metrics("version", "per_version", "of this version"),
    _metric("code.source_files", "Codebase", COUNT, "codebase.source_files", "Source files"),
    _metric("code.source_files_with_errors", "Codebase", COUNT, "codebase.source_files_with_errors",
            "Source files that do not read cleanly"),
    _metric("code.code_lines", "Codebase", COUNT, "codebase.production_lines", "Lines of production code"),
    _metric("code.test_lines", "Codebase", COUNT, "codebase.test_lines", "Lines of test code"),
    _metric("code.comment_lines", "Codebase", COUNT, "codebase.comment_lines", "Lines of comment"),
    _metric("code.transitive_dependencies", "Codebase", COUNT, "codebase.transitive_dependencies",
            "Packages reachable as dependencies"),
    _metric("trust.unsafe_blocks", "Trustworthiness", COUNT, "codebase.unsafe_count", "Uses of unsafe code"),
    _metric("trust.ci_workflows", "Trustworthiness", FLAG, "codebase.ci_workflows", "Are there CI workflows"),
    _metric("trust.miri_usage", "Trustworthiness", FLAG, "codebase.miri_usage", "Does CI run miri"),
    _metric("trust.clippy_usage", "Trustworthiness", FLAG, "codebase.clippy_usage", "Does CI run clippy"),
    _metric("trust.code_coverage_percentage", "Trustworthiness", REAL, "coverage.code_coverage_percentage",
            "Share of code covered by tests"),
)


def _root(source: str) -> str:
    return source.split("(")[-1].split(".", 1)[0]


def _value(metric: Metric, columns: set[str]) -> Column:
    found = F.col("registry").isNotNull() if "registry" in columns else F.lit(False)
    if metric.source.startswith("{"):
        if "registry" not in columns:
            return F.lit(None).cast(metric.kind)
        value = {
            "{features}": lambda: feature_names(F.col(f"{_V}.features")),
            "{docs_link}": lambda: docs_link(F.col(f"{_V}.documentation"), F.col("name"), F.col("version")),
            "{recent_all}": lambda: recent_downloads(F.col(f"{_O}.monthly_downloads")),
            "{recent_one}": lambda: recent_downloads(F.col(f"{_V}.monthly_downloads")),
        }[metric.source]()
        return F.when(found, value).cast(metric.kind)
    if _root(metric.source) not in columns:
        return F.lit(None).cast(metric.kind)
    return F.expr(metric.source).cast(metric.kind)


def _wide(values: dict[str, Column]) -> list[Column]:
    prefixes = dict.fromkeys(m.prefix for m in METRICS)
    return [
        F.struct(*[values[m.name].alias(m.field) for m in METRICS if m.prefix == p]).alias(p)
        for p in prefixes
    ]


def metrics_wide(facts: DataFrame) -> DataFrame:
    """``name, version`` and one struct per metric prefix; NULL where a source has nothing."""
    columns = set(facts.columns)
    return facts.select("name", "version", *_wide({m.name: _value(m, columns) for m in METRICS}))


def default_metrics(spark: SparkSession) -> DataFrame:
    """The row policies are checked against."""
    one = spark.range(1).select(F.lit("").alias("name"), F.lit("").alias("version"))
    return one.select("name", "version", *_wide({m.name: F.expr(m.default) for m in METRICS}))


def format_value(metric: Metric, value: Column) -> Column:
    """Report text: floats with two decimals, dates without time, lists joined."""
    if metric.kind == REAL:
        return F.call_function("format_number", value, F.lit("0.00"))
    if metric.kind == TIME:
        return F.date_format(value, "yyyy-MM-dd")
    if metric.kind == LIST:
        return F.array_join(value, ", ")
    return value.cast("string")


def metrics_long(wide: DataFrame, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """``name, version, category_ord, category, metric_ord, metric, value``."""
    entries = [
        F.struct(
            F.lit(CATEGORIES.index(m.category)).alias("category_ord"),
            F.lit(m.category).alias("category"),
            F.lit(i).alias("metric_ord"),
            F.lit(m.name).alias("metric"),
            format_value(m, F.col(f"{m.prefix}.{m.field}")).alias("value"),
        )
        for i, m in enumerate(metrics)
    ]
    return wide.select("name", "version", F.inline(F.array(*entries)))
