"""Policy files: thresholds, rules, allow list and freshness limits (TOML)."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass
from datetime import timedelta


@dataclass(frozen=True)
class Rule:
    """A named boolean Spark SQL expression over the metrics."""

    name: str
    expression: str
    description: str | None = None
    points: int | None = None

    @property
    def text(self) -> str:
        return self.description if self.description is not None else self.expression

    @property
    def weight(self) -> int:
        return 1 if self.points is None else self.points


@dataclass(frozen=True)
class Allowed:
    name: str
    version: str


_WEEK = timedelta(weeks=1)


@dataclass(frozen=True)
class Policy:
    high_risk: tuple[Rule, ...] = ()
    eval: tuple[Rule, ...] = ()
    allow_list: tuple[Allowed, ...] = ()
    medium_risk_threshold: float = 30.0
    low_risk_threshold: float = 70.0
    crates_cache_ttl: timedelta = _WEEK
    hosting_cache_ttl: timedelta = _WEEK
    codebase_cache_ttl: timedelta = _WEEK
    coverage_cache_ttl: timedelta = _WEEK
    advisories_cache_ttl: timedelta = _WEEK

    def check_thresholds(self) -> None:
        for key in ("medium_risk_threshold", "low_risk_threshold"):
            value = getattr(self, key)
            if not 0.0 <= value <= 100.0:
                raise ValueError(f"{key} must be between 0 and 100, got {value:g}")
        if self.medium_risk_threshold >= self.low_risk_threshold:
            raise ValueError(
                f"medium_risk_threshold ({self.medium_risk_threshold:g}) must be less than "
                f"low_risk_threshold ({self.low_risk_threshold:g})"
            )


_UNIT_SECONDS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hr": 3600,
                 "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800}


def parse_duration(text: str) -> timedelta:
    """'1 week', '36 hours', '1 week 2 days'."""
    total, rest = 0, text.strip()
    while rest:
        got = re.match(r"(\d+)\s*([a-z]+)\s*", rest)
        unit = got and (_UNIT_SECONDS.get(got[2]) or _UNIT_SECONDS.get(got[2].rstrip("s")))
        if not unit:
            raise ValueError(f"invalid duration '{text}'")
        total += int(got[1]) * unit
        rest = rest[got.end():]
    if not text.strip():
        raise ValueError("invalid duration ''")
    return timedelta(seconds=total)


def _strict(kind: type, data: dict, where: str):
    unknown = set(data) - set(kind.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown field `{sorted(unknown)[0]}` in {where}")
    return kind(**data)


def parse_policy(text: str) -> Policy:
    data = tomllib.loads(text)
    for key in ("high_risk", "eval"):
        if key in data:
            data[key] = tuple(_strict(Rule, r, key) for r in data[key])
    if "allow_list" in data:
        data["allow_list"] = tuple(_strict(Allowed, a, "allow_list") for a in data["allow_list"])
    for key in [k for k in data if k.endswith("_cache_ttl")]:
        data[key] = parse_duration(data[key])
    policy = _strict(Policy, data, "policy")
    policy.check_thresholds()
    return policy


def load_policy(path: str | None = None) -> Policy:
    """The policy in ``path``, or the default one."""
    if path is None:
        return default_policy()
    with open(path, encoding="utf-8") as handle:
        return parse_policy(handle.read())


# Accepted license ids.
LICENSES = (
    "AFL-3.0", "Apache-2.0", "AAL", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CATOSL-1.1",
    "EUDatagrid", "ECL-2.0", "EFL-2.0", "Entessa", "Fair", "HPND", "ISC", "MS-PL", "MIT", "MirOS",
    "Multics", "NTP", "Naumen", "OGTSL", "PHP-3.0", "CNRI-Python", "Python-2.0", "QPL-1.0", "NCSA",
    "VSL-1.0", "W3C", "Xnet", "ZPL-2.0", "Zlib", "Unicode-3.0", "CC0-1.0", "CDLA-Permissive-2.0",
    "0BSD", "Unlicense",
)


# What a default rule asks for, as its outcome says it.
DESCRIPTIONS = {
    "Allowed License": "The license names one of the accepted ids.",
    "No Critical Security Vulnerability": "No critical advisory affects this version.",
    "No High Security Vulnerability": "No advisory of high severity affects this version.",
    "Maintained Crate": "No advisory calls this version unmaintained.",
    "Sound Crate": "No advisory calls this version unsound.",
    "Not Yanked": "The version is still offered by the registry.",
    "Crate Age >= 6 Months": "The package has existed for half a year.",
    "Crate Age >= 1 Year": "The package has existed for a year.",
    "Stable Version (>= 1.0.0)": "The major version is at least 1.",
    "Some Adoption (>= 1,000 downloads in 90 days)": "A thousand downloads in the last three months.",
    "Popular Crate (>= 5,000 downloads in 90 days)": "Five thousand downloads in the last three months.",
    "Highly Adopted Crate (>= 500,000 downloads in 90 days)": "Half a million downloads in the last three months.",
    "Multiple Owners": "More than one user or team can publish it.",
    "Release in Last 12 Months": "A version came out in the last year.",
    "Release in Last 6 Months": "A version came out in the last half year.",
    "Large Community (>= 10 contributors)": "Ten people or more have committed to the repository.",
    "Some Community (>= 5 contributors)": "Five people or more have committed to the repository.",
    "Active Development (> 3 commits in 90 days)": "More than three commits in the last three months.",
    "Some Development Activity (>= 1 commit in 90 days)": "A commit in the last three months.",
    "Fast Issue Resolution (p50 < 30 days)": "Half of the issues closed in the last year were open for less than 30 days.",
    "Reasonable Issue Resolution (p75 < 180 days)": "Three quarters of the issues closed in the last year were open for less than 180 days.",
    "Fast PR Merge (p50 < 7 days)": "Half of the pull requests merged in the last year waited less than a week.",
    "Reasonable PR Merge (p75 < 15 days)": "Three quarters of the pull requests merged in the last year waited less than 15 days.",
    "Good PR Turnaround (p90 < 30 days)": "Nine tenths of the pull requests merged in the last year waited less than 30 days.",
    "Good Documentation Coverage (>= 90%)": "Nine tenths of the public items are documented.",
    "Has Examples": "The documentation or the package holds examples.",
    "Crate-Level Documentation": "The front page of the documentation has a text.",
    "CI/CD Configured": "The repository has workflows.",
    "Uses Clippy": "A workflow runs the linter.",
    "Uses Miri": "A workflow runs the interpreter that finds undefined behaviour.",
    "High Test Coverage (>= 75%)": "Tests cover three quarters of the code.",
    "Medium Test Coverage (>= 50%)": "Tests cover half of the code.",
    "No Unsafe Usage": "The code has no unsafe part.",
    "Low Unsafe Usage (< 10 blocks)": "The code has fewer than ten unsafe parts.",
    "No Medium Vulnerabilities": "No advisory of medium severity affects this version.",
    "No Low Vulnerabilities": "No advisory of low severity affects this version.",
}


def default_policy() -> Policy:
    """Rule names, thresholds and points of the default policy."""
    licenses = ", ".join(f"'{x}'" for x in LICENSES)
    gate = (
        ("Allowed License", f"exists(array({licenses}), x -> contains(crate.license, x))"),
        ("No Critical Security Vulnerability", "advisories.version_critical_severity_vulnerabilities <=> 0"),
        ("No High Security Vulnerability", "advisories.version_high_severity_vulnerabilities <=> 0"),
        ("Maintained Crate", "advisories.version_unmaintained_warnings <=> 0"),
        ("Sound Crate", "advisories.version_unsound_warnings <=> 0"),
        ("Not Yanked", "NOT stability.yanked"),
    )
    weighted = (
        (5, "Crate Age >= 6 Months", "stability.crate_created_at < now - INTERVAL '4320' HOUR"),
        (5, "Crate Age >= 1 Year", "stability.crate_created_at < now - INTERVAL '8760' HOUR"),
        (1, "Stable Version (>= 1.0.0)", "NOT startswith(crate.version, '0.')"),
        (5, "Some Adoption (>= 1,000 downloads in 90 days)", "usage.total_downloads_last_90_days >= 1000"),
        (3, "Popular Crate (>= 5,000 downloads in 90 days)", "usage.total_downloads_last_90_days >= 5000"),
        (2, "Highly Adopted Crate (>= 500,000 downloads in 90 days)",
         "usage.total_downloads_last_90_days >= 500000"),
        (9, "Multiple Owners", "size(crate.owners) >= 2"),
        (7, "Release in Last 12 Months", "stability.versions_last_365_days >= 1"),
        (5, "Release in Last 6 Months", "stability.versions_last_180_days >= 1"),
        (3, "Large Community (>= 10 contributors)", "community.repo_contributors >= 10"),
        (2, "Some Community (>= 5 contributors)", "community.repo_contributors >= 5"),
        (5, "Active Development (> 3 commits in 90 days)", "activity.commits_last_90_days > 3"),
        (3, "Some Development Activity (>= 1 commit in 90 days)", "activity.commits_last_90_days >= 1"),
        (2, "Fast Issue Resolution (p50 < 30 days)", "activity.closed_issue_age_last_365_days_p50 < 30"),
        (2, "Reasonable Issue Resolution (p75 < 180 days)", "activity.closed_issue_age_last_365_days_p75 < 180"),
        (2, "Fast PR Merge (p50 < 7 days)", "activity.merged_pr_age_last_365_days_p50 < 7"),
        (2, "Reasonable PR Merge (p75 < 15 days)", "activity.merged_pr_age_last_365_days_p75 < 15"),
        (2, "Good PR Turnaround (p90 < 30 days)", "activity.merged_pr_age_last_365_days_p90 < 30"),
        (3, "Good Documentation Coverage (>= 90%)", "docs.public_api_coverage_percentage >= 90"),
        (2, "Has Examples", "docs.examples_in_docs > 0 OR docs.standalone_examples > 0"),
        (2, "Crate-Level Documentation", "docs.crate_level_docs_present"),
        (7, "CI/CD Configured", "trust.ci_workflows"),
        (3, "Uses Clippy", "trust.clippy_usage"),
        (1, "Uses Miri", "trust.miri_usage"),
        (6, "High Test Coverage (>= 75%)", "trust.code_coverage_percentage >= 75"),
        (4, "Medium Test Coverage (>= 50%)", "trust.code_coverage_percentage >= 50"),
        (3, "No Unsafe Usage", "trust.unsafe_blocks <=> 0"),
        (2, "Low Unsafe Usage (< 10 blocks)", "trust.unsafe_blocks < 10"),
        (8, "No Medium Vulnerabilities", "advisories.version_medium_severity_vulnerabilities <=> 0"),
        (3, "No Low Vulnerabilities", "advisories.version_low_severity_vulnerabilities <=> 0"),
    )
    return Policy(
        high_risk=tuple(Rule(n, e, DESCRIPTIONS[n]) for n, e in gate),
        eval=tuple(Rule(n, e, DESCRIPTIONS[n], p) for p, n, e in weighted),
    )
