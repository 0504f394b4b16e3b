"""The entry points of an appraisal, each one lazy plan over landed tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.text import repository
from pkgrisk.operators.advisories import advisory_facts
from pkgrisk.operators.codebase import located_codebase
from pkgrisk.operators.facts import for_packages, merge_facts
from pkgrisk.operators.graph import closure_facts, closure_requests, select_roots
from pkgrisk.operators.metrics import metrics_wide
from pkgrisk.operators.registry import Registry, registry_facts
from pkgrisk.operators.resolve import analysable, deduplicate_specs, resolve, with_suggestions
from pkgrisk.operators.rules import appraise, should_appraise
from pkgrisk.session import Scratch
from pkgrisk.sources.policy import Policy


@dataclass(frozen=True)
class Sources:
    """Facts beside the registry, already at the grain they are joined on.

    ``hosting`` and ``coverage`` hold ``repo, status, reason`` and a payload,
    ``codebase`` ``repo, name`` and a payload, ``docs`` ``name, version`` and a
    payload; ``repo`` is the clean repository URL.
    """

    advisories: DataFrame | None = None
    hosting: DataFrame | None = None
    codebase: DataFrame | None = None
    coverage: DataFrame | None = None
    docs: DataFrame | None = None


@dataclass(frozen=True)
class Identified:
    """Resolved requests and the packages among them, written once.

    Everything downstream joins these two small tables instead of repeating
    the resolution in every branch of the plan.
    """

    resolved: DataFrame
    packages: DataFrame  # name, version, repo, crate_id, version_id


def identify(requests: DataFrame, registry: Registry, repo: Column | None = None) -> Identified:
    scratch = Scratch(requests.sparkSession, "identified")
    resolved = scratch.save(resolve(requests, registry.crates, registry.versions), "resolved")
    home = registry.crates.select(F.col("id").alias("crate_id"), "repository")
    found = analysable(resolved).join(home, "crate_id").withColumn(
        "repo", repository(F.col("repository"))["url"] if repo is None else repo
    )
    packages = scratch.save(
        deduplicate_specs(found).select("name", "version", "repo", "crate_id", "version_id"), "packages"
    )
    return Identified(resolved, packages)


def gather(found: Identified, registry: Registry, sources: Sources, now: Column) -> DataFrame:
    """One facts row per found package."""
    ids = found.packages.select("name", "version", "repo")
    providers: dict[str, DataFrame] = {}
    if sources.advisories is not None:
        providers["advisories"] = advisory_facts(sources.advisories, ids)
    if sources.hosting is not None:
        providers["hosting"] = for_packages(ids, sources.hosting, "hosting")
    if sources.coverage is not None:
        providers["coverage"] = for_packages(ids, sources.coverage, "coverage")
    if sources.codebase is not None:
        providers["codebase"] = located_codebase(ids, sources.codebase)
    if sources.docs is not None:
        providers["docs"] = sources.docs.join(ids, ["name", "version"], "left_semi")
    return merge_facts(registry_facts(registry, found.packages, now), providers)


def appraise_packages(
    requests: DataFrame,
    registry: Registry,
    sources: Sources,
    policy: Policy,
    now: Column,
    suggestions: bool = True,
    gate_requested: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(appraised, resolved)`` for ``requests(name, version)``.

    ``appraised`` has the metric structs and, if there is anything to judge,
    ``appraisal``; ``resolved`` tells which requests failed and why.
    """
    found = identify(requests, registry)
    resolved = found.resolved
    metrics = metrics_wide(gather(found, registry, sources, now))
    if should_appraise(policy, gate_requested):
        metrics = appraise(metrics, policy, now)
    if suggestions:
        resolved = with_suggestions(resolved, registry.crates)
    return metrics, resolved


def appraise_graph(
    graph: dict[str, DataFrame],
    registry: Registry,
    sources: Sources,
    policy: Policy,
    now: Column,
    names: Sequence[str] = (),
    workspace: bool = False,
    types: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Appraise everything a dependency graph reaches from its roots."""
    roots = select_roots(graph["packages"], names, workspace)
    closure = closure_facts(
        roots,
        graph["package_features"],
        graph["package_deps"],
        graph["resolve_edges"],
        graph["resolve_features"],
        types,
    )
    requests = closure_requests(closure, graph["packages"])
    return appraise_packages(requests, registry, sources, policy, now, suggestions=False)
