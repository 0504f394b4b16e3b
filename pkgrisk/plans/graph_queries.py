"""Reachability and the feature-aware closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.operators import graph as g
from pkgrisk.plans.catalog import query
from pkgrisk.plans.shadow import Shadow


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS src, unnest([p_partkey // 3, (p_partkey + p_size) // 4]) AS dst FROM part),
r AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst WHERE e.src <> e.dst)
SELECT p_partkey AS package, count(r.dst) AS transitive_dependencies FROM part LEFT JOIN r ON r.src = p_partkey GROUP BY 1"""
)
def closure_count(s: Shadow) -> DataFrame:
    packages = s.table("part").select(F.col("p_partkey").alias("package"))
    return g.transitive_dependency_counts(s.links, packages)


@query(
    """SELECT p_partkey::VARCHAR AS pkg_id, unnest(['default', 'std', 'alloc']) AS feature FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey::VARCHAR, 'extra' FROM part WHERE p_size % 2 = 1
UNION ALL SELECT p_partkey::VARCHAR, 'more' FROM part WHERE p_size % 2 = 1 AND p_partkey % 4 = 3"""
)
def feature_expand(s: Shadow) -> DataFrame:
    enabled = s.table("part").select(
        F.col("p_partkey").alias("pkg_id"), F.expr("IF(p_size % 2 = 0, 'default', 'extra')").alias("feature")
    )
    return g.expand_features(s.package_features, enabled)


@query(
    """SELECT p_partkey AS pkg_id, dep_lib_name, edge_kind, declared_kind, optional FROM part,
(VALUES ('a', 'normal', 'normal'), ('b', 'normal', 'normal'), ('c', 'dev', 'dev'), ('d', 'build', 'normal')) AS t(dep_lib_name, edge_kind, declared_kind),
LATERAL (SELECT dep_lib_name = 'b' AND p_partkey % 4 <> 3 AS optional)"""
)
def dep_declaration(s: Shadow) -> DataFrame:
    """Renamed, same-kind and fall-back declarations."""
    edges = g.edge_declarations(s.resolve_edges, s.package_deps)
    return edges.select("pkg_id", "dep_lib_name", "edge_kind", "declared_kind", "optional")


def _all_enabled(s: Shadow) -> DataFrame:
    return s.package_features.select("pkg_id", "feature").filter("feature <> 'extra' or pkg_id % 3 = 0").distinct()


@query(
    """SELECT p_partkey AS pkg_id, 'b' AS dep_lib_name FROM part
WHERE p_partkey % 4 = 0 OR (p_partkey % 4 = 1 AND p_partkey % 3 = 0)"""
)
def optional_active(s: Shadow) -> DataFrame:
    edges = g.edge_declarations(s.resolve_edges, s.package_deps)
    return g.active_optional(edges, s.package_features, _all_enabled(s)).select("pkg_id", "dep_lib_name")


@query(
    """SELECT p_partkey AS pkg_id, 'a' AS dep_lib_name, 'default' AS feature FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'a', 'extra' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'b', 'fast' FROM part WHERE p_partkey % 4 = 0 OR (p_partkey % 4 = 2 AND p_partkey % 3 = 0)
UNION ALL SELECT p_partkey, 'c', 'default' FROM part
UNION ALL SELECT p_partkey, 'd', 'extra' FROM part"""
)
def dep_features(s: Shadow) -> DataFrame:
    edges = g.edge_declarations(s.resolve_edges, s.package_deps)
    return g.dependency_features(edges, s.package_features, _all_enabled(s)).select("pkg_id", "dep_lib_name", "feature")


# Features of a package as (package, feature), '' for the package itself.
_IMPLIED = """imp AS MATERIALIZED (
  SELECT p_partkey AS p, 'default' AS f, p_partkey AS q, 'std' AS h FROM part
  UNION ALL SELECT p_partkey, 'std', p_partkey, 'alloc' FROM part
  UNION ALL SELECT p_partkey, 'extra', p_partkey, 'more' FROM part WHERE p_partkey % 4 = 3
  UNION ALL SELECT p_partkey, '', p_partkey // 3, '' FROM part
  UNION ALL SELECT p_partkey, '', p_partkey // 3, 'default' FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, '', p_partkey // 3, 'extra' FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, '', (p_partkey + p_size) // 4, '' FROM part WHERE p_partkey % 4 = 3
  UNION ALL SELECT p_partkey, 'std', (p_partkey + p_size) // 4, unnest(['', 'fast']) FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, 'extra', (p_partkey + p_size) // 4, '' FROM part WHERE p_partkey % 4 = 1)"""
_SEEDS = """
  SELECT p_partkey AS root, 'standard' AS type, p_partkey // 3 AS p, unnest(CASE WHEN p_partkey % 6 = 0 THEN ['', 'default', 'extra']
    WHEN p_partkey % 2 = 0 THEN ['', 'default'] WHEN p_partkey % 3 = 0 THEN ['', 'extra'] ELSE [''] END) AS f FROM part
  UNION ALL SELECT p_partkey, 'standard', (p_partkey + p_size) // 4, unnest(CASE WHEN p_partkey % 4 = 0 THEN ['', 'fast'] ELSE [''] END)
    FROM part WHERE p_partkey % 4 IN (0, 3)
  UNION ALL SELECT p_partkey, 'dev', (p_partkey + 2 * p_size) // 5, unnest(['', 'default']) FROM part
  UNION ALL SELECT p_partkey, 'build', (p_partkey + 3 * p_size) // 6, unnest(['', 'extra']) FROM part"""


def _closure_sql(where: str) -> str:
    return (
        f"WITH RECURSIVE {_IMPLIED}, facts AS (SELECT * FROM ({_SEEDS}) AS seeds{where} "
        "UNION SELECT facts.root, facts.type, q, h FROM facts JOIN imp ON imp.p = facts.p AND imp.f = facts.f)"
    )


@query(
    _closure_sql("")
    + " SELECT root::VARCHAR AS root, type, count(DISTINCT p) AS packages, sum(DISTINCT p)::BIGINT AS id_sum FROM facts GROUP BY ALL"
)
def closure_features(s: Shadow) -> DataFrame:
    """Closure of every package as root, for all three dependency types."""
    found = g.closure_facts(
        s.packages.select("pkg_id"), s.package_features, s.package_deps, s.resolve_edges, s.resolve_features
    )
    return found.groupBy("root", "type").agg(
        F.count("*").alias("packages"), F.sum(F.col("pkg_id").cast("bigint")).alias("id_sum")
    )


@query(
    _closure_sql(" WHERE root IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') AND type <> 'dev'")
    + " SELECT DISTINCT concat('part-', p_partkey) AS name, concat('1.0.', p_size) AS version FROM facts JOIN part ON p_partkey = facts.p"
)
def closure_roots(s: Shadow) -> DataFrame:
    """Requests for what the workspace members need outside of development."""
    roots = g.select_roots(s.packages, workspace=True)
    found = g.closure_facts(
        roots, s.package_features, s.package_deps, s.resolve_edges, s.resolve_features, types=("standard", "build")
    )
    return g.closure_requests(found, s.packages)
