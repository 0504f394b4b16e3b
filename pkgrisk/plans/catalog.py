"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pkgrisk.plans.shadow import Shadow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(shadow)`` under its own name."""

    def register(fn: Callable[[Shadow], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Shadow(spark, folder))

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# Shared SQL pieces ----------------------------------------------------------

NUM = (
    "concat(o_orderkey % 4, '.', o_orderkey % 13, '.', o_orderkey % 7, "
    "CASE WHEN o_orderkey % 5 = 0 THEN concat('-rc.', o_orderkey % 3) ELSE '' END)"
)
NOW = "TIMESTAMP '2001-08-01'"
CRATE_MONTHS = (
    "cm AS (SELECT o_custkey AS crate_id, date_trunc('month', l_shipdate)::DATE AS month, "
    "sum(l_quantity::BIGINT)::BIGINT AS downloads FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"
)
ISSUES = (
    "issues AS (SELECT l_suppkey AS repo, o_orderdate AS created_at, "
    "CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS closed_at, l_linestatus = 'O' AS is_open, "
    "l_returnflag = 'R' AS is_pr, "
    "CASE WHEN l_returnflag = 'R' AND l_tax > 0.04 AND l_linestatus = 'F' THEN l_shipdate END AS merged_at, "
    "l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
)


def nearest_rank(values: str, p: int) -> str:
    """Day at the nearest rank of a sorted list of ages in seconds."""
    index = f"(round({p}::DOUBLE / 100 * (len({values}) - 1)))::BIGINT + 1"
    return f"coalesce(floor(list_sort({values})[{index}] / 86400.0)::BIGINT, 0)"
