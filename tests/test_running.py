"""Running sums over ranges, and the counts per version that use them."""

import random

from pyspark.sql import functions as F

from pkgrisk.operators.advisories import COUNTERS, version_counts
from pkgrisk.operators.running import running_sums
from pkgrisk.session import Scratch


def test_one_package_of_a_million_versions(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("hot").alias("package"), F.format_string("%08d", F.col("id")).alias("key"), (F.col("id") % 3 - 1).alias("step"), F.lit(1).alias("one"))
    scratch = Scratch(spark, "test-running")
    sums = running_sums(rows.repartition(5), ("package", "key"), ("step", "one"), scratch, parts=16)
    i = F.col("key").cast("long")
    wrong = sums.filter((F.col("one") != i + 1) | (F.col("step") != F.when(i % 3 == 0, -1).when(i % 3 == 1, -1).otherwise(0)))
    assert sums.count() == n and wrong.isEmpty()
    sizes = [r["count"] for r in spark.read.parquet(f"{scratch.path}/ranges").groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * n / 16


def test_running_sums_of_small_and_empty_tables(spark):
    rng = random.Random(4)
    rows = sorted({(rng.choice("ab"), rng.randrange(40)) for _ in range(30)})
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "package string, key int, v long").repartition(3)
    for parts in (1, 7):
        got = sorted(map(tuple, running_sums(df, ("package", "key"), ("v",), Scratch(spark, "test-running"), parts=parts).collect()))
        assert got == [(*r, i * (i + 1) // 2) for i, r in enumerate(rows)]
    assert running_sums(df.limit(0), ("package", "key"), ("v",), Scratch(spark, "test-running")).isEmpty()


ADVISORY = "id string, package string, informational string, severity string, cvss string, patched array<string>, unaffected array<string>"


def test_counts_of_many_packages_against_pairs(spark):
    """Open and half-open ranges, several advisories a package, versions on and between the ends, and one malformed version."""
    rng = random.Random(9)
    packages = [f"p{i}" for i in range(6)]

    def at():
        return (rng.randrange(3), rng.randrange(4), rng.randrange(3))

    advisories, spans = [], []
    for i in range(40):
        package, low, high = rng.choice(packages), at(), at()
        severity = rng.choice(["low", "medium", "high", "critical"])
        advisories.append((str(i), package, None, severity, None, [">=" + ".".join(map(str, low))], ["<" + ".".join(map(str, high))]))
        spans.append((package, severity, low, high))
    versions = [(p, at()) for p in packages for _ in range(30)] + [("other", (1, 0, 0))]
    frame = spark.createDataFrame([(p, ".".join(map(str, v))) for p, v in versions] + [("p0", "not a version")], "package string, version string")
    counted = version_counts(spark.createDataFrame(advisories, ADVISORY), frame)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in plan and "windowspecdefinition(package" not in plan
    got = {(r.package, r.version): {c: r[f"{c}_vulnerability_count"] for c in ("low", "medium", "high", "critical")} for r in counted.collect()}
    for package, version in versions:
        want = {c: sum(p == package and s == c and not (version >= low or version < high) for p, s, low, high in spans) for c in ("low", "medium", "high", "critical")}
        assert got[package, ".".join(map(str, version))] == want
    assert sum(got["p0", "not a version"].values()) == sum(p == "p0" for p, *_ in spans)
    assert set(COUNTERS.values()) <= set(counted.columns)
