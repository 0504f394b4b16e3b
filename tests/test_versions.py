from pyspark.sql import functions as F

from pkgrisk.functions.semver import (
    is_semver,
    requirement_interval,
    requirement_matches,
    semver_key,
)

ORDERED = (
    "0.0.0 1.0.0-alpha 1.0.0-alpha.1 1.0.0-alpha.beta 1.0.0-beta 1.0.0-beta.2 1.0.0-beta.11 1.0.0-rc.1 "
    "1.0.0 1.0.0+1 1.0.0+2 1.0.0+10 1.0.0+a 1.0.1 1.2.0 1.10.0 2.0.0 18446744073709551615.0.0"
).split()


def test_order(spark):
    df = spark.createDataFrame(list(enumerate(ORDERED)), "i int, v string")
    got = [r.i for r in df.orderBy(semver_key(F.col("v"))).collect()]
    assert got == list(range(len(ORDERED)))


def test_validity(spark):
    cases = {
        "1.2.3": True, "1.2.3-a.b+c": True, "1.2": False, "01.2.3": False, "1.2.3-": False, "1.2.3-01": False,
        "1.2.3-a..b": False, "v1.2.3": False, "": False, "18446744073709551616.0.0": False,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "v string, want boolean")
    assert df.filter(is_semver(F.col("v")) != F.col("want")).count() == 0


def test_requirements(spark):
    cases = [
        ("1.2.3", "^1.2", True), ("2.0.0", "^1.2", False), ("1.2.3", "1.2.3", True), ("0.2.5", "^0.2.3", True),
        ("0.3.0", "^0.2.3", False), ("0.0.3", "^0.0.3", True), ("0.0.4", "^0.0.3", False), ("1.2.9", "~1.2.3", True),
        ("1.3.0", "~1.2.3", False), ("1.9.0", "~1", True), ("1.2.3", "*", True), ("1.2.3-a", "*", False),
        ("1.2.3-b", ">=1.2.3-a", True), ("1.2.4-b", ">=1.2.3-a", False), ("1.5.0", ">=1.0, <2.0", True),
        ("2.0.0", ">=1.0, <2.0", False), ("1.2.3+x", "=1.2.3", True), ("1.2.4", "=1.2", True), ("1.3.0", ">1.2", True),
        ("1.2.9", ">1.2", False), ("1.2.9", "<=1.2", True), ("1.3.0", "<=1.2", False), ("1.2.9", "1.*", True),
        ("1.3.9", "1.2.*", False), ("0.0.9", "^0.0", True), ("0.1.0", "^0.0", False), ("0.9.0", "^0", True),
        ("1.2.3-b", "<1.2.3-c, >=1.2", False), ("1.2.3", "bad", None), ("x", "*", None), ("1.0.0", "< 1.0.1", True),
    ]
    df = spark.createDataFrame(cases, "v string, r string, want boolean")
    got = df.withColumn("got", requirement_matches(F.col("v"), F.col("r")))
    assert got.filter("not (got <=> want)").collect() == []


def test_interval_is_plain_order(spark):
    """Advisory ranges keep pre-releases of the next version inside."""
    df = spark.createDataFrame([("1.2.3-rc.1", "<1.2.3"), ("1.2.3", "<1.2.3")], "v string, r string")
    inside = df.select(
        (semver_key(F.col("v")) < requirement_interval(F.col("r"))["hi"]).alias("inside")
    ).collect()
    assert [r.inside for r in inside] == [True, False]


def test_numbers_beyond_the_range_are_malformed(spark):
    big = "9" * 25
    cases = [(f"{big}.0.0", "^1"), ("1.0.0", f"^{big}.1"), ("1.0.0", f">=1, <{big}"), ("1.0.0", "^18446744073709551616"), (f"1.0.0-{big}", "*")]
    df = spark.createDataFrame(cases, "v string, r string")
    rows = df.select(requirement_matches(F.col("v"), F.col("r")).alias("m"), semver_key(F.col("v")).alias("k"), requirement_interval(F.col("r")).alias("i")).collect()
    assert [r.m for r in rows] == [None, None, None, None, False]
    assert rows[0].k is None and rows[4].k is not None
    assert [r.i is None for r in rows] == [False, True, True, True, False]


def test_long_identifiers_are_ordered_by_value(spark):
    pre = ["1.0.0-" + "1" * n for n in (9_998, 9_999, 10_000, 10_001)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(pre)], "i int, v string")
    assert [r.i for r in df.orderBy(semver_key(F.col("v"))).collect()] == [0, 1, 2, 3]


def test_malformed_advisory_ranges_do_not_end_the_job(spark):
    from pkgrisk.operators.advisories import version_counts

    rows = [("A-1", "p", None, "high", None, [f"^{'9' * 30}.1", ">=2.0.0"], None), ("A-2", "p", None, "low", None, ["nonsense"], None)]
    advisories = spark.createDataFrame(rows, "id string, package string, informational string, severity string, cvss string, patched array<string>, unaffected array<string>")
    versions = spark.createDataFrame([("p", "1.0.0"), ("p", "2.1.0"), ("p", f"{'9' * 25}.0.0")], "package string, version string")
    counted = {r.version: sum(v for k, v in r.asDict().items() if isinstance(v, int)) for r in version_counts(advisories, versions).collect()}
    assert counted["1.0.0"] > counted["2.1.0"] and len(counted) == 3
