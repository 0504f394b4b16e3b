"""Security advisories: severity classes and counts per package and version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.let import let
from pkgrisk.functions.semver import precedence_key, requirement_interval
from pkgrisk.operators.running import running_sums
from pkgrisk.session import Scratch

# Counter names, in report order.
CLASSES = ("low", "medium", "high", "critical", "notice", "unmaintained", "unsound")
INFORMATIONAL = ("notice", "unmaintained", "unsound")
COUNTERS = {
    **{c: f"{c}_vulnerability_count" for c in ("low", "medium", "high", "critical")},
    **{c: f"{c}_warning_count" for c in INFORMATIONAL},
}
YANKED_COUNTER = "yanked_warning_count"

# Metric weights of the published CVSS 3 base score.
_WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_CHANGED": {"N": 0.85, "L": 0.68, "H": 0.5},
    "UI": {"N": 0.85, "R": 0.62},
    "CIA": {"H": 0.56, "L": 0.22, "N": 0.0},
}


def cvss_base_score(vector: Column) -> Column:
    """CVSS 3.x base score; NULL if the vector is incomplete."""

    def letter(metric: str) -> Column:
        return F.regexp_extract(vector, rf"/{metric}:([A-Z])(/|$)", 1)

    def weight(table: str, key: Column) -> Column:
        pairs = [F.lit(x) for item in _WEIGHTS[table].items() for x in item]
        return F.try_element_at(F.create_map(*pairs), key)

    read = F.struct(
        (letter("S") == "C").alias("changed"),
        letter("PR").alias("pr"),
        (8.22 * weight("AV", letter("AV")) * weight("AC", letter("AC")) * weight("UI", letter("UI"))).alias("ease"),
        (
            1 - (1 - weight("CIA", letter("C"))) * (1 - weight("CIA", letter("I"))) * (1 - weight("CIA", letter("A")))
        ).alias("iss"),
    )

    def parts(r: Column) -> Column:
        privileges = F.when(r["changed"], weight("PR_CHANGED", r["pr"])).otherwise(weight("PR", r["pr"]))
        impact = F.when(
            r["changed"], 7.52 * (r["iss"] - 0.029) - 3.25 * F.pow(r["iss"] - 0.02, F.lit(15.0))
        ).otherwise(6.42 * r["iss"])
        scope = F.when(r["changed"], 1.08).otherwise(1.0)
        return F.struct(impact.alias("impact"), (r["ease"] * privileges).alias("ease"), scope.alias("scope"))

    def rounded_up(p: Column) -> Column:
        scaled = F.round(F.least(p["scope"] * (p["impact"] + p["ease"]), F.lit(10.0)) * 100000)
        return F.when(p["impact"] <= 0, F.lit(0.0)).otherwise(F.ceil(scaled / 10000) / 10.0)

    score = let(let(read, parts), rounded_up)
    return F.when(vector.startswith("CVSS:3") & letter("S").isin("U", "C"), score)


def severity(score: Column) -> Column:
    def band(s: Column) -> Column:
        return (
            F.when(s <= 0, "none")
            .when(s < 4, "low")
            .when(s < 7, "medium")
            .when(s < 9, "high")
            .when(s.isNotNull(), "critical")
        )

    return let(score, band)


def advisory_class(informational: Column, severity_text: Column, cvss: Column) -> Column:
    """The counter an advisory belongs to; NULL if it is not counted.

    Informational advisories never count as vulnerabilities.
    """
    known = F.coalesce(F.lower(severity_text), severity(cvss_base_score(cvss)))
    counted = let(known, lambda k: F.when(k.isin("low", "medium", "high", "critical"), k))
    return F.when(
        informational.isNotNull(), F.when(informational.isin(*INFORMATIONAL), informational)
    ).otherwise(counted)


def classified(advisories: DataFrame) -> DataFrame:
    return advisories.withColumn(
        "class", advisory_class(F.col("informational"), F.col("severity"), F.col("cvss"))
    ).filter(F.col("class").isNotNull())


def total_counts(advisories: DataFrame) -> DataFrame:
    """Counters per package over all its advisories."""
    return classified(advisories).groupBy("package").agg(
        *[F.count_if(F.col("class") == c).alias(COUNTERS[c]) for c in CLASSES]
    )


def safe_intervals(patched: Column, unaffected: Column) -> Column:
    """Patched and unaffected requirements as disjoint, sorted ``struct<lo, hi>``."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(patched, none), F.coalesce(unaffected, none))
    spans = F.filter(
        F.transform(both, requirement_interval), lambda s: s.isNotNull() & (s["lo"] < s["hi"])
    )

    def absorb(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = (F.size(done) > 0) & (span["lo"] <= last["hi"])
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        grown = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], span["hi"]).alias("hi"))
        return F.when(joins, F.concat(head, F.array(grown))).otherwise(F.concat(done, F.array(span)))

    empty = F.array().cast("array<struct<lo: string, hi: string>>")
    return F.aggregate(F.array_sort(spans), empty, absorb)


def version_counts(advisories: DataFrame, versions: DataFrame) -> DataFrame:
    """Counters of the advisories that affect each ``(package, version)``.

    A version is affected unless it lies in a safe interval.  Instead of pairing
    versions with advisories, interval ends become +1 / -1 steps per class and a
    version reads off the running sum at its place.  The steps of a package add up
    to nothing, so one running sum over all packages, in order of package and key,
    starts at zero for each of them, and a package with very many versions or
    advisories is spread over many ranges.
    """
    # A small file is read by one task or two, but its requirements are long work: deal the rows out first.
    parts = int(advisories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rated = classified(advisories.repartition(parts))
    totals = rated.groupBy("package").agg(
        *[F.count_if(F.col("class") == c).alias(f"all_{c}") for c in CLASSES]
    )
    spans = rated.select(
        "package", "class", F.explode(safe_intervals(F.col("patched"), F.col("unaffected"))).alias("s")
    )
    steps = spans.select(
        "package",
        "class",
        F.explode(
            F.array(
                F.struct(F.col("s.lo").alias("key"), F.lit(1).alias("step")),
                F.struct(F.col("s.hi").alias("key"), F.lit(-1).alias("step")),
            )
        ).alias("e"),
    ).select("package", "class", "e.key", "e.step")
    asked = versions.select("package", "version").distinct().withColumn("key", precedence_key(F.col("version")))
    marks = steps.unionByName(
        asked.select("package", F.lit(None).cast("string").alias("class"), "key", F.lit(0).alias("step"))
    )
    points = marks.groupBy("package", "key").agg(
        *[F.sum(F.when(F.col("class") == c, F.col("step")).otherwise(0)).alias(c) for c in CLASSES]
    ).filter("key is not null")
    safe = running_sums(points, ("package", "key"), CLASSES, Scratch(advisories.sparkSession, "safe-versions"))
    return (
        asked.join(safe, ["package", "key"], "left")
        .join(totals, "package", "left")
        .select(
            "package",
            "version",
            *[
                (F.coalesce(f"all_{c}", F.lit(0)) - F.coalesce(c, F.lit(0))).cast("bigint").alias(COUNTERS[c])
                for c in CLASSES
            ],
        )
    )


def advisory_facts(advisories: DataFrame, packages: DataFrame) -> DataFrame:
    """``name, version, advisories struct<per_version, total>``; zeros where there are none."""
    asked = packages.select(F.col("name").alias("package"), "version").distinct()
    total = total_counts(advisories)
    per_version = version_counts(advisories, asked)

    def counters(prefix: str, name: str) -> Column:
        return F.struct(
            *[F.coalesce(F.col(f"{prefix}{c}"), F.lit(0)).alias(c) for c in COUNTERS.values()],
            F.lit(0).cast("bigint").alias(YANKED_COUNTER),
        ).alias(name)

    total = total.select("package", *[F.col(c).alias(f"t_{c}") for c in COUNTERS.values()])
    return (
        asked.join(per_version, ["package", "version"], "left")
        .join(total, "package", "left")
        .select(
            F.col("package").alias("name"),
            "version",
            F.struct(counters("", "per_version"), counters("t_", "total")).alias("advisories"),
        )
    )
