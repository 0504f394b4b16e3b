"""Report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.semver import semver_key
from pkgrisk.functions.text import tags
from pkgrisk.operators.metrics import METRICS, TIME, Metric, format_value
from pkgrisk.operators.rules import FALSE, TRUE
from pkgrisk.operators.running import running_sums
from pkgrisk.session import Scratch

# Marks and texts of the reports.
MARKS = {TRUE: "✔️", FALSE: "❌"}
NO_MARK = "➖"
# Packages side by side in one file of a matrix; more packages make more files.
MATRIX_BLOCK = 1_000


def in_report_order(df: DataFrame) -> DataFrame:
    return df.orderBy("name", semver_key(F.col("version")))


def status_text(appraisal: Column) -> Column:
    return F.concat(
        appraisal["risk"],
        F.lit(" RISK (score = "),
        F.call_function("format_number", appraisal["score"], F.lit("0")),
        F.lit(", awarded points = "),
        appraisal["awarded"].cast("string"),
        F.lit(", available points = "),
        appraisal["available"].cast("string"),
        F.lit(")"),
    )


def _failure(o: Column) -> Column:
    return F.when(
        ~o["disposition"].isin(TRUE, FALSE),
        F.concat(F.lit(" (failure to evaluate: "), F.coalesce(o["message"], F.lit("")), F.lit(")")),
    ).otherwise(F.lit(""))


def reasons_text(appraisal: Column) -> Column:
    def one(o: Column) -> Column:
        mark = F.lit(NO_MARK)
        for disposition, sign in MARKS.items():
            mark = F.when(o["disposition"] == disposition, sign).otherwise(mark)
        return F.concat(mark, F.lit(" "), o["name"], _failure(o))

    return F.array_join(F.transform(appraisal["outcomes"], one), "; ")


def appraisal_texts(appraised: DataFrame) -> DataFrame:
    a = F.col("appraisal")
    return appraised.select("name", "version", status_text(a).alias("status"), reasons_text(a).alias("reasons"))


def report_label(name: Column, version: Column) -> Column:
    return F.concat(name, F.lit(" v"), version)


def matrix_report(long: DataFrame, texts: DataFrame | None, packages: Sequence[str]) -> DataFrame:
    """Metrics down, packages across; appraisal and reasons first.

    ``packages`` names the columns.  A package of the input that is not among
    them ends the job; see ``matrix_blocks`` for all packages, however many.
    """
    rows = long.select(
        (F.col("category_ord") + 2).alias("section"),
        "metric_ord",
        F.col("metric").alias("Metric"),
        report_label(F.col("name"), F.col("version")).alias("package"),
        "value",
    )
    if texts is not None:
        label = report_label(F.col("name"), F.col("version"))
        for section, title, value in ((0, "Appraisals", "status"), (1, "Reasons", "reasons")):
            rows = rows.unionByName(
                texts.select(
                    F.lit(section).alias("section"),
                    F.lit(0).alias("metric_ord"),
                    F.lit(title).alias("Metric"),
                    label.alias("package"),
                    F.col(value).alias("value"),
                )
            )
    listed = F.array_contains(F.lit(list(packages)), F.col("package"))
    stray = F.raise_error(F.concat(F.lit("package is not listed for the matrix: "), F.col("package")))
    rows = rows.withColumn("package", F.when(listed, F.col("package")).otherwise(stray))
    wide = rows.groupBy("section", "metric_ord", "Metric").pivot("package", list(packages)).agg(F.first("value"))
    cells = [F.coalesce(F.col(f"`{p}`"), F.lit("")).alias(p) for p in packages]
    return wide.orderBy("section", "metric_ord").select("Metric", *cells)


def matrix_reports(
    long: DataFrame, texts: DataFrame | None, packages: Sequence[str], block: int = MATRIX_BLOCK
) -> list[DataFrame]:
    """The matrix of any number of packages as several, each of at most ``block`` of them."""

    def within(df: DataFrame, names: Sequence[str]) -> DataFrame:
        return df.filter(report_label(F.col("name"), F.col("version")).isin(list(names)))

    blocks = [packages[i : i + block] for i in range(0, len(packages), block)]
    return [matrix_report(within(long, b), texts if texts is None else within(texts, b), b) for b in blocks]


def _matrix_rows(long: DataFrame, texts: DataFrame | None) -> DataFrame:
    rows = long.select("name", "version", (F.col("category_ord") + 2).alias("section"), "metric_ord", F.col("metric").alias("Metric"), "value")
    if texts is not None:
        for section, title, value in ((0, "Appraisals", "status"), (1, "Reasons", "reasons")):
            rows = rows.unionByName(
                texts.select("name", "version", F.lit(section).alias("section"), F.lit(0).alias("metric_ord"), F.lit(title).alias("Metric"), F.col(value).alias("value"))
            )
    return rows


def matrix_blocks(long: DataFrame, texts: DataFrame | None = None, block: int = MATRIX_BLOCK) -> DataFrame:
    """``block, section, metric_ord, Metric, cells``: the matrix of all packages of the input, whatever their number, in one job.

    Packages are numbered in report order by running sums over ranges and laid side by side in blocks of ``block``.  A row of a block is
    one metric with a cell for each package of the block, empty where nothing is known; its first row, of section -1, has their labels.
    Of several values of a package and metric the smallest counts.
    """
    scratch = Scratch(long.sparkSession, "matrix")
    rows = scratch.save(_matrix_rows(long, texts), "rows")
    packages = rows.select("name", "version").distinct().withColumns({"key": semver_key(F.col("version")), "number": F.lit(1).cast("long")})
    numbers = scratch.save(running_sums(packages, ["name", "key", "version"], ["number"], scratch).drop("key"), "numbers")
    at = F.col("number") - 1
    numbers = numbers.select(
        F.col("name").alias("_name"), F.col("version").alias("_version"), F.floor(at / block).alias("block"), F.pmod(at, F.lit(block)).cast("int").alias("at")
    )
    widths = numbers.groupBy("block").agg((F.max("at") + 1).alias("width"))
    labels = numbers.select(
        "block", "at", F.lit(-1).alias("section"), F.lit(0).alias("metric_ord"), F.lit("Metric").alias("Metric"), report_label(F.col("_name"), F.col("_version")).alias("value")
    )
    same = F.col("name").eqNullSafe(F.col("_name")) & F.col("version").eqNullSafe(F.col("_version"))
    placed = rows.join(numbers, same).select("block", "at", "section", "metric_ord", "Metric", "value").unionByName(labels)
    found = F.array_sort(F.collect_list(F.struct("at", F.coalesce("value", F.lit("")).alias("value"))))
    return (
        placed.groupBy("block", "section", "metric_ord", "Metric").agg(found.alias("found")).join(widths, "block")
        .select("block", "section", "metric_ord", "Metric", _filled(F.col("found"), F.col("width")).alias("cells"))
    )


def _filled(found: Column, width: Column) -> Column:
    """Values of ``found`` (sorted by place) at their places 0 .. ``width`` - 1, empty ones between them."""
    complete = (F.size(found) == width) & (F.size(F.array_distinct(found["at"])) == width)
    none = F.array().cast("array<string>")

    def empty(n: Column) -> Column:
        return F.array_repeat(F.lit(""), F.greatest(n, F.lit(0)))

    def placed(so_far: Column, x: Column) -> Column:
        return F.when(x["at"] < F.size(so_far), so_far).otherwise(F.concat(so_far, empty(x["at"] - F.size(so_far)), F.array(x["value"])))

    padded = F.aggregate(found, none, placed, lambda a: F.concat(a, empty(width - F.size(a))))
    return F.when(complete, found["value"]).otherwise(padded)


def write_matrix(blocks: DataFrame, path: str) -> None:
    """A CSV file for each block, in a folder of its number: labels first, then metrics in report order."""

    def quoted(c: Column) -> Column:
        return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    line = F.array_join(F.transform(F.concat(F.array("Metric"), "cells"), quoted), ",")
    ordered = blocks.select("block", "section", "metric_ord", line.alias("value")).repartition("block").sortWithinPartitions("block", "section", "metric_ord")
    ordered.select("block", "value").write.mode("overwrite").partitionBy("block").text(path)


def present_metrics(long: DataFrame) -> DataFrame:
    """Metrics any package has, by category and registry order."""
    return (
        long.groupBy("category_ord", "category", "metric_ord", "metric")
        .agg(F.count("value").alias("packages"))
        .orderBy("category_ord", "metric_ord")
    )


def json_report(appraised: DataFrame, metrics: Sequence[Metric] = METRICS) -> DataFrame:
    """``name, version, json``: one object per package, keys sorted, no nulls."""

    def typed(m: Metric) -> Column:
        value = F.col(f"{m.prefix}.{m.field}")
        return format_value(m, value) if m.kind == TIME else value

    parts = []
    if "appraisal" in appraised.columns:
        a = F.col("appraisal")
        reasons = F.transform(a["outcomes"], lambda o: F.concat(o["name"], _failure(o)))
        parts.append(
            F.when(
                a.isNotNull(), F.struct(reasons.alias("reasons"), status_text(a).alias("result"))
            ).alias("appraisal")
        )
    ordered = sorted(metrics, key=lambda m: m.name)
    parts.append(F.struct(*[typed(m).alias(m.name) for m in ordered]).alias("metrics"))
    return appraised.select("name", "version", F.to_json(F.struct(*parts, "name", "version")).alias("json"))


NOT_EVALUATED = "NOT_EVALUATED"


def _risk_class() -> Column:
    return F.coalesce("appraisal.risk", F.lit(NOT_EVALUATED))


def risk_summary(appraised: DataFrame) -> DataFrame:
    return appraised.groupBy(_risk_class().alias("risk")).agg(F.count("*").alias("packages"))


def risk_listing(appraised: DataFrame) -> DataFrame:
    """All packages by class, worst score first; not evaluated ones by name."""
    return appraised.select(
        _risk_class().alias("risk"),
        F.coalesce("appraisal.score", F.lit(0.0)).alias("score"),
        "name",
        "version",
    ).orderBy("risk", "score", "name", "version")


def tag_texts(long: DataFrame) -> DataFrame:
    """Keyword and category values as '#a, #b'."""
    is_tags = F.lower("metric").contains("keyword") | F.lower("metric").contains("categor")
    return long.filter(is_tags & F.col("value").isNotNull()).withColumn("tags", tags(F.col("value")))
