"""Nested look-back counts and nearest-rank age statistics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Look-back windows in days and the reported percentiles.
WINDOW_DAYS = (90, 180, 365)
PERCENTILES = (50, 75, 90, 95)

SECONDS_PER_DAY = 86400
AGE_FIELDS = ("avg", *(f"p{p}" for p in PERCENTILES))


def days_before(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(days=F.lit(days))


def window_counts(
    ts: Column,
    now: Column,
    name: str,
    days: Sequence[int] = WINDOW_DAYS,
    when: Column | None = None,
    total: bool = True,
) -> list[Column]:
    """Aggregates counting events in nested look-back windows.

    Cutoffs are inclusive and there is no upper bound: an event in the future
    counts everywhere.  One pass, any number of families.
    """
    keep = ts.isNotNull() if when is None else ts.isNotNull() & when
    counts = [F.count_if(keep & (ts >= days_before(now, d))).alias(f"{name}_last_{d}_days") for d in days]
    if total:
        counts.append(F.count_if(keep).alias(f"{name}_total"))
    return counts


def age_histogram(df: DataFrame, keys: Sequence[str], seconds: Column) -> DataFrame:
    """Ages as ``keys, day, n, seconds``; negative and non-finite ages drop out.

    A group with any number of rows shrinks to one row per whole day before
    anything has to see it in one place, so a hot group costs no more than the
    number of days it spans.
    """
    s = seconds.cast("double")
    usable = df.withColumn("_s", s).filter(
        F.col("_s").isNotNull()
        & ~F.isnan("_s")
        & (F.col("_s") >= 0)
        & (F.col("_s") < F.lit(float("inf")))
    )
    return (
        usable.withColumn("day", F.floor(F.col("_s") / SECONDS_PER_DAY))
        .groupBy(*keys, "day")
        .agg(F.count("*").alias("n"), F.sum("_s").alias("seconds"))
    )


def ages_from_histogram(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average and nearest-rank percentiles in whole days.

    Truncating to days keeps order, so the day that holds the ranked element
    is the truncated percentile: no individual age has to be kept.
    """
    group = Window.partitionBy(*keys)
    running = group.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hist.withColumn("_upto", F.sum("n").over(running)).withColumn("_all", F.sum("n").over(group))

    def ranked(p: int) -> Column:
        index = F.round(F.lit(float(p)) / F.lit(100.0) * (F.col("_all") - 1).cast("double"))
        return F.min(F.when(F.col("_upto") > index, F.col("day"))).alias(f"p{p}")

    average = F.sum("seconds") / F.sum("n") / SECONDS_PER_DAY
    return placed.groupBy(*keys).agg(
        F.floor(average).alias("avg"), *[ranked(p) for p in PERCENTILES]
    )


def age_stats(df: DataFrame, keys: Sequence[str], seconds: Column) -> DataFrame:
    return ages_from_histogram(age_histogram(df, keys, seconds), keys)


def zero_filled(columns: Iterable[str]) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in columns]
