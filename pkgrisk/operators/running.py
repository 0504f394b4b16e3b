"""Running sums over a whole table, in as many tasks as the table needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pkgrisk.session import Scratch


def running_sums(df: DataFrame, order: Sequence[str], values: Sequence[str], scratch: Scratch, name: str = "ranges", parts: int | None = None) -> DataFrame:
    """``order`` and ``values``, each value replaced by its sum over all rows up to this one; no two rows may be equal in ``order``.

    Rows are dealt out by ranges of ``order`` and written.  One sum a range says what lies before each range, and rows are summed
    up inside their range.  A window never sees more than a range, and ranges are equally large whatever the keys are; the offsets
    are one row a range, which are as many as Spark deals a shuffle to.
    """
    ranged = df.select(*order, *values)
    ranged = ranged.repartitionByRange(parts, *order) if parts else ranged.repartitionByRange(*order)
    ranged = scratch.save(ranged.withColumn("_range", F.spark_partition_id()), name)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    before = sums.select("_range", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("_range", *order, *[F.sum(v).over(inside).alias(v) for v in values])
    return local.join(F.broadcast(before), "_range").select(*order, *[(F.col(v) + F.col(f"_before_{v}")).alias(v) for v in values])
