"""Tables that are kept between runs and changed in parts."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pkgrisk.session import Scratch

_MANIFEST = "version long, part string, write string"


class KeptTable:
    """A folder of Parquet parts and a manifest that says which write each part comes from.

    A change writes new files for its own parts only, beside the old ones, and switches by writing the manifest of the next version,
    one file that Spark renames into place.  Until then readers see the old version, whatever was written; files of parts that a
    change does not name are never touched.  Of two writers that start from the same version the second one fails.  Part names
    come from the caller and are few: the manifest is one row a part.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self._spark, self.path = spark, path.rstrip("/")
        self._fields = StructType.fromDDL(schema).fields

    def _schema(self, *more: str) -> StructType:
        return StructType([*self._fields, *[StructField(name, StringType()) for name in more]])

    def version(self) -> int:
        return self._manifest()[0]

    def _manifest(self) -> tuple[int, dict[str, str]]:
        """Newest version and the write of each part; version 0 has no parts."""
        folder = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not folder.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(folder):
            return 0, {}
        rows = self._spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).parquet(f"{self.path}/manifest")
        newest = rows.agg(F.max("version")).head()[0]
        if newest is None:
            return 0, {}
        return newest, {r["part"]: r["write"] for r in rows.filter(F.col("version") == newest).collect()}

    def read(self, keep: Callable[[str], bool] = lambda part: True) -> DataFrame:
        """Rows of the parts whose name ``keep`` accepts, with their ``_part``; others are not even listed."""
        parts = {p: w for p, w in self._manifest()[1].items() if w and keep(p)}
        schema = self._schema("_part")
        if not parts:
            # Known to be empty when a plan is made, so that joins with it fall away.
            return self._spark.createDataFrame([], schema).limit(0)
        base = f"{self.path}/data"
        found = self._spark.read.schema(self._schema("_part", "_write")).option("basePath", base)
        return found.parquet(*[f"{base}/_write={w}/_part={p}" for p, w in sorted(parts.items())]).select(*schema.names)

    def replace(self, rows: DataFrame, emptied: Collection[str] = ()) -> int:
        """Parts named in ``rows._part`` get these rows instead of their own; returns the version that says so.

        Parts in ``emptied`` that get no rows have none from then on.
        Rows are dealt out by part; Spark splits large parts over several files and puts small ones in one task.
        """
        version, parts = self._manifest()
        write = uuid.uuid4().hex
        target = f"{self.path}/data/_write={write}"
        rows.select(*self._schema("_part").names).hint("rebalance", "_part").write.partitionBy("_part").parquet(target)
        names = self._spark.read.schema(self._schema("_part")).parquet(target).select("_part").distinct()
        parts |= dict.fromkeys(emptied, "") | {r["_part"]: write for r in names.collect()}
        manifest = self._spark.createDataFrame([(version + 1, p, w) for p, w in parts.items()], _MANIFEST)
        manifest.coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/{version + 1:09d}")
        return version + 1


class SnapshotStore:
    """Newest entry of each source and key, in buckets; new entries rewrite the buckets that they fall in."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], buckets: int = 64):
        """``merge`` reduces old and new rows to the rows to keep; it must not need rows of other keys."""
        self._table = KeptTable(spark, path, schema)
        self._merge, self._buckets = merge, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("source"), F.col("key").cast("string")), F.lit(self._buckets)).cast("string")

    def entries(self) -> DataFrame:
        return self._table.read().drop("_part")

    def upsert(self, fetched: DataFrame) -> None:
        """Merges new entries; an empty frame changes nothing.  ``fetched`` is read twice, so hand in a written table."""
        rows = fetched.withColumn("_part", self._bucket())
        touched = {r["_part"] for r in rows.select("_part").distinct().collect()}
        if touched:
            old = self._table.read(touched.__contains__).drop("_part")
            self._table.replace(self._merge(old.unionByName(fetched)).withColumn("_part", self._bucket()))


class DownloadStore:
    """Day rows and sums of each month, both as parts of one table, so that they always switch together."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._table = KeptTable(spark, path, "version_id long, date date, downloads long")

    def months(self) -> DataFrame:
        """``version_id, month, downloads`` over everything added so far, as ``monthly_by_version`` has them."""
        kept = self._table.read(lambda part: part.startswith("sums-"))
        return kept.select("version_id", F.col("date").alias("month"), "downloads")

    def add(self, downloads: DataFrame) -> Collection[datetime.date | None]:
        """Takes ``version_id, date, downloads``: each of its days replaces the day that is kept; returns the days that changed.

        Days are compared by count, sum and hash, and only months with a day that differs are written again, from their other kept
        days and the new ones.  Rows without a date make a day and a month of their own.
        """
        rows = downloads.groupBy("version_id", "date").agg(F.sum("downloads").cast("long").alias("downloads"))
        rows = Scratch(self._spark, "downloads").save(rows, "days")

        def marks(days: DataFrame) -> dict[datetime.date | None, tuple]:
            # One row a day.
            mark = days.groupBy("date").agg(F.count(F.lit(1)), F.sum("downloads"), F.bit_xor(F.xxhash64("version_id", "downloads")))
            return {r[0]: tuple(r[1:]) for r in mark.collect()}

        came = marks(rows)
        had = marks(self._table.read({f"days-{_month(d)}" for d in came}.__contains__))
        changed = {d for d, mark in came.items() if had.get(d) != mark}
        if changed:
            days = self._spark.createDataFrame([(d,) for d in changed], "date date")
            touched = {f"days-{_month(d)}" for d in changed}
            same = F.col("date").eqNullSafe(F.col("_date"))
            changes = F.broadcast(days.withColumnRenamed("date", "_date"))
            part = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("none"))
            whole = self._table.read(touched.__contains__).drop("_part").join(changes, same, "left_anti").unionByName(rows.join(changes, same, "left_semi"))
            sums = whole.groupBy("version_id", F.trunc("date", "MM").alias("date")).agg(F.sum("downloads").cast("long").alias("downloads"))
            self._table.replace(
                whole.withColumn("_part", F.concat(F.lit("days-"), part)).unionByName(sums.withColumn("_part", F.concat(F.lit("sums-"), part)))
            )
        return changed


class IssueAgeStore:
    """Age marks of each issue and their sums by repository and day, both as parts of one table.

    New, closed and reopened issues take back what they added before (-1) and add what they add now (+1).  Issues are in buckets by
    themselves and sums in buckets by repository and day, so that a repository with most of the issues fills no bucket.
    """

    def __init__(self, spark: SparkSession, path: str, repo: str = "string", buckets: int = 64):
        self._spark, self._buckets = spark, buckets
        self._table = KeptTable(spark, path, f"repo {repo}, issue string, family string, ended long, day long, n long, seconds long")

    def _bucket(self, kind: str, *columns: str) -> Column:
        return F.concat(F.lit(f"{kind}-"), F.pmod(F.xxhash64(*columns), F.lit(self._buckets)).cast("string"))

    def sums(self) -> DataFrame:
        """What ``hosting.ages_at`` takes."""
        return self._table.read(lambda part: part.startswith("sums-")).drop("_part", "issue")

    def add(self, issues: DataFrame, marks: Callable[[DataFrame], DataFrame]) -> None:
        """Takes the present state of some issues; ``marks`` is ``hosting.age_marks``.  Issues that are not named stay as they are.

        ``issues`` is read once: its marks have a row for every issue, which also says which ones are named.
        """
        scratch = Scratch(self._spark, "issue-ages")
        issues = issues.withColumn("issue", F.col("issue").cast("string"))
        every = scratch.save(marks(issues, every=True), "came")
        touched = {r["_part"] for r in every.select(self._bucket("issues", "repo", "issue").alias("_part")).distinct().collect()}
        if not touched:
            return
        came = every.filter("family is not null")
        named = every.select(F.col("repo").alias("_repo"), F.col("issue").alias("_issue"))
        same = F.col("repo").eqNullSafe(F.col("_repo")) & F.col("issue").eqNullSafe(F.col("_issue"))
        old = self._table.read(touched.__contains__).drop("_part")
        back = old.join(named, same, "left_semi").withColumns({"n": -F.col("n"), "seconds": -F.col("seconds")})
        change = scratch.save(_summed(back.unionByName(came)).withColumn("_part", self._sums_part()), "change")
        sums_touched = {r["_part"] for r in change.select("_part").distinct().collect()}
        sums = change.drop("_part")
        if self._table.version():
            sums = _summed(self._table.read(sums_touched.__contains__).drop("_part", "issue").unionByName(sums))
        whole = old.join(named, same, "left_anti").unionByName(came).withColumn("_part", self._bucket("issues", "repo", "issue"))
        self._table.replace(
            whole.unionByName(sums.withColumns({"issue": F.lit(None).cast("string"), "_part": self._sums_part()})), touched | sums_touched
        )

    def _sums_part(self) -> Column:
        return self._bucket("sums", "repo", "family", "ended", "day")


def _summed(marks: DataFrame) -> DataFrame:
    sums = marks.groupBy("repo", "family", "ended", "day").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"))
    return sums.filter("n <> 0 OR seconds <> 0")


def _month(date: datetime.date | None) -> str:
    return "none" if date is None else date.isoformat()[:7]
