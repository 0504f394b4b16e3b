"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pkgrisk")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A machine-local folder is only ever used in local mode, where driver and
    executors share one disk; a cluster without the setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_root()


@lru_cache(maxsize=1)
def _local_root() -> str:
    """One temporary folder a process, for local masters alone; a session's own setting can't be changed while it runs."""
    return tempfile.mkdtemp(prefix="pkgrisk-")


def wide(df: DataFrame) -> DataFrame:
    """``df`` for a join by sort and merge, whatever size is estimated.

    Rows that a generator makes are estimated by the file they come from, and
    Parquet by its compressed size, so a side that grows with the packages can
    look small enough to be collected by the driver for a broadcast.
    """
    return df.hint("merge")


class Scratch:
    """Written intermediate tables.

    Saving a frame as Parquet computes it once, cuts its lineage, survives lost
    executors and gives the next join real size statistics to plan with.
    """

    def __init__(self, spark: SparkSession, label: str):
        self._spark = spark
        self.path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        target = f"{self.path}/{name}"
        df.write.mode("error").parquet(target)
        return self._spark.read.schema(df.schema).parquet(target)

    def drop(self, name: str) -> None:
        """Deletes a table of this scratch folder that no frame reads any more."""
        target = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        target.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(target, True)
