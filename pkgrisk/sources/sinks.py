"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Cells are quoted when they hold a quote, comma or line break."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    """One object per line; NULL fields are left out."""
    df.write.mode("overwrite").json(path)
