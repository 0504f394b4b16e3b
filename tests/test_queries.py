"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "version", "dependents", "recent_downloads", "score", "risk"]
    assert df.count() > 0


def test_full_appraisal_covers_every_package(spark):
    df = entry.queries()["full_appraisal"](spark, FOLDER)
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/customer.parquet").count()
    assert {r.risk for r in rows} <= {"LOW", "MEDIUM", "HIGH"}
