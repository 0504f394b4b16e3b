"""Kept tables: only named parts are written, the manifest switches last, and batches add up."""

import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from pkgrisk.operators.freshness import snapshot_store
from pkgrisk.operators.hosting import age_marks, ages_at, issue_ages
from pkgrisk.operators.registry import monthly_by_version
from pkgrisk.sources.kept import DownloadStore, IssueAgeStore, KeptTable

SNAPSHOT = "source string, key string, fetched_at timestamp, payload string, no_data_reason string"


def files(folder):
    return {p: p.stat().st_mtime_ns for p in pathlib.Path(folder).rglob("*.parquet")}


def at(day):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)


def entries(spark, keys, day, payload):
    return spark.createDataFrame([("s", str(k), at(day), payload, None) for k in keys], SNAPSHOT)


def test_untouched_buckets_stay(spark, tmp_path):
    store = snapshot_store(spark, str(tmp_path), SNAPSHOT, buckets=16)
    store.upsert(entries(spark, range(200), 1, "old"))
    before = files(tmp_path)
    store.upsert(entries(spark, [7, 7], 2, "new").union(entries(spark, [8], 0, "older")))
    after = files(tmp_path)
    assert before.items() <= after.items()
    added = [p for p in after.keys() - before.keys() if "manifest" not in str(p)]
    assert 1 <= len({p.parent.name for p in added}) <= 2
    got = {r.key: r.payload for r in store.entries().collect()}
    assert len(got) == store.entries().count() == 200
    assert got["7"] == "new" and set(got.values()) == {"old", "new"} and sum(v == "new" for v in got.values()) == 1


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    store = snapshot_store(spark, str(tmp_path), SNAPSHOT)
    assert store.entries().isEmpty()
    store.upsert(entries(spark, [1], 1, "x"))
    before = files(tmp_path)
    store.upsert(entries(spark, [1], 1, "x").limit(0))
    assert files(tmp_path) == before


def test_a_failed_write_leaves_the_old_state(spark, tmp_path):
    table = KeptTable(spark, str(tmp_path), "n long")
    table.replace(spark.range(10).select(F.col("id").alias("n"), (F.col("id") % 2).cast("string").alias("_part")))
    bad = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("lost"))).otherwise(-F.col("id")).alias("n"), F.lit("1").alias("_part"))
    with pytest.raises(Exception, match="lost"):
        table.replace(bad)
    assert table.version() == 1
    assert sorted(r.n for r in table.read().collect()) == list(range(10))
    # Files of a write whose manifest is missing are not read either.
    (tmp_path / "data" / "_write=gone" / "_part=1").mkdir(parents=True)
    assert table.read().count() == 10


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    one, two = KeptTable(spark, str(tmp_path), "n long"), KeptTable(spark, str(tmp_path), "n long")
    rows = spark.range(3).select(F.col("id").alias("n"), F.lit("p").alias("_part"))
    stale = two._manifest()
    one.replace(rows)
    monkeypatch.setattr(two, "_manifest", lambda: stale)
    with pytest.raises(Exception, match="(?i)exist"):
        two.replace(rows.limit(1))
    assert one.read().count() == 3


def test_readers_keep_their_version(spark, tmp_path):
    table = KeptTable(spark, str(tmp_path), "n long")
    table.replace(spark.range(4).select(F.col("id").alias("n"), F.lit("p").alias("_part")))
    reader = table.read()
    table.replace(spark.range(9).select(F.col("id").alias("n"), F.lit("p").alias("_part")))
    assert (reader.count(), table.read().count(), table.version()) == (4, 9, 2)


def downloads(spark, rows):
    typed = [(v, None if d is None else datetime.date.fromisoformat(d), n) for v, d, n in rows]
    return spark.createDataFrame(typed, "version_id long, date date, downloads long")


def months(df):
    return sorted(((r.version_id, str(r.month), r.downloads) for r in df.collect()), key=str)


def test_days_replace_days_and_months_follow(spark, tmp_path):
    store = DownloadStore(spark, str(tmp_path))
    assert months(store.months()) == []
    first = [(1, "2024-01-30", 5), (1, "2024-01-31", 6), (2, "2024-01-31", 1), (1, "2024-02-01", 2), (1, "2024-02-01", 2), (3, "2023-12-01", 9), (4, None, 7)]
    assert len(store.add(downloads(spark, first))) == 5
    assert months(store.months()) == months(monthly_by_version(downloads(spark, first)))
    before = files(tmp_path)
    # One day again as it was, one completed, one new; a version that is gone from its day is gone from the sum.
    second = [(1, "2024-01-30", 5), (1, "2024-02-01", 4), (2, "2024-02-01", 3), (2, "2024-01-31", 8), (5, "2024-02-02", 1)]
    assert set(store.add(downloads(spark, second))) == {datetime.date(2024, 1, 31), datetime.date(2024, 2, 1), datetime.date(2024, 2, 2)}
    whole = [r for r in first if r[1] not in {d for _, d, _ in second}] + second
    assert months(store.months()) == months(monthly_by_version(downloads(spark, whole)))
    after = files(tmp_path)
    assert before.items() <= after.items()
    assert {p.parent.name for p in after.keys() - before.keys() if "manifest" not in str(p)} == {
        "_part=days-2024-01", "_part=days-2024-02", "_part=sums-2024-01", "_part=sums-2024-02"
    }
    assert not store.add(downloads(spark, second))
    assert files(tmp_path) == after


ISSUE = "repo string, issue long, created_at timestamp, closed_at timestamp, state string, pull_request struct<merged_at: timestamp>"


def test_emptied_parts_have_no_rows(spark, tmp_path):
    table = KeptTable(spark, str(tmp_path), "n long")
    rows = spark.range(4).select(F.col("id").alias("n"), (F.col("id") % 2).cast("string").alias("_part"))
    table.replace(rows)
    table.replace(rows.filter("_part = '1'"), ["0", "1"])
    assert sorted(r.n for r in table.read().collect()) == [1, 3]
    table.replace(rows.limit(0), ["1"])
    assert table.read().isEmpty() and table.version() == 3
    table.replace(rows)
    assert table.read().count() == 4


def test_issue_batches_add_up_to_the_whole(spark, tmp_path):
    def issue(repo, n, opened, closed=None, pr=False, merged=None):
        moment = datetime.timedelta(seconds=n * 977)
        return (repo, n, at(opened) + moment, None if closed is None else at(closed) + moment, "open" if closed is None else "closed",
                (None if merged is None else at(merged) + moment,) if pr else None)

    store, today = IssueAgeStore(spark, str(tmp_path), buckets=4), F.lit(datetime.date(2025, 1, 1))
    assert ages_at(store.sums(), today).isEmpty()
    state = {}
    batches = [
        [issue("hot", n, n % 50, n % 50 + n % 7 if n % 3 else None, n % 4 == 0, n % 50 + 1 if n % 8 == 0 else None) for n in range(120)],
        # Closed, reopened, merged, closed before it was opened, opened after the day that is asked about, no repository, the same again.
        [issue("hot", 0, 0, 300), issue("hot", 1, 1), issue("hot", 4, 4, 310, True, 310), issue("b", 500, 10, 9), issue("b", 501, 900), issue(None, 7, 5, 6),
         issue("hot", 2, 2, 4), issue("hot", 2, 2, 4)],
        [issue(None, 7, 5), issue("b", 500, 10, 12), issue("hot", 1, 1, 366)],
    ]
    for batch in batches:
        store.add(spark.createDataFrame(batch, ISSUE), age_marks)
        state |= {r[:2]: r for r in batch}
        whole = spark.createDataFrame(list(state.values()), ISSUE)
        want = sorted(map(tuple, issue_ages(whole, today.cast("timestamp")).collect()), key=str)
        assert sorted(map(tuple, ages_at(store.sums(), today).collect()), key=str) == want
    before = files(tmp_path)
    store.add(whole.limit(0), age_marks)
    assert files(tmp_path) == before
    store.add(spark.createDataFrame([issue("b", 501, 901)], ISSUE), age_marks)
    assert before.items() <= files(tmp_path).items()
    assert len({p.parent.name for p in files(tmp_path).keys() - before.keys() if "issues-" in str(p)}) == 1


def test_issues_are_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("a", n, at(1), at(2) if n % 2 else None, "closed" if n % 2 else "open", None) for n in range(10)]
    # One that adds nothing: a closed one without the time.
    rows.append(("a", 10, at(1), None, "closed", None))
    issues = spark.createDataFrame(rows, ISSUE).mapInArrow(count, ISSUE)
    store = IssueAgeStore(spark, str(tmp_path), buckets=4)
    store.add(issues, age_marks)
    assert read.value == 11
    assert {(r.family, r.n) for r in store.sums().groupBy("family").agg(F.sum("n").alias("n")).collect()} == {("open_issue_age", 5), ("closed_issue_age", 5)}
    # What it had before is taken back all the same.
    store.add(spark.createDataFrame([("a", 1, at(1), None, "closed", None)], ISSUE), age_marks)
    assert {(r.family, r.n) for r in store.sums().groupBy("family").agg(F.sum("n").alias("n")).collect()} == {("open_issue_age", 5), ("closed_issue_age", 4)}
