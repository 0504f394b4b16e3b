import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pkgrisk.functions import cells
from pkgrisk.operators.codebase import commit_stats
from pkgrisk.sources import dump, landed
from pkgrisk.sources.policy import default_policy, parse_duration, parse_policy
from pkgrisk.sources.sinks import write_csv, write_json, write_parquet

CRATES = (
    "created_at,id,name,repository,updated_at,description,surplus\n"
    '2024-01-02 03:04:05.123456+00,1,a,https://github.com/x/y,2024-01-02T03:04:05Z,"two\nlines, ""quoted""",z\n'
    "1960-01-02 03:04:05+00,2,b,a.b/c,2024-01-02 03:04:05+00,,\n"
    "2024-01-02 03:04:05+00,3,c,not a link,2024-01-02 03:04:05+00,,\n"
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "crates.csv").write_text(CRATES)
    (tmp_path / "crate_owners.csv").write_text("crate_id,owner_kind,owner_id\n1,0,5\n1,1,6\n")
    (tmp_path / "version_downloads.csv").write_text("version_id,downloads,date\n1,5,2024-02-03\n1,x,2024-02-03\n")
    return str(tmp_path)


def test_typed_crates(spark, folder):
    rows = dump.read_table(spark, folder, "crates").orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3]
    assert rows[0].description == 'two\nlines, "quoted"'
    assert [r.repository for r in rows] == ["https://github.com/x/y", "https://a.b/c", ""]
    seconds = dump.read_table(spark, folder, "crates").orderBy("id").select(F.unix_seconds("created_at").alias("t")).collect()
    assert [r.t for r in seconds][:2] == [int(dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc).timestamp()), 0]
    assert "surplus" not in rows[0].asDict()


def test_bad_cell_fails_or_is_set_aside(spark, folder):
    with pytest.raises(Exception, match="cannot parse u64 from 'x'"):
        dump.read_table(spark, folder, "version_downloads").collect()
    raw = dump.read_text(spark, f"{folder}/version_downloads.csv", False)
    good, bad = dump.typed_with_quarantine(raw, "version_downloads")
    assert good.count() == 1
    assert [r.bad_columns for r in bad.collect()] == [["downloads"]]


def test_owner_kinds(spark, folder, tmp_path):
    assert dump.read_table(spark, folder, "crate_owners").count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "crate_owners.csv").write_text("crate_id,owner_kind,owner_id\n1,2,5\n")
    with pytest.raises(Exception, match="cannot parse owner kind from '2'"):
        dump.read_table(spark, str(tmp_path / "bad"), "crate_owners").collect()


def test_missing_column(spark, tmp_path):
    (tmp_path / "keywords.csv").write_text("id\n1\n")
    with pytest.raises(ValueError, match="column 'keyword' is missing"):
        dump.read_table(spark, str(tmp_path), "keywords")


def test_convert_and_count(spark, folder, tmp_path):
    target = str(tmp_path / "tables")
    dump.convert_dump(spark, folder, target, "2024-03-01 00:00:00", ["crates", "crate_owners"])
    tables = {n: spark.read.parquet(f"{target}/{n}") for n in ("crates", "crate_owners")}
    assert "snapshot_at" in tables["crates"].columns
    assert {r.table: r.rows for r in dump.row_counts(tables).collect()} == {"crates": 3, "crate_owners": 2}


@pytest.mark.parametrize(
    "convert, text, value, valid",
    [
        (cells.u64, "5", 5, True), (cells.u64, " 5", None, False), (cells.u64, "-5", None, False),
        (cells.optional_u64, "", None, True), (cells.optional_id, "-1", None, True),
        (cells.boolean, "t", True, True), (cells.boolean, "", False, True), (cells.boolean, "x", None, False),
        (cells.edition, "2021", "2021", True), (cells.edition, "2030", "unknown", True), (cells.edition, "", None, True),
        (cells.pg_array, "{a,b}", ["a", "b"], True), (cells.pg_array, "{}", [], True), (cells.pg_array, "a", None, False),
        (cells.version, "1.0.0", "1.0.0", True), (cells.version, "1.0", None, False),
        (cells.features, '{"b":[],"a":["c"]}', {"a": ["c"], "b": []}, True), (cells.features, "{", None, False),
        (cells.date, "1960-01-01", dt.date(1970, 1, 1), True), (cells.date, "soon", None, False),
        (cells.timestamp, "2024-01-02", None, False), (cells.url, "", "", True),
    ],
)
def test_cells(spark, convert, text, value, valid):
    cell = convert(F.col("c"))
    row = spark.createDataFrame([(text,)], "c string").select(cell.value.alias("v"), cell.valid.alias("ok")).head()
    assert row.ok == valid
    if valid:
        assert row.v == value


def test_json_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"repo":"a","host":"h","stars_count":3}\n{"repo":"b","stargazers_count":4}\n')
    stars = {r.repo: r.stargazers_count for r in landed.read_repositories(spark, str(tmp_path / "r.json")).collect()}
    assert stars == {"a": 3, "b": 4}
    (tmp_path / "i.json").write_text(
        '{"repo":"a","state":"open","created_at":"2024-01-01T00:00:00Z","pull_request":{"merged_at":null}}\n'
        '{"repo":"a","state":"open","created_at":"2024-01-01T00:00:00Z"}\n'
    )
    rows = landed.read_issues(spark, str(tmp_path / "i.json")).collect()
    assert sorted(r.pull_request is not None for r in rows) == [False, True]
    (tmp_path / "a.json").write_text('{"id":"X","package":"p","patched":[">=1.0"],"unaffected":[]}\n')
    assert landed.read_advisories(spark, str(tmp_path / "a.json")).head().patched == [">=1.0"]
    (tmp_path / "b.json").write_text('{"repo":"a","branch":"main","http_status":200,"body":"<x>5%</x>"}\n')
    assert landed.read_badges(spark, str(tmp_path / "b.json")).head().http_status == 200


def test_text_and_binary_sources(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "repo1.log").write_text("300\nnoise\n 200 \n100\n")
    rows = landed.read_commit_log(spark, str(logs)).orderBy("seq").collect()
    assert [(r.repo, r.author_at) for r in rows] == [("repo1", 300), ("repo1", 200), ("repo1", 100)]
    tree = tmp_path / "tree" / "src" / "deep"
    tree.mkdir(parents=True)
    (tree / "a.rs").write_text("fn a() {}\n")
    row = landed.read_files(spark, str(tmp_path / "tree"), "*.rs").head()
    assert (row.path, row.length, row.content) == ("src/deep/a.rs", 10, "fn a() {}\n")
    (tmp_path / "doc.json").write_text(json.dumps({"format_version": 50}))
    assert landed.read_docs_json(spark, str(tmp_path / "doc.json")).head().file_name == "doc.json"


def test_commit_logs_are_split_and_stay_in_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"{10_000 - i}\n" for i in range(2_000)))
    (tmp_path / "b.log").write_text("5\n7\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        log = landed.read_commit_log(spark, str(tmp_path))
        assert log.rdd.getNumPartitions() > 5
        rows = log.orderBy("repo", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.repo, r.author_at) for r in rows] == [("a", 10_000 - i) for i in range(2_000)] + [("b", 5), ("b", 7)]
    stats = {r.repo: r for r in commit_stats(log, 20_000).collect()}
    assert stats["a"].commit_count == 2_000 and stats["b"].first_commit_at.timestamp() == 7


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([('a "q", b', None, "")], "x string, y string, z string").coalesce(1)
    write_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*.csv")).read_text()
    assert text == 'x,y,z\n"a ""q"", b",,\n'
    write_json(df, str(tmp_path / "json"))
    assert json.loads(next((tmp_path / "json").glob("part-*.json")).read_text()) == {"x": 'a "q", b', "z": ""}
    write_parquet(df, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1


def test_policy_file():
    policy = parse_policy(
        'low_risk_threshold = 80.0\nhosting_cache_ttl = "1 week 2 days"\n'
        '[[high_risk]]\nname = "a"\nexpression = "true"\n'
        '[[eval]]\nname = "b"\nexpression = "1 > 0"\npoints = 4\n'
        '[[allow_list]]\nname = "x"\nversion = "^1"\n'
    )
    assert policy.low_risk_threshold == 80.0 and policy.hosting_cache_ttl == dt.timedelta(days=9)
    assert policy.eval[0].weight == 4 and policy.high_risk[0].weight == 1 and policy.allow_list[0].version == "^1"
    assert policy.high_risk[0].text == "true"


@pytest.mark.parametrize(
    "text, message",
    [
        ("medium_risk_threshold = -1.0", "medium_risk_threshold must be between 0 and 100"),
        ("low_risk_threshold = 101.0", "low_risk_threshold must be between 0 and 100"),
        ("medium_risk_threshold = 80.0\nlow_risk_threshold = 50.0", r"\(80\) must be less than low_risk_threshold \(50\)"),
        ("medium_risk_threshold = 70.0", "must be less than"),
        ("unknown_field = 1", "unknown field `unknown_field`"),
        ('crates_cache_ttl = "not a duration"', "invalid duration"),
        ("[[high_risk]\n", "line 1"),
    ],
)
def test_bad_policies(text, message):
    with pytest.raises(ValueError, match=message):
        parse_policy(text)


def test_default_policy_weights():
    policy = default_policy()
    assert (len(policy.high_risk), len(policy.eval), sum(r.weight for r in policy.eval)) == (6, 30, 109)
    assert parse_duration("36 hours") == dt.timedelta(hours=36)
