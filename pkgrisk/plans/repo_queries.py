"""Advisories, hosting, code, documentation and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.stats import AGE_FIELDS
from pkgrisk.operators import advisories as adv
from pkgrisk.operators import codebase as code
from pkgrisk.operators import coverage as cov
from pkgrisk.operators import docs as doc
from pkgrisk.operators import hosting as host
from pkgrisk.plans.catalog import ISSUES, NOW, NUM, nearest_rank, query
from pkgrisk.plans.shadow import EVENTS_DAYS, EVENTS_NOW_UNIX, Shadow, now
from pkgrisk.session import Scratch
from pkgrisk.sources.kept import IssueAgeStore

# --------------------------------------------------------------------------
# Advisories

_CLASS = """CASE p_type WHEN 'PROMO' THEN 'notice' WHEN 'ECONOMY' THEN 'unmaintained' WHEN 'LARGE' THEN 'unsound'
  WHEN 'SMALL' THEN NULL ELSE CASE p_size % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low'
  WHEN 3 THEN 'medium' WHEN 4 THEN 'medium' END END"""
_COUNTS = ", ".join(f"count(*) FILTER (class = '{c}') AS {name}" for c, name in adv.COUNTERS.items())


@query(f"SELECT p_partkey::VARCHAR AS id, p_brand AS package, {_CLASS} AS class FROM part")
def advisory_class(s: Shadow) -> DataFrame:
    rated = adv.advisory_class(F.col("informational"), F.col("severity"), F.col("cvss"))
    return s.advisories().select("id", "package", rated.alias("class"))


@query(
    f"WITH c AS (SELECT p_brand AS package, {_CLASS} AS class FROM part) "
    f"SELECT package, {_COUNTS} FROM c WHERE class IS NOT NULL GROUP BY 1"
)
def advisory_total(s: Shadow) -> DataFrame:
    return adv.total_counts(s.advisories())


@query(
    f"""WITH a AS (SELECT p_brand AS package, {_CLASS} AS class, p_partkey AS k, p_size AS z FROM part),
v AS (SELECT DISTINCT concat('Brand#', 1 + o_orderkey % 25) AS package, {NUM} AS version,
  [o_orderkey % 4, o_orderkey % 13, o_orderkey % 7, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END,
   CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 ELSE 0 END] AS t FROM orders),
hit AS (SELECT v.package, v.version, a.class FROM v LEFT JOIN a ON a.package = v.package AND a.class IS NOT NULL
  AND NOT (t >= [1 + k % 3, z % 13, 0, 1, 0] OR t < [0, k % 11, 2, 1, 0] OR t = [2, 0, 1, 1, 0]))
SELECT package, version, {_COUNTS} FROM hit GROUP BY ALL"""
)
def advisory_version(s: Shadow) -> DataFrame:
    return adv.version_counts(s.advisories(), s.brand_versions)


# --------------------------------------------------------------------------
# Hosting


@query(
    f"WITH {ISSUES} SELECT repo, count(*) FILTER (is_open AND NOT is_pr) AS open_issues, "
    "count(*) FILTER (is_open AND is_pr) AS open_prs FROM issues GROUP BY 1"
)
def issue_counts(s: Shadow) -> DataFrame:
    return host.issue_counts(s.issues, now()).select("repo", "open_issues", "open_prs")


def _families() -> str:
    parts = []
    for family, ts, cond in (
        ("issues_opened", "created_at", "NOT is_pr"),
        ("issues_closed", "closed_at", "NOT is_pr"),
        ("prs_opened", "created_at", "is_pr"),
        ("prs_merged", "merged_at", "is_pr"),
        ("prs_closed", "closed_at", "is_pr"),
    ):
        for d in (90, 180, 365):
            parts.append(
                f"count(*) FILTER ({cond} AND {ts} >= {NOW} - INTERVAL {d} DAY) AS {family}_last_{d}_days"
            )
        parts.append(f"count(*) FILTER ({cond} AND {ts} IS NOT NULL) AS {family}_total")
    return ", ".join(parts)


@query(f"WITH {ISSUES} SELECT repo, {_families()} FROM issues GROUP BY 1")
def issue_window_counts(s: Shadow) -> DataFrame:
    return host.issue_counts(s.issues, now()).drop("open_issues", "open_prs")


def _ages(*series: tuple[str, str, str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT repo, '{name}' AS series, date_diff('second', created_at, {until}) AS s FROM issues WHERE {cond}"
        for name, until, cond in series
    )
    ranks = ", ".join(f"{nearest_rank('l', p)} AS p{p}" for p in (50, 75, 90, 95))
    return (
        f"WITH {ISSUES}, a AS ({rows}), g AS (SELECT repo, series, list(s) AS l, sum(s) AS t, count(*) AS n FROM a "
        f"WHERE s >= 0 GROUP BY ALL) SELECT repo, series, floor(t / n / 86400.0)::BIGINT AS avg, {ranks} FROM g"
    )


def _nested(base: str, until: str, cond: str) -> list[tuple[str, str, str]]:
    return [(base, until, f"{cond} AND {until} IS NOT NULL")] + [
        (f"{base}_last_{d}_days", until, f"{cond} AND {until} >= {NOW} - INTERVAL {d} DAY") for d in (90, 180, 365)
    ]


def _age_rows(s: Shadow, *bases: str) -> DataFrame:
    names = [n for n in host.age_series_names() if any(n.startswith(b) for b in bases)]
    return host.issue_ages(s.issues, now(), series=names).select("repo", "series", *AGE_FIELDS)


@query(_ages(("open_issue_age", NOW, "is_open AND NOT is_pr"), ("open_pr_age", NOW, "is_open AND is_pr")))
def open_age_stats(s: Shadow) -> DataFrame:
    return _age_rows(s, "open_issue_age", "open_pr_age")


@query(_ages(*_nested("closed_issue_age", "closed_at", "NOT is_open AND NOT is_pr")))
def issue_age_stats(s: Shadow) -> DataFrame:
    return _age_rows(s, "closed_issue_age")


@query(_ages(*_nested("merged_pr_age", "merged_at", "is_pr")))
def merged_age_stats(s: Shadow) -> DataFrame:
    return _age_rows(s, "merged_pr_age")


@query(_ages(
    ("open_issue_age", NOW, "is_open AND NOT is_pr"), ("open_pr_age", NOW, "is_open AND is_pr"),
    *_nested("closed_issue_age", "closed_at", "NOT is_open AND NOT is_pr"), *_nested("merged_pr_age", "merged_at", "is_pr"),
))
def issue_ages_kept(s: Shadow) -> DataFrame:
    """Ages kept over two batches: the second one has new issues, and some that were open or closed before."""
    issues = s.issues.withColumn("issue", F.col("id").cast("string"))
    store = IssueAgeStore(s.spark, Scratch(s.spark, "kept-issues").path, issues.schema["repo"].dataType.simpleString())
    line = F.col("id.l_linenumber")
    was = F.when(line % 3 == 1, F.when(F.col("state") == "open", "closed").otherwise("open")).otherwise(F.col("state"))
    closed = F.when(line % 3 == 1, F.when(F.col("state") == "open", F.col("id.l_shipdate"))).otherwise(F.col("closed_at"))
    store.add(issues.withColumns({"state": was, "closed_at": closed}).filter(line % 5 != 4), host.age_marks)
    store.add(issues.filter((line % 3 == 1) | (line % 5 == 4)), host.age_marks)
    return host.ages_at(store.sums(), now())


@query(
    f"""WITH {ISSUES} SELECT repo, count(*) AS rows, strftime(min(created_at), '%Y-%m-%d') AS oldest
  FROM issues WHERE created_at >= {NOW} - INTERVAL 1000 DAY GROUP BY 1"""
)
def issue_lookback(s: Shadow) -> DataFrame:
    """All issues that are young enough."""
    kept = host.lookback(s.issues, now(), days=1000)
    return kept.groupBy("repo").agg(
        F.count("*").alias("rows"), F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("oldest")
    )


@query(
    """SELECT s_suppkey AS repo, CASE WHEN s_suppkey % 4 <> 0 THEN floor(abs(s_acctbal))::BIGINT ELSE 0 END AS stars,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey ELSE 0 END::BIGINT AS forks,
  greatest(CASE WHEN s_suppkey % 3 = 1 THEN s_nationkey - 3 ELSE floor(s_acctbal)::BIGINT END, 0)::BIGINT AS subscribers
FROM supplier"""
)
def repo_stats(s: Shadow) -> DataFrame:
    return host.repo_counters(s.repos)


# --------------------------------------------------------------------------
# Code


_E = "epoch(date_trunc('second', ts))::BIGINT"


@query(
    f"""SELECT user_id AS repo, count(*) AS commit_count,
  {", ".join(f"count(*) FILTER ({_E} >= {EVENTS_NOW_UNIX} - {d} * 86400) AS commits_last_{d}_days" for d in EVENTS_DAYS)},
  arg_min({_E}, event_id) AS first_commit_at, arg_max({_E}, event_id) AS last_commit_at
FROM events GROUP BY 1"""
)
def commit_stats(s: Shadow) -> DataFrame:
    stats = code.commit_stats(s.commits, EVENTS_NOW_UNIX, EVENTS_DAYS)
    return stats.withColumns({c: F.unix_seconds(c) for c in ("first_commit_at", "last_commit_at")})


@query(
    "SELECT user_id AS repo, count(DISTINCT (event_type, floor(value / 10)::BIGINT)) AS contributors FROM events GROUP BY 1"
)
def contributors(s: Shadow) -> DataFrame:
    return code.contributors(s.commits)


@query(
    """WITH f AS (SELECT page_id // 5 AS repo, page_id % 4 < 2 AS yaml, lower(concat(html,
    CASE page_id % 6 WHEN 0 THEN 'Clippy' WHEN 1 THEN 'MIRI' ELSE '' END)) AS t FROM pages WHERE page_id % 4 < 3)
SELECT repo, true AS ci_workflows, bool_or(yaml AND contains(t, 'miri')) AS miri_usage,
  bool_or(yaml AND contains(t, 'clippy')) AS clippy_usage FROM f GROUP BY 1"""
)
def workflow_flags(s: Shadow) -> DataFrame:
    return code.workflow_flags(s.workflow_files)


_KEPT_FILE = "l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0"
_PIECES = f"""f AS (SELECT l_orderkey, l_orderkey // 10 AS package,
  sum(CASE l_linenumber % 6 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 0 END)
    + CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END AS code,
  sum(CASE l_linenumber % 6 WHEN 2 THEN 4 ELSE 0 END) AS test,
  sum(CASE l_linenumber % 6 WHEN 1 THEN 2 WHEN 3 THEN 1 WHEN 5 THEN 3 ELSE 0 END) AS comments,
  sum(CASE l_linenumber % 6 WHEN 4 THEN 2 ELSE 0 END) AS unsafe,
  l_orderkey % 97 = 0 AS bad
FROM lineitem WHERE {_KEPT_FILE} GROUP BY l_orderkey)"""


@query(
    f"""WITH {_PIECES} SELECT package, count(*) AS source_files, count(*) FILTER (bad) AS source_files_with_errors,
  sum(code)::BIGINT AS production_lines, sum(test)::BIGINT AS test_lines, sum(comments)::BIGINT AS comment_lines
FROM f GROUP BY 1"""
)
def source_lines(s: Shadow) -> DataFrame:
    return code.source_stats(code.source_files(s.source_files)).drop("unsafe_count")


@query(f"WITH {_PIECES} SELECT package, sum(unsafe)::BIGINT AS unsafe_count FROM f GROUP BY 1")
def unsafe_count(s: Shadow) -> DataFrame:
    return code.source_stats(code.source_files(s.source_files)).select("package", "unsafe_count")


@query(
    """WITH f AS (SELECT DISTINCT l_orderkey // 10 AS package, l_orderkey AS k, concat('src/f', l_orderkey, '.rs') AS path
  FROM lineitem WHERE l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0)
SELECT package, count(*) AS files, min(path) AS first_path, max(path) AS last_path FROM f GROUP BY 1"""
)
def source_file_filter(s: Shadow) -> DataFrame:
    """Which files are read."""
    kept = code.source_files(s.source_files)
    return kept.groupBy("package").agg(
        F.count("*").alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )


@query(
    """SELECT l_orderkey AS package, count(*) FILTER (l_returnflag <> 'A') AS example_count FROM lineitem GROUP BY 1"""
)
def example_targets(s: Shadow) -> DataFrame:
    kinds = F.expr(
        "named_struct('kind', CASE l_returnflag WHEN 'R' THEN array('example') WHEN 'A' THEN array('lib') "
        "ELSE array('bin', 'example') END)"
    )
    packages = s.table("lineitem").groupBy(F.col("l_orderkey").alias("package")).agg(
        F.collect_list(kinds).alias("targets")
    )
    return packages.select("package", code.example_targets(F.col("targets")).alias("example_count"))


# --------------------------------------------------------------------------
# Documentation


_ITEMS = """i AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
  WHERE 48 + doc_id % 12 BETWEEN 50 AND 57),
p AS (SELECT *, i % 3 = 0 OR i % 4 = 1 OR regexp_matches(x, '\\S') AS documented FROM i WHERE i % 5 <> 4 AND i % 7 <> 6)"""


_DOCS_METRICS = (
    f"""WITH {_ITEMS} SELECT concat('doc-', doc_id) AS package, count(*) AS public_api_elements,
  count(*) FILTER (NOT documented) AS undocumented_elements, bool_or(i = 0 AND lang = 'en') AS has_crate_level_docs,
  count(*) FILTER (i % 8 = 5) AS broken_doc_links, count(*) FILTER (i % 3 = 0) AS examples_in_docs
FROM p GROUP BY doc_id"""
)


@query(_DOCS_METRICS)
def docs_metrics(s: Shadow) -> DataFrame:
    m = doc.docs_metrics(doc.parsed(s.docs_json))
    return m.select("package", "docs.*").drop("doc_coverage_percentage")


@query(_DOCS_METRICS)
def docs_metrics_lines(s: Shadow) -> DataFrame:
    """The same from documents landed one item a line."""
    facts = doc.docs_facts_of_lines(s.docs_lines).filter("status = 'Found'")
    return facts.select(F.col("name").alias("package"), "docs.*").drop("doc_coverage_percentage")


@query(
    f"""WITH {_ITEMS} SELECT concat('doc-', doc_id) AS name, 'Found' AS status, NULL AS reason,
  round(count(*) FILTER (documented)::DOUBLE / count(*) * 100, 6) AS coverage FROM p GROUP BY doc_id
UNION ALL SELECT concat('doc-', doc_id), 'Unavailable', concat('unsupported format version ', 48 + doc_id % 12), NULL
FROM documents WHERE 48 + doc_id % 12 NOT BETWEEN 50 AND 57"""
)
def docs_coverage(s: Shadow) -> DataFrame:
    facts = doc.docs_facts(s.docs_json)
    return facts.select("name", "status", "reason", F.round("docs.doc_coverage_percentage", 6).alias("coverage"))


@query("SELECT doc_id, (doc_id % 5) // 2 AS examples FROM documents")
def doc_examples(s: Shadow) -> DataFrame:
    text = F.expr("concat(text, repeat('\n   ```\ncode', cast(doc_id % 5 as int)))")
    return s.table("documents").select("doc_id", doc.example_count(text).alias("examples"))


_LINK_TEXTS = (
    ("", ""),
    ("[`Abc`](http://x)", ""),
    ("[`http://abc`]", ""),
    ("[`ab`]", ""),
    ("[`Foo`] [`Bar`]", "Foo"),
    ("[`Foo::bar()`]", "bar"),
    ("[`x::y`][target] [`q::z`][nope]", "target"),
    ("[`alias`] and\n[`alias`]: real::Thing", "real::Thing"),
    ("```\n[`Zed`]\n```\n[`Zed`]", ""),
    ("[`call()`] [`other()`]", "call|`other`"),
)


@query("SELECT doc_id, CASE WHEN doc_id % 10 IN (4, 6, 8) THEN 1 ELSE 0 END AS broken FROM documents")
def broken_links(s: Shadow) -> DataFrame:
    """Whole document texts, each followed by one link form."""
    pick = (F.col("doc_id") % len(_LINK_TEXTS) + 1).cast("int")
    text = F.concat("text", F.lit("\n"), F.element_at(F.array(*[F.lit(t) for t, _ in _LINK_TEXTS]), pick))
    names = F.split(F.element_at(F.array(*[F.lit(n) for _, n in _LINK_TEXTS]), pick), r"\|")
    links = F.map_from_arrays(names, F.transform(names, lambda n: F.lit("1")))
    return s.table("documents").select("doc_id", doc.broken_links(text, links).alias("broken"))


# --------------------------------------------------------------------------
# Coverage


@query(
    """WITH b AS (SELECT user_id AS repo, CASE event_type WHEN 'click' THEN 'main' WHEN 'view' THEN 'master' ELSE 'dev' END AS branch,
    arg_max(event_id, event_id) AS e, arg_max((props->>'$.k')::INT, event_id) AS k FROM events GROUP BY ALL),
r AS (SELECT repo, branch, CASE branch WHEN 'main' THEN 0 ELSE 1 END AS o, e % 7 = 1 AS failed,
    CASE WHEN e % 7 > 1 AND e % 5 <> 0 THEN k + CASE WHEN e % 2 = 0 THEN 0.5 ELSE 0 END END AS pct FROM b),
f AS (SELECT * FROM r WHERE branch <> 'dev' AND (failed OR pct IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY o) = 1)
SELECT repo, CASE WHEN f.o IS NULL THEN 'Unavailable' WHEN failed THEN 'Error' ELSE 'Found' END AS status,
  CASE WHEN f.o IS NULL THEN 'no coverage data' WHEN failed THEN 'unexpected HTTP status 500' END AS reason,
  pct::DOUBLE AS pct FROM (SELECT DISTINCT repo FROM b) LEFT JOIN f USING (repo)"""
)
def coverage_pct(s: Shadow) -> DataFrame:
    return cov.coverage_facts(badges(s)).select(
        "repo", "status", "reason", F.col("coverage.code_coverage_percentage").alias("pct")
    )


def badges(s: Shadow) -> DataFrame:
    """The latest event of a user and type is the badge of a repository branch."""
    branch = F.expr("CASE event_type WHEN 'click' THEN 'main' WHEN 'view' THEN 'master' ELSE 'dev' END")
    latest = s.table("events").groupBy(F.col("user_id").alias("repo"), branch.alias("branch")).agg(
        F.max_by(F.struct("event_id", F.get_json_object("props", "$.k").alias("k")), "event_id").alias("e")
    )
    return latest.select(
        "repo",
        "branch",
        F.expr("CASE e.event_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END").alias("http_status"),
        F.expr(
            "CASE WHEN e.event_id % 5 = 0 THEN '<text>unknown</text>' ELSE "
            "concat('<svg width=\"10\"><text>', e.k, IF(e.event_id % 2 = 0, '.5', ''), '%</text></svg>') END"
        ).alias("body"),
    )
