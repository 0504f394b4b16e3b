"""Merged facts, metrics, rules, reports and freshness."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.operators import freshness as fresh
from pkgrisk.operators import reports as rep
from pkgrisk.operators import rules
from pkgrisk.operators.advisories import advisory_facts
from pkgrisk.operators.codebase import codebase_facts, located_codebase
from pkgrisk.operators.coverage import coverage_facts
from pkgrisk.operators.docs import docs_facts
from pkgrisk.operators.facts import for_packages, merge_facts
from pkgrisk.operators.graph import transitive_dependency_counts
from pkgrisk.operators.hosting import hosting_facts
from pkgrisk.operators.metrics import METRICS, metrics_long as to_long, metrics_wide as to_wide
from pkgrisk.operators.registry import registry_facts
from pkgrisk.plans.appraise import identify
from pkgrisk.plans.catalog import CRATE_MONTHS, ISSUES, NOW, query
from pkgrisk.plans.registry_queries import _LATEST, _RECENT
from pkgrisk.plans.repo_queries import badges
from pkgrisk.plans.shadow import EVENTS_NOW, EVENTS_NOW_UNIX, Shadow, now
from pkgrisk.session import Scratch
from pkgrisk.sources.policy import Policy, Rule, default_policy

# --------------------------------------------------------------------------
# Facts and metrics of every package, latest version


def _everyone(s: Shadow) -> DataFrame:
    """All packages, latest version; the customer number is also the repository."""
    asked = s.crates.select("name", F.lit(None).cast("string").alias("version"))
    return identify(asked, s.registry, repo=F.col("crate_id")).packages


def _advisory_rows(s: Shadow) -> DataFrame:
    return s.advisories("concat('Customer#', lpad(cast(p_partkey as string), 9, '0'))")


def _docs(s: Shadow, ids: DataFrame) -> DataFrame:
    facts = docs_facts(s.docs_json).withColumn("repo", F.expr("cast(substring(name, 5) as bigint)"))
    return ids.join(facts.drop("name", "version"), "repo").select("name", "version", "status", "reason", "docs")


def _repo_sources(s: Shadow, ids: DataFrame) -> dict[str, DataFrame]:
    return {
        "hosting": for_packages(ids, hosting_facts(s.repos, s.issues, now()), "hosting"),
        "coverage": for_packages(ids, coverage_facts(badges(s)), "coverage"),
        "advisories": advisory_facts(_advisory_rows(s), ids),
        "docs": _docs(s, ids),
    }


def _codebase(s: Shadow, ids: DataFrame) -> DataFrame:
    part = s.table("part").select(F.col("p_partkey").alias("package"))
    known = s.commits.select("repo").distinct().select(
        "repo",
        F.expr("concat('Customer#', lpad(cast(repo as string), 9, '0'))").alias("name"),
        F.col("repo").alias("package"),
        F.expr("array(named_struct('kind', array('lib')), named_struct('kind', array('example')))").alias("targets"),
    )
    facts = codebase_facts(
        known, s.commits, s.workflow_files, s.source_files, transitive_dependency_counts(s.links, part), EVENTS_NOW_UNIX
    )
    return located_codebase(ids, facts)


def _facts(s: Shadow, codebase: bool = False) -> DataFrame:
    packages = _everyone(s)
    ids = packages.select("name", "version", "repo")
    sources = _repo_sources(s, ids)
    if codebase:
        sources["codebase"] = _codebase(s, ids)
    return merge_facts(registry_facts(s.registry, packages, now()), sources)


_KNOWN = f"""{_LATEST}, pk AS (SELECT c_custkey AS id, c_name AS name, num AS version, o_orderkey FROM customer JOIN latest ON o_custkey = c_custkey)"""


@query(
    f"""WITH {_KNOWN}
SELECT name, version,
  CASE WHEN s_suppkey IS NULL OR s_suppkey % 3 = 2 THEN 'Unavailable' ELSE 'Found' END AS hosting_status,
  CASE WHEN s_suppkey IS NULL THEN 'not queried' WHEN s_suppkey % 3 = 2 THEN 'unsupported hosting provider: git.example.org' END AS hosting_reason,
  'Found' AS advisories_status,
  CASE WHEN doc_id IS NULL OR 48 + doc_id % 12 NOT BETWEEN 50 AND 57 THEN 'Unavailable' ELSE 'Found' END AS docs_status,
  CASE WHEN user_id IS NULL THEN 'not queried' END AS codebase_reason
FROM pk LEFT JOIN supplier ON s_suppkey = id LEFT JOIN documents ON doc_id = id LEFT JOIN (SELECT DISTINCT user_id FROM events) ON user_id = id"""
)
def facts_merge(s: Shadow) -> DataFrame:
    return _facts(s, codebase=True).select(
        "name", "version", "hosting_status", "hosting_reason", "advisories_status", "docs_status", "codebase_reason"
    )


@query(
    f"""WITH {_KNOWN}, c AS (SELECT DISTINCT user_id AS repo FROM events)
SELECT name, version, CASE WHEN repo % 3 = 0 THEN 'Unavailable' ELSE 'Found' END AS status,
  CASE WHEN repo % 3 = 0 THEN format('crate {{}} not found in repository {{}}', concat(chr(39), name, chr(39)), concat(chr(39), repo, chr(39))) END AS reason
FROM pk JOIN c ON repo = id"""
)
def package_in_repository(s: Shadow) -> DataFrame:
    """Packages whose repository was analysed; every third one holds another package only."""
    held = s.commits.select("repo").distinct().select(
        "repo",
        F.expr("CASE WHEN repo % 3 = 0 THEN 'another' ELSE concat('Customer#', lpad(cast(repo as string), 9, '0')) END").alias("name"),
        F.struct(F.col("repo").alias("seen")).alias("codebase"),
    )
    return located_codebase(_everyone(s).select("name", "version", "repo"), held).drop("codebase")


_WIDE = f"""{_KNOWN}, {CRATE_MONTHS}, {_RECENT}, {ISSUES},
iss AS (SELECT repo, count(*) FILTER (is_open AND NOT is_pr) AS open_issues, count(*) FILTER (is_pr AND merged_at >= {NOW} - INTERVAL 180 DAY) AS merged FROM issues GROUP BY 1),
tot AS (SELECT o_custkey, sum(floor(o_totalprice)::BIGINT)::BIGINT AS downloads FROM orders GROUP BY 1),
w AS (SELECT name, version, tot.downloads AS total_downloads, coalesce(recent, 0)::BIGINT AS recent_downloads,
  CASE WHEN o.o_orderkey % 6 = 0 THEN 'GPL-3.0' ELSE 'MIT OR Apache-2.0' END AS license,
  CASE o.o_orderkey % 3 WHEN 0 THEN '2018' WHEN 1 THEN '2021' END AS edition,
  concat('default, f', o.o_orderkey % 9) AS features,
  strftime(o.o_orderdate, '%Y-%m-%d') AS version_created_on,
  CASE WHEN s_suppkey % 3 < 2 THEN CASE WHEN s_suppkey % 4 <> 0 THEN floor(abs(s_acctbal))::BIGINT ELSE 0 END END AS stars,
  CASE WHEN s_suppkey % 3 < 2 THEN coalesce(open_issues, 0) END AS open_issues,
  CASE WHEN s_suppkey % 3 < 2 THEN coalesce(merged, 0) END AS merged_prs,
  CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END::BIGINT AS notices
FROM pk JOIN orders o ON o.o_orderkey = pk.o_orderkey JOIN tot ON tot.o_custkey = id LEFT JOIN recent ON recent.crate_id = id
LEFT JOIN supplier ON s_suppkey = id LEFT JOIN iss ON iss.repo = id LEFT JOIN part ON p_partkey = id)"""


@query(f"WITH {_WIDE} SELECT * FROM w")
def metrics_wide(s: Shadow) -> DataFrame:
    return to_wide(_facts(s)).select(
        "name",
        "version",
        F.col("usage.total_downloads"),
        F.col("usage.total_downloads_last_90_days").alias("recent_downloads"),
        "crate.license",
        F.col("crate.rust_edition").alias("edition"),
        F.array_join("crate.features", ", ").alias("features"),
        F.date_format("stability.version_created_at", "yyyy-MM-dd").alias("version_created_on"),
        F.col("community.repo_stars").alias("stars"),
        "activity.open_issues",
        F.col("activity.prs_merged_last_180_days").alias("merged_prs"),
        F.col("advisories.total_notice_warnings").alias("notices"),
    )


_LONG = {
    "usage.total_downloads": ("Usage", "total_downloads::VARCHAR"),
    "crate.license": ("Metadata", "license"),
    "crate.rust_edition": ("Metadata", "edition"),
    "crate.features": ("Metadata", "features"),
    "stability.version_created_at": ("Stability", "version_created_on"),
    "community.repo_stars": ("Community", "stars::VARCHAR"),
    "activity.open_issues": ("Activity", "open_issues::VARCHAR"),
    "advisories.total_notice_warnings": ("Advisories", "notices::VARCHAR"),
}


@query(
    f"WITH {_WIDE} "
    + " UNION ALL ".join(
        f"SELECT name, version, '{c}' AS category, '{m}' AS metric, {v} AS value FROM w" for m, (c, v) in _LONG.items()
    )
)
def metrics_long(s: Shadow) -> DataFrame:
    some = tuple(m for m in METRICS if m.name in _LONG)
    return to_long(to_wide(_facts(s)), some).select("name", "version", "category", "metric", "value")


# --------------------------------------------------------------------------
# Rules over customer level metrics


def _metrics(s: Shadow) -> DataFrame:
    bought = s.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.expr("cast(floor(o_totalprice) as bigint)")).alias("total_downloads")
    )
    return s.table("customer").join(bought, "c_custkey", "left").selectExpr(
        "c_name AS name",
        "concat(c_custkey % 3, '.1.', c_custkey % 5) AS version",
        "named_struct('name', c_name, 'version', concat(c_custkey % 3, '.1.', c_custkey % 5), "
        "'license', CASE c_custkey % 5 WHEN 0 THEN 'GPL-3.0' WHEN 1 THEN NULL ELSE 'MIT OR Zlib' END, "
        "'owners', slice(array('a', 'b', 'c'), 1, c_nationkey % 4), "
        "'keywords', slice(array('async', 'io', c_mktsegment), 1, cast(c_custkey % 4 as int))) AS crate",
        "named_struct('total_downloads', total_downloads) AS usage",
        "named_struct('yanked', c_custkey % 7 = 0, 'crate_created_at', "
        "TIMESTAMP_NTZ'1998-01-01' + make_dt_interval(cast(c_custkey % 1400 as int))) AS stability",
        "named_struct('public_api_coverage_percentage', "
        "CASE WHEN c_custkey % 4 <> 0 THEN cast(c_custkey % 100 + 0.5 as double) END) AS docs",
    )


_M = """m AS (SELECT c_name AS name, concat(c_custkey % 3, '.1.', c_custkey % 5) AS version, c_custkey AS k, c_nationkey % 4 AS owners,
  t AS downloads, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 100 + 0.5 END AS coverage,
  DATE '1998-01-01' + (c_custkey % 1400)::INT AS created,
  CASE c_custkey % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS g0, c_custkey % 7 <> 0 AS g1
FROM customer LEFT JOIN (SELECT o_custkey, sum(floor(o_totalprice)::BIGINT) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey),
r AS (SELECT *, downloads >= 2500000 AS r0, coverage >= 50 AS r1, owners >= 2 AS r2, created < DATE '2000-08-01' AS r3, k % 3 <> 0 AS r4,
  coalesce(g0, false) AND g1 AS open FROM m),
a AS (SELECT *, CASE WHEN open THEN 3 * (r0 IS NOT NULL)::INT + 2 * (r1 IS NOT NULL)::INT + 1 + 4 + 1 ELSE 0 END AS available,
  CASE WHEN open THEN 3 * coalesce(r0, false)::INT + 2 * coalesce(r1, false)::INT + r2::INT + 4 * r3::INT + r4::INT ELSE 0 END AS awarded FROM r),
s AS (SELECT *, CASE WHEN NOT open THEN 0.0 ELSE awarded::DOUBLE / available * 100.0 END AS score FROM a),
x AS (SELECT *, CASE WHEN NOT open THEN 'HIGH' WHEN score >= 70 THEN 'LOW' WHEN score >= 30 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM s)"""

_GATE = (
    Rule("License", "contains(crate.license, 'MIT')", description="An accepted license."),
    Rule("Not Yanked", "NOT stability.yanked"),
)
_EVAL = (
    Rule("Adoption", "usage.total_downloads >= 2500000", points=3),
    Rule("Docs", "docs.public_api_coverage_percentage >= 50", points=2),
    Rule("Owners", "size(crate.owners) >= 2"),
    Rule("Age", "stability.crate_created_at < now - INTERVAL '8760' HOUR", points=4),
    Rule("Stable", "NOT startswith(crate.version, '0.')"),
)
_POLICY = Policy(high_risk=_GATE, eval=_EVAL)
_DISP = "CASE WHEN {0} IS NULL THEN 'FAILED' WHEN {0} THEN 'TRUE' ELSE 'FALSE' END"


def _appraised(s: Shadow, policy: Policy = _POLICY) -> DataFrame:
    return rules.appraise(_metrics(s), policy, now())


def _outcomes_sql() -> str:
    named = [(r, f"g{i}", "true") for i, r in enumerate(_GATE)] + [(r, f"r{i}", "open") for i, r in enumerate(_EVAL)]
    rows = []
    for i, (rule, column, cond) in enumerate(named):
        text = rule.text.replace("'", "''")
        rows.append(
            f"SELECT name, {i} AS ord, '{rule.name}' AS rule, CASE WHEN {column} IS NULL THEN 'INCONCLUSIVE' "
            f"WHEN {column} THEN 'PASSED' ELSE 'FAILED' END AS verdict, "
            f"CASE WHEN {column} IS NULL THEN 'no value' ELSE '{text}' END AS detail FROM x WHERE {cond}"
        )
    for i, name in ((7, "Unknown metric"), (8, "Not boolean")):
        rows.append(f"SELECT name, {i}, '{name}', 'INCONCLUSIVE', '' FROM x WHERE open")
    return f"WITH {_M} " + " UNION ALL ".join(rows)


@query(_outcomes_sql())
def rule_outcomes(s: Shadow) -> DataFrame:
    """Each rule fails alone: two broken ones do not disturb the rest."""
    broken = (Rule("Unknown metric", "no.such_metric > 1"), Rule("Not boolean", "usage.total_downloads"))
    rows = rules.outcome_rows(_appraised(s, Policy(high_risk=_GATE, eval=_EVAL + broken)))
    detail = F.when(F.col("ord") < 7, F.col("detail")).otherwise("")
    return rows.select("name", "ord", "rule", "verdict", detail.alias("detail"))


_FUNCTIONS = (
    ("contains", "contains(crate.license, 'Zlib')", "CASE k % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END"),
    ("starts with", "startswith(crate.version, '1.')", "k % 3 = 1"),
    ("size", "size(crate.owners) = 3", "owners = 3"),
    ("duration", "now - stability.crate_created_at > INTERVAL '1000' DAY", "DATE '2001-08-01' - created > 1000"),
    ("is missing", "docs.public_api_coverage_percentage <=> null", "coverage IS NULL"),
    ("is present", "NOT (crate.license <=> null)", "k % 5 <> 1"),
    ("either", "crate.license = 'none' OR crate.version > '0'", "true"),
    ("both", "docs.public_api_coverage_percentage > 1 AND NOT stability.yanked",
     "CASE WHEN NOT g1 THEN false WHEN coverage IS NULL THEN NULL ELSE coverage > 1 END"),
    ("choice", "CASE WHEN stability.yanked THEN size(crate.owners) > 1 ELSE true END", "g1 OR owners > 1"),
)


@query(
    f"WITH {_M} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, {_DISP.format('(' + sql + ')')} AS disposition, count(*) AS packages FROM x GROUP BY 2"
        for n, _, sql in _FUNCTIONS
    )
)
def rule_functions(s: Shadow) -> DataFrame:
    policy = Policy(eval=tuple(Rule(n, e) for n, e, _ in _FUNCTIONS))
    return rules.outcome_rows(_appraised(s, policy)).groupBy("rule", "disposition").agg(F.count("*").alias("packages"))


@query(
    f"""WITH {_M} SELECT name, 'gate only' AS policy, CASE WHEN open THEN 'LOW' ELSE 'HIGH' END AS risk,
  CASE WHEN open THEN 100.0 ELSE 0.0 END AS score, 2 AS rules FROM x
UNION ALL SELECT name, 'both', risk, score, CASE WHEN open THEN 7 ELSE 2 END FROM x"""
)
def risk_gate(s: Shadow) -> DataFrame:
    """A gate rule that is false or fails decides; without rated rules the rest is fine."""

    def shown(policy: Policy, label: str) -> DataFrame:
        return _appraised(s, policy).select(
            "name",
            F.lit(label).alias("policy"),
            "appraisal.risk",
            "appraisal.score",
            F.size("appraisal.outcomes").alias("rules"),
        )

    return shown(Policy(high_risk=_GATE), "gate only").unionByName(shown(_POLICY, "both"))


@query(f"WITH {_M} SELECT name, available, awarded, score FROM x")
def weighted_score(s: Shadow) -> DataFrame:
    return _appraised(s).select("name", "appraisal.available", "appraisal.awarded", "appraisal.score")


@query(f"WITH {_M} SELECT name, risk FROM x")
def risk_class(s: Shadow) -> DataFrame:
    return _appraised(s).select("name", "appraisal.risk")


def _mark(column: str, name: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN '➖ {name} (failure to evaluate: no value)' "
        f"WHEN {column} THEN '✔️ {name}' ELSE '❌ {name}' END"
    )


_MARKS = ", ".join(_mark(f"g{i}", r.name) for i, r in enumerate(_GATE))
_MARKS_EVAL = ", ".join(_mark(f"r{i}", r.name) for i, r in enumerate(_EVAL))


@query(
    f"""WITH {_M} SELECT name, version,
  concat(risk, ' RISK (score = ', round_even(score, 0)::INT, ', awarded points = ', awarded, ', available points = ', available, ')') AS status,
  CASE WHEN open THEN concat_ws('; ', {_MARKS}, {_MARKS_EVAL}) ELSE concat_ws('; ', {_MARKS}) END AS reasons FROM x"""
)
def appraisal_text(s: Shadow) -> DataFrame:
    return rep.appraisal_texts(_appraised(s))


@query(
    f"""WITH {_M} SELECT name, version FROM x WHERE risk IN ('MEDIUM', 'HIGH') AND NOT coalesce(CASE k % 4
  WHEN 0 THEN true WHEN 1 THEN k % 3 = 1 WHEN 2 THEN k % 3 = 2 AND k % 5 = 3 ELSE k % 3 >= 1 END, false)"""
)
def gate_allow_list(s: Shadow) -> DataFrame:
    """Risky packages no allow-list entry covers; one entry per customer."""
    allowed = s.table("customer").select(
        F.col("c_name").alias("name"),
        F.expr("element_at(array('*', '^1', '=2.1.3', '>=1.0, <3'), cast(c_custkey % 4 + 1 as int))").alias("version_req"),
    )
    return rules.rejected(_appraised(s), allowed, error_if_medium=True).select("name", "version")


# --------------------------------------------------------------------------
# Reports


def _nation_metrics(s: Shadow) -> DataFrame:
    """A package per nation."""
    facts = s.table("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("debtors"), F.min("c_name").alias("first_name")
    )
    return facts.join(s.table("nation"), "n_nationkey").selectExpr(
        "n_name AS name",
        "concat('1.', n_nationkey, '.0') AS version",
        "named_struct('name', n_name, 'version', concat('1.', n_nationkey, '.0'), 'license', "
        "CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('say \"', first_name, '\", ok') END, "
        "'keywords', array(lower(n_name), cast(n as string))) AS crate",
        "named_struct('total_downloads', n) AS usage",
        "named_struct('yanked', debtors > 5) AS stability",
        "named_struct('code_coverage_percentage', n / 4) AS trust",
    )


_NATION = """n AS (SELECT n_name AS name, n_nationkey AS k, concat('1.', n_nationkey, '.0') AS version, count(*) AS n,
  count(*) FILTER (c_acctbal < 0) > 5 AS yanked, min(c_name) AS first_name
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"""
_NATION_METRICS = tuple(
    m for m in METRICS
    if m.name in ("crate.name", "crate.license", "crate.keywords", "stability.yanked", "usage.total_downloads",
                  "trust.code_coverage_percentage")
)
_NATION_POLICY = Policy(eval=(Rule("Kept", "NOT stability.yanked"), Rule("Licensed", "contains(crate.license, 'say')", points=2)))
_NATION_RISK = (
    "CASE WHEN k % 3 = 0 THEN CASE WHEN yanked THEN 'HIGH RISK (score = 0, awarded points = 0, available points = 1)' "
    "ELSE 'LOW RISK (score = 100, awarded points = 1, available points = 1)' END "
    "WHEN yanked THEN 'MEDIUM RISK (score = 67, awarded points = 2, available points = 3)' "
    "ELSE 'LOW RISK (score = 100, awarded points = 3, available points = 3)' END"
)
_NATION_REASONS = (
    "concat(CASE WHEN yanked THEN '❌ Kept' ELSE '✔️ Kept' END, '; ', CASE WHEN k % 3 = 0 "
    "THEN '➖ Licensed (failure to evaluate: no value)' ELSE '✔️ Licensed' END)"
)
_MATRIX_ROWS = {
    "Appraisals": _NATION_RISK,
    "Reasons": _NATION_REASONS,
    "crate.name": "name",
    "crate.license": "CASE WHEN k % 3 <> 0 THEN concat('say \"', first_name, '\", ok') END",
    "crate.keywords": "concat(lower(name), ', ', n)",
    "stability.yanked": "yanked::VARCHAR",
    "usage.total_downloads": "n::VARCHAR",
    "trust.code_coverage_percentage": "printf('%.2f', n / 4)",
}


def _matrix_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT k, '{m}' AS metric, {v} AS value FROM n" for m, v in _MATRIX_ROWS.items())
    cells = ", ".join(
        f"coalesce(max(CASE WHEN k = {i} THEN value END), '') AS \"NATION_{i} v1.{i}.0\"" for i in range(25)
    )
    return f'WITH {_NATION}, c AS ({rows}) SELECT metric AS "Metric", {cells} FROM c GROUP BY metric'


@query(_matrix_sql())
def report_matrix(s: Shadow) -> DataFrame:
    appraised = rules.appraise(_nation_metrics(s), _NATION_POLICY, now())
    names = [f"NATION_{i} v1.{i}.0" for i in range(25)]
    return rep.matrix_report(to_long(appraised, _NATION_METRICS), rep.appraisal_texts(appraised), names)


_BLOCK_METRICS = tuple(m for m in METRICS if m.name in ("crate.name", "crate.license", "stability.yanked", "usage.total_downloads"))


@query(
    f"""WITH {_M}, n AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS i FROM x),
c AS (SELECT i, 'Metric' AS metric, concat(name, ' v', version) AS value FROM n
  UNION ALL SELECT i, 'Appraisals', concat(risk, ' RISK (score = ', printf('%.0f', score), ', awarded points = ', awarded, ', available points = ', available, ')') FROM n
  UNION ALL SELECT i, 'crate.name', name FROM n
  UNION ALL SELECT i, 'crate.license', CASE k % 5 WHEN 0 THEN 'GPL-3.0' WHEN 1 THEN NULL ELSE 'MIT OR Zlib' END FROM n
  UNION ALL SELECT i, 'stability.yanked', (NOT g1)::VARCHAR FROM n
  UNION ALL SELECT i, 'usage.total_downloads', downloads::VARCHAR FROM n)
SELECT i // 100 AS block, metric AS "Metric", string_agg(coalesce(value, ''), '|' ORDER BY i) AS cells FROM c GROUP BY 1, 2"""
)
def report_matrix_blocks(s: Shadow) -> DataFrame:
    """The matrix of every package, a hundred side by side."""
    appraised = _appraised(s)
    blocks = rep.matrix_blocks(to_long(appraised, _BLOCK_METRICS), rep.appraisal_texts(appraised), 100)
    return blocks.filter("Metric <> 'Reasons'").select("block", "Metric", F.array_join("cells", "|").alias("cells"))


@query(
    f"""WITH {_NATION} SELECT name, version, concat('{{"appraisal":{{"reasons":["Kept","Licensed',
  CASE WHEN k % 3 = 0 THEN ' (failure to evaluate: no value)' ELSE '' END, '"],"result":"', {_NATION_RISK}, '"}},"metrics":{{"crate.keywords":["',
  lower(name), '","', n, '"]', CASE WHEN k % 3 <> 0 THEN concat(',"crate.license":"say \\"', first_name, '\\", ok"') ELSE '' END,
  ',"crate.name":"', name, '","stability.yanked":', yanked, ',"trust.code_coverage_percentage":', n / 4,
  ',"usage.total_downloads":', n, '}},"name":"', name, '","version":"', version, '"}}') AS json FROM n"""
)
def report_json(s: Shadow) -> DataFrame:
    return rep.json_report(rules.appraise(_nation_metrics(s), _NATION_POLICY, now()), _NATION_METRICS)


@query(f"WITH {_M} SELECT risk, count(*) AS packages FROM x GROUP BY 1")
def risk_summary(s: Shadow) -> DataFrame:
    return rep.risk_summary(_appraised(s))


@query(f"WITH {_M} SELECT risk, score, name, version FROM x")
def risk_listing(s: Shadow) -> DataFrame:
    return rep.risk_listing(_appraised(s))


@query(
    """SELECT c_name AS name, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '#async' WHEN 2 THEN '#async, #io'
  ELSE concat('#async, #io, #', c_mktsegment) END AS tags FROM customer"""
)
def tag_format(s: Shadow) -> DataFrame:
    some = tuple(m for m in METRICS if m.name == "crate.keywords")
    return rep.tag_texts(to_long(_metrics(s), some)).select("name", "tags")


# --------------------------------------------------------------------------
# Freshness

_TTL = timedelta(days=7)


def _snapshots(s: Shadow) -> DataFrame:
    """An entry per document, and a later one for each labelled document."""
    at = "TIMESTAMP_NTZ'2024-01-15' + make_dt_interval(cast(doc_id % {0} as int))"
    first = s.table("documents").selectExpr(
        "'docs' AS source", "doc_id AS key", f"{at.format(20)} AS fetched_at", "lang AS payload",
        "CASE WHEN doc_id % 6 = 0 THEN 'gone' END AS no_data_reason",
    )
    later = s.table("labels").selectExpr(
        "'docs' AS source", "doc_id AS key", f"{at.format(12)} + INTERVAL '8' DAY AS fetched_at", "'label' AS payload",
        "cast(null as string) AS no_data_reason",
    )
    return first.unionByName(later)


_SNAP = """sn AS (SELECT doc_id AS key, TIMESTAMP '2024-01-15' + to_days((doc_id % 20)::INT) AS fetched_at, lang AS payload,
    CASE WHEN doc_id % 6 = 0 THEN 'gone' END AS no_data_reason FROM documents
  UNION ALL SELECT doc_id, TIMESTAMP '2024-01-15' + to_days((doc_id % 12)::INT) + INTERVAL 8 DAY, 'label', NULL FROM labels),
last AS (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY key ORDER BY fetched_at DESC, payload DESC) = 1),
st AS (SELECT *, CASE WHEN fetched_at <= TIMESTAMP '2024-01-24' THEN 'Miss' WHEN no_data_reason IS NOT NULL THEN 'NoData' ELSE 'Data' END AS state FROM last)"""


@query(f"WITH {_SNAP} SELECT key, strftime(fetched_at, '%Y-%m-%d') AS fetched_on, payload, no_data_reason FROM last")
def latest_snapshot(s: Shadow) -> DataFrame:
    return fresh.latest_snapshots(_snapshots(s)).select(
        "key", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "payload", "no_data_reason"
    )


@query(f"WITH {_SNAP} SELECT key, state, fetched_at < TIMESTAMP '2024-01-24' AS stale FROM st")
def freshness_state(s: Shadow) -> DataFrame:
    at, moment = F.col("fetched_at"), F.expr(EVENTS_NOW)
    return fresh.latest_snapshots(_snapshots(s)).select(
        "key",
        fresh.entry_state(at, F.col("no_data_reason"), moment, _TTL).alias("state"),
        fresh.snapshot_is_stale(at, moment, _TTL).alias("stale"),
    )


@query(
    f"""WITH {_SNAP} SELECT DISTINCT conv_id AS key FROM conversations
WHERE conv_id NOT IN (SELECT key FROM st WHERE state <> 'Miss')"""
)
def refresh_plan(s: Shadow) -> DataFrame:
    wanted = s.table("conversations").selectExpr("'docs' AS source", "conv_id AS key")
    return fresh.refresh_plan(wanted, _snapshots(s), F.expr(EVENTS_NOW), _TTL).select("key")


@query(
    f"""WITH {_SNAP}, p AS (SELECT DISTINCT conv_id // 4 AS repo, conv_id AS key FROM conversations),
bad AS (SELECT DISTINCT repo FROM p WHERE key NOT IN (SELECT key FROM st WHERE state <> 'Miss'))
SELECT repo, key FROM p WHERE repo IN (SELECT repo FROM bad)"""
)
def refresh_plan_repo(s: Shadow) -> DataFrame:
    packages = s.table("conversations").selectExpr("conv_id div 4 AS repo", "conv_id AS key")
    return fresh.refresh_plan_by_repo(packages, _snapshots(s), F.expr(EVENTS_NOW), _TTL)


_LIMITS = {"hosting": timedelta(days=9), "coverage": timedelta(days=3)}


@query(
    """WITH sn AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'hosting' WHEN 1 THEN 'coverage' ELSE 'other' END AS source, doc_id AS key,
    TIMESTAMP '2024-01-15' + to_days((doc_id % 20)::INT) AS fetched_at FROM documents
  UNION ALL SELECT CASE doc_id % 3 WHEN 0 THEN 'hosting' WHEN 1 THEN 'coverage' ELSE 'other' END, doc_id,
    TIMESTAMP '2024-01-15' + to_days((doc_id % 12)::INT) + INTERVAL 8 DAY FROM labels),
last AS (SELECT source, key, max(fetched_at) AS fetched FROM sn GROUP BY ALL)
SELECT source, key FROM last WHERE NOT coalesce(CASE source WHEN 'hosting' THEN fetched > TIMESTAMP '2024-01-31' - INTERVAL 9 DAY
  WHEN 'coverage' THEN fetched > TIMESTAMP '2024-01-31' - INTERVAL 3 DAY END, false)"""
)
def freshness_job(s: Shadow) -> DataFrame:
    """New entries are merged into the kept ones, bucket by bucket, and what is kept is checked against the limit of each source."""
    entries = _snapshots(s).withColumn("source", F.expr("CASE key % 3 WHEN 0 THEN 'hosting' WHEN 1 THEN 'coverage' ELSE 'other' END"))
    old, new = entries.filter("payload <> 'label'"), entries.filter("payload = 'label'")
    store = fresh.snapshot_store(s.spark, Scratch(s.spark, "snapshots").path, "source string, key long, fetched_at timestamp_ntz, payload string, no_data_reason string", buckets=8)
    store.upsert(old)
    store.upsert(new)
    return fresh.refresh_plan_by_source(entries, store.entries(), F.expr("TIMESTAMP_NTZ'2024-01-31'"), _LIMITS)


# --------------------------------------------------------------------------
# Whole appraisals

_FLAGSHIP = Policy(
    high_risk=(Rule("Not Yanked", "NOT stability.yanked"),),
    eval=(
        Rule("Adoption", "usage.total_downloads_last_90_days >= 60", points=5),
        Rule("Dependents", "usage.dependent_crates >= 20", points=3),
        Rule("Recent release", "stability.versions_last_365_days >= 1", points=2),
        Rule("License", "contains(crate.license, 'MIT')"),
    ),
)


@query(
    f"""WITH {_LATEST}, {CRATE_MONTHS}, {_RECENT},
dep AS (SELECT l_partkey AS id, count(DISTINCT o_custkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
y AS (SELECT o_custkey AS id, count(*) FILTER (o_orderdate >= {NOW} - INTERVAL 365 DAY) AS n FROM orders GROUP BY 1),
f AS (SELECT c_name AS name, num AS version, coalesce(dep.n, 0)::BIGINT AS dependents, coalesce(recent, 0)::BIGINT AS recent_downloads,
  o.o_orderstatus <> 'F' AS open, y.n AS releases, o.o_orderkey % 6 <> 0 AS mit
FROM customer JOIN latest ON latest.o_custkey = c_custkey JOIN orders o ON o.o_orderkey = latest.o_orderkey
LEFT JOIN dep ON dep.id = c_custkey LEFT JOIN recent ON recent.crate_id = c_custkey JOIN y ON y.id = c_custkey),
s AS (SELECT *, CASE WHEN open THEN (5 * (recent_downloads >= 60)::INT + 3 * (dependents >= 20)::INT + 2 * (releases >= 1)::INT + mit::INT)::DOUBLE / 11 * 100.0
  ELSE 0.0 END AS score FROM f)
SELECT name, version, dependents, recent_downloads, score,
  CASE WHEN NOT open THEN 'HIGH' WHEN score >= 70 THEN 'LOW' WHEN score >= 30 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM s"""
)
def package_risk(s: Shadow) -> DataFrame:
    """Which packages have the most dependents and downloads, and what is their risk?"""
    judged = rules.appraise(to_wide(registry_facts(s.registry, _everyone(s), now())), _FLAGSHIP, now())
    return judged.select(
        "name",
        "version",
        F.col("usage.dependent_crates").alias("dependents"),
        F.col("usage.total_downloads_last_90_days").alias("recent_downloads"),
        "appraisal.score",
        "appraisal.risk",
    ).orderBy(F.desc("dependents"), F.desc("recent_downloads"), "name")


@query()
def full_appraisal(s: Shadow) -> DataFrame:
    """All sources, all 140 metrics, the default policy."""
    judged = rules.appraise(to_wide(_facts(s, codebase=True)), default_policy(), now())
    return judged.select("name", "version", "appraisal.risk", "appraisal.score", "appraisal.awarded", "appraisal.available")
