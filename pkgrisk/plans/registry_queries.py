"""Ingest, requests, versions, names and registry aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions import cells
from pkgrisk.functions.semver import requirement_matches, semver_key
from pkgrisk.operators import registry as reg
from pkgrisk.operators import resolve as res
from pkgrisk.operators.hosting import host_status
from pkgrisk.plans.appraise import identify
from pkgrisk.plans.catalog import CRATE_MONTHS, NOW, NUM, query
from pkgrisk.plans.shadow import Shadow, now
from pkgrisk.session import Scratch, wide
from pkgrisk.sources import dump
from pkgrisk.sources.kept import DownloadStore
from pkgrisk.sources.sinks import write_csv

# --------------------------------------------------------------------------
# Ingest


def _cell_texts(s: Shadow) -> DataFrame:
    return s.table("orders").select(
        "o_orderkey",
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE cast(o_orderkey as string) END").alias("number"),
        F.expr("element_at(array('t', 'true', 'f', 'false', ''), cast(o_orderkey % 5 + 1 as int))").alias("flag"),
        F.expr(
            "CASE WHEN o_orderkey % 10 = 0 THEN '1960-02-03 04:05:06.7+00' WHEN o_orderkey % 2 = 0 "
            "THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 10:20:30.456+00') "
            "ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:20:30+02:00') END"
        ).alias("moment"),
        F.expr(
            "CASE WHEN o_orderkey % 10 = 0 THEN '1960-02-03' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"
        ).alias("day"),
        F.expr(
            "element_at(array('', concat('https://a.example/', o_orderkey), concat('b.example/', o_orderkey), "
            "'not a link'), cast(o_orderkey % 4 + 1 as int))"
        ).alias("link"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '{}' ELSE concat('{a,', o_orderkey, '}') END").alias("items"),
        F.expr("element_at(array('', '2021', '2030', '2015'), cast(o_orderkey % 4 + 1 as int))").alias("edition"),
    )


@query(
    """SELECT o_orderkey,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS number,
  o_orderkey % 5 < 2 AS flag,
  CASE WHEN o_orderkey % 10 = 0 THEN '1970-01-01 00:00:00'
       WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:20:30'
       ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 08:20:30' END AS moment,
  CASE WHEN o_orderkey % 10 = 0 THEN '1970-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE o_orderkey % 4 WHEN 1 THEN concat('https://a.example/', o_orderkey)
       WHEN 2 THEN concat('https://b.example/', o_orderkey) ELSE '' END AS link,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('a|', o_orderkey) END AS items,
  CASE o_orderkey % 4 WHEN 1 THEN '2021' WHEN 2 THEN 'unknown' WHEN 3 THEN '2015' END AS edition
FROM orders"""
)
def cell_converters(s: Shadow) -> DataFrame:
    """Every text cell converter, strict."""

    def strict(convert, name: str) -> Column:
        return cells.strict(convert(F.col(name)), name, F.col(name))

    moment = F.to_utc_timestamp(strict(cells.timestamp, "moment"), F.current_timezone())
    return _cell_texts(s).select(
        "o_orderkey",
        strict(cells.optional_u64, "number").alias("number"),
        strict(cells.boolean, "flag").alias("flag"),
        F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("moment"),
        F.date_format(strict(cells.date, "day"), "yyyy-MM-dd").alias("day"),
        strict(cells.url, "link").alias("link"),
        F.array_join(strict(cells.pg_array, "items"), "|").alias("items"),
        strict(cells.edition, "edition").alias("edition"),
    )


@query(
    f"""SELECT o_orderkey AS id, o_custkey AS crate_id, {NUM} AS num,
  floor(o_totalprice)::BIGINT AS downloads, '2021' AS edition,
  strftime(o_orderdate, '%Y-%m-%d') AS created_on,
  concat('say "', o_orderpriority, '", or', chr(10), o_orderkey) AS description,
  concat('default=std|f', o_orderkey % 9, '=') AS features,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'MIT' END AS license,
  o_orderstatus = 'F' AS yanked,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('https://d.example/', o_orderkey) ELSE '' END AS documentation
FROM orders"""
)
def ingest_roundtrip(s: Shadow) -> DataFrame:
    """A dump file written as CSV (quotes, commas, line breaks), read back typed."""
    text = s.table("orders").select(
        F.expr("concat('x', o_orderkey)").alias("not_a_column_we_read"),
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("crate_id"),
        F.expr(NUM).alias("num"),
        F.expr("cast(floor(o_totalprice) as bigint)").alias("downloads"),
        F.lit("2021").alias("edition"),
        F.expr("concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 00:00:00.123+00')").alias("created_at"),
        F.expr("concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 00:00:00+00')").alias("updated_at"),
        F.expr("concat('say \"', o_orderpriority, '\", or\n', o_orderkey)").alias("description"),
        F.expr("concat('{\"f', o_orderkey % 9, '\":[],\"default\":[\"std\"]}')").alias("features"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'MIT' END").alias("license"),
        F.lit("").alias("rust_version"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN 't' ELSE 'f' END").alias("yanked"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN concat('d.example/', o_orderkey) ELSE '' END").alias("documentation"),
        F.lit("").alias("homepage"),
    )
    folder = Scratch(s.spark, "dump").path
    write_csv(text, f"{folder}/versions.csv")
    v = dump.read_table(s.spark, folder, "versions")
    names = reg.feature_names(F.col("features"))
    created = F.to_utc_timestamp("created_at", F.current_timezone())
    return v.select(
        "id",
        "crate_id",
        "num",
        "downloads",
        "edition",
        F.date_format(created, "yyyy-MM-dd").alias("created_on"),
        "description",
        F.array_join(
            F.transform(names, lambda n: F.concat(n, F.lit("="), F.array_join(F.col("features")[n], "+"))), "|"
        ).alias("features"),
        "license",
        "yanked",
        "documentation",
    )


# --------------------------------------------------------------------------
# Requests


def _requests(s: Shadow) -> DataFrame:
    """One request per order: latest, existing, or missing version, some unknown names."""
    customer = s.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return (
        s.table("orders")
        .join(customer, "o_custkey")
        .select(
            F.expr("CASE WHEN o_orderkey % 17 = 0 THEN concat(c_name, 'x') ELSE c_name END").alias("name"),
            F.expr(
                f"CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN {NUM} ELSE concat('99.0.', o_orderkey % 5) END"
            ).alias("version"),
        )
    )


_DESC = (
    "o_orderkey % 4 DESC, o_orderkey % 13 DESC, o_orderkey % 7 DESC, (o_orderkey % 5 <> 0) DESC, "
    "(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 ELSE 0 END) DESC"
)
_LATEST = (
    f"latest AS (SELECT o_custkey, o_orderkey, {NUM} AS num FROM orders "
    f"QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_DESC}, o_orderkey DESC) = 1)"
)
_RESOLVED = f"""
req AS (SELECT DISTINCT CASE WHEN o_orderkey % 17 = 0 THEN concat(c_name, 'x') ELSE c_name END AS name,
    CASE o_orderkey % 3 WHEN 1 THEN {NUM} WHEN 2 THEN concat('99.0.', o_orderkey % 5) END AS requested
  FROM orders JOIN customer ON c_custkey = o_custkey),
{_LATEST},
exact AS (SELECT o_custkey, {NUM} AS num, min(o_orderkey) AS id FROM orders GROUP BY ALL),
resolved AS (SELECT r.name, r.requested,
    coalesce(r.requested, l.num, '0.0.0') AS version,
    CASE WHEN c.c_custkey IS NULL THEN 'CrateNotFound'
         WHEN CASE WHEN r.requested IS NULL THEN l.o_orderkey ELSE e.id END IS NULL THEN 'VersionNotFound'
         ELSE 'Found' END AS status,
    CASE WHEN r.requested IS NULL THEN l.o_orderkey ELSE e.id END AS version_id
  FROM req r LEFT JOIN customer c ON c.c_name = r.name
  LEFT JOIN latest l ON l.o_custkey = c.c_custkey
  LEFT JOIN exact e ON e.o_custkey = c.c_custkey AND e.num = r.requested)
"""


@query(
    f"""SELECT c_name AS name, CASE o_orderkey % 6 WHEN 1 THEN {NUM} END AS version,
  o_orderkey % 6 > 1 AS failed, count(*) AS requests
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"""
)
def request_parse(s: Shadow) -> DataFrame:
    customer = s.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    texts = s.table("orders").join(customer, "o_custkey").select(
        F.expr(
            f"CASE o_orderkey % 6 WHEN 0 THEN c_name WHEN 1 THEN concat(c_name, '@', {NUM}) "
            "WHEN 2 THEN concat(c_name, '@1.2') WHEN 3 THEN concat(c_name, '@01.2.3') "
            "WHEN 4 THEN concat(c_name, '@1.2.3-a..b') ELSE concat(c_name, '@1.2.3@z') END"
        ).alias("request")
    )
    return res.parse_requests(texts).groupBy(
        "name", "version", F.col("error").isNotNull().alias("failed")
    ).agg(F.count("*").alias("requests"))


@query(f"WITH {_RESOLVED} SELECT name, requested, version, status, version_id FROM resolved")
def resolve_status(s: Shadow) -> DataFrame:
    r = res.resolve(_requests(s), s.crates, s.versions)
    return r.select("name", "requested", "version", "status", "version_id")


@query(
    f"""WITH {_RESOLVED}, f AS (SELECT *, length(name) + length(version) AS n FROM resolved WHERE status <> 'Found')
SELECT name, version, status, CASE WHEN status = 'VersionNotFound'
  THEN concat('Could not find information on version ', version, ' of crate `', name, '`')
  ELSE concat('Could not find information on crate ''', name, '''',
    CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN concat('. Did you mean ''', name, 'a''?')
      WHEN 2 THEN concat('. Did you mean ''', name, 'a'' or ''', name, 'b''?')
      ELSE concat('. Did you mean ''', name, 'a'', ''', name, 'b'', or ''', name, 'c''?') END) END AS message
FROM f"""
)
def failed_messages(s: Shadow) -> DataFrame:
    r = res.resolve(_requests(s), s.crates, s.versions)
    some = F.expr(
        "slice(array(concat(name, 'a'), concat(name, 'b'), concat(name, 'c')), 1, "
        "(length(name) + length(version)) % 4)"
    )
    return res.failures(r.withColumn("suggestions", some))


_WORD = "[^A-Za-z0-9_-]+"


def _words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.split("text", _WORD)).alias("name")).filter("name <> ''").distinct()


@query(
    f"""WITH offered AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '{_WORD}')) AS w FROM documents) WHERE w <> ''),
asked AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '{_WORD}')) AS w FROM conversations) WHERE w <> ''),
a AS (SELECT w, lower(translate(w, '-_ ', '')) AS n FROM asked WHERE length(w) >= 5 AND w NOT IN (SELECT w FROM offered)),
o AS (SELECT w, lower(translate(w, '-_ ', '')) AS n FROM offered WHERE w NOT IN (SELECT w FROM asked)),
near AS MATERIALIZED (SELECT a.w AS wanted, o.w AS offered, a.n AS an, o.n AS bn
  FROM a JOIN o ON 5 * abs(length(a.n) - length(o.n)) <= greatest(length(a.n), length(o.n))
  WHERE levenshtein(a.n, o.n) <= 2 * (greatest(length(a.n), length(o.n)) // 5)),
pairs AS (SELECT wanted, offered, 1 - damerau_levenshtein(an, bn)::DOUBLE / greatest(length(an), length(bn)) AS score FROM near),
best AS (SELECT wanted, offered, row_number() OVER (PARTITION BY wanted ORDER BY score DESC, offered) AS rank
  FROM pairs WHERE score >= 0.8)
SELECT wanted AS name, string_agg(offered, '|' ORDER BY rank) AS suggestions FROM best WHERE rank <= 3 GROUP BY wanted"""
)
def name_suggest(s: Shadow) -> DataFrame:
    """Words of the conversations that no document has, against the document words."""
    # Both are read for the missing words and for those on offer.
    scratch = Scratch(s.spark, "words")
    offered, asked = scratch.save(_words(s.table("documents")), "offered"), scratch.save(_words(s.table("conversations")), "asked")
    missing = asked.join(wide(offered), "name", "left_anti")
    return res.suggest_names(missing, offered, requested=asked).select(
        "name", F.array_join("suggestions", "|").alias("suggestions")
    )


# --------------------------------------------------------------------------
# Versions

@query(f"WITH {_LATEST} SELECT o_custkey AS crate_id, num, o_orderkey AS id FROM latest")
def latest_version(s: Shadow) -> DataFrame:
    return res.latest_versions(s.versions.select("id", "crate_id", "num")).select("crate_id", "num", "id")


@query(
    f"""SELECT o_custkey AS crate_id,
  arg_min({NUM}, [o_orderkey % 4, o_orderkey % 13, o_orderkey % 7, (o_orderkey % 5 <> 0)::BIGINT,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 ELSE 0 END]) AS lowest,
  arg_max({NUM}, [o_orderkey % 4, o_orderkey % 13, o_orderkey % 7, (o_orderkey % 5 <> 0)::BIGINT,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 ELSE 0 END]) AS highest
FROM orders GROUP BY o_custkey"""
)
def semver_sort(s: Shadow) -> DataFrame:
    """Both ends of the version order per package, in report order."""
    key = semver_key(F.col("num"))
    ends = s.versions.groupBy("crate_id").agg(
        F.min_by("num", key).alias("lowest"), F.max_by("num", key).alias("highest")
    )
    return ends.orderBy("crate_id", semver_key(F.col("highest")))


_REQ = """CASE o_orderkey % 9 WHEN 0 THEN '*' WHEN 1 THEN concat('^', o_orderkey % 3, '.', o_orderkey % 5)
  WHEN 2 THEN concat('~', o_orderkey % 3, '.', o_orderkey % 5) WHEN 3 THEN concat('=', o_orderkey % 4, '.', o_orderkey % 13)
  WHEN 4 THEN '>=1.0, <3.0' WHEN 5 THEN concat(o_orderkey % 3, '.*') WHEN 6 THEN concat('^0.', o_orderkey % 13, '.', o_orderkey % 5)
  WHEN 7 THEN '<=2.5' ELSE concat('>=', o_orderkey % 4, '.', o_orderkey % 13, '.', o_orderkey % 7, '-rc.1') END"""


@query(
    f"""WITH v AS (SELECT o_orderkey AS k, o_orderkey % 4 AS ma, o_orderkey % 13 AS mi, o_orderkey % 7 AS pa,
    o_orderkey % 5 = 0 AS pre, {NUM} AS num, {_REQ} AS req FROM orders)
SELECT num, req, CASE k % 9
  WHEN 0 THEN NOT pre
  WHEN 1 THEN NOT pre AND ma = k % 3 AND CASE WHEN k % 3 = 0 THEN mi = k % 5 ELSE mi >= k % 5 END
  WHEN 2 THEN NOT pre AND ma = k % 3 AND mi = k % 5
  WHEN 3 THEN NOT pre
  WHEN 4 THEN NOT pre AND ma IN (1, 2)
  WHEN 5 THEN NOT pre AND ma = k % 3
  WHEN 6 THEN NOT pre AND ma = 0 AND CASE WHEN k % 13 = 0 THEN CASE WHEN k % 5 = 0 THEN mi = 0 AND pa = 0 ELSE mi = 0 AND pa = k % 5 END
                                      ELSE mi = k % 13 AND pa >= k % 5 END
  WHEN 7 THEN NOT pre AND (ma < 2 OR (ma = 2 AND mi <= 5))
  ELSE CASE WHEN pre THEN k % 3 >= 1 ELSE true END END AS matches, count(*) AS versions
FROM v GROUP BY ALL"""
)
def version_req_match(s: Shadow) -> DataFrame:
    v = s.table("orders").select(F.expr(NUM).alias("num"), F.expr(_REQ).alias("req"))
    return (
        v.groupBy("num", "req")
        .agg(F.count("*").alias("versions"))
        .select("num", "req", requirement_matches(F.col("num"), F.col("req")).alias("matches"), "versions")
    )


# --------------------------------------------------------------------------
# Repositories


def _page_repos(s: Shadow) -> DataFrame:
    """Page links as repository links; half of the ".html" become ".git"."""
    return s.table("pages").select(
        "page_id",
        F.expr("CASE WHEN page_id % 2 = 0 THEN replace(url, '.html', '.git') ELSE url END").alias("repository"),
    )


_PAGE_REPOS = """p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '.html', '.git') ELSE url END AS u FROM pages),
r AS (SELECT page_id, regexp_extract(u, '^([a-z]+)://([^/?#]+)/([^/?#]+)/([^/?#]+)', 1) AS scheme,
    lower(regexp_extract(u, '^([a-z]+)://([^/?#]+)/([^/?#]+)/([^/?#]+)', 2)) AS host,
    regexp_extract(u, '^([a-z]+)://([^/?#]+)/([^/?#]+)/([^/?#]+)', 3) AS owner,
    regexp_replace(regexp_extract(u, '^([a-z]+)://([^/?#]+)/([^/?#]+)/([^/?#]+)', 4), '(\\.git)+$', '') AS repo FROM p)"""


@query(
    f"""WITH {_PAGE_REPOS} SELECT page_id, nullif(host, '') AS host, nullif(owner, '') AS owner, nullif(repo, '') AS repo,
  CASE WHEN host <> '' THEN concat(scheme, '://', host, '/', owner, '/', repo) END AS url FROM r"""
)
def repo_parse(s: Shadow) -> DataFrame:
    return res.with_repository(_page_repos(s)).select("page_id", "repo.host", "repo.owner", "repo.repo", "repo.url")


@query(
    f"""WITH {_PAGE_REPOS}, g AS (SELECT scheme, host, owner, repo, count(*) AS pages, max(page_id) AS newest FROM r WHERE host <> '' GROUP BY ALL)
SELECT page_id, pages, newest FROM r LEFT JOIN g USING (scheme, host, owner, repo)"""
)
def repo_fanout(s: Shadow) -> DataFrame:
    """Facts once per repository, handed to every package of it."""
    packages = res.with_repository(_page_repos(s)).select("page_id", F.col("repo.url").alias("repo"))
    once = packages.filter("repo is not null").groupBy("repo").agg(
        F.count("*").alias("pages"), F.max("page_id").alias("newest")
    )
    return res.fan_out_by_repo(packages, once).select("page_id", "pages", "newest")


@query(
    f"""WITH {_PAGE_REPOS}, h AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'github.com' WHEN 1 THEN 'codeberg.org' ELSE host END AS host FROM r)
SELECT page_id, host, CASE WHEN page_id % 3 < 2 THEN 'Found' ELSE 'Unavailable' END AS status,
  CASE WHEN page_id % 3 = 2 THEN concat('unsupported hosting provider: ', host) END AS reason FROM h"""
)
def host_support(s: Shadow) -> DataFrame:
    hosts = res.with_repository(_page_repos(s)).select(
        "page_id",
        F.expr("CASE page_id % 3 WHEN 0 THEN 'github.com' WHEN 1 THEN 'codeberg.org' ELSE repo.host END").alias("host"),
    )
    return host_status(hosts)


# --------------------------------------------------------------------------
# Registry aggregates


@query(
    """SELECT p_partkey AS crate_id, count(DISTINCT o_custkey)::BIGINT AS dependents
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"""
)
def dependents_count(s: Shadow) -> DataFrame:
    wanted = s.table("part").select(F.col("p_partkey").alias("crate_id"))
    return reg.dependents(s.dependencies, s.versions, wanted)


@query(
    """SELECT DISTINCT l_partkey AS crate_id, l_orderkey AS version_id FROM lineitem
WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_type = 'PROMO')"""
)
def semi_dependents(s: Shadow) -> DataFrame:
    wanted = s.table("part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("crate_id"))
    return reg.dependent_versions(s.dependencies, wanted)


@query(
    f"""SELECT o_custkey AS crate_id, count(*) FILTER (o_orderdate >= {NOW} - INTERVAL 90 DAY) AS versions_last_90_days,
  count(*) FILTER (o_orderdate >= {NOW} - INTERVAL 180 DAY) AS versions_last_180_days,
  count(*) FILTER (o_orderdate >= {NOW} - INTERVAL 365 DAY) AS versions_last_365_days FROM orders GROUP BY 1"""
)
def version_recency(s: Shadow) -> DataFrame:
    return reg.version_recency(s.versions, now())


@query(
    """SELECT l_orderkey AS version_id, date_trunc('month', l_shipdate)::DATE AS month,
  sum(l_quantity::BIGINT)::BIGINT AS downloads FROM lineitem GROUP BY ALL"""
)
def monthly_downloads_version(s: Shadow) -> DataFrame:
    return reg.monthly_by_version(s.version_downloads)


@query(
    """SELECT l_orderkey AS version_id, date_trunc('month', l_shipdate)::DATE AS month,
  sum(l_quantity::BIGINT)::BIGINT AS downloads FROM lineitem GROUP BY ALL"""
)
def monthly_downloads_kept(s: Shadow) -> DataFrame:
    """Month sums kept over two dumps: the second one completes days of the first and brings new ones."""
    store = DownloadStore(s.spark, Scratch(s.spark, "kept-downloads").path)
    rows, recent = s.version_downloads, F.col("date") >= F.lit("1998-03-17").cast("date")
    store.add(rows.filter(~recent | ((F.col("date") < "1998-08-20") & (F.col("version_id") % 2 == 0))))
    store.add(rows.filter(recent))
    return store.months()


@query(f"WITH {CRATE_MONTHS} SELECT crate_id, month, downloads FROM cm")
def monthly_downloads_crate(s: Shadow) -> DataFrame:
    return reg.monthly_by_crate(reg.monthly_by_version(s.version_downloads), s.versions)


_RECENT = (
    "recent AS (SELECT crate_id, sum(downloads)::BIGINT AS recent FROM (SELECT *, row_number() OVER "
    "(PARTITION BY crate_id ORDER BY month DESC) AS r FROM cm) WHERE r <= 3 GROUP BY 1)"
)


@query(f"WITH {CRATE_MONTHS}, {_RECENT} SELECT crate_id, recent AS recent_downloads FROM recent")
def recent_downloads(s: Shadow) -> DataFrame:
    months = reg.monthly_by_crate(reg.monthly_by_version(s.version_downloads), s.versions)
    return reg.as_series(months, "crate_id").select(
        "crate_id", reg.recent_downloads(F.col("monthly_downloads")).alias("recent_downloads")
    )


@query(
    """SELECT c_custkey AS crate_id, coalesce(sum(floor(o_totalprice)::BIGINT), 0)::BIGINT AS downloads
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def total_downloads(s: Shadow) -> DataFrame:
    return reg.total_downloads(s.crates.select(F.col("id").alias("crate_id")), s.crate_downloads)


_OWNERS = """own AS (SELECT c_custkey AS crate_id, 'user' AS kind, n_name AS login,
    CASE WHEN n_nationkey % 3 <> 0 THEN concat(n_name, ' Inc') END AS display_name
  FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 'team', r_name, r_name FROM customer JOIN region ON r_regionkey = c_nationkey WHERE c_custkey % 2 = 1)"""


@query(f"WITH {_OWNERS} SELECT crate_id, kind, login, display_name FROM own")
def owners_union(s: Shadow) -> DataFrame:
    return reg.owners(s.crate_owners, s.users, s.teams)


_CATEGORIES = """cat AS (SELECT crate_id, string_agg(slug, '|' ORDER BY slug) AS categories FROM (
  SELECT DISTINCT o_custkey AS crate_id, lower(r_name) AS slug FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN region ON r_regionkey = l_linenumber) GROUP BY 1)"""
_KEYWORDS = """key AS (SELECT crate_id, string_agg(keyword, '|' ORDER BY keyword) AS keywords FROM (
  SELECT DISTINCT o_custkey AS crate_id, lower(n_name) AS keyword FROM orders JOIN nation ON n_nationkey = o_orderkey % 30) GROUP BY 1)"""


@query(f"WITH {_CATEGORIES} SELECT crate_id, categories FROM cat")
def categories_list(s: Shadow) -> DataFrame:
    lists = reg.label_lists(s.crates_categories, s.categories, "category_id", "slug", "categories")
    return lists.select("crate_id", F.array_join("categories", "|").alias("categories"))


@query(f"WITH {_KEYWORDS} SELECT crate_id, keywords FROM key")
def keywords_list(s: Shadow) -> DataFrame:
    lists = reg.label_lists(s.crates_keywords, s.keywords, "keyword_id", "keyword", "keywords")
    return lists.select("crate_id", F.array_join("keywords", "|").alias("keywords"))


@query(
    """SELECT event_id, array_to_string(list_sort(json_keys(
  concat('{"z', props->>'$.k', '":[],"', event_type, '":["x"],"default":["', event_type, '"]}')::JSON)), '|') AS features
FROM events"""
)
def features_keys(s: Shadow) -> DataFrame:
    """Feature maps are JSON text in the dump; their names come out sorted."""
    text = F.expr(
        "concat('{\"z', get_json_object(props, '$.k'), '\":[],\"', event_type, '\":[\"x\"],\"default\":[\"', event_type, '\"]}')"
    )
    cell = cells.features(text)
    return s.table("events").select(
        "event_id", F.array_join(reg.feature_names(cells.strict(cell, "features", text)), "|").alias("features")
    )


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN concat('https://d.example/', o_orderkey)
  ELSE concat('https://docs.rs/', c_name, '/', {NUM}) END AS link FROM orders JOIN customer ON c_custkey = o_custkey"""
)
def docs_link_default(s: Shadow) -> DataFrame:
    names = s.crates.select(F.col("id").alias("crate_id"), "name")
    return s.versions.join(names, "crate_id").select(
        F.col("id").alias("o_orderkey"), reg.docs_link(F.col("documentation"), F.col("name"), F.col("num")).alias("link")
    )


@query(
    f"""WITH {_LATEST}, {CRATE_MONTHS}, {_RECENT}, {_OWNERS}, {_CATEGORIES}, {_KEYWORDS},
dep AS (SELECT l_partkey AS crate_id, count(DISTINCT o_custkey) AS dependents FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
tot AS (SELECT o_custkey AS crate_id, sum(floor(o_totalprice)::BIGINT) AS downloads,
    count(*) FILTER (o_orderdate >= {NOW} - INTERVAL 365 DAY) AS y FROM orders GROUP BY 1),
vm AS (SELECT l_orderkey, date_trunc('month', l_shipdate) AS month, sum(l_quantity::BIGINT) AS d FROM lineitem GROUP BY ALL),
vr AS (SELECT l_orderkey, sum(d) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY month DESC) AS r FROM vm) WHERE r <= 3 GROUP BY 1)
SELECT c_name AS name, num AS version, tot.downloads::BIGINT AS downloads, coalesce(dependents, 0)::BIGINT AS dependents,
  y::BIGINT AS versions_last_365_days, coalesce(recent.recent, 0)::BIGINT AS recent_downloads,
  coalesce(vr.recent, 0)::BIGINT AS version_recent_downloads, coalesce(own.login, '') AS owners,
  coalesce(categories, '') AS categories, coalesce(keywords, '') AS keywords,
  strftime(orders.o_orderdate, '%Y-%m-%d') AS version_created_on, orders.o_orderstatus = 'F' AS yanked
FROM customer JOIN latest ON latest.o_custkey = c_custkey JOIN orders ON orders.o_orderkey = latest.o_orderkey
LEFT JOIN tot ON tot.crate_id = c_custkey LEFT JOIN dep ON dep.crate_id = c_custkey
LEFT JOIN recent ON recent.crate_id = c_custkey LEFT JOIN vr ON vr.l_orderkey = latest.o_orderkey
LEFT JOIN own ON own.crate_id = c_custkey LEFT JOIN cat ON cat.crate_id = c_custkey LEFT JOIN key ON key.crate_id = c_custkey"""
)
def registry_facts(s: Shadow) -> DataFrame:
    """Everything the registry knows, for the latest version of every package."""
    everyone = s.crates.select("name", F.lit(None).cast("string").alias("version"))
    f = reg.registry_facts(s.registry, identify(everyone, s.registry).packages, now())
    v, o = "registry.version_facts", "registry.overall"
    return f.select(
        "name",
        "version",
        f"{o}.downloads",
        f"{o}.dependents",
        f"{o}.versions_last_365_days",
        reg.recent_downloads(F.col(f"{o}.monthly_downloads")).alias("recent_downloads"),
        reg.recent_downloads(F.col(f"{v}.monthly_downloads")).alias("version_recent_downloads"),
        F.array_join(f"{o}.owners.login", "|").alias("owners"),
        F.array_join(f"{o}.categories", "|").alias("categories"),
        F.array_join(f"{o}.keywords", "|").alias("keywords"),
        F.date_format(f"{v}.created_at", "yyyy-MM-dd").alias("version_created_on"),
        f"{v}.yanked",
    )
