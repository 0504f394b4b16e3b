"""A package registry read out of the order tables.

The check tables hold orders, not packages.  These projections give them the
shape of a registry dump and its companions, whole table by whole table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.operators.registry import Registry

NOW = "TIMESTAMP_NTZ'2001-08-01 00:00:00'"
EVENTS_NOW = "TIMESTAMP_NTZ'2024-01-31 00:00:00'"
EVENTS_NOW_UNIX = 1706659200  # 2024-01-31
EVENTS_DAYS = (7, 14, 30)  # the events span one month

CVSS = (
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:H",
    "CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:L/I:N/A:N",
    "CVSS:3.1/AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:L/A:N",
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N",
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N",
)

NUM = (
    "concat(o_orderkey % 4, '.', o_orderkey % 13, '.', o_orderkey % 7, "
    "CASE WHEN o_orderkey % 5 = 0 THEN concat('-rc.', o_orderkey % 3) ELSE '' END)"
)


def now() -> Column:
    return F.expr(NOW)


class Shadow:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Registry -------------------------------------------------------------

    @cached_property
    def crates(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.expr("TIMESTAMP_NTZ'1994-01-01' + make_dt_interval(cast(c_custkey % 4000 as int))").alias("created_at"),
            F.expr(NOW).alias("updated_at"),
            F.expr("concat('https://github.com/', c_mktsegment, '/', c_custkey, '.git')").alias("repository"),
        )

    @cached_property
    def versions(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("crate_id"),
            F.expr(NUM).alias("num"),
            F.expr("cast(floor(o_totalprice) as bigint)").alias("downloads"),
            F.expr("CASE o_orderkey % 3 WHEN 0 THEN '2018' WHEN 1 THEN '2021' END").alias("edition"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
            F.col("o_orderpriority").alias("description"),
            F.expr(
                "map('default', array('std'), concat('f', o_orderkey % 9), cast(array() as array<string>))"
            ).alias("features"),
            F.expr("CASE WHEN o_orderkey % 6 = 0 THEN 'GPL-3.0' ELSE 'MIT OR Apache-2.0' END").alias("license"),
            F.lit("1.70").alias("rust_version"),
            (F.col("o_orderstatus") == "F").alias("yanked"),
            F.expr("CASE WHEN o_orderkey % 4 = 0 THEN concat('https://d.example/', o_orderkey) ELSE '' END").alias(
                "documentation"
            ),
            F.lit("").alias("homepage"),
        )

    @cached_property
    def dependencies(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("crate_id")
        )

    @cached_property
    def version_downloads(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("version_id"),
            F.col("l_quantity").cast("bigint").alias("downloads"),
            F.col("l_shipdate").cast("date").alias("date"),
        )

    @cached_property
    def crate_downloads(self) -> DataFrame:
        return (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("crate_id"))
            .agg(F.sum(F.expr("cast(floor(o_totalprice) as bigint)")).alias("downloads"))
        )

    @cached_property
    def crate_owners(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("crate_id"),
            F.expr("cast(c_custkey % 2 as int)").alias("owner_kind"),
            F.col("c_nationkey").cast("bigint").alias("owner_id"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.col("n_name").alias("gh_login"),
            F.expr("CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE concat(n_name, ' Inc') END").alias("name"),
        )

    @cached_property
    def teams(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_regionkey").cast("bigint").alias("id"),
            F.col("r_name").alias("login"),
            F.col("r_name").alias("name"),
        )

    @cached_property
    def crates_categories(self) -> DataFrame:
        """Line numbers as category ids; ids from 5 on resolve to nothing."""
        owner = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        return (
            self.table("lineitem")
            .select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("category_id"))
            .join(owner, "l_orderkey")
            .select(F.col("o_custkey").alias("crate_id"), "category_id")
            .distinct()
        )

    @cached_property
    def categories(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_regionkey").cast("bigint").alias("id"), F.lower("r_name").alias("slug")
        )

    @cached_property
    def crates_keywords(self) -> DataFrame:
        return (
            self.table("orders")
            .select(F.col("o_custkey").alias("crate_id"), (F.col("o_orderkey") % 30).alias("keyword_id"))
            .distinct()
        )

    @cached_property
    def keywords(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"), F.lower("n_name").alias("keyword")
        )

    @cached_property
    def registry(self) -> Registry:
        return Registry(
            self.crates,
            self.versions,
            self.version_downloads,
            self.dependencies,
            self.crate_downloads,
            self.crate_owners,
            self.users,
            self.teams,
            self.crates_categories,
            self.categories,
            self.crates_keywords,
            self.keywords,
        )

    # Companions -----------------------------------------------------------

    def advisories(self, package: str = "p_brand") -> DataFrame:
        vector = F.element_at(F.array(*[F.lit(c) for c in CVSS], F.lit(None)), (F.col("p_size") % 7 + 1).cast("int"))
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("id"),
            F.expr(package).alias("package"),
            F.expr(
                "CASE p_type WHEN 'PROMO' THEN 'notice' WHEN 'ECONOMY' THEN 'unmaintained' "
                "WHEN 'LARGE' THEN 'unsound' WHEN 'SMALL' THEN 'other' END"
            ).alias("informational"),
            F.lit(None).cast("string").alias("severity"),
            vector.alias("cvss"),
            F.expr("array(concat('>=', 1 + p_partkey % 3, '.', p_size % 13, '.0'))").alias("patched"),
            F.expr("array(concat('<0.', p_partkey % 11, '.2'), '=2.0.1')").alias("unaffected"),
        )

    @cached_property
    def brand_versions(self) -> DataFrame:
        return self.table("orders").select(
            F.expr("concat('Brand#', 1 + o_orderkey % 25)").alias("package"), F.expr(NUM).alias("version")
        )

    @cached_property
    def issues(self) -> DataFrame:
        opened = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
        closed = "CASE WHEN l_linestatus = 'F' THEN l_shipdate END"
        return (
            self.table("lineitem")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_tax")
            .join(opened, "l_orderkey")
            .select(
                F.col("l_suppkey").alias("repo"),
                F.col("o_orderdate").alias("created_at"),
                F.expr(closed).alias("closed_at"),
                F.expr("CASE WHEN l_linestatus = 'F' THEN 'closed' ELSE 'open' END").alias("state"),
                F.expr(
                    "CASE WHEN l_returnflag = 'R' THEN named_struct('merged_at', "
                    f"CASE WHEN l_tax > 0.04 THEN {closed} END) END"
                ).alias("pull_request"),
                F.expr("struct(l_orderkey, l_linenumber, l_partkey, l_shipdate)").alias("id"),
            )
        )

    @cached_property
    def repos(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("repo"),
            F.expr(
                "CASE s_suppkey % 3 WHEN 0 THEN 'github.com' WHEN 1 THEN 'codeberg.org' ELSE 'git.example.org' END"
            ).alias("host"),
            F.expr("CASE WHEN s_suppkey % 4 <> 0 THEN cast(floor(abs(s_acctbal)) as bigint) END").alias("stargazers_count"),
            F.expr("CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey END").cast("bigint").alias("forks_count"),
            F.expr("cast(floor(s_acctbal) as bigint)").alias("subscribers_count"),
            F.expr("cast(s_nationkey as bigint) - 3").alias("watchers_count"),
        )

    @cached_property
    def commits(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("repo"),
            (-F.col("event_id")).alias("seq"),
            F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01'"), F.col("ts")).alias("author_at"),
            F.col("event_type").alias("author_name"),
            F.expr("concat(cast(floor(value / 10) as bigint), '@example.org')").alias("author_email"),
        )

    @cached_property
    def workflow_files(self) -> DataFrame:
        return self.table("pages").select(
            F.expr("page_id div 5").alias("repo"),
            F.expr(
                "concat(CASE page_id % 4 WHEN 0 THEN '.github/workflows/ci' WHEN 1 THEN '.github/workflows/sub/b' "
                "WHEN 2 THEN '.github/workflows/readme' ELSE 'src/x' END, page_id, "
                "CASE page_id % 4 WHEN 0 THEN '.yml' WHEN 1 THEN '.yaml' WHEN 2 THEN '.md' ELSE '.yml' END)"
            ).alias("path"),
            F.expr(
                "concat(html, CASE page_id % 6 WHEN 0 THEN '\nrun: Clippy' WHEN 1 THEN '\nrun: MIRI test' ELSE '' END)"
            ).alias("content"),
        )

    @cached_property
    def source_files(self) -> DataFrame:
        """One file per order, one piece of code per line item."""
        pieces = F.array(*[F.lit(p) for p in SNIPPETS])
        # Line numbers are shuffled, and become text where the file is.
        lines = F.sort_array(F.collect_list("l_linenumber"))
        text = F.array_join(F.transform(lines, lambda n: F.element_at(pieces, (n % len(SNIPPETS) + 1).cast("int"))), "")
        return (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(text.alias("body"))
            .select(
                F.expr("l_orderkey div 10").alias("package"),
                F.expr(
                    "concat(CASE WHEN l_orderkey % 11 = 0 THEN 'tests/f' ELSE 'src/f' END, l_orderkey, "
                    "CASE WHEN l_orderkey % 13 = 0 THEN '.txt' ELSE '.rs' END)"
                ).alias("path"),
                F.expr("CASE WHEN l_orderkey % 17 = 0 THEN 5000001L ELSE cast(octet_length(body) as bigint) END").alias("length"),
                F.expr("concat(body, CASE WHEN l_orderkey % 97 = 0 THEN 'fn bad( {\n' ELSE '' END)").alias("content"),
            )
        )

    # Graph ----------------------------------------------------------------

    @cached_property
    def links(self) -> DataFrame:
        part = self.table("part")
        return part.select(
            F.col("p_partkey").alias("src"), F.explode(F.expr("array(p_partkey div 3, (p_partkey + p_size) div 4)")).alias("dst")
        ).filter("src <> dst")

    @cached_property
    def packages(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("pkg_id"),
            F.expr("concat('part-', p_partkey)").alias("name"),
            F.expr("concat('1.0.', p_size)").alias("version"),
            F.expr("p_type = 'PROMO'").alias("is_member"),
            F.lit(False).alias("is_root"),
        )

    @cached_property
    def package_features(self) -> DataFrame:
        return (
            self.table("part")
            .select(
                F.col("p_partkey").alias("pkg_id"),
                F.inline(
                    F.expr(
                        "arrays_zip(array('default', 'std', IF(p_partkey % 4 = 0, 'std', 'extra')), array('std', 'alloc', "
                        "CASE p_partkey % 4 WHEN 0 THEN 'b/fast' WHEN 1 THEN 'dep:b' WHEN 2 THEN 'b?/fast' ELSE 'more' END))"
                    )
                ).alias("feature", "activation"),
            )
        )

    @cached_property
    def package_deps(self) -> DataFrame:
        none = "cast(array() as array<string>)"
        return self.table("part").select(
            F.col("p_partkey").alias("pkg_id"),
            F.inline(
                F.expr(
                    "arrays_zip(array(0, 1, 2, 3), array('a', 'bee', 'c', 'd'), array(null, 'b', null, null), "
                    "array('normal', 'normal', 'dev', 'normal'), array(false, p_partkey % 4 <> 3, false, false), "
                    f"array(p_partkey % 2 = 0, false, true, false), "
                    f"array(IF(p_partkey % 3 = 0, array('extra'), {none}), {none}, {none}, array('extra')))"
                )
            ).alias("ord", "name", "rename", "kind", "optional", "uses_default_features", "features"),
        )

    @cached_property
    def resolve_edges(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("pkg_id"),
            F.inline(
                F.expr(
                    "arrays_zip(array('a', 'b', 'c', 'd'), array(p_partkey div 3, (p_partkey + p_size) div 4, "
                    "(p_partkey + 2 * p_size) div 5, (p_partkey + 3 * p_size) div 6), "
                    "array(array('normal'), array('normal'), array('dev'), array('build')))"
                )
            ).alias("dep_lib_name", "dep_pkg_id", "kinds"),
        )

    @cached_property
    def resolve_features(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("pkg_id"), F.lit("default").alias("feature"))

    # Documentation --------------------------------------------------------

    @cached_property
    def docs_json(self) -> DataFrame:
        """One item per text line of a document."""
        index = f"map_from_entries(transform(split(text, '\n'), (x, i) -> struct(cast(i as string), {_DOC_ITEM})))"
        return self.table("documents").select(
            F.expr("concat('doc-', doc_id)").alias("package"),
            F.lit("1.0.0").alias("version"),
            F.expr(
                f"to_json(named_struct('format_version', 48 + doc_id % 12, 'root', '0', 'index', {index}))"
            ).alias("body"),
        )

    @cached_property
    def docs_lines(self) -> DataFrame:
        """The same documents with a line for each item and one for the head."""
        docs, name = self.table("documents"), F.expr("concat('doc-', doc_id)").alias("package")
        heads = docs.select(name, F.expr("to_json(named_struct('format_version', 48 + doc_id % 12, 'root', '0'))").alias("body"))
        lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "x"))
        items = lines.select(name, F.expr(f"to_json(named_struct('id', cast(i as string), 'item', {_DOC_ITEM}))").alias("body"))
        return heads.unionByName(items).select("package", F.lit("1.0.0").alias("version"), "body")


# A documentation item made of text line x, number i.
_DOC_ITEM = (
    "named_struct("
    "'name', CASE WHEN i = 0 AND lang = 'en' THEN concat('doc_', doc_id) ELSE concat('item', i) END, "
    "'visibility', CASE WHEN i % 5 = 4 THEN 'default' ELSE 'public' END, "
    "'docs', concat(x, CASE WHEN i % 3 = 0 THEN '\n  ```\nlet a = \"[`Nope`]\";\n```\n' ELSE '' END, "
    "CASE WHEN i % 4 = 1 THEN ' see [`Foo`]' ELSE '' END), "
    "'links', CASE WHEN i % 8 = 1 THEN map('`Foo`', 1) ELSE cast(map() as map<string, int>) END, "
    "'inner', CASE WHEN i % 7 = 6 THEN map('use', map('source', 'x')) ELSE map('struct', map('kind', 'x')) END)"
)

# Pieces of code with known line counts, by line number.
SNIPPETS = (
    "use a::b;\n",
    "/// doc\npub fn f() {\n    let x = 1; // c\n\n    x\n}\n",
    "#[cfg(test)]\nmod tests {\n    #[test]\n    fn t() { assert!(true); }\n}\n",
    "// free\n\n",
    "unsafe fn g() {\n    unsafe { h(\"}\") }\n}\n",
    "/* block\n\n   text */\n\nstruct S;\n",
)
