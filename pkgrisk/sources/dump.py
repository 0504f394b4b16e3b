"""Typed ingest of a package-registry dump (one CSV with header per table).

Files are read as text and projected by column name, so wider files are fine.
A bad cell fails the job, or, with ``quarantine``, goes to a second frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.functions import cells
from pkgrisk.functions.cells import Cell

_IMPOSSIBLE = "\x01no such cell\x01"


@dataclass(frozen=True)
class Field:
    name: str
    convert: Callable[[Column], Cell]
    what: str
    source: str = ""
    optional: bool = False  # only some dumps carry the column

    @property
    def header(self) -> str:
        return self.source or self.name


@dataclass(frozen=True)
class Table:
    fields: tuple[Field, ...]
    free_text: bool = False  # cells may hold line breaks
    optional: bool = False  # only some dumps carry the table


def _f(name: str, convert: Callable[[Column], Cell], what: str = "", source: str = "", optional: bool = False) -> Field:
    return Field(name, convert, what or convert.__name__, source, optional)


def _extra(name: str, convert: Callable[[Column], Cell], source: str = "") -> Field:
    return _f(name, convert, source=source, optional=True)


_KIND = cells.one_of("0", "1", "2")
_OWNER_KIND = cells.one_of("0", "1")

# The tables and columns of the dump.
TABLES: dict[str, Table] = {
    "crates": Table(
        (
            _f("id", cells.u64),
            _f("name", cells.text),
            _f("created_at", cells.timestamp),
            _f("updated_at", cells.timestamp),
            _f("repository", cells.url),
            _extra("description", cells.text),
            _extra("documentation", cells.url),
            _extra("homepage", cells.url),
            _extra("readme", cells.text),
            _extra("max_features", cells.optional_u64),
            _extra("max_upload_size", cells.optional_u64),
            _extra("trustpub_only", cells.boolean),
        ),
        free_text=True,
    ),
    "versions": Table(
        (
            _f("id", cells.u64),
            _f("crate_id", cells.u64),
            _f("num", cells.version),
            _f("downloads", cells.u64),
            _f("edition", cells.edition),
            _f("created_at", cells.timestamp),
            _f("updated_at", cells.timestamp),
            _f("description", cells.text),
            _f("features", cells.features),
            _f("license", cells.text),
            _f("rust_version", cells.text),
            _f("yanked", cells.boolean),
            _f("documentation", cells.url),
            _f("homepage", cells.url),
            _extra("categories", cells.pg_array),
            _extra("keywords", cells.pg_array),
            _extra("repository", cells.url),
            _extra("links", cells.text),
            _extra("bin_names", cells.pg_array),
            _extra("checksum", cells.text),
            _extra("crate_size", cells.optional_u64),
            _extra("published_by", cells.optional_u64),
            _extra("has_lib", cells.boolean),
        ),
        free_text=True,
    ),
    "version_downloads": Table(
        (_f("version_id", cells.u64), _f("downloads", cells.u64), _f("date", cells.date))
    ),
    "dependencies": Table(
        (
            _f("version_id", cells.u64),
            _f("crate_id", cells.u64),
            _extra("features", cells.pg_array),
            _extra("id", cells.u64),
            Field("kind", _KIND, "dependency kind", optional=True),
            _extra("default_features", cells.boolean),
            _extra("explicit_name", cells.text),
            _extra("optional", cells.boolean),
            _extra("req", cells.text),
            _extra("target", cells.text),
        )
    ),
    "crate_downloads": Table((_f("crate_id", cells.u64), _f("downloads", cells.u64))),
    "crates_categories": Table((_f("crate_id", cells.u64), _f("category_id", cells.u64))),
    "crates_keywords": Table((_f("crate_id", cells.u64), _f("keyword_id", cells.u64))),
    "categories": Table(
        (
            _f("id", cells.u64),
            _f("slug", cells.text),
            _extra("category", cells.text),
            _extra("description", cells.text),
            _extra("crates_cnt", cells.u64),
            _extra("created_at", cells.timestamp),
            _extra("path", cells.text),
        ),
        free_text=True,
    ),
    "keywords": Table(
        (
            _f("id", cells.u64),
            _f("keyword", cells.text),
            _extra("crates_cnt", cells.u64),
            _extra("created_at", cells.timestamp),
        )
    ),
    "teams": Table(
        (
            _f("id", cells.u64),
            _f("login", cells.text),
            _f("name", cells.text),
            _extra("org_id", cells.optional_id),
            _extra("avatar", cells.text),
            _extra("github_id", cells.u64),
        ),
        free_text=True,
    ),
    "users": Table(
        (
            _f("id", cells.u64),
            _f("gh_login", cells.text),
            _f("name", cells.text),
            _extra("gh_id", cells.optional_id),
            _extra("gh_avatar", cells.text),
        ),
        free_text=True,
    ),
    "crate_owners": Table(
        (
            _f("crate_id", cells.u64),
            Field("owner_kind", _OWNER_KIND, "owner kind"),
            _f("owner_id", cells.u64),
            _extra("created_at", cells.timestamp),
            _extra("created_by", cells.optional_u64),
        )
    ),
    "metadata": Table((_f("total_downloads", cells.u64),), optional=True),
    "default_versions": Table(
        (_f("crate_id", cells.u64), _f("num_versions", cells.u64), _f("version_id", cells.u64)),
        optional=True,
    ),
    "reserved_crate_names": Table((_f("name", cells.text),), optional=True),
}


def read_text(spark: SparkSession, path: str, free_text: bool) -> DataFrame:
    """All cells as text.  Only tables with free text give up split reading."""
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", free_text)
        .option("mode", "FAILFAST")
        .option("nullValue", _IMPOSSIBLE)
        .option("inferSchema", False)
        .csv(path)
    )


def _present(raw: DataFrame, table: Table) -> list[tuple[Field, Column]]:
    have = set(raw.columns)
    out = []
    for field in table.fields:
        if field.header in have:
            out.append((field, F.coalesce(F.col(f"`{field.header}`"), F.lit(""))))
        elif not field.optional:
            raise ValueError(f"column '{field.header}' is missing")
    return out


def typed(raw: DataFrame, table_name: str) -> DataFrame:
    """Project to the typed columns; any bad cell is a job error."""
    fields = _present(raw, TABLES[table_name])
    return raw.select(
        *[cells.strict(f.convert(c), f.what, c).alias(f.name) for f, c in fields]
    )


def typed_with_quarantine(raw: DataFrame, table_name: str) -> tuple[DataFrame, DataFrame]:
    """Good rows typed, bad rows as read plus the names of their bad columns."""
    fields = _present(raw, TABLES[table_name])
    bad = F.array_compact(
        F.array(*[F.when(~f.convert(c).valid, F.lit(f.name)) for f, c in fields])
    )
    marked = raw.withColumn("_bad", bad)
    good = marked.filter(F.size("_bad") == 0).select(
        *[f.convert(c).value.alias(f.name) for f, c in fields]
    )
    return good, marked.filter(F.size("_bad") > 0).withColumnRenamed("_bad", "bad_columns")


def read_table(spark: SparkSession, folder: str, name: str, snapshot_at: str | None = None) -> DataFrame:
    """One typed table; ``snapshot_at`` stamps rows with the age of the dump."""
    table = typed(read_text(spark, f"{folder}/{name}.csv", TABLES[name].free_text), name)
    if snapshot_at is not None:
        table = table.withColumn("snapshot_at", F.lit(snapshot_at).cast("timestamp"))
    return table


def convert_dump(spark: SparkSession, folder: str, target: str, snapshot_at: str, names: list[str] | None = None) -> None:
    """Turn a landed dump into Parquet tables, one folder each."""
    for name in names or [n for n, t in TABLES.items() if not t.optional]:
        read_table(spark, folder, name, snapshot_at).write.mode("overwrite").parquet(f"{target}/{name}")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rows`` in one job; Parquet answers from its footers."""
    counted = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out
