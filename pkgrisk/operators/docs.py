"""Metrics of documentation JSON: coverage, examples, broken links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.session import Scratch

# Accepted format versions and the link syntax looked for.
FORMAT_VERSIONS = (50, 57)
CODE_BLOCK = r"```[\s\S]*?```"
FENCE_LINE = r"(?md)^[^\S\n]*```"
LINK = r"\[`([^`\]]+)`\](?=(\(|\[[^\]]*\])?)"
LINK_DEFINITION = r"\[`([^`\]]+)`\]:\s*(\S+)"


# What is read of a document; anything else is skipped while parsing, so no
# value but a single text has a size limit.
ITEM = (
    "struct<visibility: string, name: string, docs: string, links: map<string, string>, "
    "inner: struct<`use`: string>>"
)
DOCUMENT = f"struct<format_version: string, root: string, index: map<string, {ITEM}>, _bad: string>"
_READ = {
    "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad",
    "maxStringLen": str(2**31 - 1), "maxNestingDepth": "100000",
}


def parsed(docs_json: DataFrame) -> DataFrame:
    """Adds ``doc``, ``status`` and ``reason`` to ``body`` rows."""
    # A value of another type than expected spoils its own field only; text that is no JSON object to its end is malformed.
    broken = F.col("doc._bad").isNotNull() & F.json_object_keys("body").isNull()
    reason = _reason(F.col("doc").isNull() | broken, F.col("doc.format_version"))
    return (
        docs_json.withColumn("doc", F.from_json("body", DOCUMENT, _READ))
        .withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason").isNull(), "Found").otherwise("Unavailable"))
        .drop("body")
    )


def _reason(broken: Column, format_version: Column) -> Column:
    """Why a document can't be read; NULL if it can."""
    low, high = FORMAT_VERSIONS
    version = format_version.try_cast("bigint")
    return (
        F.when(broken, "malformed JSON")
        .when(version.isNull(), "missing 'format_version' field")
        .when(~version.between(low, high), F.concat(F.lit("unsupported format version "), version.cast("string")))
    )


def items(docs: DataFrame) -> DataFrame:
    """``package, version, id, root, counts, name, docs, links`` of every item.

    ``counts`` is true for public items that are not re-exports.  A document
    without items keeps one row, so that no join has to bring it back.
    """
    exploded = docs.filter(F.col("status") == "Found").select(
        "package", "version", F.col("doc.root").alias("root"), F.explode_outer("doc.index").alias("id", "item")
    )
    return exploded.select(
        "package",
        "version",
        "id",
        "root",
        _counts(F.col("item")).alias("counts"),
        "item.name",
        "item.docs",
        "item.links",
    )


def _counts(item: Column) -> Column:
    return F.coalesce((item["visibility"] == "public") & item["inner"]["use"].isNull(), F.lit(False))


def has_docs(docs: Column) -> Column:
    return F.coalesce(docs.rlike(r"(?U)\S"), F.lit(False))


def example_count(docs: Column) -> Column:
    """Half the lines that begin a code fence, rounded down."""
    return F.floor(F.regexp_count(docs, F.lit(FENCE_LINE)) / 2)


def broken_links(docs: Column, links: Column) -> Column:
    """Backtick links outside code blocks that resolve to nothing.

    Inline links, URLs and texts of one or two bytes are not looked at.
    ``links`` maps resolved link texts to item ids.
    """
    text = F.regexp_replace(docs, CODE_BLOCK, "")
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(LINK), F.lit(1)).alias("label"),
        F.regexp_extract_all(text, F.lit(LINK), F.lit(2)).alias("after"),
    )
    definitions = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(LINK_DEFINITION), F.lit(1)).alias("label"),
        F.regexp_extract_all(text, F.lit(LINK_DEFINITION), F.lit(2)).alias("target"),
    )

    def known(name: Column) -> Column:
        return F.coalesce(F.map_contains_key(links, name), F.lit(False))

    def defined(label: Column) -> Column:
        # The last definition of a label is the one that holds.
        mine = F.filter(definitions, lambda d: d["label"] == label)
        return known(F.get(mine, F.size(mine) - 1)["target"])

    def resolved(link: Column) -> Column:
        label = link["label"]
        bare = F.regexp_replace(label, r"\(\)$", "")
        tick = F.lit("`")
        inline = F.when(
            link["after"].startswith("["), F.substring(link["after"], F.lit(2), F.length(link["after"]) - 2)
        )
        tail = F.when(F.contains(bare, F.lit("::")), F.substring_index(bare, "::", -1))
        return (
            known(label)
            | known(bare)
            | known(F.concat(tick, label, tick))
            | known(F.concat(tick, bare, tick))
            | known(inline)
            | defined(label)
            | defined(bare)
            | known(tail)
            | defined(tail)
        )

    broken = F.filter(
        found,
        lambda link: (link["after"] != "(")
        & ~F.contains(link["label"], F.lit("://"))
        & (F.octet_length(link["label"]) > 2)
        & ~resolved(link),
    )
    return F.size(broken)


def docs_metrics(docs: DataFrame) -> DataFrame:
    """``package, version, docs struct`` for every readable document."""
    documented = F.col("counts") & has_docs(F.col("docs"))
    is_front = (F.col("id") == F.col("root")) & _front_name(F.col("name"))
    zero = F.lit(0).cast("bigint")
    counted = items(docs).groupBy("package", "version").agg(
        F.count_if(F.col("counts")).alias("public_api_elements"),
        F.count_if(documented).alias("documented"),
        F.coalesce(F.bool_or(documented & is_front), F.lit(False)).alias("has_crate_level_docs"),
        F.coalesce(
            F.sum(F.when(documented, broken_links(F.col("docs"), F.col("links")))), zero
        ).alias("broken_doc_links"),
        F.coalesce(F.sum(F.when(documented, example_count(F.col("docs")))), zero).alias("examples_in_docs"),
    )
    return counted.select("package", "version", _payload().alias("docs"))


def _front_name(name: Column) -> Column:
    return name == F.replace("package", F.lit("-"), F.lit("_"))


def _payload() -> Column:
    n, covered = F.col("public_api_elements"), F.col("documented")
    return F.struct(
        n,
        (n - covered).alias("undocumented_elements"),
        F.when(n > 0, covered / n * 100.0).otherwise(F.lit(100.0)).alias("doc_coverage_percentage"),
        "has_crate_level_docs",
        "broken_doc_links",
        "examples_in_docs",
    )


LINE = f"struct<format_version: string, root: string, id: string, item: {ITEM}, _bad: string>"


def docs_facts_of_lines(lines: DataFrame) -> DataFrame:
    """``docs_facts`` of documents landed one item a line: ``package, version, body`` rows.

    A document is a head line ``{"format_version": .., "root": ..}`` and a line ``{"id": .., "item": {..}}`` for each item, in any order
    and in any number of files, so that its items are read by many tasks.  Only numbers are shuffled, combined first; the front page is
    met by its id.  A document with a line that is no JSON object is malformed; the largest of several heads counts.
    """
    line = F.col("line")
    broken = line.isNull() | line["_bad"].isNotNull() & F.json_object_keys("body").isNull()
    is_item = line["id"].isNotNull()
    counts = is_item & _counts(line["item"])
    documented = counts & has_docs(line["item"]["docs"])
    text, links = line["item"]["docs"], line["item"]["links"]
    read = lines.filter("body IS NULL OR body RLIKE '\\\\S'").withColumn("line", F.from_json("body", LINE, _READ)).select(
        "package", "version", broken.alias("broken"),
        F.when(~is_item, F.struct(line["format_version"].alias("format_version"), line["root"].alias("root"))).alias("head"),
        counts.cast("long").alias("counts"), documented.cast("long").alias("documented"),
        F.when(documented, broken_links(text, links)).otherwise(0).cast("long").alias("broken_links"),
        F.when(documented, example_count(text)).otherwise(0).cast("long").alias("examples"),
        F.when(documented & _front_name(line["item"]["name"]), line["id"]).alias("front"),
    )
    read = Scratch(lines.sparkSession, "docs-lines").save(read, "lines")
    counted = read.groupBy("package", "version").agg(
        F.max("broken").alias("broken"), F.max("head").alias("head"), F.sum("counts").alias("public_api_elements"), F.sum("documented").alias("documented"),
        F.sum("broken_links").alias("broken_doc_links"), F.sum("examples").alias("examples_in_docs"),
    )
    front = read.filter("front IS NOT NULL").select(F.col("package").alias("_package"), F.col("version").alias("_version"), "front").distinct()
    same = (F.col("package") == F.col("_package")) & F.col("version").eqNullSafe(F.col("_version")) & (F.col("head.root") == F.col("front"))
    known = counted.join(front, same, "left").withColumn("has_crate_level_docs", F.col("front").isNotNull())
    reason = _reason(F.coalesce("broken", F.lit(False)), F.col("head.format_version"))
    known = known.withColumn("reason", reason)
    found = F.col("reason").isNull()
    return known.select(
        F.col("package").alias("name"), "version", F.when(found, "Found").otherwise("Unavailable").alias("status"), "reason", F.when(found, _payload()).alias("docs")
    )


def docs_facts(docs_json: DataFrame) -> DataFrame:
    """``name, version, status, reason, docs`` from ``package, version, body`` rows."""
    docs = parsed(docs_json)
    good = docs_metrics(docs).withColumn("status", F.lit("Found")).withColumn("reason", F.lit(None).cast("string"))
    bad = docs.filter(F.col("status") != "Found").select("package", "version", "status", "reason")
    return (
        good.unionByName(bad, allowMissingColumns=True)
        .select(F.col("package").alias("name"), "version", "status", "reason", "docs")
    )
