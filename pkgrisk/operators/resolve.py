"""Package requests: parsing, lookup, latest version, name suggestions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgrisk.functions.distance import MAX_DELETED, deletion_keys, edit_distance
from pkgrisk.functions.semver import is_semver, semver_key
from pkgrisk.functions.text import did_you_mean, normalize_name, repository
from pkgrisk.session import Scratch, wide

# Suggestion limits, placeholder version, outcome names.
MAX_SUGGESTIONS = 3
# Pieces of a name beyond those that a similar name must share; the commonest are left out.
SPARE_PIECES = 1
NAMES_PER_PARTITION = 10_000
# Bits that a sketch of keys has for each name, some 13 a key, up to 32 MB; beyond that it lets more keys through.
BITS_PER_NAME = 1024
BITMAP_BITS = 32_768
MAX_BITMAPS = 8192
MIN_SCORE = 0.8
MIN_SUGGESTABLE_BYTES = 5
PLACEHOLDER_VERSION = "0.0.0"
FOUND, CRATE_NOT_FOUND, VERSION_NOT_FOUND = "Found", "CrateNotFound", "VersionNotFound"
INVALID_REQUEST = "InvalidRequest"


def parse_requests(df: DataFrame, text: str = "request") -> DataFrame:
    """``name[@version]`` text to ``name, version, error``; the first '@' splits."""
    raw = F.col(text)
    has_version = F.instr(raw, "@") > 0
    name = F.substring_index(raw, "@", 1)
    version = F.when(has_version, F.substring(raw, F.length(name) + 2, F.length(raw)))
    bad = has_version & ~F.coalesce(is_semver(version), F.lit(False))
    error = F.when(bad, F.format_string("cannot parse version '%s' in request '%s'", version, raw))
    return df.select(
        name.alias("name"), F.when(~bad, version).alias("version"), error.alias("error")
    )


def deduplicate(requests: DataFrame) -> DataFrame:
    return requests.dropDuplicates(["name", "version"])


def latest_versions(versions: DataFrame) -> DataFrame:
    """Greatest version per package; pre-releases and yanked versions included."""
    others = [c for c in versions.columns if c != "crate_id"]
    ids = [c for c in ("id", "version_id") if c in others]
    return (
        versions.groupBy("crate_id")
        .agg(F.max_by(F.struct(*others), F.struct(semver_key(F.col("num")), *ids)).alias("_v"))
        .select("crate_id", "_v.*")
    )


def resolve(requests: DataFrame, crates: DataFrame, versions: DataFrame) -> DataFrame:
    """Outcome of every request.

    ``requests(name, version)``, ``crates(id, name)``, ``versions(id, crate_id, num)``.
    Answers ``name, requested, version, status, crate_id, version_id``.  Only the
    versions of requested packages go through the latest-version aggregate.
    """
    asked = deduplicate(requests).select("name", F.col("version").alias("requested"))
    known = asked.join(
        crates.select(F.col("id").alias("crate_id"), "name"), "name", "left"
    )
    ids = known.filter(F.col("crate_id").isNotNull()).select("crate_id").distinct()
    relevant = versions.select(F.col("id").alias("version_id"), "crate_id", "num").join(
        ids, "crate_id", "left_semi"
    )
    newest = latest_versions(relevant).select(
        "crate_id",
        F.col("version_id").alias("latest_id"),
        F.col("num").alias("latest_num"),
    )
    # A registry holds a version once; the pair key keeps it that way.
    exact = relevant.groupBy("crate_id", F.col("num").alias("requested")).agg(
        F.min("version_id").alias("exact_id")
    )
    joined = known.join(newest, "crate_id", "left").join(exact, ["crate_id", "requested"], "left")
    wants_latest = F.col("requested").isNull()
    version_id = F.when(wants_latest, F.col("latest_id")).otherwise(F.col("exact_id"))
    return joined.select(
        "name",
        "requested",
        F.coalesce("requested", "latest_num", F.lit(PLACEHOLDER_VERSION)).alias("version"),
        F.when(F.col("crate_id").isNull(), CRATE_NOT_FOUND)
        .when(version_id.isNull(), VERSION_NOT_FOUND)
        .otherwise(FOUND)
        .alias("status"),
        "crate_id",
        version_id.alias("version_id"),
    )


def with_repository(df: DataFrame, url: str = "repository") -> DataFrame:
    return df.withColumn("repo", repository(F.col(url)))


def deduplicate_specs(specs: DataFrame) -> DataFrame:
    """One row per resolved (name, version, repository)."""
    return specs.dropDuplicates(["name", "version", "repo"])


def fan_out_by_repo(packages: DataFrame, per_repo: DataFrame) -> DataFrame:
    """Give every package the facts that were computed once for its repository."""
    return packages.join(per_repo, "repo", "left")


# --------------------------------------------------------------------------
# Suggestions


def _layout(lengths: DataFrame) -> DataFrame:
    """Where to look for an unharmed piece of a wanted name.

    A similar pair has distance d <= k = max(length) / 5.  Of those edits, the
    length difference ``gap`` is forced insertions or deletions, which harm at
    most one piece each; any other edit harms at most two.  Cut into
    ``2k - gap + 1 + SPARE_PIECES`` pieces, the wanted name therefore keeps
    1 + SPARE_PIECES of them whole, each at an offset limited by the edits on
    either side of it, so the SPARE_PIECES commonest need no look.  The table
    depends on the distinct name lengths only.
    """
    pairs = (
        lengths.withColumn(
            "offered_len",
            F.explode(
                F.sequence(
                    F.ceil(F.col("wanted_len") * 4 / 5).cast("int"),
                    F.floor(F.col("wanted_len") * 5 / 4).cast("int"),
                )
            ),
        )
        .withColumn("shift_by", F.col("offered_len") - F.col("wanted_len"))
        .withColumn("gap", F.abs("shift_by"))
        .withColumn("k", F.floor(F.greatest("offered_len", "wanted_len") / 5).cast("int"))
        .filter(f"gap <= k and k > {MAX_DELETED}")
        .withColumn("pieces", F.expr(f"least(2 * k - gap + 1 + {SPARE_PIECES}, wanted_len)"))
        .withColumn("spare", F.expr("pieces - (2 * k - gap + 1)"))
    )
    return (
        pairs.withColumn("i", F.explode(F.expr("sequence(0, pieces - 1)")))
        .withColumn("cut_at", F.expr("cast(i * wanted_len div pieces as int)"))
        .withColumn("cut_len", F.expr("cast((i + 1) * wanted_len div pieces as int) - cut_at"))
        .withColumn(
            "move",
            F.explode(
                F.expr(
                    "sequence(cast(ceil((shift_by - k) / 2) as int), cast(floor((shift_by + k) / 2) as int))"
                )
            ),
        )
        .withColumn("at", F.col("cut_at") + F.col("move"))
        .filter("at >= 0 and at + cut_len <= offered_len")
        .select("wanted_len", "offered_len", "k", "i", "spare", "cut_at", "cut_len", "at")
        .distinct()
    )


def _letters(text: str) -> Column:
    """The set of characters as bits.  An edit changes at most two of them."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0).cast("bigint"),
        lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(c) % 64)),
    )


def _forms(names: DataFrame, name: str, form: str) -> DataFrame:
    """Distinct names and their normal forms, written once since they are read for keys, for pieces and for the result."""
    distinct = names.filter("name is not null").select(F.col("name").alias(name)).distinct()
    return Scratch(names.sparkSession, "names").save(distinct.withColumn(form, normalize_name(F.col(name))), name)


def _keys(forms: DataFrame, form: str, held: Broadcast | None = None) -> DataFrame:
    """``key, <form>``: hashes of what deletions leave of each form, see ``deletion_keys``."""
    parts = max(int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-forms.count() // NAMES_PER_PARTITION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return deletion_keys(batches, None if held is None else held.value)

    distinct = forms.select(form).distinct().repartition(parts, form)
    return distinct.mapInArrow(run, "key bigint, name string").withColumnRenamed("name", form)


def _key_sketch(forms: DataFrame, form: str) -> Broadcast:
    """Bits of the keys of all forms by their remainder, so that most keys of the other side need no shuffle."""
    spark = forms.sparkSession
    bitmaps = min(max(forms.count() * BITS_PER_NAME // BITMAP_BITS, 1), MAX_BITMAPS)
    # Bitmaps count from 1.
    bit = F.pmod("key", F.lit(bitmaps * BITMAP_BITS).cast("bigint")) + 1
    bits = _keys(forms, form).select(F.bitmap_bucket_number(bit).alias("bitmap"), F.bitmap_bit_position(bit).alias("at"))
    sketch = np.zeros((bitmaps, BITMAP_BITS // 8), dtype=np.uint8)
    # Bits lie by bitmap before they are set, so no task makes bitmaps of all.
    for row in bits.repartition("bitmap").groupBy("bitmap").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator():
        sketch[row["bitmap"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(sketch.reshape(-1))


def _sharing_pieces(w: DataFrame, o: DataFrame) -> DataFrame:
    """Pairs ``w, o`` of long forms that may be similar.

    They come from an equi join on (length, position, piece), see ``_layout``,
    thinned by a lower bound on the letters used.
    """
    # A longer name of 25 letters has a shorter one of 20 at least.
    long = F.lit(4 * (MAX_DELETED + 1))
    w = w.select("w").distinct().withColumn("wanted_len", F.length("w")).filter(F.col("wanted_len") >= long).withColumn("w_letters", _letters("w"))
    o = o.select("o").distinct().withColumn("offered_len", F.length("o")).filter(F.col("offered_len") >= long).withColumn("o_letters", _letters("o"))
    layout = _layout(w.select("wanted_len").distinct())
    spots = layout.select("offered_len", "at", "cut_len").distinct()

    def piece(text: str, at: str) -> Column:
        return F.col(text).substr(F.col(at) + 1, F.col("cut_len"))

    place = ["offered_len", "at", "cut_len", "piece"]
    asked = w.join(layout, "wanted_len").withColumn("piece", piece("w", "cut_at"))
    held = o.join(spots, "offered_len").withColumn("piece", piece("o", "at"))
    # Of each wanted name the commonest pieces are left out, as many as are to spare.
    common = held.groupBy(*place).agg(F.count(F.lit(1)).alias("names"))
    cost = asked.join(common, place).groupBy("w", "offered_len", "i", "spare").agg(F.sum("names").alias("names"))
    dearest = Window.partitionBy("w", "offered_len").orderBy(F.desc("names"), "i")
    looked = cost.withColumn("rank", F.row_number().over(dearest)).filter(F.col("rank") > F.col("spare")).select("w", "offered_len", "i")
    return (
        asked.join(looked, ["w", "offered_len", "i"])
        .join(held, place)
        .filter(F.bit_count(F.col("w_letters").bitwiseXOR(F.col("o_letters"))) <= 2 * F.col("k"))
        .select("w", "o")
    )


def _candidate_forms(w: DataFrame, o: DataFrame) -> DataFrame:
    """Pairs of normal forms that may be similar, once each; no similar pair is missing.

    Up to MAX_DELETED edits they share what deletions leave of both, which few
    other pairs do, however the names are made; longer ones share a piece.
    """
    # A pair may share several keys and pieces; it is compared once.
    # A name has some hundred keys, which are estimated by the names.
    pairs = _keys(w, "w").join(wide(_keys(o, "o", _key_sketch(w, "w"))), "key").select("w", "o").unionByName(_sharing_pieces(w, o)).distinct()
    sized = pairs.withColumn("wanted_len", F.length("w")).withColumn("offered_len", F.length("o"))
    return sized.withColumn("k", F.floor(F.greatest("offered_len", "wanted_len") / 5).cast("int"))


def candidate_names(wanted: DataFrame, offered: DataFrame, min_bytes: int = MIN_SUGGESTABLE_BYTES) -> DataFrame:
    """Pairs that may be similar, once each; no similar pair is missing."""
    w = _forms(wanted.filter(F.octet_length("name") >= min_bytes), "wanted", "w")
    o = _forms(offered, "offered", "o")
    return _candidate_forms(w, o).join(wide(w), "w").join(wide(o), "o").select("wanted", "offered", "w", "o", "k", "wanted_len", "offered_len")


def similar_names(wanted: DataFrame, offered: DataFrame, min_bytes: int = MIN_SUGGESTABLE_BYTES) -> DataFrame:
    """All pairs ``wanted, offered, score`` with similarity of at least 0.8.

    Both inputs have a ``name``.  The plain edit distance, a lower bound, thins
    the candidates; only the rest reaches the Arrow batches, each pair of normal
    forms once.
    """
    w = _forms(wanted.filter(F.octet_length("name") >= min_bytes), "wanted", "w")
    o = _forms(offered, "offered", "o")
    near = _candidate_forms(w, o).filter(F.levenshtein("w", "o") <= 2 * F.col("k"))
    longest = F.greatest("wanted_len", "offered_len")
    scored = (
        near.withColumn("d", edit_distance("w", "o"))
        .filter(F.col("d") <= F.col("k"))
        .select("w", "o", F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.col("d") / longest).alias("score"))
    )
    return scored.join(wide(w), "w").join(wide(o), "o").select("wanted", "offered", "score")


def suggest_names(
    missing: DataFrame,
    crates: DataFrame,
    requested: DataFrame | None = None,
    limit: int = MAX_SUGGESTIONS,
) -> DataFrame:
    """``name, suggestions``: the best ``limit`` names per missing name.

    A name that is itself requested is never offered.
    """
    offered = crates.select("name")
    if requested is not None:
        offered = offered.join(wide(requested.select("name").distinct()), "name", "left_anti")
    best = Window.partitionBy("wanted").orderBy(F.desc("score"), F.asc("offered"))
    return (
        similar_names(missing, offered)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= limit)
        .groupBy(F.col("wanted").alias("name"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "offered"))).alias("_s"))
        .select("name", F.col("_s.offered").alias("suggestions"))
    )


def with_suggestions(resolved: DataFrame, crates: DataFrame) -> DataFrame:
    """Attach ``suggestions array<string>`` to the requests that were not found."""
    missing = resolved.filter(F.col("status") == CRATE_NOT_FOUND)
    found = suggest_names(missing, crates, resolved)
    none = F.array().cast("array<string>")
    return resolved.join(found, "name", "left").withColumn(
        "suggestions",
        F.when(F.col("status") == CRATE_NOT_FOUND, F.coalesce("suggestions", none)),
    )


def analysable(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("status") == FOUND)


def failures(resolved: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Rows that cannot be analysed, with the text a user sees.

    ``parsed``: the parsed requests, whose errors are failures too.
    """
    hint = did_you_mean(F.coalesce("suggestions", F.array().cast("array<string>")))
    not_found = F.concat(
        F.format_string("Could not find information on crate '%s'", F.col("name")),
        F.when(hint != "", F.concat(F.lit(". "), hint)).otherwise(F.lit("")),
    )
    no_version = F.format_string(
        "Could not find information on version %s of crate `%s`", F.col("version"), F.col("name")
    )
    failed = resolved.filter(F.col("status") != FOUND).select(
        "name",
        "version",
        "status",
        F.when(F.col("status") == CRATE_NOT_FOUND, not_found)
        .when(F.col("status") == VERSION_NOT_FOUND, no_version)
        .alias("message"),
    )
    if parsed is None:
        return failed
    unread = parsed.filter("error is not null").select(
        "name", "version", F.lit(INVALID_REQUEST).alias("status"), F.col("error").alias("message")
    )
    return failed.unionByName(unread.distinct())
