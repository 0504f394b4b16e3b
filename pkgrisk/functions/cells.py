"""Text cell converters for registry dumps.

Each converter answers two Columns: the typed value and whether the text was
acceptable.  ``strict`` turns a bad cell into a job error; ingest can also send
the row to a quarantine table instead.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from pkgrisk.functions.semver import is_semver

# Edition years the registry knows.
EDITIONS = ("2015", "2018", "2021", "2024")

_EPOCH_TS = "TIMESTAMP '1970-01-01 00:00:00+00:00'"
_TIMESTAMP_TEXT = (
    r"^\d{4}-\d{2}-\d{2}[ Tt]\d{2}:\d{2}:\d{2}(\.\d+)?\s?([Zz]|[+-]\d{2}(:?\d{2})?)$"
)
_DATE_TEXT = r"^\d{4}-\d{1,2}-\d{1,2}$"


class Cell(NamedTuple):
    value: Column
    valid: Column


def strict(cell: Cell, what: str, raw: Column) -> Column:
    message = F.concat(F.lit(f"cannot parse {what} from '"), raw, F.lit("'"))
    return F.when(cell.valid, cell.value).otherwise(F.raise_error(message))


def text(raw: Column) -> Cell:
    """Text columns hold '' where the dump has nothing."""
    return Cell(F.coalesce(raw, F.lit("")), F.lit(True))


def u64(raw: Column) -> Cell:
    value = raw.try_cast("bigint")
    return Cell(value, F.coalesce(raw.rlike(r"^\+?[0-9]+$") & value.isNotNull(), F.lit(False)))


def optional_u64(raw: Column) -> Cell:
    inner = u64(raw)
    empty = F.coalesce(raw, F.lit("")) == ""
    return Cell(F.when(~empty, inner.value), empty | inner.valid)


def optional_id(raw: Column) -> Cell:
    """-1 is the dump's way of saying that there is no id."""
    inner = optional_u64(F.when(raw == "-1", F.lit("")).otherwise(raw))
    return Cell(inner.value, inner.valid)


def boolean(raw: Column) -> Cell:
    known = F.coalesce(raw, F.lit(""))
    return Cell(known.isin("t", "true"), known.isin("t", "true", "f", "false", ""))


def timestamp(raw: Column) -> Cell:
    """Dump or RFC 3339 form, in UTC, whole seconds, never before the epoch."""
    shaped = F.when(raw.rlike(_TIMESTAMP_TEXT), raw).try_cast("timestamp")
    value = F.date_trunc("second", F.greatest(shaped, F.expr(_EPOCH_TS)))
    return Cell(F.when(shaped.isNotNull(), value), shaped.isNotNull())


def date(raw: Column) -> Cell:
    shaped = F.when(raw.rlike(_DATE_TEXT), raw).try_cast("date")
    value = F.greatest(shaped, F.expr("DATE '1970-01-01'"))
    return Cell(F.when(shaped.isNotNull(), value), shaped.isNotNull())


def url(raw: Column) -> Cell:
    """A usable absolute URL, https:// added if that is all it lacks, else ''."""
    known = F.coalesce(raw, F.lit(""))
    with_scheme = F.concat(F.lit("https://"), known)
    value = (
        F.when(known == "", F.lit(""))
        .when(F.try_parse_url(known, F.lit("PROTOCOL")).isNotNull(), known)
        .when(F.try_parse_url(with_scheme, F.lit("HOST")).isNotNull(), with_scheme)
        .otherwise(F.lit(""))
    )
    return Cell(value, F.lit(True))


def version(raw: Column) -> Cell:
    return Cell(raw, F.coalesce(is_semver(raw), F.lit(False)))


def pg_array(raw: Column) -> Cell:
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    value = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))
    return Cell(value, F.coalesce(raw.startswith("{") & raw.endswith("}"), F.lit(False)))


def features(raw: Column) -> Cell:
    value = F.from_json(raw, "map<string,array<string>>")
    return Cell(value, value.isNotNull())


def edition(raw: Column) -> Cell:
    known = F.coalesce(raw, F.lit(""))
    value = F.when(known == "", F.lit(None)).when(known.isin(*EDITIONS), known).otherwise(F.lit("unknown"))
    return Cell(value, F.lit(True))


def one_of(*codes: str):
    """A small integer code out of a fixed set."""

    def convert(raw: Column) -> Cell:
        return Cell(raw.try_cast("int"), F.coalesce(raw.isin(*codes), F.lit(False)))

    return convert
