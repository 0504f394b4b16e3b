"""Name normalisation, repository links and report text."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(name: Column) -> Column:
    """ASCII lower case without '-', '_' and blanks; one character per byte."""
    folded = F.translate(name, string.ascii_uppercase + "-_ ", string.ascii_lowercase)
    return F.decode(F.encode(folded, "UTF-8"), "ISO-8859-1")


def repository(url: Column) -> Column:
    """``struct<host, owner, repo, url>``; NULL unless host/owner/repo are there."""
    path = F.split(F.try_parse_url(url, F.lit("PATH")), "/")
    owner = F.get(path, F.lit(1))
    repo = F.get(path, F.lit(2))
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    name = F.regexp_replace(repo, r"(\.git)+$", "")
    sound = host.isNotNull() & (F.coalesce(owner, F.lit("")) != "") & (F.coalesce(repo, F.lit("")) != "")
    return F.when(
        sound,
        F.struct(
            host.alias("host"),
            owner.alias("owner"),
            name.alias("repo"),
            F.concat(scheme, F.lit("://"), F.concat_ws("/", host, owner, name)).alias("url"),
        ),
    )


def is_url(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://")


def tags(c: Column) -> Column:
    """'a, b' becomes '#a, #b'."""
    marked = F.transform(F.split(c, ","), lambda x: F.concat(F.lit("#"), F.trim(x)))
    return F.when(c == "", F.lit("")).otherwise(F.array_join(marked, ", "))


def did_you_mean(names: Column) -> Column:
    """'' / one / "a or b" / "a, b, or c"."""
    quoted = F.transform(names, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    n = F.size(quoted)
    head = F.array_join(F.slice(quoted, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.get(quoted, n - 1)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.concat(F.lit("Did you mean "), last, F.lit("?")))
        .when(n == 2, F.concat(F.lit("Did you mean "), head, F.lit(" or "), last, F.lit("?")))
        .otherwise(F.concat(F.lit("Did you mean "), head, F.lit(", or "), last, F.lit("?")))
    )


def csv_cell(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[",\n\r]'), quoted).otherwise(c)
