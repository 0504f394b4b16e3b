"""Issue, pull-request and repository statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.stats import (
    AGE_FIELDS,
    SECONDS_PER_DAY,
    WINDOW_DAYS,
    age_histogram,
    ages_from_histogram,
    days_before,
    window_counts,
)

# Supported hosts and whether watchers stand for subscribers.
HOSTS = {"github.com": False, "codeberg.org": True}
LOOKBACK_DAYS = 3650

# Count families and age series.
COUNT_FAMILIES = ("issues_opened", "issues_closed", "prs_opened", "prs_merged", "prs_closed")
OPEN_SERIES = ("open_issue_age", "open_pr_age")
CLOSED_SERIES = ("closed_issue_age", "merged_pr_age")

def _is_pr() -> Column:
    return F.col("pull_request").isNotNull()


_MERGED = "pull_request.merged_at"


def age_series_names(days: Sequence[int] = WINDOW_DAYS) -> list[str]:
    return [*OPEN_SERIES] + [
        s for base in CLOSED_SERIES for s in (base, *[f"{base}_last_{d}_days" for d in days])
    ]


def lookback(issues: DataFrame, now: Column, days: int | None = None) -> DataFrame:
    """Issues created in the last ``days``; all of them by default."""
    return issues if days is None else issues.filter(F.col("created_at") >= days_before(now, days))


def issue_counts(issues: DataFrame, now: Column, days: Sequence[int] = WINDOW_DAYS) -> DataFrame:
    """Open counts and the five windowed families in one pass."""
    is_pr, is_open = _is_pr(), F.col("state") == "open"
    created, closed, merged = F.col("created_at"), F.col("closed_at"), F.col(_MERGED)
    return issues.groupBy("repo").agg(
        F.count_if(~is_pr & is_open).alias("open_issues"),
        F.count_if(is_pr & is_open).alias("open_prs"),
        *window_counts(created, now, "issues_opened", days, ~is_pr),
        *window_counts(closed, now, "issues_closed", days, ~is_pr),
        *window_counts(created, now, "prs_opened", days, is_pr),
        *window_counts(merged, now, "prs_merged", days, is_pr),
        *window_counts(closed, now, "prs_closed", days, is_pr),
    )


def issue_ages(
    issues: DataFrame, now: Column, days: Sequence[int] = WINDOW_DAYS, series: Sequence[str] | None = None
) -> DataFrame:
    """``repo, series, avg, p50, p75, p90, p95`` in whole days.

    An issue is counted once per series with the narrowest window it falls in;
    the nested windows are unrolled on the day histogram, not on the issues.
    """
    is_pr, is_open = _is_pr(), F.col("state") == "open"
    created, closed, merged = F.col("created_at"), F.col("closed_at"), F.col(_MERGED)
    everything = len(days)

    def seconds(until: Column) -> Column:
        return F.timestamp_diff("SECOND", created, until).cast("double")

    def narrowest(ts: Column) -> Column:
        out = F.lit(everything)
        for i in reversed(range(everything)):
            out = F.when(ts >= days_before(now, days[i]), F.lit(i)).otherwise(out)
        return out

    def entry(name: str, until: Column, window: Column) -> Column:
        return F.when(
            until.isNotNull(), F.struct(F.lit(name).alias("family"), window.alias("window"), seconds(until).alias("s"))
        )

    # An issue is in one series by its state; a pull request may also be merged.
    none = F.lit(everything)
    by_state = (
        F.when(~is_pr & is_open, entry("open_issue_age", now, none))
        .when(is_pr & is_open, entry("open_pr_age", now, none))
        .when(~is_pr, entry("closed_issue_age", closed, narrowest(closed)))
    )
    as_merged = F.when(is_pr, entry("merged_pr_age", merged, narrowest(merged)))
    rows = (
        issues.select("repo", F.explode(F.array(by_state, as_merged)).alias("e"))
        .filter(F.col("e").isNotNull())
        .select("repo", "e.*")
    )
    hist = age_histogram(rows, ["repo", "family", "window"], F.col("s"))
    return ages_of_windows(hist, days, series)


def ages_of_windows(hist: DataFrame, days: Sequence[int] = WINDOW_DAYS, series: Sequence[str] | None = None) -> DataFrame:
    """Statistics of each series from ``repo, family, window, day, n, seconds`` by narrowest window."""
    everything = len(days)
    unrolled = hist.withColumn("window", F.explode(F.sequence(F.col("window"), F.lit(everything))))
    label = F.col("family")
    for i, d in enumerate(days):
        label = F.when(F.col("window") == i, F.concat("family", F.lit(f"_last_{d}_days"))).otherwise(label)
    named = unrolled.withColumn("series", label)
    if series is not None:
        named = named.filter(F.col("series").isin(*series))
    return ages_from_histogram(named, ["repo", "series"])


def _unix(ts: Column) -> Column:
    """Whole seconds since 1970, rounded up."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp"), ts)
    return F.ceil(micros / 1_000_000)


def age_marks(issues: DataFrame, every: bool = False) -> DataFrame:
    """``repo, issue, family, ended, day, n, seconds``: what each issue adds to its repository's ages, whatever the time is.

    Takes the columns of ``issue_counts`` and ``issue``.  A closed or merged one has the day it ended and its age in days; an open one
    has the day from which its age is counted, and seconds that the time of asking is added to.  Of several rows of one issue an open
    one counts, then the one that was closed last.  ``every``: an issue that adds nothing has a row too, without family and numbers.
    """
    state = F.max(F.struct(F.col("state"), F.col("closed_at"), F.col("created_at"), F.col(_MERGED).alias("merged_at"), _is_pr().alias("is_pr")))
    one = issues.groupBy("repo", "issue").agg(state.alias("i")).select("repo", "issue", "i.*")
    is_open, created = F.col("state") == "open", _unix(F.col("created_at"))

    def ended(name: str, until: str) -> Column:
        age = F.timestamp_diff("SECOND", F.col("created_at"), F.col(until))
        on = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp"), F.col(until)) / 86_400_000_000)
        return F.when(age >= 0, F.struct(
            F.lit(name).alias("family"), on.alias("ended"), F.floor(age / SECONDS_PER_DAY).alias("day"), age.cast("long").alias("seconds")
        ))

    def going(name: str) -> Column:
        return F.when(created.isNotNull(), F.struct(
            F.lit(name).alias("family"), F.lit(None).cast("long").alias("ended"), F.ceil(created / SECONDS_PER_DAY).alias("day"), (-created).alias("seconds")
        ))

    marks = F.array(
        F.when(~F.col("is_pr") & is_open, going("open_issue_age")).when(is_open, going("open_pr_age"))
        .when(~F.col("is_pr"), ended("closed_issue_age", "closed_at")),
        F.when(F.col("is_pr"), ended("merged_pr_age", "merged_at")),
    )
    unroll = F.explode_outer if every else F.explode
    return one.select("repo", "issue", unroll(F.array_compact(marks)).alias("m")).select(
        "repo", "issue", "m.family", "m.ended", "m.day", F.when(F.col("m").isNotNull(), F.lit(1).cast("long")).alias("n"), "m.seconds"
    )


def ages_at(marks: DataFrame, today: Column, days: Sequence[int] = WINDOW_DAYS, series: Sequence[str] | None = None) -> DataFrame:
    """``issue_ages`` from summed ``age_marks``, as of the start of the day ``today``."""
    start = today.cast("date").cast("timestamp")
    now, day = _unix(start), F.floor(_unix(start) / SECONDS_PER_DAY)
    window = F.lit(len(days))
    for i in reversed(range(len(days))):
        window = F.when(F.col("ended") >= day - days[i], F.lit(i)).otherwise(window)
    is_open = F.col("ended").isNull()
    hist = marks.select(
        "repo", "family", window.alias("window"),
        F.when(is_open, day - F.col("day")).otherwise(F.col("day")).alias("day"), "n",
        F.when(is_open, F.col("n") * now + F.col("seconds")).otherwise(F.col("seconds")).cast("double").alias("seconds"),
    ).filter("day >= 0")
    hist = hist.groupBy("repo", "family", "window", "day").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"))
    return ages_of_windows(hist, days, series)


def ages_wide(ages: DataFrame, days: Sequence[int] = WINDOW_DAYS) -> DataFrame:
    """One struct column per series; zeros for a series without rows."""
    stats = F.struct(*AGE_FIELDS)
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f) for f in AGE_FIELDS])
    return ages.groupBy("repo").agg(
        *[
            F.coalesce(F.max(F.when(F.col("series") == s, stats)), zero).alias(s)
            for s in age_series_names(days)
        ]
    )


def host_status(repos: DataFrame, host: str = "host") -> DataFrame:
    """``status, reason``: only some hosts can be asked."""
    supported = F.col(host).isin(*HOSTS)
    return repos.withColumn("status", F.when(supported, "Found").otherwise("Unavailable")).withColumn(
        "reason", F.when(~supported, F.concat(F.lit("unsupported hosting provider: "), F.col(host)))
    )


def repo_counters(repos: DataFrame) -> DataFrame:
    """``repo, stars, forks, subscribers``; a negative counter means nothing known."""
    watchers = F.col("host").isin(*[h for h, w in HOSTS.items() if w])
    subscribers = F.when(watchers, F.col("watchers_count")).otherwise(F.col("subscribers_count"))
    return repos.select(
        "repo",
        F.coalesce("stargazers_count", F.lit(0)).cast("bigint").alias("stars"),
        F.coalesce("forks_count", F.lit(0)).cast("bigint").alias("forks"),
        F.greatest(F.coalesce(subscribers, F.lit(0)), F.lit(0)).cast("bigint").alias("subscribers"),
    )


def hosting_facts(repos: DataFrame, issues: DataFrame, now: Column) -> DataFrame:
    """``repo, status, reason, hosting struct`` at repository grain."""
    known = host_status(repos)
    counts = issue_counts(issues, now)
    ages = ages_wide(issue_ages(issues, now))
    count_names = [c for c in counts.columns if c != "repo"]
    zero_age = F.struct(*[F.lit(0).cast("bigint").alias(f) for f in AGE_FIELDS])
    payload = F.struct(
        "stars",
        "forks",
        "subscribers",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in count_names],
        *[F.coalesce(s, zero_age).alias(s) for s in age_series_names()],
    )
    return (
        known.select("repo", "status", "reason")
        .join(repo_counters(repos), "repo")
        .join(counts, "repo", "left")
        .join(ages, "repo", "left")
        .select("repo", "status", "reason", F.when(F.col("status") == "Found", payload).alias("hosting"))
    )
