"""Policies over metrics: rule outcomes, weighted score, risk, gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pkgrisk.functions.semver import requirement_matches
from pkgrisk.operators.metrics import default_metrics
from pkgrisk.sources.policy import Allowed, Policy, Rule

# Outcome and risk names.
TRUE, FALSE, FAILED = "TRUE", "FALSE", "FAILED"
LOW, MEDIUM, HIGH = "LOW", "MEDIUM", "HIGH"
NO_VALUE = "no value"

_OUTCOME = "array<struct<name: string, description: string, disposition: string, message: string>>"


@dataclass(frozen=True)
class Compiled:
    rule: Rule
    column: str
    expression: Column
    error: str | None

    def disposition(self) -> Column:
        c = F.col(self.column)
        return F.when(c.isNull(), FAILED).when(c, TRUE).otherwise(FALSE)

    def outcome(self) -> Column:
        message = F.lit(self.error or NO_VALUE)
        return F.struct(
            F.lit(self.rule.name).alias("name"),
            F.lit(self.rule.text).alias("description"),
            self.disposition().alias("disposition"),
            F.when(F.col(self.column).isNull(), message).alias("message"),
        )


def compile_rules(metrics: DataFrame, rules: tuple[Rule, ...], prefix: str) -> list[Compiled]:
    """Check each rule on its own, so that a bad one fails alone, not the job.

    Only analysis runs here.  A rule that names an unknown metric or is not
    boolean becomes a constant failure.
    """
    out = []
    for i, rule in enumerate(rules):
        error, expression = None, F.lit(None).cast("boolean")
        try:
            kind = metrics.select(F.expr(rule.expression).alias("r")).schema["r"].dataType
            if isinstance(kind, BooleanType):
                expression = F.expr(rule.expression)
            else:
                error = f"expression '{rule.name}' did not return a boolean, got '{kind.simpleString()}' instead"
        except (AnalysisException, ParseException) as problem:
            error = str(problem).strip().splitlines()[0]
        out.append(Compiled(rule, f"_{prefix}{i}", expression, error))
    return out


def appraise(metrics: DataFrame, policy: Policy, now: Column) -> DataFrame:
    """Adds ``appraisal struct<risk, score, available, awarded, outcomes>``.

    All rules are columns of one projection: no join, no shuffle.
    """
    base = metrics.withColumn("now", now)
    gate = compile_rules(base, policy.high_risk, "gate")
    weighted = compile_rules(base, policy.eval, "rule")
    judged = base.select("*", *[c.expression.alias(c.column) for c in gate + weighted])

    def total(parts: list[Column]) -> Column:
        out = F.lit(0)
        for p in parts:
            out = out + p
        return out.cast("int")

    blocked = F.lit(False)
    for c in gate:
        blocked = blocked | ~F.coalesce(F.col(c.column), F.lit(False))
    available = total([F.when(F.col(c.column).isNotNull(), c.rule.weight).otherwise(0) for c in weighted])
    awarded = total([F.when(F.col(c.column), c.rule.weight).otherwise(0) for c in weighted])
    summed = judged.withColumn("_blocked", blocked).withColumn("_available", available).withColumn("_awarded", awarded)

    stopped = F.col("_blocked")
    score = F.when(stopped, F.lit(0.0)).when(
        F.col("_available") > 0, F.col("_awarded") / F.col("_available") * 100.0
    ).otherwise(F.lit(100.0))
    scored = summed.withColumn("_score", score)
    by_score = (
        F.when(F.col("_score") >= policy.low_risk_threshold, LOW)
        .when(F.col("_score") >= policy.medium_risk_threshold, MEDIUM)
        .otherwise(HIGH)
    )
    risk = F.when(stopped, HIGH).otherwise(F.lit(LOW) if not weighted else by_score)
    empty = F.array().cast(_OUTCOME)
    gate_outcomes = F.array(*[c.outcome() for c in gate]).cast(_OUTCOME) if gate else empty
    eval_outcomes = F.array(*[c.outcome() for c in weighted]).cast(_OUTCOME) if weighted else empty
    appraisal = F.struct(
        risk.alias("risk"),
        F.col("_score").alias("score"),
        F.when(stopped, 0).otherwise(F.col("_available")).alias("available"),
        F.when(stopped, 0).otherwise(F.col("_awarded")).alias("awarded"),
        F.when(stopped, gate_outcomes).otherwise(F.concat(gate_outcomes, eval_outcomes)).alias("outcomes"),
    )
    return scored.select(*metrics.columns, appraisal.alias("appraisal"))


def outcome_rows(appraised: DataFrame) -> DataFrame:
    """One row per rule with a reader's verdict and its detail text."""
    verdict = (
        F.when(F.col("o.disposition") == TRUE, "PASSED")
        .when(F.col("o.disposition") == FALSE, "FAILED")
        .otherwise("INCONCLUSIVE")
    )
    return appraised.select(
        "name", "version", F.posexplode("appraisal.outcomes").alias("ord", "o")
    ).select(
        "name",
        "version",
        "ord",
        F.col("o.name").alias("rule"),
        "o.disposition",
        verdict.alias("verdict"),
        F.coalesce("o.message", "o.description").alias("detail"),
    )


def validate_policy(spark: SparkSession, policy: Policy, now: Column) -> None:
    """Thresholds must be sane and every rule must evaluate on the default metrics."""
    policy.check_thresholds()
    row = default_metrics(spark)
    checked = Policy(eval=policy.high_risk + policy.eval)
    failed = (
        outcome_rows(appraise(row, checked, now)).filter(F.col("disposition") == FAILED).orderBy("ord").head()
    )
    if failed is not None:
        raise ValueError(f"expression '{failed.rule}' failed: {failed.detail}")


def should_appraise(policy: Policy, gate_requested: bool) -> bool:
    return bool(policy.high_risk or policy.eval or gate_requested)


# --------------------------------------------------------------------------
# Gate


def allow_table(spark: SparkSession, allow_list: tuple[Allowed, ...]) -> DataFrame:
    """The allow list of a policy file as a (small) table."""
    return spark.createDataFrame([(a.name, a.version) for a in allow_list], "name string, version_req string")


def rejected(appraised: DataFrame, allowed: DataFrame, error_if_medium: bool = False) -> DataFrame:
    """Packages at or above the level that no allow-list entry covers.

    ``allowed(name, version_req)``.  The requirement is a residual of an anti
    join on the name, so no pair is ever produced.
    """
    levels = (MEDIUM, HIGH) if error_if_medium else (HIGH,)
    risky = appraised.filter(F.col("appraisal.risk").isin(*levels))
    a = allowed.select(F.col("name").alias("_name"), "version_req")
    covered = (risky["name"] == a["_name"]) & requirement_matches(risky["version"], a["version_req"])
    return risky.join(a, covered, "left_anti")


def check_gate(appraised: DataFrame, allowed: DataFrame, error_if_medium: bool = False) -> None:
    if not rejected(appraised, allowed, error_if_medium).isEmpty():
        level = "medium or high risk" if error_if_medium else "high risk"
        raise ValueError(f"one or more crates were flagged as {level}")
