"""Pattern scans, severities and risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity of each kind of finding.
SEVERITY = {
    "reentrancy": "high", "timestamp_dependency": "medium", "integer_overflow": "medium",
    "delegatecall": "high", "access_control": "high", "selfdestruct": "critical",
}
# Weight and floor of each severity, and the levels of risk.
WEIGHT = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.1, "info": 0.0}
FLOOR = {"critical": 0.7, "high": 0.5, "medium": 0.3, "low": 0.1, "info": 0.0}
LEVELS = ((0.7, "critical"), (0.5, "high"), (0.3, "medium"), (0.1, "low"))


def source_rules(source: Column) -> dict[str, tuple[Column, float, float]]:
    """For each kind: the condition, the confidence if it holds, and the confidence if not."""
    low = F.lower(source)
    any_of = lambda t, *parts: F.greatest(*[t.contains(p).cast("int") for p in parts], F.lit(0)) == 1
    call = any_of(source, ".call{value:", ".call.value(") | any_of(low, ".send(")
    return {
        "reentrancy": (call & ~any_of(low, "nonreentrant", "reentrancyguard"), 0.7, 0.8),
        "timestamp_dependency": (any_of(source, "block.timestamp", "now"), 0.6, 0.9),
        "integer_overflow": (any_of(source, "+", "-", "*") & ~any_of(low, "safemath") & ~any_of(source, "pragma solidity ^0.8", "pragma solidity >=0.8"), 0.5, 0.8),
        "delegatecall": (any_of(low, "delegatecall"), 0.7, 0.9),
        "access_control": (any_of(low, "selfdestruct", "suicide") & ~any_of(low, "onlyowner", "msg.sender == owner"), 0.6, 0.8),
        "selfdestruct": (any_of(low, "selfdestruct", "suicide"), 0.9, 0.95),
    }


def scan(df: DataFrame, id_: str, rules: dict[str, tuple[Column, float, float]], severity: dict[str, str] = SEVERITY) -> DataFrame:
    """A row for each id and kind: detected, confidence and severity."""
    each = [F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.lit(False)).alias("detected"), F.when(c, yes).otherwise(no).alias("confidence"), F.lit(severity.get(k, "medium")).alias("severity")) for k, (c, yes, no) in rules.items()]
    return df.select(id_, F.explode(F.array(*each)).alias("f")).select(id_, "f.*")


def fragment_severity(kind: Column, fragments: Column, severity: dict[str, str] = SEVERITY) -> Column:
    """More than three fragments raise what isn't critical to high."""
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])[kind], F.lit("medium"))
    return F.when((fragments > 3) & (base != "critical"), "high").otherwise(base)


def fragment_confidence(n: Column) -> Column:
    return F.least(0.5 + 0.1 * n, F.lit(0.95))


def noisy_or(df: DataFrame, id_: str, weight: Column, confidence: Column, floor: Column) -> DataFrame:
    """(id, risk): 1 less the product of 1 - weight * confidence, at least the largest floor, at most 1.

    Zero factors and the
    logarithms of the others are added up apart, which needs no list of a group's rows.
    """
    x = F.round(1 - weight * confidence, 12)
    return df.groupBy(id_).agg(
        F.max(F.when(x <= 0, 1).otherwise(0)).alias("_zero"), F.sum(F.when(x > 0, F.log(x)).otherwise(0.0)).alias("_log"), F.max(floor).alias("_floor")
    ).select(id_, F.least(F.greatest(F.when(F.col("_zero") == 1, 1.0).otherwise(1 - F.exp("_log")), F.coalesce("_floor", F.lit(0.0))), F.lit(1.0)).alias("risk"))


def linear_risk(df: DataFrame, id_: str, severity: Column, confidence: Column, kinds: int = 6) -> DataFrame:
    return df.groupBy(id_).agg(F.least(F.sum(severity * confidence) / kinds, F.lit(1.0)).alias("risk"))


def risk_level(risk: Column) -> Column:
    out = F.lit("minimal")
    for bound, name in reversed(LEVELS):
        out = F.when(risk >= bound, name).otherwise(out)
    return out


def severity_counts(findings: DataFrame, severity: str = "severity") -> DataFrame:
    return findings.groupBy(severity).agg(F.count(F.lit(1)).alias("n"))
