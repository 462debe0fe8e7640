"""Comparisons of runs, quality gates and worst samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.stats import unpivot


def paired_deltas(a: DataFrame, b: DataFrame, on: str, metrics: list[str]) -> DataFrame:
    """(on, metric, baseline, candidate, delta) of the rows that both runs have."""
    left = unpivot(a, [on], metrics).withColumnRenamed("value", "baseline")
    right = unpivot(b, [on], metrics).withColumnRenamed("value", "candidate")
    return left.join(right, [on, "metric"]).withColumn("delta", F.col("candidate") - F.col("baseline"))


def paired_comparison(a: DataFrame, b: DataFrame, on: str, metrics: list[str], tolerance: float = 0.0) -> DataFrame:
    d = F.col("delta")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return paired_deltas(a, b, on, metrics).groupBy("metric").agg(
        F.count(F.lit(1)).alias("paired_count"), F.avg(d).alias("mean_delta"), count(d > tolerance).alias("improved_count"),
        count(d < -tolerance).alias("regressed_count"), count(F.abs(d) <= tolerance).alias("unchanged_count"),
    )


def worst_deltas(deltas: DataFrame, metric: str, on: str, limit: int = 10) -> DataFrame:
    return deltas.where(F.col("metric") == metric).orderBy("delta", on).limit(limit)


def bucket_delta(a: DataFrame, b: DataFrame, bucket: str) -> DataFrame:
    """Counts of each bucket in both runs, and their difference."""
    n = lambda df, name: df.groupBy(bucket).agg(F.count(F.lit(1)).alias(name))
    both = n(a, "baseline").join(n(b, "candidate"), bucket, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return both.select(bucket, zero("baseline").alias("baseline"), zero("candidate").alias("candidate"), (zero("candidate") - zero("baseline")).alias("delta"))


def metric_direction(metric: Column) -> Column:
    """lower or higher is better; null: not compared."""
    m = F.lower(metric)
    none = m.endswith("_std") | m.endswith("_count") | m.contains("confidence_interval")
    lower = m.contains("distance") | m.contains("loss") | m.contains("error")
    higher = m.endswith("_mean") | m.startswith("pct_") | m.endswith("_micro")
    return F.when(none, F.lit(None).cast("string")).when(lower, "lower").when(higher, "higher")


def baseline_comparison(current: DataFrame, baseline: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Of two (metric, value) tables: delta, relative delta and status by the metric's direction."""
    both = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric")
    both = both.withColumn("direction", metric_direction(F.col("metric"))).where("direction is not null").withColumn("delta", F.col("current") - F.col("baseline"))
    gain = F.when(F.col("direction") == "lower", -F.col("delta")).otherwise(F.col("delta"))
    status = F.when(gain < -tolerance, "regressed").when(gain > tolerance, "improved").otherwise("unchanged")
    return both.withColumn("relative_delta", F.when(F.col("baseline") != 0, F.col("delta") / F.abs("baseline"))).withColumn("status", status)


#: Default thresholds of the quality gate.
THRESHOLDS = (
    ("semantic_similarity_mean", ">=", 0.82),
    ("pct_above_0.8_similarity", ">=", 0.78),
    ("pct_below_0.4_edit_dist", ">=", 0.82),
    ("failure_rate", "<=", 0.0),
    ("replication_f1_mean", ">=", 0.75),
    ("solidity_valid_mean", ">=", 1.0),
    ("solidity_compiler_checked_mean", ">=", 1.0),
    ("solidity_ast_valid_mean", ">=", 1.0),
    ("bytecode_semantic_score_mean", ">=", 0.5),
    ("bytecode_semantic_checked_mean", ">=", 1.0),
    ("bytecode_deployable_mean", ">=", 1.0),
)


def quality_gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, value, op, threshold, required, status) of (metric, value) against (metric, op, threshold, required)."""
    both = thresholds.join(metrics.select("metric", "value"), "metric", "left")
    v, t = F.col("value"), F.col("threshold")
    holds = F.when(F.col("op") == ">=", v >= t).when(F.col("op") == "<=", v <= t).when(F.col("op") == ">", v > t).when(F.col("op") == "<", v < t).otherwise(v == t)
    status = F.when(v.isNull() & ~F.col("required"), "skipped").when(F.coalesce(holds, F.lit(False)), "passed").otherwise("failed")
    return both.select("metric", "value", "op", "threshold", "required", status.alias("status"))


#: Decisions from the strongest to the weakest.
DECISIONS = ("reject", "smoke_only", "keep_candidate", "no_change")


def run_decision(rows: Column, regressed: Column, improved: Column, least_rows: int = 30) -> Column:
    return F.when(rows < least_rows, "smoke_only").when(regressed > 0, "reject").when(improved > 0, "keep_candidate").otherwise("no_change")


def suite_decision(decisions: DataFrame, column: str = "decision") -> DataFrame:
    rank = F.coalesce(*[F.when(F.col(column) == d, F.lit(i)) for i, d in enumerate(DECISIONS)])
    return decisions.agg(F.element_at(F.array(*map(F.lit, DECISIONS)), F.coalesce(F.min(rank), F.lit(len(DECISIONS) - 1)) + 1).alias("decision"))


def worst_samples(df: DataFrame, id_: str, lists: dict[str, tuple[Column, Column]], limit: int = 5) -> DataFrame:
    """The first ``limit`` rows of each list, (condition, order), with their rank: a top-k for each, no full sort."""
    out = None
    for name, (condition, order) in lists.items():
        top = df.where(condition).select(id_, order.alias("_o")).orderBy("_o", id_).limit(limit)
        ranked = top.select(F.lit(name).alias("reason"), id_, F.row_number().over(Window.partitionBy(F.lit(name)).orderBy("_o", id_)).alias("rank"))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def failure_slices(df: DataFrame, slices: Column, score: Column, id_: str) -> DataFrame:
    """Size and mean score of each slice that a row is in; ``slices`` is an array of names. Missing scores are 0."""
    rows = df.select(id_, F.coalesce(score, F.lit(0.0)).alias("_s"), F.explode(F.array_distinct(slices)).alias("slice"))
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("mean_score"))


def pivot_winner(a: DataFrame, b: DataFrame, fields: list[str], value: str) -> DataFrame:
    """Means of both runs by field and value, and which is higher."""
    def means(df, name):
        long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("pivot")) for f in fields])).alias("p"), value)
        return long.groupBy("p.field", "p.pivot").agg(F.avg(value).alias(name))

    both = means(a, "left_mean").join(means(b, "right_mean"), ["field", "pivot"], "full_outer")
    x, y = F.col("left_mean"), F.col("right_mean")
    return both.withColumn("winner", F.when(y.isNull() | (x > y), "left").when(x.isNull() | (y > x), "right").otherwise("tie"))
