"""Evaluation rows: semantic scores, issues, diagnostics, covers, interfaces, storage slots and inference results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severity ranks.
RANK = {"high": 3, "medium": 2, "low": 1, "info": 0}


def completed(df: DataFrame, numbers: list[str], flags: list[str], success: Column, distance: str = "normalized_edit_distance") -> DataFrame:
    """Missing metrics as 0, flags as false, and the distance as 1 for failed rows only."""
    out = df
    for c in numbers:
        default = F.when(success, 0.0).otherwise(1.0) if c == distance else F.lit(0.0)
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), default))
    for c in flags:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("boolean"), F.lit(False)))
    return out


def issue_counts(df: DataFrame, issues: Column) -> DataFrame:
    """Rows of each issue; an issue counts once for a row."""
    return df.select(F.explode(F.array_distinct(issues)).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))


def strongest_issues(df: DataFrame, id_: str, severity: str, position: str) -> DataFrame:
    """One row for each id: the most severe, of equals the first."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col(severity)], F.lit(-1))
    w = Window.partitionBy(id_).orderBy(F.desc(rank), position)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def diagnostics(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(metric, value, severity, advice) of metrics beyond a rule's medium or high bound.

    ``rules`` is (metric, op, medium, high, advice): ``<`` flags low values, ``>`` high ones.
    """
    both = metrics.join(F.broadcast(rules), "metric")  # a table of constants
    v = F.col("value")
    beyond = lambda c: F.when(F.col("op") == "<", v < F.col(c)).otherwise(v > F.col(c))
    return both.withColumn("severity", F.when(beyond("high"), "high").when(beyond("medium"), "medium")).where("severity is not null").select("metric", "value", "severity", "advice")


def overall_status(issues: DataFrame) -> DataFrame:
    top = F.max(F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0))
    return issues.agg(F.when(top == 2, "needs_attention").when(top == 1, "watch").otherwise("healthy").alias("status"))


def next_steps(issues: DataFrame, limit: int = 8) -> DataFrame:
    """The first ``limit`` distinct pieces of advice, the most severe first."""
    first = issues.groupBy("advice").agg(F.min(F.when(F.col("severity") == "high", 0).otherwise(1)).alias("o"), F.min("metric").alias("m"))
    return first.orderBy("o", "m", "advice").limit(limit).select("advice")


def greedy_cover(df: DataFrame, id_: str, pivots: Column, n: int) -> list:
    """At most ``n`` ids that cover pivots one after the other: each covers most of what is open, of equals the least.

    One aggregate for each id chosen; only that id and its pivots reach the driver.
    """
    long = df.select(id_, F.explode(F.array_distinct(pivots)).alias("p"))
    chosen, done = [], set()
    for _ in range(n):
        left = long.where(~F.col("p").isin(sorted(done))) if done else long
        best = left.groupBy(id_).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("p")).alias("ps")).orderBy(F.desc("n"), id_).limit(1).collect()
        if not best:
            break
        chosen.append(best[0][id_])
        done |= set(best[0]["ps"])
    return chosen


def sample(df: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    from orrery.functions.records import sample_key

    return df.orderBy(sample_key(F.col(id_), seed), id_).limit(n)


def interfaces(selectors: DataFrame, id_: str, known: DataFrame) -> DataFrame:
    """(id, interface, matched, coverage) where at least four, or all, of an interface's selectors occur; of Ownable's, two.

    ``known`` (interface, selector) is a small table of constants.
    """
    sizes = known.groupBy("interface").agg(F.countDistinct("selector").alias("total"))
    hits = selectors.select(id_, "selector").distinct().join(F.broadcast(known), "selector").groupBy(id_, "interface").agg(F.count(F.lit(1)).alias("matched"))
    both = hits.join(F.broadcast(sizes), "interface").where(F.col("matched") >= F.when(F.col("interface") == "Ownable", 2).otherwise(F.least(F.lit(4), F.col("total"))))
    return both.select(id_, "interface", "matched", F.bround(F.col("matched") / F.col("total"), 3).alias("coverage"))


def storage_slots(variables: DataFrame, contract: str, position: str) -> DataFrame:
    """A slot for each state variable in order of declaration; constants and immutables have none."""
    w = Window.partitionBy(contract).orderBy(position)
    return variables.where(~F.col("constant")).withColumn("slot", F.row_number().over(w) - 1)


def inference_results(functions: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """Functions with the body of their digest: ``lookup`` if there is one, else ``tac_only``."""
    return functions.join(bodies, key, "left").withColumn("source", F.when(F.col("body").isNotNull(), "lookup").otherwise("tac_only"))


def source_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def function_quality(blocks: Column, operations: Column, unresolved: Column) -> Column:
    """1 less a tenth for each unresolved jump, halved for empty functions, within 0 and 1."""
    score = 1.0 - 0.1 * unresolved
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((blocks == 0) | (operations == 0), score / 2).otherwise(score)))


def iteration_plan(slices: DataFrame, n: int) -> DataFrame:
    """``n`` iterations that take the slices by rank in turn."""
    ranked = slices.withColumn("k", F.row_number().over(Window.orderBy("rank")) - 1).orderBy("k").limit(n)
    total = ranked.agg(F.count(F.lit(1)).alias("m"))
    grid = total.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("iteration"), "m").where("m > 0")
    return grid.join(ranked, F.expr("iteration % m = k")).select("iteration", "slice")
