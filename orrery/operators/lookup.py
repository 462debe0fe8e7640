"""Exact, tiered and resumable lookups, upserts and status transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_lookup(probes: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """Every probe with the body of its key, if there is one."""
    return probes.join(bodies, key, "left")


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))).where("_rn = 1").drop("_rn")


def match_last(left: DataFrame, right: DataFrame, key: str, left_position: str, right_position: str) -> DataFrame:
    """Inner join in which the last row of a key stands for it on either side."""
    return last_wins(left, key, left_position).join(last_wins(right, key, right_position), key)


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def jobs(df: DataFrame, versions: list, flags: tuple = (True, False)) -> DataFrame:
    """Every row with every version and flag; both lists are constants, so nothing is joined."""
    return df.withColumn("version", F.explode(F.array(*map(F.lit, versions)))).withColumn("flag", F.explode(F.array(*map(F.lit, flags))))


def tiered(probes: DataFrame, tiers: list[tuple[str, DataFrame]], key: str, value: str, weight: str) -> DataFrame:
    """For each probe the values of the first tier that knows its key: the heaviest, how many there are, and the tier."""
    all_ = None
    for rank, (name, t) in enumerate(tiers):
        part = t.select(key, value, weight, F.lit(rank).alias("_tier"), F.lit(name).alias("tier"))
        all_ = part if all_ is None else all_.unionByName(part)
    best = all_.groupBy(key, "_tier", "tier").agg(F.min_by(value, F.struct(-F.col(weight), F.col(value))).alias(value), F.count(F.lit(1)).alias("candidates"))
    first = best.groupBy(key).agg(F.min_by(F.struct("tier", value, "candidates"), "_tier").alias("b"))
    found = first.select(key, "b.*")
    return probes.join(found, key, "left").withColumn("tier", F.coalesce("tier", F.lit("unknown"))).withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str], count: str, first: str, name: str) -> DataFrame:
    """Occurrences add up; the mapping ``first`` of the earliest row stays; the longest ``name`` wins.

    Both sides are (keys, count, first, name, pos), where pos orders rows and old ones come before new ones.
    """
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return both.groupBy(*keys).agg(
        F.sum(count).alias(count), F.min_by(first, F.struct("_side", "pos")).alias(first), F.max_by(name, F.struct(F.length(name), -F.col("_side"), -F.col("pos"))).alias(name)
    )


def registry_import(old: DataFrame, new: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The larger count of either side for each key."""
    return old.select(*keys, count).unionByName(new.select(*keys, count)).groupBy(*keys).agg(F.max(count).alias(count))


def outcomes(events: DataFrame, id_: str, position: str, produced: Column, failed: Column, status: str, error: str) -> DataFrame:
    """Status of each id: processed if anything was produced, else its first failure, else ``no_pairs``."""
    first = lambda c: F.min_by(F.when(failed, F.col(c)), F.when(failed, F.col(position)))
    any_ = F.max(produced.cast("int")) == 1
    return events.groupBy(id_).agg(
        F.when(any_, F.lit("processed")).otherwise(F.coalesce(first(status), F.lit("no_pairs"))).alias("status"),
        F.when(~any_, first(error)).alias("error"), F.count(F.lit(1)).alias("attempts"),
    )
