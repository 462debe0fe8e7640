"""Connected components by alternating stars, entirely in joins, and joins that a hot key doesn't put into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import drop, put

HOT = 500  # at most so many keys count as hot


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each key and in ``_n`` how many of ``rows`` have it.

    Keys of more than ``total`` / HOT rows are under HOT by this bound; their facts are broadcast, so that their rows
    stay where they are. All others meet in a join that is told to shuffle, as plans should be alike at every size.
    """
    limit = max(1000, -(-total // HOT))
    hot = F.broadcast(facts.where(F.col("_n") > limit).drop("_n"))
    rest = rows.join(F.broadcast(facts.where(F.col("_n") > limit).select(*keys)), keys, "left_anti").join(facts.where(F.col("_n") <= limit).drop("_n").hint("merge"), keys)
    return rest.unionByName(rows.join(hot, keys))


def components(edges: DataFrame, spark: SparkSession, name: str = "stars", rows: int | None = None) -> DataFrame:
    """(a, root) of every vertex that has an edge in ``edges`` (a, b) and isn't the least of its component.

    Each round hangs the larger neighbours of a vertex on its least neighbour and then its smaller ones, so the
    number of rounds grows with the logarithm of a component's size, and no task holds a component. Rounds are cut
    to the shared folder; they end when the edges don't change, which then are stars. ``rows`` are the most edges there are.
    """
    tell = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    now, path = put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), spark, name, rows)
    before = tell(now)
    while before["n"]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
        large = looked_up(both, least, ["a"], 2 * before["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, between = put(large, spark, name, 2 * before["n"])
        # Here a vertex has smaller neighbours only, so no key is a hub that many vertices hang on.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        then, new = put(small, spark, name, 2 * before["n"])
        drop(spark, path, between)
        now, path, told = then, new, tell(then)
        if tuple(told) == tuple(before):
            break
        before = told
    return now.select("a", F.col("b").alias("root"))
