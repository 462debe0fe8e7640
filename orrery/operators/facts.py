"""Fact sets of references and candidates: matches, misses, extras and their rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision(tp: Column, fp: Column) -> Column:
    """1 if nothing was claimed."""
    return F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp / F.greatest(tp + fp, F.lit(1)))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.when(p + r == 0, F.lit(1.0)).otherwise(p + r))


def compare(df: DataFrame, reference: Column, candidate: Column) -> DataFrame:
    """``df`` with matched, missing and extra facts of two arrays, sorted."""
    return df.withColumn("matched", F.array_sort(F.array_intersect(reference, candidate))).withColumn("missing", F.array_sort(F.array_except(reference, candidate))).withColumn("extra", F.array_sort(F.array_except(candidate, reference)))


def category_scores(facts: DataFrame, by: list[str] = ("category",)) -> DataFrame:
    """Micro precision, recall and F1 of rows (…, matched, missing, extra) by ``by``."""
    sums = facts.groupBy(*by).agg(*[F.sum(F.size(c)).cast("long").alias(n) for c, n in (("matched", "tp"), ("extra", "fp"), ("missing", "fn"))])
    return rates(sums)


def rates(sums: DataFrame) -> DataFrame:
    p, r = precision(F.col("tp"), F.col("fp")), precision(F.col("tp"), F.col("fn"))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def category_gaps(scores: DataFrame) -> DataFrame:
    """Categories short of perfect, and whether recall or precision is the larger trouble."""
    gaps = scores.where(F.col("fn") + F.col("fp") > 0)
    return gaps.withColumn("primary_error", F.when(F.col("fn") >= F.col("fp"), "recall").otherwise("precision")).orderBy("f1", F.desc(F.col("fn") + F.col("fp")), "category")


def ungrounded(extra: Column, grounding: Column) -> Column:
    """Extra facts that nothing grounds."""
    return F.array_sort(F.array_except(extra, grounding))
