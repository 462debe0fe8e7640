"""Term features, entropy splits, threshold classifiers and heuristic scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequencies(df: DataFrame, doc: str, term: str) -> DataFrame:
    return df.groupBy(doc, term).agg(F.count(F.lit(1)).alias("n"))


def normalize_opcode(op: Column) -> Column:
    """PUSH1 to PUSH32, DUP1 to DUP16, SWAP1 to SWAP16 and LOG0 to LOG4 without their number."""
    n = r"(?:^(PUSH)(?:[0-9]|[12][0-9]|3[0-2])$)|(?:^(DUP|SWAP)(?:[1-9]|1[0-6])$)|(?:^(LOG)[0-4]$)"
    base = F.regexp_extract(op, "^(PUSH|DUP|SWAP|LOG)", 1)
    return F.when(op.rlike(n), base).otherwise(op)


def idf(freq: DataFrame, doc: str, term: str) -> DataFrame:
    """(term, df, idf) with idf = ln((N + 1) / (df + 1)) + 1; ``freq`` has one row for each document and term."""
    n = freq.select(doc).distinct().agg(F.count(F.lit(1)).alias("docs"))  # one row
    return freq.groupBy(term).agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select(term, "df", (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(freq: DataFrame, weights: DataFrame, doc: str, term: str) -> DataFrame:
    """(doc, term, tfidf) of the terms that occur; terms without weight count in a document's total only."""
    total = Window.partitionBy(doc)
    tf = freq.withColumn("_all", F.sum("n").over(total))
    return tf.join(weights.select(term, "idf"), term).select(doc, term, (F.col("n") / F.greatest(F.col("_all"), F.lit(1)) * F.col("idf")).alias("tfidf"))


def dense(values: DataFrame, docs: DataFrame, terms: DataFrame, doc: str, term: str, value: str) -> DataFrame:
    """Every document with every term of a bounded vocabulary, which is collected; 0 where there is no value."""
    vocabulary = [r[term] for r in terms.select(term).distinct().orderBy(term).collect()]
    grid = docs.select(doc).distinct().withColumn(term, F.explode(F.array(*map(F.lit, vocabulary))))
    return grid.join(values, [doc, term], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def entropy(counts: Column) -> Column:
    """Of an array of counts, in bits."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return -F.aggregate(counts, F.lit(0.0), lambda s, x: s + F.when(x > 0, x / total * F.log2(x / total + F.lit(1e-10))).otherwise(F.lit(0.0)))


def _entropy2(a: Column, n: Column) -> Column:
    part = lambda x: F.when(x > 0, x / n * F.log2(x / n + F.lit(1e-10))).otherwise(F.lit(0.0))
    return -(part(a) + part(n - a))


def optimal_split(df: DataFrame, feature: str, value: str, label: str) -> DataFrame:
    """(feature, split, gain): the midpoint of neighbouring values with the most information gain on a 0/1 label.

    Values are counted first, so the windows see one row for each distinct value. The first of equal gains wins; a
    constant feature splits at its value with no gain.
    """
    by = df.groupBy(feature, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("double")).alias("_a"))
    up, all_ = Window.partitionBy(feature).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(feature)
    w = Window.partitionBy(feature).orderBy("_v")
    s = by.select(
        feature, "_v", F.lead("_v").over(w).alias("_next"), F.sum("_n").over(up).cast("double").alias("ln"), F.sum("_a").over(up).alias("la"),
        F.sum("_n").over(all_).cast("double").alias("tn"), F.sum("_a").over(all_).alias("ta"), F.count(F.lit(1)).over(all_).alias("values"),
    )
    rn, ra = F.col("tn") - F.col("ln"), F.col("ta") - F.col("la")
    gain = _entropy2(F.col("ta"), F.col("tn")) - (F.col("ln") / F.col("tn") * _entropy2(F.col("la"), F.col("ln")) + rn / F.col("tn") * _entropy2(ra, F.when(rn > 0, rn).otherwise(F.lit(1.0))))
    cand = s.where("_next is not null or values = 1").select(feature, F.when(F.col("values") == 1, F.col("_v")).otherwise((F.col("_v") + F.col("_next")) / 2).alias("split"), F.when(F.col("values") == 1, F.lit(0.0)).otherwise(gain).alias("gain"))
    best = Window.partitionBy(feature).orderBy(F.desc(F.round("gain", 12)), "split")
    return cand.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def binary_features(df: DataFrame, splits: DataFrame, feature: str, value: str) -> DataFrame:
    """``df`` with ``bit``: 1 from the split on, which inference includes while fitting counts it to the left."""
    return df.join(F.broadcast(splits.select(feature, "split")), feature).withColumn("bit", (F.col(value) >= F.col("split")).cast("int")).drop("split")


def mean_difference(df: DataFrame, feature: str, value: str, label: str) -> DataFrame:
    """(feature, weight, threshold): the difference of the classes' means, and their middle."""
    pos, neg = F.avg(F.when(F.col(label) == 1, F.col(value).cast("double"))), F.avg(F.when(F.col(label) == 0, F.col(value).cast("double")))
    return df.groupBy(feature).agg(F.coalesce(pos, F.lit(0.0)).alias("_p"), F.coalesce(neg, F.lit(0.0)).alias("_q")).select(feature, (F.col("_p") - F.col("_q")).alias("weight"), ((F.col("_p") + F.col("_q")) / 2).alias("threshold"))


def threshold_classify(df: DataFrame, model: DataFrame, doc: str, feature: str, value: str) -> DataFrame:
    """(doc, score, bound, positive): the weighted sum of values against that of the thresholds."""
    both = df.join(F.broadcast(model), feature)  # a row for each feature
    sums = both.groupBy(doc).agg(F.sum(F.col(value) * F.col("weight")).alias("score"), F.sum(F.col("threshold") * F.col("weight")).alias("bound"))
    return sums.withColumn("positive", F.col("score") > F.col("bound"))


def importance(df: DataFrame, name: str, value: str, position: str, limit: int = 5) -> DataFrame:
    """The features of most importance; of equals the later first."""
    return df.orderBy(F.desc(value), F.desc(position)).limit(limit)


# Counts above which an opcode is suspicious, from which it is benign, and the share of calls.
SUSPICIOUS = {"SELFDESTRUCT": 0, "DELEGATECALL": 1, "CREATE": 2, "CREATE2": 1, "CALLCODE": 0}
BENIGN = {"REVERT": 3, "JUMPI": 5}
CALL_SHARE = ("CALL", 0.05)


def heuristic_score(df: DataFrame, doc: str, term: str, count: str, suspicious: dict = SUSPICIOUS, benign: dict = BENIGN, call: tuple = CALL_SHARE) -> DataFrame:
    """(doc, score, flagged, confidence) from counts (doc, term, count)."""
    n = lambda t: F.coalesce(F.sum(F.when(F.col(term) == t, F.col(count))), F.lit(0))
    raw = F.lit(0.0)
    for t, most in suspicious.items():
        raw = raw + F.when(n(t) > most, 0.2).otherwise(0.0)
    for t, least in benign.items():
        raw = raw - F.when(n(t) >= least, 0.1).otherwise(0.0)
    raw = raw + F.when(n(call[0]) / F.greatest(F.sum(count), F.lit(1)) > call[1], 0.15).otherwise(0.0)
    s = df.groupBy(doc).agg(F.least(F.greatest(F.round(raw, 10), F.lit(0.0)), F.lit(1.0)).alias("score"))
    return s.withColumn("flagged", F.col("score") > 0.4).withColumn("confidence", F.greatest("score", 1 - F.col("score")))


def z_value(confidence: float) -> float:
    """Of the two-sided normal interval."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(0.5 + confidence / 2) if 0 < confidence < 1 else math.inf
