"""Document fingerprints of closed syncmers, with DataFrame functions only.

The letters are words; a word of more than LONG characters, as scripts without blanks have, counts as that many
letters. A k-mer is K consecutive letters, its inner substrings are single letters, ordered by a hash. A k-mer is chosen
if its least letter stands at its first or last place. Whether it is depends on nothing around it, so what two texts
share is anchored alike in both, wherever it stands. A fingerprint is the text's chosen k-mers in order, without
repetition, as eight hexadecimal digits each; a text of fewer than K letters has one anchor, all its letters, and a
text without letters has none. Likeness is the Jaccard similarity of the anchors (two empty fingerprints: 1).
``located`` keeps where the anchors stand, and ``shared`` matches texts by them.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import table

K = 4
LONG = 24  # characters of a word that is one letter
BUCKET = 500  # rows of a range of doc_id
MOST_BUCKETS = 100_000  # beyond which ranges grow


def _chosen(df: DataFrame, text: str, k: int) -> DataFrame:
    """``df`` with the hashes ``_h`` of the letters of a text and the places ``_at`` of its closed syncmers, from 1."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("_w", words)
    apart = F.flatten(F.transform("_w", lambda w: F.when(F.length(w) <= LONG, F.array(w)).otherwise(F.filter(F.split(w, ""), lambda c: c != ""))))
    letters = F.when(F.exists("_w", lambda w: F.length(w) > LONG), apart).otherwise(F.col("_w"))
    df = df.withColumn("_h", F.transform(letters, lambda w: F.xxhash64(w))).withColumn("_m", F.col("_h"))
    have = 1
    while have < k:  # the least of each k letters, by doubling
        step = min(have, k - have)
        more = F.slice("_m", step + 1, F.greatest(F.size("_m") - step, F.lit(0)))
        df = df.withColumn("_n", F.zip_with(F.slice("_m", 1, F.size(more)), more, lambda a, b: F.least(a, b))).drop("_m").withColumnRenamed("_n", "_m")
        have += step
    h, m = F.col("_h"), F.col("_m")
    some = F.filter(F.sequence(F.lit(1), F.size("_m")), lambda i: (m[i - 1] == h[i - 1]) | (m[i - 1] == h[i + (k - 2)]))
    return df.withColumn("_at", F.when(F.size("_m") > 0, some).otherwise(F.array().cast("array<int>"))).drop("_w")


def _anchor(h: Column, i: Column, k: int) -> Column:
    return F.hash(*[h[i + (j - 1)] for j in range(k)])


def anchors(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """``df`` with the array of anchors of column ``text``; null counts as empty."""
    df, h, n = _chosen(df, text, k), F.col("_h"), F.size("_h")
    some = F.array_distinct(F.transform("_at", lambda i: _anchor(h, i, k)))
    empty = F.array().cast("array<int>")
    return df.withColumn(out, F.when(n == 0, empty).when(n < k, F.array(F.hash("_h"))).otherwise(some)).drop("_h", "_m", "_at")


def located(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, anchor and position (its first letter, from 0) of each occurrence of an anchor in ``docs`` (doc_id, text)."""
    df, h, n = _chosen(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", k), F.col("_h"), F.size("_h")
    all_ = F.transform("_at", lambda i: F.struct(_anchor(h, i, k).alias("anchor"), (i - 1).alias("position")))
    whole = F.array(F.struct(F.hash("_h").alias("anchor"), F.lit(0).alias("position")))
    found = df.select("doc_id", F.explode(F.when(n == 0, F.slice(whole, 1, 0)).when(n < k, whole).otherwise(all_)).alias("x"))
    return found.select("doc_id", "x.anchor", "x.position")


def shared(left: DataFrame, right: DataFrame, k: int = K) -> DataFrame:
    """left_id, right_id, shift and n: how many anchors of two texts stand ``shift`` letters apart. The largest n of a
    pair tells how its texts are aligned. Both sides are stated sets of documents: each meets all of the other's rows
    that share an anchor."""
    a, b = (located(d, k).select(F.col("doc_id").alias(f"{s}_id"), "anchor", F.col("position").alias(s)) for d, s in ((left, "left"), (right, "right")))
    return a.join(b, "anchor").groupBy("left_id", "right_id", (F.col("right") - F.col("left")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))


def written(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / F.greatest(all_, F.lit(1)))


def with_next(docs: DataFrame, columns: list[str], bucket: int = BUCKET, derive=lambda df: df) -> DataFrame:
    """``docs`` with ``next_<column>`` of the row that follows by ascending doc_id; after the last: of the first.

    Rows are dealt into ranges of doc_id. Each range gets a copy of the first row of the next one, so the texts are
    shuffled once and no window spans all rows. ``derive`` adds columns that are computed once for a row before it is
    shuffled, and besides for the copied rows only. Rows of equal doc_id follow each other by text; a null doc_id comes first.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ids = docs.select(key.cast("double").alias("key"))
    n = ids.count()
    parts = max(1, min(MOST_BUCKETS, math.ceil(n / bucket)))
    splits = sorted(set(ids.approxQuantile("key", [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    dealt = docs.withColumn("_key", key.cast("double"))
    if splits:
        dealt = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="_key", outputCol="_bucket").transform(dealt)
    dealt = dealt.withColumn("_bucket", (F.col("_bucket") if splits else F.lit(0)).cast("int"))
    # One row for each range, MOST_BUCKETS at most.
    firsts = dealt.groupBy("_bucket").agg(F.min(key).alias("_first"))
    order = Window.orderBy("_bucket")
    around = firsts.select(F.col("_first"), F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(Window.partitionBy())).alias("_before"))
    ghosts = dealt.withColumn("_first", key).join(F.broadcast(around), "_first")
    ghosts = ghosts.groupBy("_before").agg(F.min_by(F.struct(*docs.columns), F.struct(key, F.col("text"))).alias("_row"))
    ghosts = derive(ghosts.select(F.col("_before").alias("_bucket"), F.lit(1).alias("_ghost"), *[F.col("_row")[c].alias(c) for c in docs.columns]))
    rows = derive(dealt.select("_bucket", F.lit(0).alias("_ghost"), *docs.columns))
    rows = rows.select("_bucket", "_ghost", *columns).unionByName(ghosts.select("_bucket", "_ghost", *columns))
    following = Window.partitionBy("_bucket").orderBy("_ghost", key, "text")
    for c in columns[1:]:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(following))
    return rows.where("_ghost = 0").drop("_ghost", "_bucket")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text, anchors and fingerprint of each row. Null texts count as empty; rows are independent, so repeated
    ones get the same fingerprint; extra columns go, whatever their names; an empty table gives an empty one."""
    rows = anchors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "text", "anchors")
    return rows.withColumn("fingerprint", written(F.col("anchors")))


def op10_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, ["doc_id", "text", "anchors"], derive=lambda df: anchors(df, "text", "anchors"))
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(next_text, 1, length(text) div 2)"))
    rows = anchors(rows.withColumn("edited", edited), "edited", "edited_anchors")
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("anchors")).alias("fingerprint"), written(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
