"""Two-stage dedup, duplicate statistics and validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(columns: list[str], id_: str) -> list[Column]:
    return [*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.col(id_)]


def pair_ranked(df: DataFrame, pair: Column, body: Column, id_: str, order: list[str] = ()) -> DataFrame:
    """``df`` with ``pair_rn`` and, for the first of each pair, ``body_rn`` among the survivors of its body.

    Both windows rank by the other key, then ``order``, then ``id_``. The second one sees first rows only.
    """
    keyed = df.withColumn("_pair", pair).withColumn("_body", body)
    first = keyed.withColumn("pair_rn", F.row_number().over(Window.partitionBy("_pair").orderBy(F.coalesce("_body", F.lit("")), *_order(list(order), id_))))
    survives = F.col("pair_rn") == 1
    w = Window.partitionBy("_body", survives).orderBy(F.coalesce("_pair", F.lit("")), *_order(list(order), id_))
    return first.withColumn("body_rn", F.when(survives, F.row_number().over(w))).drop("_pair", "_body")


def pair_dedup(df: DataFrame, pair: Column, body: Column, id_: str, cap: int = 2, order: list[str] = ()) -> DataFrame:
    """One row for each pair, and of these at most ``cap`` for each body."""
    return pair_ranked(df, pair, body, id_, order).where(F.col("body_rn") <= cap).drop("pair_rn", "body_rn")


def selection_stats(df: DataFrame, pair: Column, body: Column, id_: str, cap: int = 2, order: list[str] = ()) -> DataFrame:
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return pair_ranked(df, pair, body, id_, order).agg(
        F.count(F.lit(1)).alias("total_pairs"),
        count(F.col("pair_rn") == 1).alias("rows_after_pair_dedup"),
        count(F.col("body_rn") <= cap).alias("rows_exported"),
        count(F.col("pair_rn") > 1).alias("pair_duplicate_rows_dropped"),
        count(F.col("body_rn") > cap).alias("body_cap_rows_dropped"),
    )


def duplicate_stats(df: DataFrame, pair: Column, body: Column, cap: int = 2) -> DataFrame:
    """Totals, distinct pairs and bodies, and the bodies and rows above the cap, from two grouped counts."""
    pairs = df.groupBy(pair.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_pairs"), F.count("k").alias("unique_pairs"))
    over = F.col("n") > cap
    bodies = df.groupBy(body.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count("k").alias("unique_bodies"),
        F.coalesce(F.sum(F.when(over, 1).otherwise(0)), F.lit(0)).cast("long").alias("bodies_over_cap"),
        F.coalesce(F.sum(F.when(over, F.col("n") - cap).otherwise(0)), F.lit(0)).cast("long").alias("rows_over_cap"),
    )
    # One row on either side.
    return pairs.join(F.broadcast(bodies)).withColumn("duplicate_pair_rows", F.col("total_pairs") - F.col("unique_pairs")).withColumn("duplicate_body_rows", F.col("total_pairs") - F.col("unique_bodies"))


def top_duplicates(df: DataFrame, key: Column, id_: str, limit: int = 5, samples: int = 5) -> DataFrame:
    """The most frequent keys with their first ids; only the rows of those keys are ranked."""
    top = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(limit)
    rows = df.select(key.alias("key"), F.col(id_).alias("id")).join(F.broadcast(top), "key")  # ``limit`` rows
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("rn") <= samples)
    return ranked.groupBy("key", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("sample_ids"))


def ingest_first_wins(df: DataFrame, content: Column, address: Column, position: str) -> DataFrame:
    """The first row of each content, then the first of these for each address.

    A content counts as seen even if its first row goes for a duplicate address.
    """
    first = Window.partitionBy("_content").orderBy(position)
    winners = df.withColumn("_content", content).withColumn("_address", address).withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    by_address = Window.partitionBy("_address").orderBy(position)
    return winners.withColumn("_rn", F.row_number().over(by_address)).where("_rn = 1").drop("_content", "_address", "_rn")


def unseen(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't in ``known``."""
    return df.join(known.select(*on).distinct(), on, "left_anti")


def cap_violations(df: DataFrame, key: Column, cap: int = 2) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).withColumn("over_cap_by", F.col("n") - cap)


def first_accepted_duplicates(df: DataFrame, key: Column, accepted: Column, position: str) -> DataFrame:
    """``df`` with ``is_duplicate``: an earlier accepted row has the same key. Rejected rows seed nothing."""
    w = Window.partitionBy(key)
    return df.withColumn("_first", F.min(F.when(accepted, F.col(position))).over(w)).withColumn("is_duplicate", F.coalesce(F.col(position) > F.col("_first"), F.lit(False))).drop("_first")


def keep_first(df: DataFrame, keys: list[Column], position: str) -> DataFrame:
    """The row of the least position for each key; nulls are a key like any other."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).where("_rn = 1").drop("_rn")


def cascade(df: DataFrame, before: list[tuple[str, Column]], keys: tuple[str, list[Column]], after: list[tuple[str, Column]], position: str) -> DataFrame:
    """``df`` with ``rule``: the first rule that drops a row, or null for a survivor.

    Rules of ``before`` and ``after`` look at single rows, each only at what earlier rules left; between them, the
    duplicates by ``keys`` among what ``before`` left go, but for the least position.
    """
    def first(rules, otherwise):
        out = otherwise
        for name, c in reversed(rules):
            out = F.when(F.coalesce(c, F.lit(False)), F.lit(name)).otherwise(out)
        return out

    tagged = df.withColumn("_early", first(before, F.lit(None).cast("string")))
    w = Window.partitionBy(*keys[1], F.col("_early").isNull()).orderBy(position)
    tagged = tagged.withColumn("_rn", F.when(F.col("_early").isNull(), F.row_number().over(w)))
    rule = F.coalesce("_early", F.when(F.col("_rn") > 1, F.lit(keys[0])), first(after, F.lit(None).cast("string")))
    return tagged.withColumn("rule", rule).drop("_early", "_rn")


def drop_counts(tagged: DataFrame, rule: str = "rule") -> DataFrame:
    return tagged.where(F.col(rule).isNotNull()).groupBy(rule).agg(F.count(F.lit(1)).alias("rows_dropped"))
