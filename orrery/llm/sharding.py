"""Balanced label propagation of documents over shards, with DataFrame functions only.

Documents of equal text are linked. A linked document starts in a shard by hash and in each round moves towards
the shard where most of its neighbours are, as far as quotas allow: what moves between two shards in both
directions is exchanged, and beyond that a shard takes what it has room for. Neighbours are counted by group and
shard, so no pair of documents is ever written out. Groups that are large against a shard are split by a salt
into clusters that fill few shards one after the other. Documents without links fill the shards up, so the counts
of rows end at most one apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import cut, drop, put, table

ROUNDS = 6
PARTS = 256  # a group above this share of all rows is split
RANGE = 50_000  # rows ranked in a window, about
MOST_RANGES = 4096


def ranked(df: DataFrame, by: list[str], order: Column, rows: int, name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row among those of equal ``by``, from 0 without gaps.

    Rows are ranked in ranges of a hash, and each range is shifted by the sizes of those before it, of which there
    are MOST_RANGES at most for each value of ``by``: no window spans all rows.
    """
    ranges = max(1, min(MOST_RANGES, math.ceil(rows / RANGE)))
    df = df.withColumn("_range", F.pmod(F.shiftrightunsigned(F.col("h"), 7), F.lit(ranges)))
    sizes = df.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order, "h", "doc_id"))
    return df.withColumn("_place", place).join(F.broadcast(shifts), [*by, "_range"]).withColumn(name, F.col("_shift") + F.col("_place") - 1).drop("_place", "_shift", "_range")


def allowed(flow: dict[tuple[int, int], int], size: dict[int, int], quota: list[int]) -> dict[tuple[int, int], float]:
    """The share of the rows that want to move from one shard to another that may do so."""
    swap = {(a, b): min(n, flow.get((b, a), 0)) for (a, b), n in flow.items()}
    want: dict[int, int] = {}
    for (a, b), n in flow.items():
        want[b] = want.get(b, 0) + n - swap[a, b]
    share = {}
    for (a, b), n in flow.items():
        free = max(0, quota[b] - size.get(b, 0))
        more = n - swap[a, b]
        share[a, b] = (swap[a, b] + (more if want[b] <= free else more * free / want[b])) / n
    return share


def shard(docs: DataFrame, spark: SparkSession, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of each row of ``docs`` (doc_id, text).

    A null text is of size 1 and linked with nothing. Repeated rows are rows of their own, linked by their text.
    Extra columns go; an empty table gives an empty one.
    """
    text, raw = F.col("text").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base, _ = put(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
            F.when(text.isNotNull(), F.xxhash64(text, F.octet_length(raw))).alias("g"), F.xxhash64("doc_id", text).alias("h"),
        ),
        spark, "shard-base",
    )
    n = base.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    part = max(2, n // PARTS)
    groups = base.where(F.col("g").isNotNull()).groupBy("g").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    large = F.broadcast(groups.where(F.col("members") > part).select("g", "members"))  # PARTS rows at most
    some = base.join(large, "g", "left")
    step = max(1, PARTS // shards * 3 // 4)  # clusters of a large group that one shard takes
    salt = F.pmod(F.shiftrightunsigned(F.col("h"), 11), F.expr(f"members div {part} + 1"))
    hot = some.where("members is not null").withColumn("salt", salt.cast("int")).withColumn("linked", F.lit(True))
    hot = hot.withColumn("shard", F.pmod(F.col("g") + F.expr(f"salt div {step}"), F.lit(shards)).cast("int")).drop("members")
    rest = some.where("members is null").drop("members").join(groups.where(F.col("members") <= part).hint("merge"), "g", "left")
    rest = rest.withColumn("salt", F.lit(0)).withColumn("linked", F.col("members").isNotNull()).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).drop("members")
    columns = ["doc_id", "size", "text_crc32", "g", "h", "salt", "shard"]
    whole, _ = put(hot.unionByName(rest).select(*columns, "linked"), spark, "shard-start")
    linked, old = whole.where("linked").select(*columns), None
    for r in range(ROUNDS):
        near = linked.groupBy("g", "salt", "shard").agg(F.count(F.lit(1)).alias("members"))
        target = near.groupBy("g", "salt").agg(F.max_by("shard", F.struct("members", F.hash("g", "shard"))).alias("target"))
        moves, path = put(linked.join(target.hint("merge"), ["g", "salt"]), spark, f"shard-moves{r}")
        counts = moves.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("members")).collect()  # shards squared at most
        flow = {(x["shard"], x["target"]): x["members"] for x in counts if x["shard"] != x["target"]}
        size: dict[int, int] = {}
        for x in counts:
            size[x["shard"]] = size.get(x["shard"], 0) + x["members"]
        share = allowed(flow, size, quota)
        draw = F.pmod(F.xxhash64("h", F.lit(r)), F.lit(1 << 20)) / float(1 << 20)
        limit = F.create_map(*[F.lit(x) for (a, b), p in share.items() for x in (a * shards + b, float(p))]) if share else None
        moved = F.when(draw < limit[F.col("shard") * shards + F.col("target")], F.col("target")).otherwise(F.col("shard")) if share else F.col("shard")
        linked = moves.withColumn("shard", moved).select(*columns)
        if old:
            drop(spark, old)
        old = path
        if not flow or not any(share.values()) or all(p >= 1 for p in share.values()) and r:
            break
    # Linked rows beyond a shard's quota go to the rows without links, which fill all shards up.
    top = F.element_at(F.array(*map(F.lit, quota)), F.col("shard") + 1)
    placed, _ = put(ranked(linked, ["shard"], F.lit(0), n, "slot").withColumn("kept", F.col("slot") < top), spark, "shard-placed")
    kept = placed.where("kept").select("doc_id", "size", "text_crc32", "shard", "slot")
    taken = {x["shard"]: x["members"] for x in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("members")).collect()}  # a row for each shard
    left = whole.where("not linked").select("doc_id", "size", "text_crc32", "h").unionByName(placed.where("not kept").select("doc_id", "size", "text_crc32", "h"))
    left = ranked(left.withColumn("_all", F.lit(0)), ["_all"], F.lit(0), n, "place")
    start, shard_of, slot_of = 0, F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(shards):
        room = quota[s] - taken.get(s, 0)
        here = (F.col("place") >= start) & (F.col("place") < start + room)
        shard_of, slot_of = F.when(here, F.lit(s)).otherwise(shard_of), F.when(here, F.col("place") - start + taken.get(s, 0)).otherwise(slot_of)
        start += room
    filled = left.select("doc_id", "size", "text_crc32", shard_of.alias("shard"), slot_of.alias("slot"))
    return kept.unionByName(filled).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"))


def op2_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), spark).withColumn("grown_shard", F.lit(None).cast("int"))
