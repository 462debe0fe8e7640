"""Packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents longer than a sequence are cut into whole sequences and a rest. Whole pieces are sequences of their
own. The rests are dealt by a hash into blocks of bounded size, so no task grows with the input, and each block
is packed on several islands: a population of packings is evolved by injecting whole well-filled bins of one
packing into another, dissolving the bins that hold the injected pieces, and placing what is displaced by best
fit. After each epoch every island sends its elite to the next one. The few poorly filled bins of all blocks
are then packed again together, in ever fewer blocks.
"""

from __future__ import annotations

import math
import pickle
import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import cut, files_for, owned, table, vectorised
from orrery.llm.tokens import encoder, vocabulary

CAPACITY = 2048
BLOCK = 4096  # pieces packed together
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 4, 25, 8
LOOSE, SWAPPED = 100, 200  # displaced pieces that are swapped, bins they are swapped into, at most
FULL_ENOUGH = 0.98  # bins below this are packed again

Packing = dict[int, list[int]]  # pieces of each bin


def best_fit(bins: Packing, room: dict[int, int], items: list[int], length: list[int], capacity: int) -> None:
    """Place ``items`` in order, each where least room is left, in ``bins`` or new ones."""
    free = sorted((r, b) for b, r in room.items() if r > 0)
    new = max(bins, default=-1) + 1
    for i in items:
        at = bisect_left(free, (length[i], -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b, new = capacity, new, new + 1
            bins[b] = []
        bins[b] = [*bins[b], i]
        room[b] = r - length[i]
        if room[b]:
            insort(free, (room[b], b))


def fresh(length: list[int], capacity: int, pick: random.Random, jitter: float) -> tuple[Packing, dict[int, int]]:
    """Best fit in descending order of lengths, which ``jitter`` disturbs."""
    order = sorted(range(len(length)), key=lambda i: (-length[i] * (1 + jitter * pick.random()), i))
    bins: Packing = {}
    room: dict[int, int] = {}
    best_fit(bins, room, order, length, capacity)
    return bins, room


def fitness(one: tuple[Packing, dict[int, int]], capacity: int) -> tuple[int, float]:
    """Fewer bins, then more uneven filling."""
    return -len(one[0]), sum((capacity - r) ** 2 for r in one[1].values())


def swapped(bins: Packing, room: dict[int, int], loose: list[int], length: list[int], some: list[int]) -> list[int]:
    """Let one or two of the ``loose`` pieces take the place of one or two shorter ones of a bin of ``some``, where that
    fills the bin best; what comes out is loose, and easier to place. The loose pieces, by descending length."""
    loose = sorted(loose, key=lambda i: (length[i], i))
    for k in some:
        free, items = room[k], bins[k]
        if not free or not loose:
            continue
        best, outs, ins = 0, (), ()
        for out in [(i,) for i in items] + [(i, j) for n, i in enumerate(items[:8]) for j in items[n + 1 : 8]]:
            had = sum(length[i] for i in out)
            at = bisect_right(loose, had + free, key=lambda i: length[i]) - 1
            if at >= 0 and length[loose[at]] - had > best:
                best, outs, ins = length[loose[at]] - had, out, (loose[at],)
            low, high = 0, len(loose) - 1
            while low < high:
                both = length[loose[low]] + length[loose[high]]
                if both > had + free:
                    high -= 1
                else:
                    if both - had > best:
                        best, outs, ins = both - had, out, (loose[low], loose[high])
                    low += 1
        if best:
            bins[k] = [i for i in items if i not in outs] + list(ins)
            room[k] = free - best
            loose = sorted([i for i in loose if i not in ins] + list(outs), key=lambda i: (length[i], i))
    return loose[::-1]


def crossover(a, b, length: list[int], capacity: int, pick: random.Random):
    """Whole well-filled bins of ``b`` go into a copy of ``a``; bins that hold their pieces too, and some of the worst,
    dissolve. What they displace is swapped into other bins where that fills them better, then placed by best fit."""
    bins, room = dict(a[0]), dict(a[1])
    where = {i: k for k, items in bins.items() for i in items}
    full = sorted(b[0], key=lambda k: (b[1][k], k))
    full = full[: max(1, len(full) * 3 // 4)]
    chosen = pick.sample(full, max(1, min(len(full), len(full) // 8, 64)))
    injected = {i for k in chosen for i in b[0][k]}
    worst = sorted(bins, key=lambda k: (-room[k], k))[: 1 + pick.randrange(3)]
    gone = {where[i] for i in injected} | set(worst)
    displaced = [i for k in gone for i in bins.pop(k) if i not in injected]
    for k in gone:
        del room[k]
    new = max(bins, default=-1) + 1
    for k in chosen:
        bins[new], room[new] = b[0][k], b[1][k]
        new += 1
    if len(displaced) <= LOOSE:
        displaced = swapped(bins, room, displaced, length, pick.sample(sorted(bins), min(len(bins), SWAPPED)))
    best_fit(bins, room, sorted(displaced, key=lambda i: (-length[i], i)), length, capacity)
    return bins, room


def evolve(population: list, length: list[int], capacity: int, pick: random.Random, generations: int) -> list:
    """Each generation the worse half makes room for as many children. It ends early only at the least number of bins
    that the lengths allow, which nothing can beat."""
    least = math.ceil(sum(length) / capacity)
    rank = lambda some: sorted(some, key=lambda x: fitness(x, capacity), reverse=True)
    population = rank(population)
    for _ in range(generations):
        if len(population[0][0]) <= least:
            break
        parents = population[: max(2, POPULATION // 2)]
        children = [crossover(*pick.sample(parents, 2), length, capacity, pick) for _ in parents] if len(parents) > 1 else []
        population = rank(parents + children)[:POPULATION]
    return population


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """The pieces of each document: its ids, then ``end``. Null: an empty text. Extra columns are dropped."""

    @vectorised("n long, crcs array<long>")
    def run(text: pd.Series) -> pd.DataFrame:
        e, last = encoder(path or vocabulary()), np.array([end], "<u4")
        n, crcs = [], []
        for ids in e.many(text):
            raw = memoryview(np.concatenate([ids.astype("<u4", copy=False), last]).tobytes())
            n.append(len(raw) // 4)
            crcs.append([zlib.crc32(raw[at : at + 4 * capacity]) for at in range(0, len(raw), 4 * capacity)])
        return pd.DataFrame({"n": n, "crcs": crcs})

    found = docs.select("doc_id", run(F.col("text").cast("string").cast("binary")).alias("x"))
    found = found.select("doc_id", "x.n", F.posexplode("x.crcs").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * F.lit(capacity)
    return found.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - start).alias("length"), "ids_crc32")


ORDER = ["doc_id", "piece", "start", "ids_crc32"]
STATE = "block long, island int, lengths binary, population binary, elite binary, n_bins long, least long"


def _state(block: int, island: int, lengths: bytes, population: list, capacity: int) -> tuple:
    best = population[0]
    least = math.ceil(sum(np.frombuffer(lengths, "<i4").tolist()) / capacity)
    return block, island, lengths, pickle.dumps(population[1:]), pickle.dumps(best), len(best[0]), least


def _blocks(items: DataFrame, spark: SparkSession, capacity: int, level: int, name: str) -> DataFrame:
    """``items`` with the bin of each piece in its block, and how full that bin is."""

    def gather(key, rows: pd.DataFrame) -> pd.DataFrame:
        owned("islands")
        rows = rows.sort_values(ORDER, kind="stable")
        lengths = rows["length"].to_numpy().astype("<i4").tobytes()
        return pd.DataFrame({"block": [key[0]] * ISLANDS, "island": range(ISLANDS), "lengths": [lengths] * ISLANDS})

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for x in batch.itertuples():
                    length = np.frombuffer(x.lengths, "<i4").tolist()
                    pick = random.Random(f"{level}:{x.block}:{x.island}:{number}")
                    if number:
                        population = [pickle.loads(x.elite), *pickle.loads(x.population)]
                        if x.migrant is not None:
                            population.append(pickle.loads(x.migrant))
                    else:
                        population = [fresh(length, capacity, pick, 0.0 if not x.island and not k else 0.02 * (1 + x.island) * k) for k in range(POPULATION)]
                    rows.append(_state(x.block, x.island, x.lengths, evolve(population, length, capacity, pick, GENERATIONS), capacity))
                yield pd.DataFrame(rows, columns=["block", "island", "lengths", "population", "elite", "n_bins", "least"])

        return run

    states = items.select("block", *ORDER, "length").groupBy("block").applyInPandas(gather, "block long, island int, lengths binary")
    states = cut(states.repartition("block", "island").mapInPandas(epoch(0), STATE), spark, f"{name}-epoch0")
    for number in range(1, EPOCHS):
        best = states.groupBy("block").agg(F.min(F.col("n_bins") - F.col("least")).alias("over"))
        if not best.where("over > 0").limit(1).count():
            break
        sent = states.select("block", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.col("elite").alias("migrant"))
        states = cut(states.join(sent, ["block", "island"]).mapInPandas(epoch(number), STATE), spark, f"{name}-epoch{number}")
    best = states.groupBy("block").agg(F.min_by("elite", F.struct("n_bins", "island")).alias("elite"))

    def assign(key, rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        owned("islands")
        rows = rows.sort_values(ORDER, kind="stable").reset_index(drop=True)
        bins, room = pickle.loads(chosen["elite"].iloc[0])
        length = rows["length"].tolist()
        bin_of, offset, used = [0] * len(rows), [0] * len(rows), [0] * len(rows)
        for k, items_ in enumerate(bins.values()):
            at = 0
            for i in items_:
                bin_of[i], offset[i] = k, at
                at += length[i]
            for i in items_:
                used[i] = at
        return rows.assign(bin=bin_of, offset=offset, used=used)[["block", *ORDER, "length", "bin", "offset", "used"]]

    schema = "block long, doc_id string, piece int, start long, ids_crc32 long, length long, bin long, offset long, used long"
    return items.select("block", *ORDER, "length").groupBy("block").cogroup(best.groupBy("block")).applyInPandas(assign, schema)


def pack(docs: DataFrame, spark: SparkSession, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of ``docs``.

    A null or empty text is one piece, the end mark; a null doc_id stays null. Ties and repeated rows are pieces like
    any other; extra columns go, whatever their names; an empty table gives an empty one.
    """
    # A doc_id goes through Python as a string: a null would make floats of the others. Pieces are narrow rows, and an
    # executor may start a process for each file, so the many partitions of the texts are gathered into few files.
    found = pieces(docs, path, capacity).withColumn("doc_id", F.col("doc_id").cast("string"))
    cut_up = cut(found.repartition(files_for(docs.count())), spark, "pieces")
    columns = [*ORDER, "length"]
    whole = cut_up.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, rest, level = [whole], cut_up.where(F.col("length") < capacity).select(*columns), 0
    n = rest.count()
    while n:
        blocks = math.ceil(n / BLOCK)
        items = rest.withColumn("block", F.pmod(F.xxhash64(*ORDER), F.lit(blocks)).cast("long"))
        placed = _blocks(items, spark, capacity, level, f"pack{level}")
        placed = cut(placed.withColumn("sequence_id", F.lit(level << 56) + F.col("block") * F.lit(1 << 24) + F.col("bin")), spark, f"packed{level}")
        poor = F.col("used") < F.lit(FULL_ENOUGH * capacity) if blocks > 1 else F.lit(False)
        done.append(placed.where(~poor).select(*columns, "sequence_id", "offset"))
        rest, before, level = placed.where(poor).select(*columns), n, level + 1
        n = rest.count() if blocks > 1 else 0
        if n > before // 2:  # blocks that don't fill: what is left stays as it is
            done.append(placed.where(poor).select(*columns, "sequence_id", "offset"))
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), spark)
