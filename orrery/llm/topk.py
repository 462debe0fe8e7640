"""Exact top-k inner products by no-random-access aggregation.

Each dimension of a block of vectors is a list sorted by the component. A query reads all lists in step, from the
high end where its own component is positive and from the low end where it is negative. What is read of a vector is
summed up, and never looked up elsewhere. After each of DEPTHS a vector has a lower bound (its sum, plus the least that
its unread components can give) and an upper bound (its sum, plus the most they can give, which the last values read in
each list bound). Vectors whose upper bound is below the query's k-th lower bound can't qualify: they are read no
further. A query stops once no more than k vectors are left, whose scores are then resolved; one that reads its lists to
their ends has its scores in the sums. In many independent dimensions bounds close late: README gives the shares.

Depths are taken for a block of queries at once, as matrix products over what is newly read. Blocks of vectors and of
queries are bounded and meet in a join on the query block, so neither side is broadcast or collected; partial results
are k rows for each query and block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import cut, table

SCALE = 1024
VECTORS, QUERIES = 8192, 512  # of a block
TOGETHER = 64  # blocks of queries in a task
DEPTHS = (1 / 32, 1 / 8, 1 / 2, 1)  # shares of each list that are read before bounds are looked at


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the components times ``scale``, rounded down; vectors null or with a null or non-finite component go."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def blocks(rows: DataFrame, size: int, name: str, spark: SparkSession) -> tuple[DataFrame, int]:
    """``rows`` (vec_id, x) as blocks of about ``size`` vectors, ids and components as bytes; how many blocks."""
    n = max(1, math.ceil(rows.count() / size))

    def gather(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        width = max(map(len, part["x"]), default=0)
        x = np.zeros((len(part), width), "<i8")  # a missing component counts as 0
        for i, v in enumerate(part["x"]):
            x[i, : len(v)] = v
        return pd.DataFrame({name: [key[0]], f"{name}_ids": [part["vec_id"].to_numpy().astype("<i8").tobytes()], f"{name}_x": [x.tobytes()]})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(n)).cast("int"))
    return cut(dealt.groupBy(name).applyInPandas(gather, f"{name} int, {name}_ids binary, {name}_x binary"), spark, f"{name}-blocks"), n


class Lists:
    """The sorted lists of a block: the rank of each vector in each dimension, and the components by rank."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        order = np.argsort(x, axis=0, kind="stable")
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(x))[:, None], axis=0)
        self.sorted = np.take_along_axis(x, order, axis=0)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
        """For each query its id, the ids and scores of the best k vectors of this block, itself left out, and the share
        of each list that it read."""
        n, x = len(self.x), self.x
        width = max(q.shape[1], x.shape[1])
        fill = lambda a: np.pad(a, ((0, 0), (0, width - a.shape[1])))
        q, rank = fill(q), fill(self.rank)
        most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(width, 1)
        kind = float if most < 2**51 else np.int64 if most < 2**60 else object  # each exact for its scores
        none = -4 * most - 1  # below all bounds
        up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
        full, line = fill(x).astype(kind), fill(self.sorted).astype(kind)
        left, cols, before = np.arange(len(q)), np.arange(n), 0
        read = np.zeros((len(q), n), kind)
        alive = query_ids[:, None] != self.ids[None, :]
        for depth in DEPTHS:
            t = n if depth == 1 else int(n * depth)
            if t <= before or not len(left):
                continue
            u, d, r = up[left], down[left], rank[cols]
            high, low = (r >= n - t) & (r < n - before), (r < t) & (r >= before)  # newly read from the top, from the bottom
            read = read + u @ (full[cols] * high).T + d @ (full[cols] * low).T
            before, lower, upper = t, read, read
            if t < n:  # unread components lie between the end of the list and the value last read
                above, below = (r < n - t).T.astype(kind), (r >= t).T.astype(kind)
                upper = read + (u * line[n - t]) @ above + (d * line[t - 1]) @ below
                lower = read + (u * line[0]) @ above + (d * line[-1]) @ below
            lower = np.where(alive, lower, none)
            kth = np.partition(lower, len(cols) - k, axis=1)[:, len(cols) - k] if len(cols) > k else np.full(len(left), none)
            alive = alive & (upper >= kth[:, None])
            done = (alive.sum(1) <= k) | (t == n)
            for i in np.flatnonzero(done).tolist():
                at = np.flatnonzero(alive[i])
                scores = read[i, at] if t == n else full[cols[at]] @ q[left[i]].astype(kind)
                yield (int(query_ids[left[i]]), *_best(self.ids[cols[at]], scores, k), t / n)
            some = alive[~done].any(0)  # vectors that no query of the block needs any more are read no further
            left, cols, read, alive = left[~done], cols[some], read[~done][:, some], alive[~done][:, some]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` by exact scores, which are then kept to 64 bits."""
    order = np.lexsort((ids, -scores))[:k]
    some = scores[order]
    return ids[order], (np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in some.tolist()], np.int64) if some.dtype == object else some.astype(np.int64))


def search(vectors: DataFrame, spark: SparkSession, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best vectors for each row of ``queries``.

    Scores are exact; one beyond 64 bits is written as the nearest 64-bit number, and ties of such go to the smaller vec_id.
    Both are (vec_id, embedding). A query never finds its own id; repeated rows of another id are found as often as
    they occur, ties go to the smaller vec_id. Vectors of unequal length compare as if filled up with zeros. Rows
    without id take no part; an empty side gives an empty result.
    """
    v, n_v = blocks(scaled(vectors), VECTORS, "v", spark)
    # Of repeated query rows the one of the least components asks.
    asked = scaled(queries).groupBy("vec_id").agg(F.min("x").alias("x"))
    q, n_q = blocks(asked, QUERIES, "q", spark)
    # Each group of query blocks meets each block of vectors once; both are bounded in bytes.
    v = v.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit((n_q - 1) // TOGETHER))))
    q = q.withColumn("g", F.expr(f"q div {TOGETHER}").cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            ids = np.frombuffer(left["v_ids"].iloc[0], "<i8")
            lists = Lists(ids, np.frombuffer(left["v_x"].iloc[0], "<i8").reshape(len(ids), -1))
            for r in right.itertuples():
                qids = np.frombuffer(r.q_ids, "<i8")
                for a, found, s, _ in lists.search(qids, np.frombuffer(r.q_x, "<i8").reshape(len(qids), -1), k):
                    rows += zip([a] * len(found), found.tolist(), s.tolist())
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    some = v.groupBy("v", "g").cogroup(q.groupBy("v", "g")).applyInPandas(meet, "query_id long, vec_id long, score long")
    return some.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_no_random_access_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, spark, vectors.where(F.col("vec_id") % 100 == 0))


OP3_SQL = """
with x as (
  select vec_id, list_transform(embedding, lambda v: cast(floor(1024 * cast(v as double)) as bigint)) as x
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
  from x q join x c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
