"""MinHash near-dedup by an inverted join of signature coordinates.

A document's signature has COORDINATES values, each the least hash of its shingles under another mixing. Documents
of equal shingle sets are one representative. Representatives are posted under (coordinate, value) tuples of WIDTH
coordinates; what shares a posting is joined into clusters by stars on the least document, never by pairs. A pair
of Jaccard similarity 0.85 shares no posting with a probability of 2e-8. The clusters only say who must meet:
within one, and for large ones between bounded blocks of it, an inverted index over the single coordinate-value
pairs is merged. The shortest COORDINATES - matches + 1 lists of a document give its candidates, lists skip what
precedes the document, and pairs with at least ``matches`` collisions are retained and confirmed on their full shingle
sets, if they aren't connected yet. The links that are found, a forest for each task, are joined into components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import drop, owned, put, table, trim, vectorised
from orrery.llm.graphs import components, looked_up
from orrery.llm.words import bounds, hashes, rolled, words_of

SHINGLE = 5
COORDINATES, WIDTH = 96, 4
BELOW = 6.17  # deviations below its average that a retained pair's collisions may be
TILE = 512  # shingles that are mixed at once
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 1_000_000  # of a cluster, that meet in a task
MIXES = np.random.default_rng(20240501).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text, A-Z in lower case; of all its words, if they are fewer."""
    line = b" ".join(words_of(text)).lower()  # of bytes: A-Z only
    h = hashes(line, *bounds(line))
    return np.unique(rolled(h, min(SHINGLE, len(h)))) if len(h) else h


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), TILE):
        z = s[None, at : at + TILE] * MIXES[:, None]
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(out, (z >> np.uint64(32)).min(axis=1).astype(np.uint32), out=out)
    return out


@vectorised("n_shingles long, hi long, lo long, keys array<long>")
def _sign(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        s = shingles(t)
        if not len(s):
            rows.append((0, 0, 0, None))
            continue
        d = xxhash.xxh3_128_intdigest(s.tobytes())
        sig = signature(s).reshape(-1, WIDTH).astype(np.uint64)
        keys = rolled(np.concatenate([sig, np.arange(len(sig), dtype=np.uint64)[:, None]], axis=1).ravel(), WIDTH + 1)[:: WIDTH + 1]
        rows.append((len(s), (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), keys.view(np.int64)))
    return pd.DataFrame(rows, columns=["n_shingles", "hi", "lo", "keys"])


class Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def matches(percent: int) -> int:
    """Collisions of a retained pair: 60 at a similarity of 0.85, where a pair has 81.6 on average; 52 of 76.8 at 0.80."""
    p = percent / 100
    return max(1, int(COORDINATES * p - BELOW * math.sqrt(COORDINATES * p * (1 - p))))


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs of ``sets`` whose similarity is at least ``percent`` / 100; with two sides, of pairs across."""
    m, least = len(sets), matches(percent)
    size = np.array([len(s) for s in sets])
    across = side.min() != side.max()
    sig = np.stack([signature(s) for s in sets])
    lists, token = [], np.empty((m, COORDINATES), np.int64)
    for c in range(COORDINATES):
        values, inverse = np.unique(sig[:, c], return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        token[:, c] = len(lists) + inverse
        lists += np.split(order, np.cumsum(np.bincount(inverse, minlength=len(values)))[:-1])
    length = np.array([len(x) for x in lists])
    union, forest, near = Union(m), [], []

    def confirm(i: int, js: np.ndarray) -> None:
        sizes = size[js]
        if not len(js):
            return
        hit = np.isin(np.concatenate([sets[j] for j in js]), sets[i], assume_unique=False)
        both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        for j in js[100 * both >= percent * (sizes + size[i] - both)].tolist():
            if union.join(i, j):
                forest.append((i, j))

    for i in range(m):
        mine = token[i]
        short = mine[np.argsort(length[mine], kind="stable")[: COORDINATES - least + 1]]
        parts = [x[np.searchsorted(x, i, "right") :] for x in (lists[t] for t in short.tolist()) if len(x) > 1]
        js = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
        if across and len(js):
            js = js[side[js] != side[i]]
        if len(js):
            js = js[(100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i]))]
        if not len(js):
            continue
        n = (sig[js] == sig[i]).sum(axis=1)
        js, n = js[n >= least], n[n >= least]
        best = js[np.argsort(-n, kind="stable")[:3]]
        confirm(i, best)
        if len(js) > len(best):
            near.append((i, js))
    for i, js in near:
        mine = union.root(i)
        confirm(i, js[np.fromiter((union.root(j) != mine for j in js.tolist()), bool, len(js))])
    return forest


def link(docs: DataFrame, spark: SparkSession, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    Texts that are null, empty or without words have no shingles and are linked with nothing. Rows of one doc_id are
    one document: if their texts differ, they are linked with all that any of these is linked with. A row without
    doc_id is linked with nothing. Extra columns go, whatever their names; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    signed, signed_at = put(rows.withColumn("x", _sign("text")).select("doc_id", "x.*"), spark, "signed")
    some = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = some.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("_n"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    reps, reps_at = put(reps, spark, "reps", signed.count())
    size = reps.agg(F.count(F.lit(1)).alias("reps"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    posted = reps.select("rep", F.explode("keys").alias("key"))
    heads = posted.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("_n")).where("head < last").drop("last")
    edges = looked_up(posted, heads, ["key"], size["reps"] * (COORDINATES // WIDTH)).where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    coarse = components(edges, spark, "clusters", size["reps"] * (COORDINATES // WIDTH))
    roots = coarse.select(F.col("root").alias("rep"), F.col("root").alias("cluster")).distinct()
    sizes = reps.groupBy("rep").agg(F.sum("n").alias("n"))
    member, _ = put(coarse.select(F.col("a").alias("rep"), F.col("root").alias("cluster")).unionByName(roots).join(sizes.hint("merge"), "rep"), spark, "members", size["reps"])
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    dealt = looked_up(member, member.groupBy("cluster").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("_n")), ["cluster"], size["reps"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A block meets itself and each other block of its cluster; most clusters are of one block.
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("rep", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    texts = rows.join(dealt.hint("merge"), rows["doc_id"] == dealt["rep"]).select("rep", "cluster", "i", "j", "block", "text")

    def confirm(key, part: pd.DataFrame) -> pd.DataFrame:
        owned(__name__)
        part = part.drop_duplicates(["rep", "text"]).sort_values("rep", kind="stable")
        sets, ids = [shingles(t) for t in part["text"]], part["rep"].to_numpy()
        some = np.flatnonzero([len(s) > 0 for s in sets])
        found = linked([sets[i] for i in some], part["block"].to_numpy()[some], percent) if len(some) > 1 else []
        ids = ids[some].tolist()
        trim()
        return pd.DataFrame([(ids[a], ids[b]) for a, b in found], columns=["a", "b"])

    links = texts.groupBy("cluster", "i", "j").applyInPandas(confirm, "a long, b long")
    twice = some.groupBy("doc_id").agg(F.min("hi").alias("low"), F.max("hi").alias("high"), F.count(F.lit(1)).alias("_n")).where("low < high").select("doc_id", "_n")
    if twice.limit(1).count():  # documents of several texts
        own = looked_up(some.select("doc_id", "hi", "lo"), twice, ["doc_id"], size["rows"]).select("doc_id", "hi", "lo").distinct()
        links = links.unionByName(own.join(reps.select("hi", "lo", "rep").hint("merge"), ["hi", "lo"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = components(links, spark, "links").select(F.col("a").alias("rep"), "root")
    named = reps.join(roots.hint("merge"), "rep", "left").select("hi", "lo", F.coalesce("root", "rep").alias("root"), "last", "rep", "_n")
    # Only texts that several rows hold, or that are linked, are looked up; a third of all rows may hold one of them.
    named, _ = put(named.where("last > rep or root <> rep").select("hi", "lo", "root", "_n"), spark, "named", size["reps"])
    drop(spark, reps_at)
    base = signed.select("doc_id", "n_shingles", "hi", "lo")
    free = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = looked_up(base.where(~free), named, ["hi", "lo"], size["rows"]).select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    alone = base.where(~free).join(named.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti").unionByName(base.where(free))
    return out.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def without_copies(docs: DataFrame, spark: SparkSession, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, as it is; of several rows of that doc_id the
    one whose text has the least hash. Rows without doc_id stay."""
    found = link(docs, spark, percent)
    stays = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    stays, _ = put(stays, spark, "stays", docs.count())
    kept = docs.join(stays.select("doc_id").hint("merge"), "doc_id", "left_semi")
    if stays.where("rows > 1").limit(1).count():  # repeated rows of one id
        rows = kept.select(F.struct(*docs.columns).alias("row"))
        kept = rows.groupBy(F.col("row.doc_id").alias("id")).agg(F.min_by("row", F.xxhash64(F.col("row.text").cast("string"))).alias("row")).select("row.*")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op5_signature_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(table(spark, sf_dir, "documents"), spark)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
