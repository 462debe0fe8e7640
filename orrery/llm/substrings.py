"""Substring dedup by automata of repeated phrases.

Every window of WINDOW words has an anchor: of its PHRASE-word phrases the one with the least hash. Equal windows
have equal anchors, so a window can recur only if its anchor does. The distinct anchors of each shard of documents,
with their words, are met in ranges of their hash; those that a second document holds are the recurring phrases.
Each phrase goes, as it was read in the first document that holds it, to every shard whose documents may hold it.
There an Aho-Corasick automaton is compiled of the phrases and all documents of the shard are streamed through it.
Only windows whose anchor the automaton located are looked at: they are grouped over all shards by a 96-bit key, and
a word is removed if a window that covers it also starts in a document with a smaller doc_id. Whole copies of a text
lose all words at once.

Shards are of bounded size, and what they send to a range is combined before: a passage that a third of all documents
share is one entry for each shard. So are ranges, whose number grows with the bytes of the texts.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import drop, owned, put, table, tidy, trim, vectorised
from orrery.llm.words import bounds, hashes, rolled, sliding, words_of

WINDOW, PHRASE = 13, 4
SPAN = WINDOW - PHRASE + 1  # phrases of a window
CORNERS = (0, 4, 8, SPAN - 1)  # phrases of a window that together hold all its words
SHARD_DOCS, SHARD_BYTES = 600, 4_000_000  # of a shard, as expected
CHUNK = 1 << 19  # bytes of documents that are hashed together
RANGE_BYTES = 16_000_000  # of texts whose anchors or windows a range holds
OWN = -1  # the range of rows that stay in their shard
HIGHEST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(*parts: np.ndarray, seed: int) -> np.ndarray:
    out = np.full(len(parts[0]), seed, np.uint64)
    for x in parts:
        out = (out ^ x) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(35)
    return out


def _own(docs: pd.DataFrame, copies: pd.DataFrame) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int]]]:
    """(doc_id, rid, words joined by blanks) of the documents that are no copies of one with a smaller doc_id, once
    each, and (doc_id, rid) of the copies."""
    low = dict(zip(zip(copies["rid"].tolist(), copies["sub"].tolist()), copies["low"].tolist()))
    own, gone, seen = [], [], set()
    for doc_id, rid, sub, text in zip(docs["doc_id"].tolist(), docs["rid"].tolist(), docs["sub"].tolist(), docs["text"]):
        words = words_of(text)
        if len(words) < WINDOW or (doc_id, rid) in seen:
            continue
        seen.add((doc_id, rid))
        if low.get((rid, sub), doc_id) < doc_id:
            gone.append((doc_id, rid))
        else:
            own.append((doc_id, rid, b" ".join(words)))
    return own, gone


def _chunks(lines: list[bytes]):
    """Slices of ``lines`` of about CHUNK bytes."""
    at, size = 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        if size >= CHUNK or i == len(lines) - 1:
            yield lines[at : i + 1]
            at, size = i + 1, 0


def anchors_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of documents: the distinct hashes of their anchors in order, which of them several documents hold, and the phrases."""
    line = b" ".join(lines)
    starts, ends = bounds(line)
    doc = np.repeat(np.arange(len(lines)), [x.count(b" ") + 1 for x in lines])
    phrases = rolled(hashes(line, starts, ends), PHRASE)
    inside = doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :]
    anchors = np.where(inside, sliding(np.minimum, phrases, SPAN), np.uint64(0))
    # A phrase is the anchor of one of the windows that hold it if the highest of their anchors is this phrase.
    edge = np.zeros(SPAN - 1, np.uint64)
    at = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, anchors, edge]), SPAN) == phrases)
    values, first, inverse = np.unique(phrases[at], return_index=True, return_inverse=True)
    low, high = np.full(len(values), len(lines)), np.full(len(values), -1)
    np.minimum.at(low, inverse, doc[at])
    np.maximum.at(high, inverse, doc[at])
    texts = [line[s:e] for s, e in zip(starts[at[first]].tolist(), ends[at[first] + PHRASE - 1].tolist())]
    return values, low < high, texts


def _ranges(keys: np.ndarray, bits: int):
    """(range, first, end) of the sorted ``keys``, by their first ``bits`` bits."""
    if bits == 0:
        yield 0, 0, len(keys)
        return
    numbers = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(numbers[1:] != numbers[:-1]) + 1, [len(keys)]]).tolist()
    for i, j in zip(edges, edges[1:]):
        if i < j:
            yield int(numbers[i]), i, j


ANCHORS = "range int, shard int, keys binary, several binary, texts binary"


def _anchors(bits: int):
    def run(key, docs: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
        owned(__name__)
        own, _ = _own(docs, copies)
        parts = [anchors_of(lines) for lines in _chunks([line for _, _, line in own])]
        rows = []
        if parts:
            keys, several, texts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), list(chain.from_iterable(p[2] for p in parts))
            order = np.argsort(keys, kind="stable")
            heads = np.concatenate([[0], np.flatnonzero(np.diff(keys[order])) + 1])
            several = np.add.reduceat(several[order].astype(np.int64) + 1, heads) > 1
            keys, texts = keys[order][heads], [texts[i] for i in order[heads].tolist()]
            for number, i, j in _ranges(keys, bits):
                rows.append((number, int(key[0]), keys[i:j].tobytes(), several[i:j].tobytes(), b"\n".join(texts[i:j])))
        trim()
        return pd.DataFrame(rows, columns=["range", "shard", "keys", "several", "texts"])

    return run


def _recurring(key, rows: pd.DataFrame) -> pd.DataFrame:
    """For each shard the phrases of the range that it holds and that some second document holds as well."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["keys"]])
    several = np.concatenate([np.frombuffer(x, bool) for x in rows["several"]])
    shard = np.repeat(rows["shard"].to_numpy(np.int64), [len(x) // 8 for x in rows["keys"]])
    texts = list(chain.from_iterable(x.split(b"\n") for x in rows["texts"]))
    order = np.argsort(keys, kind="stable")
    heads = np.concatenate([[0], np.flatnonzero(np.diff(keys[order])) + 1])
    recurs = np.add.reduceat(several[order].astype(np.int64) + 1, heads) > 1
    size = np.diff(np.concatenate([heads, [len(keys)]]))
    first = np.repeat(order[heads], size)[np.repeat(recurs, size)]  # of each entry that recurs, where its phrase was first read
    mine = shard[order][np.repeat(recurs, size)]
    by = np.argsort(mine, kind="stable")
    first, mine = first[by], mine[by]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(mine)) + 1, [len(mine)]]).tolist()
    out = [(int(mine[i]), b"\n".join([texts[x] for x in first[i:j].tolist()])) for i, j in zip(edges, edges[1:]) if i < j]
    trim()
    return pd.DataFrame(out, columns=["shard", "phrases"])


def automaton_of(phrases: list[bytes]):
    """An Aho-Corasick automaton of phrases with blanks around, over bytes written as the letters up to U+00FF."""
    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(f" {p.decode('latin-1')} ", 1)
    automaton.make_automaton()
    return automaton


def located(line: bytes, automaton, starts: np.ndarray) -> np.ndarray:
    """The words of a line at which a phrase of the automaton starts."""
    ends = np.fromiter((end for end, _ in automaton.iter(f" {line.decode('latin-1')} ")), np.int64)
    return np.searchsorted(starts, ends) - PHRASE


def windows_of(line: bytes, automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows start whose anchor the automaton locates, and their keys of 64 and 32 bits."""
    starts, ends = bounds(line)
    at = located(line, automaton, starts)
    if not len(at):
        return at, at.astype(np.uint64), at.astype(np.uint32)
    phrases = rolled(hashes(line, starts, ends), PHRASE)
    found = np.full(len(phrases), HIGHEST)
    found[at] = phrases[at]
    at = np.flatnonzero(sliding(np.minimum, found, SPAN) == sliding(np.minimum, phrases, SPAN))
    parts = [phrases[at + c] for c in CORNERS]
    return at, _mixed(*parts, seed=1), (_mixed(*parts, seed=2) >> np.uint64(32)).astype(np.uint32)


WINDOWS = "range int, shard int, doc_id long, rid long, at binary, a binary, b binary, low binary, high binary"


def _scan(bits: int):
    def run(key, docs: pd.DataFrame, feed: pd.DataFrame) -> pd.DataFrame:
        owned(__name__)
        own, gone = _own(docs, feed[feed["phrases"].isna()])
        # A row without windows says that all words go. Numbers are never null: among nulls they would become floats.
        rows = [(OWN, int(key[0]), doc_id, rid, None, None, None, None, None) for doc_id, rid in gone]
        phrases = list(chain.from_iterable(p.split(b"\n") for p in feed["phrases"].dropna()))
        if phrases and own:
            automaton = automaton_of(phrases)
            ids, sizes, parts = [], [], []
            for doc_id, rid, line in own:
                at, a, b = windows_of(line, automaton)
                if len(at):
                    rows.append((OWN, int(key[0]), doc_id, rid, at.astype("<i4").tobytes(), a.tobytes(), b.tobytes(), None, None))
                    ids.append(doc_id)
                    sizes.append(len(at))
                    parts.append((a, b))
            if ids:
                a, b, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.repeat(np.array(ids, np.int64), sizes)
                a, b, low, high = _extremes(a, b, doc, doc)
                for number, i, j in _ranges(a, bits):
                    rows.append((number, int(key[0]), 0, 0, None, a[i:j].tobytes(), b[i:j].tobytes(), low[i:j].tobytes(), high[i:j].tobytes()))
            del automaton
        trim()
        return pd.DataFrame(rows, columns=["range", "shard", "doc_id", "rid", "at", "a", "b", "low", "high"])

    return run


def _extremes(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The distinct keys in order, with the least ``low`` and the greatest ``high`` of each."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    heads = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1])
    return a[heads], b[heads], np.minimum.reduceat(low[order], heads), np.maximum.reduceat(high[order], heads)


def _blobs(column: pd.Series, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column]) if len(column) else np.empty(0, kind)


def _first(key, rows: pd.DataFrame) -> pd.DataFrame:
    """For each shard the keys of the range that a smaller doc_id holds too, with the least doc_id."""
    a, b, low, high = (_blobs(rows[c], k) for c, k in (("a", np.uint64), ("b", np.uint32), ("low", np.int64), ("high", np.int64)))
    shard = np.repeat(rows["shard"].to_numpy(np.int64), [len(x) // 8 for x in rows["a"]])
    order = np.lexsort((b, a))
    a, b, high, shard = a[order], b[order], high[order], shard[order]
    heads = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1])
    low = np.repeat(np.minimum.reduceat(low[order], heads), np.diff(np.concatenate([heads, [len(a)]])))
    some = np.flatnonzero(low < high)
    some = some[np.argsort(shard[some], kind="stable")]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard[some])) + 1, [len(some)]]).tolist()
    out = []
    for i, j in zip(edges, edges[1:]):
        if i < j:
            at = some[i:j]
            out.append((int(shard[at[0]]), a[at].tobytes(), b[at].tobytes(), low[at].tobytes()))
    trim()
    return pd.DataFrame(out, columns=["shard", "a", "b", "low"])


def _lost(key, rows: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
    """Of each document of a shard the starts of the windows that go; none of a document that goes as a whole."""
    a, b, low = (_blobs(first[c], k) for c, k in (("a", np.uint64), ("b", np.uint32), ("low", np.int64)))
    order = np.lexsort((b, a))
    a, b, low = a[order], b[order], low[order]
    out = []
    for doc_id, rid, at, x, y in zip(rows["doc_id"], rows["rid"], rows["at"], rows["a"], rows["b"]):
        if at is None:
            out.append((int(doc_id), int(rid), np.empty(0, np.int32)))
        elif len(a):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint32)
            i = np.searchsorted(a, x)
            gone = np.zeros(len(x), bool)
            for step in (0, 1):  # two keys may agree in 64 bits
                j = np.minimum(i + step, len(a) - 1)
                gone |= (a[j] == x) & (b[j] == y) & (low[j] < int(doc_id))
            if gone.any():
                out.append((int(doc_id), int(rid), np.frombuffer(at, "<i4")[gone]))
    trim()
    return pd.DataFrame(out, columns=["doc_id", "rid", "lost"])


def repeats(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, rid (a hash of the text) and ``lost`` of the rows of ``docs`` that lose words: the starts of the windows
    that go, or none if all words go. Rows of equal doc_id and text are one row here."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * WINDOW - 1))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(1, math.ceil(max(size["n"] / SHARD_DOCS, (size["bytes"] or 0) / SHARD_BYTES)))
    bits = max(3, math.ceil(math.log2(max(1, (size["bytes"] or 0) / RANGE_BYTES))))
    rid, sub = F.xxhash64("text"), F.xxhash64(F.lit("sub"), "text")
    dealt = rows.select("doc_id", rid.alias("rid"), sub.alias("sub"), F.col("text").cast("binary").alias("text"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(shards)).cast("int"))
    # Copies are counted by shard first, so a text that a third of all rows hold is one row for each shard.
    held = dealt.groupBy("shard", "rid", "sub").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    many = held.groupBy("rid", "sub").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    copies, copies_at = put(held.select("shard", "rid", "sub").join(many.select("rid", "sub", "low").hint("merge"), ["rid", "sub"]).select("shard", "rid", "sub", "low"), spark, "copies")
    anchors = dealt.groupBy("shard").cogroup(copies.groupBy("shard")).applyInPandas(_anchors(bits), ANCHORS)
    phrases, phrases_at = put(anchors.groupBy("range").applyInPandas(_recurring, "shard int, phrases binary"), spark, "phrases")
    del anchors
    tidy(spark)
    zero = F.lit(0).cast("long")  # no nulls, which would make floats of the other numbers
    feed = phrases.select("shard", "phrases", zero.alias("rid"), zero.alias("sub"), zero.alias("low"))
    feed = feed.unionByName(copies.select("shard", F.lit(None).cast("binary").alias("phrases"), "rid", "sub", "low"))
    windows, windows_at = put(dealt.groupBy("shard").cogroup(feed.groupBy("shard")).applyInPandas(_scan(bits), WINDOWS), spark, "windows")
    drop(spark, copies_at, phrases_at)
    del feed, phrases, copies
    tidy(spark)
    first = windows.where(F.col("range") != OWN).select("range", "shard", "a", "b", "low", "high").groupBy("range").applyInPandas(_first, "shard int, a binary, b binary, low binary")
    own = windows.where(F.col("range") == OWN).select("shard", "doc_id", "rid", "at", "a", "b")
    lost, _ = put(own.groupBy("shard").cogroup(first.groupBy("shard")).applyInPandas(_lost, "doc_id long, rid long, lost array<int>"), spark, "lost")
    drop(spark, windows_at)
    tidy(spark)
    return lost


def covered(n: int, at) -> np.ndarray:
    """Which of n words a window that starts at one of ``at`` covers; all, if ``at`` is empty."""
    if not len(at):
        return np.ones(n, bool)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.asarray(at), 1)
    np.add.at(steps, np.minimum(n, np.asarray(at) + WINDOW), -1)
    return np.cumsum(steps[:n]) > 0


def _marked(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """``docs`` as a struct, its text as bytes, and what it loses. Columns of ``docs`` can't clash with the added ones."""
    # The key of a row without doc_id agrees with nothing, and its rid spreads such rows.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("rid"))
    return rows.join(lost.hint("merge"), ["doc_id", "rid"], "left").select("row", "lost")


def _kept(text, at) -> tuple[int, list[bytes]]:
    """How many words a text has, and which of them stay."""
    words = words_of(text)
    return len(words), words if at is None else [w for w, g in zip(words, covered(len(words), at).tolist()) if not g]


@vectorised("n_words long, n_removed long, kept_sha256 string")
def _counted(text: pd.Series, lost: pd.Series) -> pd.DataFrame:
    out = []
    for t, at in zip(text, lost):
        n, kept = _kept(t, at)
        out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])


@vectorised("string")
def _left(text: pd.Series, lost: pd.Series) -> pd.Series:
    return pd.Series([b" ".join(_kept(t, at)[1]).decode("utf-8", "surrogatepass") for t, at in zip(text, lost)], dtype=object)


def dedup(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of ``docs``.

    Null and empty texts have no words. Rows of one doc_id don't remove each other's words, whatever their texts; a
    row without doc_id neither loses nor removes any. Ties don't arise: the smaller doc_id keeps its words. Extra
    columns go, whatever their names; an empty table gives an empty one.
    """
    marked = _marked(docs.select("doc_id", "text"), repeats(docs, spark))
    found = marked.select(F.col("row.doc_id").cast("long").alias("doc_id"), _counted(F.col("row.text").cast("string").cast("binary"), "lost").alias("x"))
    return found.select("doc_id", "x.n_words", "x.n_removed", "x.kept_sha256")


def without_repeats(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """``docs`` without the words that repeat a smaller doc_id; a column ``n_chars``, if there is one, follows.

    A text that loses none stays as it is; else its kept words are joined by blanks. A row whose every word is a
    repeat goes. Nulls, repeated rows and rows without doc_id are as in ``dedup``. Only texts that lose words pass
    through Python; all other columns keep their names and types.
    """
    marked = _marked(docs, repeats(docs, spark))
    same = marked.where("lost is null").select("row.*")
    less = marked.where("lost is not null").withColumn("left", _left(F.col("row.text").cast("string").cast("binary"), "lost")).where("left <> ''")
    new = {"text": F.col("left"), "n_chars": F.length("left")}
    less = less.select(*[(new[c] if c in new else F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    return same.unionByName(less)


def op6_repeated_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), spark)
