"""Language identification by bit-sliced Bloom filters of n-grams.

One filter holds all languages: a slot is a word with a bit for each language. An n-gram sets its language's bit
in K slots; the conjunction of the K words read for an n-gram has the bits of all languages that contain it. A
text's count for a language is the number of its n-grams with that bit, less what false positives add at the
filter's filling; the language with the highest corrected count is predicted.

The filter is learned from a bounded sample (``PER_LANGUAGE`` expected documents of each language, their ``GRAMS`` most
frequent n-grams); predictions read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import table, vectorised

SIZES = (2, 3, 4)  # letters of an n-gram; a run of other characters counts as one blank
PER_LANGUAGE = 1500
GRAMS = 100_000  # of a language
SLOTS, K = 1 << 21, 3
SHARE = 0.4  # of the highest rate of an n-gram that a language needs, to contain it
LEAST = 4  # times an n-gram must occur
STRETCH = 1 << 20  # characters hashed at once
B = np.uint64(0x100000001B3)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)


def codes(text: str) -> np.ndarray:
    """Code points of the lower-case letters, one blank for each run of other characters, blanks around."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(x, 0xFFFF)]
    if (high := np.flatnonzero(x > 0xFFFF)).size:
        letter = letter.copy()
        letter[high] = [chr(c).isalpha() for c in x[high].tolist()]
    x = np.concatenate([[0], np.where(letter, x, 0), [0]]).astype(np.uint64)
    return x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text, in stretches of bounded size."""
    x = codes(text)
    if not x.any():
        return
    for at in range(0, len(x), STRETCH):
        part = x[at : at + STRETCH + max(SIZES) - 1]
        h, out = part, []
        for n in range(2, max(SIZES) + 1):
            if len(part) < n:
                break
            h = h[:-1] * B + part[n - 1 :] + np.uint64(1)
            if n in SIZES:
                out.append((h[: min(len(h), STRETCH)] ^ np.uint64(n)) * MIX[0])
        if out:
            yield np.concatenate(out)


def _slots(h: np.ndarray, k: int, slots: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX[k]
    return (h >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


class Filter:
    """Bit-sliced Bloom filter over up to 64 languages for each word of a slot."""

    def __init__(self, languages: list[str], members: list[np.ndarray], slots: int = SLOTS):
        self.languages, self.slots = languages, slots
        kind = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
        self.words = np.zeros(((len(languages) + 63) // 64 or 1, slots), kind)
        for i, h in enumerate(members):
            for k in range(K):
                self.words[i // 64, _slots(h, k, slots)] |= kind(1 << i % 64)
        self.false = [float(np.mean((self.words[i // 64] >> kind(i % 64)) & kind(1))) ** K for i in range(len(languages))]

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """n-grams of a text, and for each language its count, corrected for false positives."""
        n, hits = 0, np.zeros(len(self.languages))
        for h in grams(text):
            n += len(h)
            at = [_slots(h, k, self.slots) for k in range(K)]
            for w, word in enumerate(self.words):
                mask = word[at[0]]
                for a in at[1:]:
                    mask &= word[a]
                for i in range(64 * w, min(len(self.languages), 64 * w + 64)):
                    hits[i] += np.count_nonzero(mask & word.dtype.type(1 << i % 64))
        false = np.array(self.false)
        return n, np.maximum((hits - n * false) / np.maximum(1 - false, 1e-9), 0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and its share of all corrected counts; ``und`` without letters."""
        if not isinstance(text, str) or not self.languages:
            return "und", 0.0
        n, hits = self.counts(text)
        if not n:
            return "und", 0.0
        best = int(hits.argmax())
        return self.languages[best], float(hits[best] / hits.sum()) if hits.sum() else 0.0


def fold(column="doc_id"):
    """0 to 4; rows of 0 are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = GRAMS) -> Filter:
    """Learn a filter from ``docs`` (doc_id, text, lang), without the held-out fold; null texts or langs take no part."""
    known = docs.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not sizes:
        return Filter([], [])
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(per_language) / n)])
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < share[F.col("lang")] * F.lit(1 << 30))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                found = [h for t in rows["text"] for h in grams(t)]
                if found:
                    g, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": g.view(np.int64), "n": n})

    counted = sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    # Each language has its own ranks, so none is crowded out; ``most`` grams for each, LEAST times only where it has so many.
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    top = ranked.where(F.col("rank") <= most).select("lang", "gram", "n").toPandas()
    rare = top.groupby("lang")["n"].transform("max") < 10 * LEAST  # a language of few texts keeps all its grams
    top = top[rare | (top["n"] >= LEAST)].copy()
    languages = sorted(sizes)
    top["rate"] = top["n"] / top.groupby("lang")["n"].transform("sum")
    inside = top[top["rate"] >= SHARE * top.groupby("gram")["rate"].transform("max")]
    return Filter(languages, [inside[inside["lang"] == x]["gram"].to_numpy().astype(np.int64).view(np.uint64) for x in languages])


def identify(docs: DataFrame, spark: SparkSession, model: Filter | None = None) -> DataFrame:
    """doc_id, lang_pred and score of each row. Null, empty and letterless texts: ``und``, 0. Ties go to the language
    that comes first by name; repeated rows get the same answer; extra columns go; an empty table gives an empty one."""
    sent = spark.sparkContext.broadcast(model or fit(docs))  # bounded: SLOTS words

    @vectorised("lang_pred string, score double")
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.predict(t) for t in text], columns=["lang_pred", "score"])

    return docs.select("doc_id", run(F.col("text").cast("string")).alias("x")).select("doc_id", "x.*")


def op4_language_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"), spark)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
