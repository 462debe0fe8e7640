"""Toxicity by a weighted finite-state grammar of clauses.

Words are mapped to classes (insult, threat, target, negation, reported speech, other), and each clause, a
sequence of classes, is read by the composition of small transducers: one marks what stands in the scope of a
negation, one what stands in reported speech, one what is aimed at a target. The output tells for each insult
and threat in which of these settings it stands, and each setting has a weight. A clause counts once, in its weightiest
setting; a text's score is logistic in the logarithms of the numbers of its clauses of each setting, so a second
clause tells more than the first alone, but less than twice as much.

The insults are learned from labelled rows: words, and stems that several words share, which nearly only toxic
documents hold. A greedy cover of the toxic documents keeps those that explain many of them and leaves the
accidents. The weights of the settings are fitted to the labels, all together; those of the grammar are their prior.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import drop, owned, put, table, vectorised
from orrery.llm.langid import fold

SAMPLE = 20_000  # labelled rows that are learned from, at most
STEMS = (4, 5, 6)  # letters of a stem
PURE, COVER = 0.96, 0.01  # share of toxic documents among a word's, share of all toxic ones that it must add
CACHED = 50_000
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

# Fixed word lists of the grammar, in English, German, French and Spanish.
THREAT = frozenset("kill hurt destroy murder attack töten verletzen vernichten umbringen tuer blesser détruire matar herir destruir".split())
TARGET = frozenset("you your yours you're he she they them du dich dein ihr euch sie tu toi vous ton votre usted ustedes vosotros tú ti".split())
NEGATION = frozenset("not never no isn't aren't don't nicht nie kein keine keinen pas jamais aucun nunca jamás ningún".split())
REPORTED = frozenset("said says wrote writes quoted claimed called sagte schrieb behauptete dit écrit affirmé dijo escribió afirmó".split())

#: Classes: insult, threat, target, negation, reported speech, other, end of a clause.
INSULT_, THREAT_, TARGET_, NEGATION_, REPORTED_, OTHER_, END_ = "itynro."

#: What a clause adds to the log-odds before labels are seen: (class, negated, reported, aimed).
PRIOR = {
    (c, n, r, a): (4.0 if c == "i" else 1.0) - (1.5 if n else 0.0) - (1.0 if r else 0.0) + (0.5 if a else 0.0)
    for c in "it" for n in (False, True) for r in (False, True) for a in (False, True)
}
SETTINGS = sorted(PRIOR)
BIAS = -3.0  # log-odds of a text without clauses
STRENGTH = 1.0  # of the prior: a deviation by one costs as much as one standard deviation of a normal variable


class Transducer:
    """A deterministic transducer: ``step(state, symbol)`` gives the output and the next state."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __rshift__(self, other: Transducer) -> Transducer:
        """The composition: this one's output is the other's input."""

        def step(state, symbol):
            out, mine = self.step(state[0], symbol)
            out, theirs = other.step(state[1], out)
            return out, (mine, theirs)

        return Transducer((self.start, other.start), step)

    def compiled(self, symbols: str) -> tuple[list[dict[str, tuple[object, int]]], int]:
        """States reachable over ``symbols``, as a table."""
        number, rows, todo = {self.start: 0}, [], [self.start]
        for state in todo:
            row = {}
            for s in symbols:
                out, then = self.step(state, s)
                if then not in number:
                    number[then] = len(number)
                    todo.append(then)
                row[s] = out, number[then]
            rows.append(row)
        return rows, 0


def negating(scope: int = 3) -> Transducer:
    def step(state, s):
        if s == END_:
            return (s, False), 0
        if s == NEGATION_:
            return (s, False), scope
        return (s, state > 0), max(0, state - 1)

    return Transducer(0, step)


def reporting() -> Transducer:
    return Transducer(False, lambda state, x: ((*x, state), x[0] == REPORTED_ or (state and x[0] != END_)))


def aiming(reach: int = 4) -> Transducer:
    def step(state, x):
        if x[0] == END_:
            return (*x, False), 0
        if x[0] == TARGET_:
            return (*x, False), reach
        return (*x, state > 0), max(0, state - 1)

    return Transducer(0, step)


GRAMMAR, START = (negating() >> reporting() >> aiming()).compiled("itynro.")


def settings(classes: str) -> list[list[tuple]]:
    """(class, negated, reported, aimed) of the insults and threats of each clause that has any, in a string of classes."""
    found = []
    for clause in classes.split(END_):
        if INSULT_ in clause or THREAT_ in clause:
            state, hits = START, []
            for s in clause:
                out, state = GRAMMAR[state][s]
                if s in "it":
                    hits.append(out)
            found.append(hits)
    return found


def counted(classes: str) -> list[int]:
    """How many clauses there are of each setting; a clause counts in the one that the grammar weighs most."""
    n = Counter(max(hits, key=lambda x: (PRIOR[x], x)) for hits in settings(classes))
    return [n[x] for x in SETTINGS]


def fitted(counts: list[list[int]], toxic: list[int], rows: list[int], rounds: int = 30) -> tuple[float, list[float]]:
    """Bias and weights of the settings by Newton's method: logistic regression with the grammar's weights as prior."""
    prior = np.array([BIAS, *[PRIOR[x] for x in SETTINGS]])
    if not counts:
        return BIAS, prior[1:].tolist()
    x = np.column_stack([np.ones(len(counts)), np.log2(1 + np.array(counts, float))])
    y, n, w = np.array(toxic, float), np.array(rows, float), prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - (w - prior) / STRENGTH**2
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / STRENGTH**2
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:].tolist()


class Model:
    """Words and stems that insult, the bias, and the weight of each setting."""

    def __init__(self, words: set[str], stems: set[str], bias: float = BIAS, weights: list[float] | None = None):
        self.words, self.stems, self.bias, self.weights = words, stems, bias, weights or [PRIOR[x] for x in SETTINGS]
        self.known: dict[str, str] = {}

    def __getstate__(self):
        return self.words, self.stems, self.bias, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def insult(self, word: str) -> bool:
        return word in self.words or any(word[:k] in self.stems for k in STEMS if len(word) > k)

    def classes(self, chunk: str) -> str:
        out = []
        for w in WORD.findall(chunk.lower()):
            w = w.replace("’", "'")
            out.append(
                INSULT_ if self.insult(w) else THREAT_ if w in THREAT else TARGET_ if w in TARGET else NEGATION_ if w in NEGATION else REPORTED_ if w in REPORTED else OTHER_
            )
        return "".join(out) + (END_ if chunk[-1:] in ".!?;" else "")

    def read(self, text: str) -> str:
        """The classes of a text's words, with the ends of clauses."""
        known, out = self.known, []
        for c in SPACE.split(text):
            s = known.get(c)
            if s is None:
                s = self.classes(c)
                if len(c) <= 48:
                    if len(known) >= CACHED:
                        known.clear()
                    known[c] = s
            out.append(s)
        return "".join(out)

    def score(self, text: str | None) -> float:
        """Of a text: 0 to 1. Null and empty: that of a text without clauses."""
        n = counted(self.read(text)) if isinstance(text, str) and text else ()
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.bias + sum(w * math.log2(1 + k) for w, k in zip(self.weights, n) if k)))))


def features(text: str) -> set[str]:
    words = {w.replace("’", "'") for w in WORD.findall(text.lower())}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _counted(rows: DataFrame, only: set[str] | None, name: str) -> DataFrame:
    """Of each word and stem (or of ``only`` some), in how many rows it occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owned(__name__)
        for batch in batches:
            n: Counter = Counter()
            for t in batch["text"]:
                n.update(features(t) if only is None else features(t) & only)
            yield pd.DataFrame({"feature": list(n), "n": list(n.values())})

    return rows.select("text").mapInPandas(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias(name))


def fit(docs: DataFrame, labels: DataFrame, spark: SparkSession, most: int = SAMPLE) -> Model:
    """Learn from at most ``most`` labelled rows that aren't held out, chosen by a hash of doc_id."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(most)
    rows, path = put(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id"), spark, "toxic-sample")  # at most ``most`` ids
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic = 0")
    n_toxic = toxic.count()
    least = max(4, round(COVER * n_toxic))
    top = _counted(toxic, None, "n").where(F.col("n") >= least).toPandas()  # of at most ``most`` rows
    bad = dict(zip(top["feature"], top["n"]))
    good = {r["feature"]: r["n"] for r in _counted(clean, set(bad), "n").collect()} if bad else {}
    pure = {f for f, n in bad.items() if n / (n + good.get(f, 0)) >= PURE}
    single: Counter = Counter()  # of a stem, the most documents that one word has
    for f, n in bad.items():
        for k in STEMS if not f.endswith("*") else ():
            single[f[:k] + "*"] = max(single[f[:k] + "*"], n) if len(f) > k else 0
    pure -= {f for f in pure if f.endswith("*") and single[f] > 0.6 * bad[f]}

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"pure": [sorted(features(t) & pure) for t in batch["text"]]})

    docs_of = defaultdict(set)
    for i, r in enumerate(toxic.select("text").mapInPandas(held, "pure array<string>").collect() if pure else []):  # at most ``most`` rows
        for f in r["pure"]:
            docs_of[f].add(i)
    words, stems, covered = set(), set(), set()
    while docs_of:
        best = max(docs_of, key=lambda f: (len(docs_of[f] - covered), not f.endswith("*"), len(f), f))
        if len(docs_of[best] - covered) < least:
            break
        covered |= docs_of[best]
        (stems if best.endswith("*") else words).add(best.rstrip("*"))
        del docs_of[best]
    # what is as pure, and frequent by itself, insults too
    for f in [f for f, d in docs_of.items() if len(d) >= max(least, 0.04 * n_toxic)]:
        (stems if f.endswith("*") else words).add(f.rstrip("*"))
    model = Model(words, stems)


    @vectorised("array<long>")
    def clauses(text: pd.Series) -> pd.Series:
        return pd.Series([counted(model.read(t)) for t in text], dtype=object)

    seen = rows.select(clauses("text").alias("n"), "toxic").groupBy("n", "toxic").agg(F.count(F.lit(1)).alias("rows")).collect()  # at most ``most``
    seen = sorted(seen, key=lambda r: (list(r["n"]), r["toxic"]))
    model.bias, model.weights = fitted([list(r["n"]) for r in seen], [int(r["toxic"] > 0) for r in seen], [r["rows"] for r in seen])
    drop(spark, path)
    return model


def scorer(spark: SparkSession, model: Model):
    """The scores of a column of texts."""
    sent = spark.sparkContext.broadcast(model)  # as many words and stems as the sample's toxic rows need for a cover

    @vectorised("double")
    def run(text: pd.Series) -> pd.Series:
        model = sent.value
        out = pd.Series([model.score(t) for t in text], dtype=float)
        model.known.clear()
        return out

    return run


def score(docs: DataFrame, spark: SparkSession, model: Model) -> DataFrame:
    """doc_id and score of each row of ``docs``. Null and empty texts score as texts without insults or threats; rows are
    independent, so repeated ones score alike; extra columns go, whatever their names; an empty table gives an empty one."""
    return docs.select("doc_id", scorer(spark, model)(F.col("text").cast("string")).alias("score"))


def without_toxic(docs: DataFrame, spark: SparkSession, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, as they are. Only texts leave the JVM, and no row is moved;
    nulls, repeated rows and empty tables are as in ``score``."""
    return docs.where(scorer(spark, model)(F.col("text").cast("string")) < least)


def op8_weighted_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), spark)
    found = score(docs, spark, model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
