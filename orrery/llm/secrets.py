"""Secret scan: pattern matches plus a battery of randomness tests with false-discovery control.

Every maximal run of SHORTEST or more encoding characters is a candidate. Its encoding is inferred from the characters
it uses, and three tests are made of its codes: chi-squared uniformity over the alphabet, runs, and lag-one serial
correlation. Each test has two sides. Held against *uniformly random in that encoding*, a candidate must not be
rejected. Held against *written text or an identifier*, where few letters are frequent, classes of characters seldom
change, vowels alternate with consonants and neighbours are alike, each test gives a p-value; the three are joined by
Fisher's method, and a Benjamini-Hochberg threshold on the joint p-value is set for each class of lengths over all
documents. So the level holds among candidates of like lengths: short ones, of which texts hold many, need more.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import CLEAR, cut, vectorised

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
SHORTEST = 12  # characters of a candidate
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}(?![A-Za-z0-9+/_-])" % SHORTEST)
LOWER, UPPER, TEN = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets, the first that holds all characters of a candidate is its encoding.
ALPHABETS = (
    ("hex", TEN + "abcdef"), ("HEX", TEN + "ABCDEF"), ("lower", LOWER), ("upper", UPPER), ("base32", UPPER + "234567"), ("base36", TEN + LOWER),
    ("BASE36", TEN + UPPER), ("letters", UPPER + LOWER), ("base62", TEN + UPPER + LOWER), ("base64", UPPER + LOWER + TEN + "+/"), ("base64url", UPPER + LOWER + TEN + "_-"),
)
CODES = [(name, {c: i for i, c in enumerate(letters)}) for name, letters in ALPHABETS]
# Written text, on the careful side: the chance that two characters agree, that neighbours are of other classes (digit,
# upper, lower, mark), that of two neighbouring letters one is a vowel, and the correlation of neighbours in mixed classes.
AGREE, CHANGE, ALTERNATE, ALIKE = 0.055, 0.12, 0.5, 0.15
VOWELS = frozenset("aeiouyAEIOUY")
UNLIKE = 10.0  # bits of evidence against a random string that end its candidacy
BINS = 256  # of -log2 p


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the pattern matches, in order."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _lower_tail(z: float) -> float:
    return _upper_tail(-z)


def _cube(x: float, free: float, away: float = 0.0) -> float:
    """About how many deviations ``x`` is above its mean, if chi-squared with ``free`` degrees and ``away`` off centre."""
    mean, spread = free + away, 2 * (free + 2 * away) / (9 * (free + away) ** 2)
    return ((x / mean) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)


@lru_cache(maxsize=1 << 14)
def _binomial(n: int, k: int, p: float, least: bool) -> float:
    """The chance of ``k`` or more (or else of ``k`` or fewer) of ``n``."""
    some = range(k, n + 1) if least else range(k + 1)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in some]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def joint(p: list[float]) -> float:
    """-log2 of the p-value that Fisher's method makes of independent ones."""
    half = -sum(math.log(min(max(x, 1e-60), 1.0)) for x in p)
    return max(0.0, (half - math.log(sum(half**j / math.factorial(j) for j in range(len(p))))) / math.log(2))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def battery(body: str, codes: list[int], letters: int) -> tuple[list[float], list[float]]:
    """p-values of uniformity, runs and serial correlation of a string: were it random over so many letters, and were it written."""
    n, free = len(codes), letters - 1
    chi = sum(k * k for k in Counter(codes).values()) * letters / n - n
    uniform = _upper_tail(_cube(chi, free))
    uneven = _lower_tail(_cube(chi, free, n * max(0.0, letters * AGREE - 1)))
    high = [2 * c >= letters for c in codes]
    a = sum(high)
    b = n - a
    runs = 0.0
    if a and b:
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max(2 * a * b * (2 * a * b - n) / (n * n * (n - 1)), 1e-9))
        runs = 2 * _upper_tail(abs(1 + sum(x != y for x, y in zip(high, high[1:])) - mean) / spread)
    kinds = [_kind(c) for c in body]
    changes = _binomial(n - 1, sum(x != y for x, y in zip(kinds, kinds[1:])), CHANGE, least=True)
    pairs = [(x in VOWELS) != (y in VOWELS) for x, y in zip(body, body[1:]) if x.isalpha() and y.isalpha()]
    turns = _binomial(len(pairs), sum(pairs), ALTERNATE, least=False) if pairs else 1.0
    middle = sum(codes) / n
    x = [c - middle for c in codes]
    power = sum(c * c for c in x)
    r = sum(a * b for a, b in zip(x, x[1:])) / power if power else 1.0
    serial = 2 * _upper_tail(abs(r * math.sqrt(n) + 1 / math.sqrt(n)))
    # Marks between words push neighbours apart as well, so this test never tells more than one in twenty.
    apart = max(0.05, _lower_tail((r - ALIKE) * math.sqrt(n))) if len(set(kinds)) > 1 else 1.0
    return [uniform, runs, serial], [uneven, 2 ** -joint([changes, turns]), apart]


@lru_cache(maxsize=1 << 14)
def evidence(token: str) -> tuple[str, float] | None:
    """The inferred encoding and -log2 of the joint p-value under written text; None if the string isn't random."""
    body = token.rstrip("=")
    used = set(body)
    if len(used) < 2 or body.isdigit():
        return None
    name, codes = next(((name, codes) for name, codes in CODES if used <= codes.keys()), (None, None))
    if name is None:
        return None
    random, written = battery(body, [codes[c] for c in body], len(codes))
    return (name, joint(written)) if joint(random) < UNLIKE else None


CLEAR += [evidence.cache_clear, _binomial.cache_clear]


def length_class(n: int) -> int:
    """Classes of lengths, four to each doubling."""
    return int(4 * math.log2(n))


SCANNED = "base array<struct<s:int,e:int,k:int>>, tests array<struct<s:int,e:int,encoding:string,bin:int,klass:int>>"


@vectorised(SCANNED)
def _scan(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        t = t if isinstance(t, str) else ""
        more = []
        for m in CANDIDATE.finditer(t):
            if e := evidence(m[0]):
                more.append({"s": m.start(), "e": m.end(), "encoding": e[0], "bin": int(min(e[1], BINS)), "klass": length_class(m.end() - m.start())})
        rows.append(([{"s": s, "e": e, "k": k} for s, e, k in base_spans(t)], more))
    return pd.DataFrame(rows, columns=["base", "tests"])


def scan(docs: DataFrame) -> DataFrame:
    """The base spans of each text and the joint evidence of each of its candidates."""
    return docs.select("doc_id", _scan(F.col("text").cast("string")).alias("x")).select("doc_id", "x.base", "x.tests")


def thresholds(scanned: DataFrame, q: float) -> DataFrame:
    """For each class of lengths the least bin at which Benjamini-Hochberg rejects written text at level ``q``.

    At most BINS + 1 bins for each class of lengths reach the window, whatever the number of documents.
    """
    bins = scanned.select(F.explode("tests").alias("t")).groupBy("t.klass", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumnRenamed("t.klass", "klass").withColumnRenamed("t.bin", "bin")
    down = Window.partitionBy("klass").orderBy(F.desc("bin"))
    ranked = bins.select("klass", "bin", F.sum("n").over(down).alias("above"), F.sum("n").over(Window.partitionBy("klass")).alias("all"))
    return ranked.where(F.pow(F.lit(2.0), -F.col("bin")) <= F.lit(q) * F.col("above") / F.col("all")).groupBy("klass").agg(F.min("bin").alias("least"))


def find_secrets(docs: DataFrame, spark: SparkSession, q: float = 1e-3) -> DataFrame:
    """doc_id, base spans and all spans of each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text counts as empty. Rows are independent but for the thresholds, so ties and repeated rows need no
    rule; an empty table gives an empty one.
    """
    scanned = cut(scan(docs), spark, "secrets")
    least = {r["klass"]: r["least"] for r in thresholds(scanned, q).collect()}  # a row for each class of lengths
    limit = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else F.lit(None).cast("map<int,int>")
    sure = F.filter("tests", lambda t: t["bin"] >= F.coalesce(limit[t["klass"]], F.lit(BINS + 1)))
    more = F.filter(
        F.transform(sure, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), F.lit(3).alias("k"))),
        lambda t: ~F.exists("base", lambda b: (b["s"] <= t["s"]) & (t["e"] <= b["e"])),
    )
    key = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    return scanned.select("doc_id", "base", F.array_sort(F.transform(F.concat("base", more), key)).alias("spans"))


def written(spans):
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name[x["k"]], x["s"], x["e"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, spark: SparkSession, q: float = 1e-3) -> DataFrame:
    """``docs`` with each secret of a text replaced by its kind in brackets; a column ``n_chars``, if there is one, follows.

    Null texts stay null, repeated rows are rows like any other, an empty table gives an empty one. The texts are
    scanned twice, once for the thresholds and once to replace, and never shuffled; no other column leaves the JVM.
    """
    least = {r["klass"]: r["least"] for r in thresholds(scan(docs), q).collect()}  # a row for each class of lengths

    @vectorised("string")
    def cover(text: pd.Series) -> pd.Series:
        return pd.Series([None if not isinstance(t, str) else replaced(t, least) for t in text], dtype=object)

    rows = docs.withColumn("text", cover(F.col("text").cast("string")))
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def replaced(text: str, least: dict[int, int]) -> str:
    spans = base_spans(text)
    for m in CANDIDATE.finditer(text):
        if (e := evidence(m[0])) and min(e[1], BINS) >= least.get(length_class(m.end() - m.start()), BINS + 1):
            spans.append((m.start(), m.end(), 3))
    out, at = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])):
        if e > at:
            out += [text[at : max(at, s)], f"[{KINDS[k]}]"]
            at = e
    return "".join([*out, text[at:]])
