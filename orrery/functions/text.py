"""Text normalisation, estimates and similarities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is written and computed once, however often ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def collapse_whitespace(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def strip_comments(c: Column | str) -> Column:
    """Without line comments, then without block comments: ``/* // */`` keeps its unclosed start."""
    return F.regexp_replace(F.regexp_replace(text(c), r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")


def normalize_body(c: Column | str) -> Column:
    return F.lower(collapse_whitespace(strip_comments(c)))


def normalize_tac(c: Column | str) -> Column:
    return F.lower(collapse_whitespace(F.regexp_replace(text(c), r"//[^\n]*", "")))


def words(c: Column | str) -> Column:
    """The runs of other characters than white space."""
    return F.filter(F.split(text(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c)).cast("long")


def token_estimate(c: Column | str) -> Column:
    """The larger of the number of words and a quarter of the characters, rounded up."""
    return F.greatest(word_count(c), F.ceil(F.length(text(c)) / 4).cast("long"))


def lines(c: Column | str) -> Column:
    """As ``str.splitlines``: a line end at the very end starts no further line."""
    t = text(c)
    parts = F.split(t, "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]", -1)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def line_count(c: Column | str) -> Column:
    return F.size(lines(c)).cast("long")


#: Fixed value: lines of three-address code that name a block.
BLOCK_LABEL = r"(?i)^\s*(?:block|bb|label)[A-Za-z0-9_]*:\s*$"


def instruction_lines(c: Column | str) -> Column:
    """Lines that are neither blank, comment, function header nor block label."""
    ops = F.filter(
        F.transform(lines(c), lambda x: F.trim(x)),
        lambda s: (s != "") & ~s.startswith("//") & ~(F.lower(s).startswith("function ") & s.endswith(":")) & ~s.rlike(BLOCK_LABEL),
    )
    return F.size(ops).cast("long")


def occurrences(c: Column | str, part: str) -> Column:
    """How often ``part`` occurs, without overlaps."""
    t = text(c)
    return ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("long")


def length_bucket(n: Column | str, bounds: tuple[int, ...] = (256, 512, 1024, 2048, 4096)) -> Column:
    out, low = F.lit(f">{bounds[-1]}"), None
    for i in range(len(bounds) - 1, -1, -1):
        low = bounds[i - 1] + 1 if i else None
        out = F.when(col(n) <= bounds[i], f"{low}-{bounds[i]}" if low else f"<={bounds[i]}").otherwise(out)
    return out


#: Families by key words, in order of precedence; words with ^ must start the name.
FAMILIES = (
    ("fallback_receive", ("fallback", "receive")),
    ("constructor", ("constructor",)),
    ("transfer", ("transfer", "send")),
    ("approval", ("approve", "allowance", "permit")),
    ("read_getter", ("balance", "^get", "view")),
    ("write_setter", ("^set", "update")),
    ("access_control", ("owner", "admin", "role")),
    ("mint", ("mint",)),
    ("burn", ("burn",)),
    ("pause", ("pause",)),
)


def function_family(name: Column | str) -> Column:
    t, out = F.lower(text(name)), F.lit("other")
    for family, keys in reversed(FAMILIES):
        hit = F.lit(False)
        for k in keys:
            hit = hit | (t.startswith(k[1:]) if k[0] == "^" else t.rlike(r"\bview\b") if k == "view" else t.contains(k))
        out = F.when(hit, family).otherwise(out)
    return F.when(t == "", "unknown").otherwise(out)


def bool_label(c: Column | str) -> Column:
    t = F.lower(F.trim(text(c)))
    return (
        F.when(text(c) == "", "unknown")
        .when(t.isin("true", "1", "yes", "y", "enabled", "on"), "enabled")
        .when(t.isin("false", "0", "no", "n", "disabled", "off"), "disabled")
        .when(t == "", "unknown")
        .otherwise(t)
    )


def missing(c: Column | str) -> Column:
    """The value without blanks around, null if nothing is left."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def int_or(c: Column | str, default: int) -> Column:
    return F.coalesce(col(c).try_cast("int"), F.lit(default))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; an empty reference ``a`` gives 1 if ``b`` is empty as well, else 0."""
    union = F.size(F.array_union(a, b))
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def normalized_edit_distance(a: Column | str, b: Column | str) -> Column:
    a, b = collapse_whitespace(a), collapse_whitespace(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


#: What structural preservation counts.
STRUCTURE = ("if", "else", "for", "while", "require", "assert", "revert", "return", "emit", "mapping", "struct", "event", "modifier")


def structural_preservation(a: Column | str, b: Column | str, parts: tuple[str, ...] = STRUCTURE) -> Column:
    """1 less the mean of |m - n| / (m + n) over the parts that occur in either text; 1 if none does."""
    counts = F.array(*[F.struct(occurrences(a, p).alias("m"), occurrences(b, p).alias("n")) for p in parts])
    some = F.filter(counts, lambda x: x["m"] + x["n"] > 0)
    lost = F.aggregate(some, F.lit(0.0), lambda s, x: s + F.abs(x["m"] - x["n"]) / (x["m"] + x["n"]))
    return F.when(F.size(some) == 0, F.lit(1.0)).otherwise(1 - lost / F.greatest(F.size(some), F.lit(1)))


def nesting_depth(c: Column | str, opening: str = "{", closing: str = "}") -> Column:
    """The deepest nesting; what closes without an opening doesn't count below 0."""
    marks = F.regexp_extract_all(text(c), F.lit(f"[\\{opening}\\{closing}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s, m):
        now = F.when(m == opening, s["now"] + 1).otherwise(F.greatest(s["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(marks, zero, step, lambda s: s["most"])


def cosine(a: Column | str, b: Column | str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = col(a), col(b)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def confidence(occurrences_: Column | str) -> Column:
    """Trust in a signature by how often it was seen."""
    n = col(occurrences_)
    return F.when(n >= 10, 0.95).when(n >= 5, 0.90).when(n >= 2, 0.85).otherwise(0.80)
