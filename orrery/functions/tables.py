"""The order of a hash table of texts, as DuckDB's ``list_distinct`` gives it.

``list_distinct`` keeps no order of its own: its result is read off a hash table (chained, its number of buckets a
prime). A query whose SQL takes one entry of that result by its place needs the table's order, so it is followed here:
DuckDB's hash of a text, and the order of a libstdc++ ``unordered_map``. Held against DuckDB 2.0.0 on Linux.
"""

from __future__ import annotations

import re
from functools import lru_cache

WORD = re.compile(r"[^\t\n\f\r ]+")  # what RE2's \s leaves
ALL, FACTOR = (1 << 64) - 1, 0xD6E8FEB86659FD93
#: The numbers of buckets that a growing table goes through.
BUCKETS = (13, 29, 59, 127, 257, 541, 1109, 2357, 5087, 10273, 20753, 42043, 85229, 172933, 351061, 712697, 1447153, 2938679, 5967347, 12117689, 24607243)


@lru_cache(maxsize=1 << 16)
def hashed(text: str) -> int:
    """DuckDB's ``hash`` of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    h = 0xE17A1465 ^ (len(raw) * 0xC6A4A7935BD1E995 & ALL)
    for i in range(0, len(raw), 8):
        h = (h ^ int.from_bytes(raw[i : i + 8], "little")) * FACTOR & ALL
    for _ in range(2):
        h = (h ^ h >> 32) * FACTOR & ALL
    return h ^ h >> 32


def dealt(entries: list[str], buckets: int) -> list[str]:
    """``entries``, put into a table one by one, as they are read off it: a bucket stands before those that were taken
    into use earlier, an entry before the others of its bucket."""
    found: dict[int, list[str]] = {}
    for x in entries:
        found.setdefault(hashed(x) % buckets, []).append(x)
    return [x for bucket in reversed(found.values()) for x in reversed(bucket)]


def distinct(entries: list[str]) -> list[str]:
    """The distinct entries in the order of ``list_distinct``. A full table is read off into a larger one."""
    once, out, at = list(dict.fromkeys(entries)), [], 0
    for buckets in BUCKETS:
        out, at = dealt(out + once[at:buckets], buckets), buckets
        if len(once) <= buckets:
            return out
    raise ValueError(f"more than {BUCKETS[-1]} distinct entries")


def first_word(text: str | None) -> str | None:
    """The first of the distinct words of a text in that order; null without words."""
    return next(iter(distinct(WORD.findall(text))), None) if text else None
