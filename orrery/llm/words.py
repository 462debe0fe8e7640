"""Words and their hashes, for the operators on shingles and passages."""

from __future__ import annotations

import numpy as np
import xxhash

BLOCK = 1 << 16  # bytes that are hashed at once
LETTER = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
POWER, INVERSE = (np.full(BLOCK, b, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
POWER[0] = INVERSE[0] = 1
np.multiply.accumulate(POWER, out=POWER)
np.multiply.accumulate(INVERSE, out=INVERSE)


def utf8(text) -> bytes:
    """A text as it comes out of a string or a binary column; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)


def words_of(text) -> list[bytes]:
    """The maximal runs of other characters than blank and U+0009 to U+000D, in UTF-8."""
    return utf8(text).split()  # of bytes: at just these six


def bounds(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a line, words joined by one blank, start and end."""
    if not line:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    return np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(line)]])


def hashes(line: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, from running sums of each block of the line."""
    x, h = np.frombuffer(line, np.uint8), np.empty(len(starts), np.uint64)
    for at in range(0, len(line), BLOCK):
        part = x[at : at + BLOCK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(LETTER[part] * POWER[: len(part)], out=sums[1:])
        i, j = np.searchsorted(starts, (at, at + len(part)))
        if i < j:
            s, e = starts[i:j] - at, np.minimum(ends[i:j] - at, len(part))
            h[i:j] = (sums[e] - sums[s]) * INVERSE[np.minimum(s, BLOCK - 1)]
            if ends[j - 1] > at + len(part):  # the last word goes on in the next block
                word = x[starts[j - 1] : ends[j - 1]]
                h[j - 1] = (LETTER[word] * POWER[: len(word)]).sum() if len(word) <= BLOCK else xxhash.xxh3_64_intdigest(word.tobytes())
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolled(h: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """A hash of each n consecutive elements."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    b, out = np.uint64(base | 1), np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= b
        out += h[k : len(h) - n + 1 + k] ^ np.uint64(k)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def sliding(best, x: np.ndarray, n: int) -> np.ndarray:
    """The best, by ``np.minimum`` or ``np.maximum``, of each n consecutive elements."""
    if len(x) < n:
        return x[:0]
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = best(out[:-step], out[step:])
        have += step
    return out
