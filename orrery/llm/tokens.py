"""BPE encoding by forced boundaries, and decoding.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged across, so a
text may be cut there and its fragments encoded one by one; the concatenation equals the encoding of the whole.
White space is in no token of the vocabulary used here, so every pair with a white-space byte forces a cut as
well. Fragments repeat a lot, which makes a bounded cache of encoded fragments pay.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import CLEAR, table, vectorised
from orrery.llm.words import hashes, utf8

SPACE = re.compile(r"[ \t\n\r]+")
MARKS = "\x1c\x1d\x1e\x1f"  # white space to str.split, not to the tokenizer
#: Stretches of a lower-case text that the tokenizer takes as one, if only these and white space occur: letters that
#: NFC leaves alone, single digits, marks without apostrophes.
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
OTHER = re.compile(r"[^\sa-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~]")
#: A stretch without white space that holds something else.
ODD = re.compile(r"(?<!\S)[a-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~]*+[^\sa-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~]\S*")
CACHED = 50_000  # stretches kept by a worker, and as many of those that were kept before
LONGEST = 48  # characters of a stretch that is kept
#: Classes of the bytes of a text: white space, letter, digit, mark, first and second byte of an accented letter, other.
WHITE, LETTER, DIGIT, MARK, LEAD, TAIL, ODD_BYTE = range(7)
CLASS = np.full(256, ODD_BYTE, np.uint8)
CLASS[list(b" \t\n\x0b\x0c\r")] = WHITE
CLASS[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = LETTER
CLASS[list(range(0x30, 0x3A))] = DIGIT
CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = MARK
CLASS[0xC3], CLASS[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = LEAD, TAIL
SMALL = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
CHUNK = 1 << 19  # bytes of texts that are cut together; each takes about 45 more while they are
SLOTS = 1 << 20  # of the table of known fragments
STORED = 3_000_000  # ids that the table holds, at most


class Kept(dict):
    """A bounded cache of two generations: when the young one is full, the old one goes."""

    def __init__(self, make, size: int = CACHED):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes as the tokenizer in ``path`` does without special tokens added, truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        self.last = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.strings = [""] * (max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in chain(model["vocab"].items(), ((t["content"], t["id"]) for t in spec["added_tokens"])):
            self.strings[i] = token
        #: Pairs that occur inside a token: all others force a cut.
        self.joined = {(a, b) for t in model["vocab"] for bare in [t.removesuffix(self.suffix) if self.suffix else t] for a, b in zip(bare, bare[1:])}
        self.letters = {ord(c): "".join(self.letter(b) for b in c.encode()) for c in map(chr, range(256)) if c.isalpha()}
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.strings))]
        self.safe = re.compile(f"[{re.escape(self._safe())}]+")
        self.pieces, self.chunks = Kept(self.piece), Kept(self.chunk)
        letters = [self.letter(b) for b in range(256)]
        self.pairs = np.array([[(a, b) in self.joined for b in letters] for a in letters])
        self.bytes = {b: letters[b] for b in range(256) if b != 0x20}
        self.final = np.array([bool(self.suffix) and t.endswith(self.suffix) for t in self.strings])
        #: The same models behind a splitter at blanks, for many fragments at once.
        self.inside, self.at_end = Tokenizer(self.inner), Tokenizer(self.last)
        self.inside.pre_tokenizer = self.at_end.pre_tokenizer = WhitespaceSplit()
        self.forget()

    @staticmethod
    def letter(byte: int) -> str:
        """The letter that byte-level vocabularies write for a byte: itself if it prints, else one from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        return chr(byte) if byte in shown else chr(0x100 + byte - sum(b < byte for b in shown))

    def _safe(self) -> str:
        """Letters of which any two may stand together inside a token: words of these have no forced cut."""
        letters = {c for pair in self.joined for c in pair}
        apart = {c: {d for d in letters if (c, d) not in self.joined or (d, c) not in self.joined} for c in letters}
        while letters and (worst := max(sorted(letters), key=lambda c: len(apart[c] & letters))) and apart[worst] & letters:
            letters.discard(worst)
        return "".join(sorted(letters))

    def word(self, word: str) -> bytes:
        """Ids of a word of byte letters: the fragments between forced cuts, encoded one by one."""
        joined, packed, at, out = self.joined, self.packed, 0, []
        if not self.safe.fullmatch(word):
            for i in range(1, len(word)):
                if (word[i - 1], word[i]) not in joined:
                    out += [packed[t.id] for t in self.inner.tokenize(word[at:i])]
                    at = i
        out += [packed[t.id] for t in self.last.tokenize(word[at:])]
        return b"".join(out)

    def piece(self, piece: str) -> bytes:
        """Ids of a stretch that ``PIECE`` matches."""
        return self.word(piece if piece.isascii() else piece.translate(self.letters))

    def chunk(self, chunk: str) -> bytes:
        """Ids of any stretch without spaces, tabs or line ends."""
        if any(s in chunk for s in self.special):
            return b"".join([self.packed[i] for i in self.whole.encode(chunk, add_special_tokens=False).ids])
        clean = self.whole.normalizer.normalize_str(chunk) if self.whole.normalizer else chunk
        return b"".join([self.word(w) for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(clean)])

    def raw(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if any(c in text for c in MARKS) or any(s in text for s in self.special):
            return b"".join(map(self.chunks.__getitem__, [c for c in SPACE.split(text) if c]))
        small, pieces = text.lower(), self.pieces.__getitem__
        if not OTHER.search(small):
            return b"".join(map(pieces, PIECE.findall(small)))
        out, at = [], 0
        if len(small) != len(text) or "\u03a3" in text:  # letters whose lower case depends on what is around, or is longer
            return b"".join(map(self.chunks.__getitem__, text.split()))
        for m in ODD.finditer(small):
            out += map(pieces, PIECE.findall(small, at, m.start()))
            out.append(self.chunks[text[m.start() : m.end()]])
            at = m.end()
        return b"".join([*out, *map(pieces, PIECE.findall(small, at))])

    def encode(self, text: str | None) -> list[int]:
        return self.many([text])[0].tolist()

    def many(self, texts: list) -> list[np.ndarray]:
        """Ids of each text, given as string or in UTF-8; null counts as empty."""
        texts, out, at, size = [utf8(t) for t in texts], [], 0, 0
        for i, t in enumerate(texts):
            size += len(t) + 1
            if size >= CHUNK or i == len(texts) - 1:
                out += self.together(texts[at : i + 1])
                at, size = i + 1, 0
        return out

    def together(self, texts: list[bytes]) -> list[np.ndarray]:
        """As ``many``: all forced cuts of the texts are found at once, and each fragment is looked up by its hash."""
        line = b"\n".join(texts)
        if not line:
            return [np.empty(0, np.uint32) for _ in texts]
        edge = np.cumsum([0, *[len(t) + 1 for t in texts]])
        x = SMALL[np.frombuffer(line, np.uint8)]
        kind = CLASS[x]
        lead, tail = kind == LEAD, kind == TAIL
        after = np.concatenate([[False], lead[:-1]])
        odd = np.flatnonzero((kind == ODD_BYTE) | (tail != after) | (lead & np.concatenate([~tail[1:], [True]])))
        apart = set((np.searchsorted(edge, odd, "right") - 1).tolist())
        if b"<|" in line:
            apart |= {i for i, t in enumerate(texts) if any(s.encode() in t for s in self.special)}
        for i in apart:
            kind[edge[i] : edge[i + 1]] = WHITE
        x[after & (x >= 0x80) & (x <= 0x9E)] += np.uint8(0x20)  # accented capitals
        kind[lead | tail] = np.minimum(kind[lead | tail], LETTER)
        # Cuts between classes, around digits, and where two bytes stand together in no token.
        turns = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT), [True]])
        cuts = turns.copy()
        cuts[1:-1] |= ~self.pairs[x[:-1], x[1:]]
        starts = np.flatnonzero(cuts[:-1] & (kind != WHITE))
        every = np.flatnonzero(cuts)
        ends = every[np.searchsorted(every, starts, "right")]
        flat, size = self.known(x.tobytes(), starts, ends, turns[ends])
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, edge)]
        out = [flat[i:j] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist())]
        for i in apart:  # texts with other characters are read by themselves
            out[i] = np.frombuffer(self.raw(texts[i].decode("utf-8", "surrogatepass")), "<u4")
        return out

    def known(self, line: bytes, starts: np.ndarray, ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the fragments of a line, of which ``last`` end a word, and how many each has.

        They are looked up by hash and length in a table, where new ones take the place of others."""
        if self.filled > STORED:
            self.forget()
        h, length = hashes(line, starts, ends), ends - starts
        h[last] ^= np.uint64(0xA0761D6478BD642F)
        slot = (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        new = np.flatnonzero((self.hash[slot] != h) | (self.length[slot] != length))
        if len(new):
            _, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            some = new[first]
            ids, n = np.empty(0, np.uint32), np.zeros(len(some), np.int64)
            order = np.argsort(~last[some], kind="stable")  # those that end a word come first
            ending = int(last[some].sum())
            for model, part in ((self.at_end, order[:ending]), (self.inside, order[ending:])):
                if len(part):
                    words = [line[s:e] for s, e in zip(starts[some[part]].tolist(), ends[some[part]].tolist())]
                    together = b" ".join(words).decode("latin-1").translate(self.bytes)
                    if self.suffix and model is self.at_end:  # its last token tells where a word ends
                        mine = np.array(model.encode_batch_fast([together], add_special_tokens=False)[0].ids, np.uint32)
                        n[part] = np.diff(np.concatenate([[-1], np.flatnonzero(self.final[mine])]))
                    else:
                        found = model.encode(together, add_special_tokens=False)
                        mine = np.array(found.ids, np.uint32)
                        n[part] = np.bincount(np.array(found.word_ids, np.int64), minlength=len(part))
                    ids = np.concatenate([ids, mine])
            begin = np.empty(len(some), np.int64)
            begin[order] = self.filled + np.concatenate([[0], np.cumsum(n[order])[:-1]])
            while self.filled + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            self.ids[self.filled : self.filled + len(ids)] = ids
            self.filled += len(ids)
            at[new], size[new] = begin[inverse], n[inverse]
            self.hash[slot[some]], self.length[slot[some]], self.at[slot[some]], self.size[slot[some]] = h[some], length[some], begin, n
        shift = at - np.concatenate([[0], np.cumsum(size)[:-1]])
        return self.ids[np.repeat(shift, size) + np.arange(size.sum())], size

    def forget(self) -> None:
        """Empty the table of known fragments."""
        self.hash, self.length = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.at, self.size = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.ids, self.filled = np.empty(1 << 18, np.uint32), 0

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by spaces: the file names no decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    return Encoder(path)


CLEAR.append(encoder.cache_clear)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of each text. Null and empty texts have no ids; ties and repeated rows are rows like any other;
    extra columns go, whatever their names; an empty table gives an empty one."""

    @vectorised("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        e = encoder(path or vocabulary())
        return pd.Series([x.astype(np.int32) for x in e.many(text)], dtype=object)

    return docs.select("doc_id", ids(F.col("text").cast("string").cast("binary")).alias("ids"))


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each list of ids; null: null. Repeated rows, extra columns and empty tables are as in ``encode``."""

    @vectorised("string")
    def text(column: pd.Series) -> pd.Series:
        e = encoder(path or vocabulary())
        return pd.Series([None if i is None else e.decode(i) for i in column], dtype=object)

    return ids.select("doc_id", text("ids").alias("text"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, without moving either out of the worker.

    Null and empty texts have no tokens; repeated rows give repeated rows; extra columns are dropped.
    """

    @vectorised("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(text: pd.Series) -> pd.DataFrame:
        e = encoder(path or vocabulary())
        decimal = [str(i) for i in range(len(e.strings))]
        rows = []
        for ids in map(np.ndarray.tolist, e.many(text)):
            digest = hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest()
            rows.append((len(ids), digest, hashlib.sha256(e.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(F.col("text").cast("string").cast("binary")).alias("x")).select("doc_id", "x.*")


def op7_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
