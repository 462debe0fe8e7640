"""Operators, queries and pipeline stages against plain versions of what they compute."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from orrery.llm import fingerprints, langid, neardup, packing, secrets, sharding, substrings, tokens, topk, toxicity

D = "/root/testdata/sf0.001"
BIG = (1 << 60) + 1


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


# Secrets


def plain_base(text):
    """Base spans, found by walking over the characters."""
    out, low = [], "abcdefghijklmnopqrstuvwxyz"
    value = set(string.ascii_letters + string.digits + "+/_.=-")
    small = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    at = 0
    while at < len(text):
        hit = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if small.startswith(word, at):
                p = at + len(word)
                for skip in ([1, 0] if text[p : p + 1] in ('"', "'") and p < len(text) else [0]):
                    q = p + skip
                    while text[q : q + 1] == " ":
                        q += 1
                    if text[q : q + 1] in (":", "=") and q < len(text):
                        q += 1
                        while text[q : q + 1] == " ":
                            q += 1
                        if text[q : q + 1] in ('"', "'") and q < len(text):
                            q += 1
                        e = q
                        while e < len(text) and text[e] in value:
                            e += 1
                        if e > q:
                            hit = (at, e, e - q)
                            break
                break
        if hit:
            if hit[2] >= 12:
                out.append((hit[0], hit[1], 0))
            at = hit[1]
        else:
            at += 1
    for kind, first, chars, least in ((1, "AKIA", string.ascii_uppercase + string.digits, 18), (2, "", string.digits + low[:6], 16)):
        at = 0
        while at < len(text):
            e = at + len(first)
            if text.startswith(first, at) and (e < len(text) and text[e] in chars):
                while e < len(text) and text[e] in chars:
                    e += 1
                if e - at >= least:
                    out.append((at, e, kind))
                at = e
            else:
                at += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans(texts):
    pick = random.Random(1)
    parts = ["password", "PASSWD", "secret", "token", "api_key", "apikey", "AKIA", "=", ":", '"', "'", " ", "abc123", "deadbeef", "A1B2", "é", "\n", "x" * 9, "0f" * 6]
    for t in [*filter(None, texts.values()), *["".join(pick.choice(parts) for _ in range(30)) for _ in range(400)]]:
        assert secrets.base_spans(t) == plain_base(t)


def test_false_discovery_thresholds(spark):
    pick = random.Random(2)
    tests = [(pick.choice([14, 16]), pick.choice([0, 1, 2, 3, 30, 40])) for _ in range(400)]
    scanned = spark.createDataFrame([([{"klass": k, "bin": b} for k, b in tests],)], "tests array<struct<klass:int,bin:int>>")
    got = {r["klass"]: r["least"] for r in secrets.thresholds(scanned, 0.01).collect()}
    for klass in (14, 16):
        p = sorted(2.0**-b for k, b in tests if k == klass)
        level = max((x for i, x in enumerate(p, 1) if x <= 0.01 * i / len(p)), default=None)
        assert got[klass] == round(-math.log2(level))


def test_battery_finds_random_strings_of_any_alphabet(spark):
    pick = random.Random(3)
    prose = "internationalisation characteristically some-ordinary-written-words thequickbrownfoxjumpsoverthelazydogs"
    planted = {}
    for n, letters in ((40, string.ascii_letters), (32, string.ascii_letters + string.digits), (24, string.ascii_letters + string.digits + "+/"), (20, string.ascii_letters + string.digits)):
        for _ in range(12):
            planted[len(planted)] = "".join(pick.choice(letters) for _ in range(n))
    rows = [(i, f"{prose} {k} end") for i, k in planted.items()] + [(1000 + i, f"{prose} nothing {i}") for i in range(50)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(table(spark, rows), spark).collect()}
    where = {i: (len(prose) + 1, len(prose) + 1 + len(k)) for i, k in planted.items()}
    assert sum(any(x["k"] == 3 and x["s"] == where[i][0] for x in got[i]) for i in planted) >= 0.9 * len(planted)
    assert not any(got[i] for i in range(1000, 1050))


def test_battery_p_values_are_uniform_for_random_strings():
    pick = random.Random(4)
    names = {c: i for i, c in enumerate(string.ascii_letters)}
    p = []
    for _ in range(600):
        body = "".join(pick.choice(string.ascii_letters) for _ in range(60))
        p.append(secrets.battery(body, [names[c] for c in body], 52)[0])
    for one in zip(*p):
        assert 0.02 < sum(x < 0.05 for x in one) / len(one) < 0.1 and 0.35 < sum(x < 0.5 for x in one) / len(one) < 0.65


# Sharding, top k, languages


def test_shards_of_the_whole_table(spark, texts):
    got = sharding.op2_balanced_label_propagation(spark, D).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(list(texts))
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    n = Counter(r["shard"] for r in got)
    assert set(n) <= set(range(16)) and max(n.values()) - min(n.get(s, 0) for s in range(16)) <= 1
    for s in n:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n[s]))


def test_aggregation_equals_products_and_closes_early_where_bounds_allow():
    rng = np.random.default_rng(0)
    near = np.repeat(rng.normal(0, 1, (40, 16)), 100, 0) + rng.normal(0, 0.02, (4000, 16))
    heavy = np.minimum(np.abs(rng.standard_cauchy((4000, 8))), 50)
    few = rng.integers(-2, 3, (300, 5)) * 1e-3
    for vectors, early in ((near, 5), (heavy, 10), (few, 0), (heavy * 1e9, 5)):
        x, ids = np.floor(vectors * 1024).astype(np.int64), rng.permutation(len(vectors))
        shares = []
        for query, found, scores, share in topk.Lists(ids, x).search(ids[::100], x[::100], 10):
            own = x[np.flatnonzero(ids == query)[0]]
            want = sorted(((-sum(int(a) * int(b) for a, b in zip(v, own)), int(i)) for v, i in zip(x, ids) if i != query))[:10]
            if max(-s for s, _ in want) < 2**63:
                assert list(zip((-scores).tolist(), found.tolist())) == want
            shares.append(share)
        assert sum(s < 1 for s in shares) >= early


def test_corrected_counts_of_a_filter():
    pick = random.Random(5)
    words = lambda some: " ".join("".join(pick.choice(some) for _ in range(5)) for _ in range(300))
    texts = [words("abcdefghijkl"), words("ghijklmnopqr"), words("stuvwxyzäöü")]
    members = [np.unique(np.concatenate(list(langid.grams(t)))) for t in texts]
    model = langid.Filter(["a", "b", "c"], members, slots=1 << 14)
    for t in (*texts, "abc xyz cde"):
        h = np.concatenate(list(langid.grams(t)))
        n, found = model.counts(t)
        true = [int(np.isin(h, m).sum()) for m in members]
        assert n == len(h)
        often = (np.unique(h, return_counts=True)[1] ** 2).sum()
        for got, want, false in zip(found, true, model.false):
            assert abs(got - want) <= 5 * math.sqrt(often * false) + 1e-6  # what false positives add is taken off again
    assert [model.predict(t)[0] for t in texts] == ["a", "b", "c"] and model.predict("12 ,")[0] == "und"


# Near copies, repeated passages


def test_rows_of_one_doc_id_keep_their_texts(spark):
    word = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(5, word("a", 40)), (6, word("a", 40)), (6, word("b", 40)), (7, word("b", 40) + " more"), (BIG, word("c", 40)), (None, word("c", 40)), (9, word("d", 40))]
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.dedup(table(spark, rows), spark).collect()))
    assert got == [(0, 40, 0), (5, 40, 0), (6, 40, 0), (6, 40, 40), (7, 41, 40), (9, 40, 0), (BIG, 40, 0)]
    linked = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in neardup.link(table(spark, rows), spark).collect())
    assert linked == [(0, 0), (5, 5), (6, 5), (6, 5), (7, 5), (9, 9), (BIG, BIG)]


def test_the_automaton_decides(spark, monkeypatch):
    line = [b" ".join(b"%s%d" % (a, i) for i in range(30)) for a in (b"x", b"y")]
    assert not len(substrings.windows_of(line[1], substrings.automaton_of([b"x3 x4 x5 x6"]))[0])
    values, several, phrases = substrings.anchors_of([line[0], line[1], line[0] + b" z"])
    own = substrings.anchors_of([line[0]])
    assert set(own[2]) <= {p for p, s in zip(phrases, several) if s} and not any(p.startswith(b"y") for p, s in zip(phrases, several) if s)
    assert len(substrings.windows_of(line[0], substrings.automaton_of(own[2]))[0]) == 18  # all windows have their anchor among them


def removed(rows):
    first, out, words = {}, {}, {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out[i] = [x for j, x in enumerate(w) if j not in gone]
    return words, out


def test_repeats_of_the_whole_table(spark, texts):
    words, kept = removed(texts.items())
    for r in substrings.op6_repeated_phrase_automata(spark, D).collect():
        i = r["doc_id"]
        assert (r["n_words"], r["n_removed"]) == (len(words[i]), len(words[i]) - len(kept[i]))
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept[i]).encode()).hexdigest()


# Tokens and packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary())


def test_many_texts_at_once(texts, library):
    pick = random.Random(6)
    letters = "abcdefgXYZéÉßñÀ×÷ÿþ'!?.<|>0123456789 \t\n\r漢ΣéİĿ"
    some = [t or "" for t in texts.values()] + ["".join(pick.choice(letters) for _ in range(pick.randrange(60))) for _ in range(1500)] + ["Ça va ÉTÉ ÖL", "<|endoftext|>x", "\x7f\x00", ""]
    own = tokens.Encoder(tokens.vocabulary())
    for _ in range(2):  # the second time fragments are known
        for t, ids in zip(some, own.many(some)):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_packed_pieces(spark, texts, library):
    got = packing.op9_grouping_genetic_packing(spark, D).collect()
    want = {}
    for i, t in texts.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[i, k] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    rows = defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in rows.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(rows) <= math.ceil(sum(x[1] for x in want.values()) / 2048) + 1


def triplets(n, seed):
    pick, out = random.Random(seed), []
    for _ in range(n):
        a = pick.randrange(780, 1000)
        b = pick.randrange(512, 2048 - a - 511)
        out += [a, b, 2048 - a - b]
    pick.shuffle(out)
    return out


def test_islands_beat_best_fit_where_it_fails():
    for seed in (1, 2):
        length = triplets(100, seed)
        alone = packing.fresh(length, 2048, random.Random(0), 0.0)
        islands = [[packing.fresh(length, 2048, random.Random(i), 0.02 * (1 + i) * k) for k in range(packing.POPULATION)] for i in range(packing.ISLANDS)]
        for epoch in range(packing.EPOCHS):
            islands = [packing.evolve(p, length, 2048, random.Random(f"{i}:{epoch}"), packing.GENERATIONS) for i, p in enumerate(islands)]
            elite = [p[0] for p in islands]
            islands = [[*p, elite[i - 1]] for i, p in enumerate(islands)]
        best = min(elite, key=lambda x: len(x[0]))
        assert sorted(i for items in best[0].values() for i in items) == list(range(len(length)))
        assert all(sum(length[i] for i in items) + best[1][k] == 2048 and best[1][k] >= 0 for k, items in best[0].items())
        assert len(alone[0]) >= 115 and len(best[0]) <= 103


def test_islands_of_a_table(spark):
    length = triplets(60, 5)
    rows = [(i, 0, 0, n, n) for i, n in enumerate(length)]
    items = spark.createDataFrame(rows, "doc_id string, piece int, start long, ids_crc32 long, length long").withColumn("block", F.lit(0).cast("long"))
    placed = packing._blocks(items, spark, 2048, 0, "test").collect()
    assert len(placed) == 180 and len({r["bin"] for r in placed}) <= 62 < len(packing.fresh(length, 2048, random.Random(0), 0.0)[0])


# Toxicity


def plain_settings(classes):
    out = []
    for clause in classes.split("."):
        hits = []
        for i, c in enumerate(clause):
            if c in "it":
                negated = any(clause[j] == "n" for j in range(max(0, i - 3), i))
                aimed = any(clause[j] == "y" for j in range(max(0, i - 4), i))
                hits.append((c, negated, "r" in clause[:i], aimed))
        if hits:
            out.append(hits)
    return out


def test_grammar_against_a_plain_reading():
    pick = random.Random(8)
    for _ in range(2000):
        classes = "".join(pick.choice("itynro.oo") for _ in range(pick.randrange(30)))
        assert toxicity.settings(classes) == plain_settings(classes)


def test_settings_weigh_by_label():
    """Aimed insults are toxic, reported ones aren't: the weights follow, and more clauses count for more."""
    at = {x: i for i, x in enumerate(toxicity.SETTINGS)}
    one = lambda x, k=1: [k if i == at[x] else 0 for i in range(len(at))]
    aimed, reported = ("i", False, False, True), ("i", False, True, False)
    bias, weights = toxicity.fitted([one(aimed), one(reported), [0] * len(at), one(reported, 3)], [1, 0, 0, 1], [200, 200, 2000, 50])
    model = toxicity.Model({"idiot"}, set(), bias, weights)
    score = [model.score(t) for t in ("you idiot", "she said you idiot", "he said idiot. He wrote idiot! She said idiot.", "a fine day", "", None)]
    assert score[0] > 0.9 and score[1] < 0.5 and score[2] > score[1] and score[3] == score[4] == score[5] < 0.1


def test_scores_use_the_settings(spark):
    """Held-out rows of which only aimed insults are toxic: without the settings, reported ones are taken for toxic too."""
    pick = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        kind = i % 4
        middle = {0: "you are an idiot", 1: "somebody said he met an idiot", 2: "a fine day"}.get(kind, "nothing here")
        rows.append((i, " ".join(pick.sample(words, 12)) + f". {middle}. " + " ".join(pick.sample(words, 12)) + "."))
        labels.append((i, 0, int(kind == 0)))
    docs, marked = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.Model({"idiot"}, set())
    counts = [toxicity.counted(model.read(t)) for _, t in rows]
    train = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5]
    model.bias, model.weights = toxicity.fitted([counts[i] for i in train], [labels[i][2] for i in train], [1] * len(train))
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs, spark, model).collect()}
    assert all(got[i] == bool(y) for i, _, y in labels)
    merged = toxicity.fitted([[sum(counts[i])] + [0] * (len(toxicity.SETTINGS) - 1) for i in train], [labels[i][2] for i in train], [1] * len(train))
    flat = [1 / (1 + math.exp(-(merged[0] + merged[1][0] * math.log2(1 + sum(c))))) >= 0.5 for c in counts]
    assert sum(f != bool(y) for f, (_, _, y) in zip(flat, labels)) >= 300


# Fingerprints


def letters_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return words if all(len(w) <= fingerprints.LONG for w in words) else [c for w in words for c in ([w] if len(w) <= fingerprints.LONG else w)]


def syncmers(text, k=fingerprints.K):
    w = letters_of(text)
    order = [xxhash.xxh64_intdigest(x.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(x.encode(), 42) >> 63 else 0) for x in w]
    if len(w) < k:
        return [tuple(w)] if w else []
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1) if min(order[i : i + k]) in (order[i], order[i + k - 1])]


def alike(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_fingerprints_of_the_whole_table(spark, texts):
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in fingerprints.op10_closed_syncmers(spark, D).collect()}
    assert set(got) == set(ids)
    marks = {i: syncmers(texts[i] or "") for i in ids}
    for i, after in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[i] or "", len(texts[i] or "")
        edited = t[: n - n // 2] + (texts[after] or "")[: n // 2]
        r, edited_marks = got[i], syncmers(edited)
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert len(r["fingerprint"]) == 8 * len(set(marks[i])) and len(r["edited_fingerprint"]) == 8 * len(set(edited_marks))
        assert abs(r["near_edited"] - alike(marks[i], edited_marks)) < 1e-9 and abs(r["near_next"] - alike(marks[i], marks[after])) < 1e-9


@pytest.mark.parametrize("k", [2, 3, 4, 5, 7])
def test_anchors_of_any_length_and_without_blanks(spark, k):
    rows = [(1, "漢字かな交じり文と仮名の長い文章です" * 3), (2, " ".join(f"w{i % 13}" for i in range(40))), (3, "a b"), (4, ""), (5, None)]
    got = {r["doc_id"]: len(r["a"]) for r in fingerprints.anchors(table(spark, rows), "text", "a", k).collect()}
    assert got == {i: len(set(syncmers(t or "", k))) for i, t in rows}
    spots = Counter(r["doc_id"] for r in fingerprints.located(table(spark, rows), k).collect())
    assert spots == Counter({i: len(syncmers(t or "", k)) for i, t in rows if syncmers(t or "", k)})


def test_positions_tell_the_shift(spark):
    body = " ".join(f"w{i}" for i in range(60))
    best = fingerprints.shared(table(spark, [(1, body)]), table(spark, [(2, "three more words " + body)])).orderBy(F.desc("n")).first()
    assert (best["left_id"], best["right_id"], best["shift"]) == (1, 2, 3) and best["n"] == len(syncmers(body))


# Pipeline stages


EXTRA = ", lang string, source string, n_chars long"


def test_stages_leave_ids_and_columns_alone(spark):
    prose = " ".join(f"p{i}" for i in range(50))
    rows = [(BIG, prose, "en", None, None), (None, "you idiot " + prose, None, "s", 3), (3, None, None, None, 0), (BIG + 2, prose + " tail", "en", "s", 9), (BIG + 4, "key AKIA" + "A1" * 8, "en", "s", 24)]
    docs = table(spark, rows, EXTRA)
    model = toxicity.Model({"idiot"}, set())
    kept = toxicity.without_toxic(docs, spark, model)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect()), key=repr) == sorted((r for r in rows if r[0] is not None), key=repr)
    cut = {r["doc_id"]: tuple(r) for r in substrings.without_repeats(docs, spark).collect()}
    assert cut[BIG] == rows[0] and cut[None] == rows[1] and cut[3] == rows[2] and cut[BIG + 2] == (BIG + 2, "tail", "en", "s", 4)
    clean = {r["doc_id"]: tuple(r) for r in secrets.redact(docs, spark).collect()}
    assert set(clean) == {r[0] for r in rows} and clean[BIG + 4] == (BIG + 4, "key [access]", "en", "s", 12) and clean[BIG][1] == prose


def test_stages_against_plain_versions(spark, texts):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet"), spark)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, D).collect()}
    assert kept == {i for i, t in texts.items() if model.score(t) < 0.5}
    words, left = removed(texts.items())
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, D).collect()}
    assert got == {i: texts[i] if len(left[i]) == len(words[i]) else " ".join(left[i]) for i in texts if left[i] or not words[i]}
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs, spark).collect()}
    for r in corpus_pipeline.redact_secrets(spark, docs, D).collect():
        text, out, at = texts[r["doc_id"]], [], 0
        for x in spans[r["doc_id"]]:
            if x["e"] > at:
                out += [text[at : max(at, x["s"])], f"[{secrets.KINDS[x['k']]}]"]
                at = x["e"]
        assert r["text"] == (None if text is None else "".join([*out, text[at:]]))
