import random
from pathlib import Path

import pytest
from tokenizers import Tokenizer

from orrery.llm.tokens import Encoder, encode, decode, round_trip, vocabulary


@pytest.fixture(scope="module")
def pair():
    return Encoder(vocabulary()), Tokenizer.from_file(vocabulary())


HARD = ["", " ", "a  b\n", "don't!!??'ll've", "x<|endoftext|>abc <|startoftext|>", "\x00\x1c ﬁ é é ́x", "ΟΔΟΣ ΣΑΣ.", "ǅ İstanbul ß", "  x\u0085y", "漢字かな交じり文 \U0001f600\U0001f468‍\U0001f469", "a" * 5000, "tion" * 900, "１２３ ²", "힣가"]


def test_equals_the_library(pair):
    own, library = pair
    letters = "abcdefghijéñüßΣ漢'!?.<|>0123456789 \t\n\r ́‍\U0001f600ABCÀ"
    pick = random.Random(7)
    for text in HARD + ["".join(pick.choice(letters) for _ in range(pick.randrange(120))) for _ in range(1500)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(text)


def test_cuts_are_used(pair):
    own, _ = pair
    assert ("Ø", "A") not in own.joined and ("t", "h") in own.joined


def test_nulls_extra_columns_and_empty_table(spark, pair):
    rows = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "Hello hello", "x"), (3, "Hello hello", "x")], "doc_id long, text string, ids string")
    got = sorted(map(tuple, round_trip(rows).select("doc_id", "n_tokens").collect()))
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert decode(encode(rows)).where("doc_id = 3").first()["text"] == "hello</w> hello</w>"
    assert round_trip(rows.limit(0)).count() == 0
