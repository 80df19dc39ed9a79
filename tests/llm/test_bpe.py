import os
import random

import pytest

from tests.conftest import rows
from tidemark.llm.bpe import VOCABULARY, Bpe, count_tokens, encode_texts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabulary here")
TEXTS = [
    "", " ", "\n\n \t", "Hello world", "it's they'LL 12,345.67", "naïve café — 日本語テキスト", "🔥👩🏽‍💻 <|endoftext|>", "ab" * 3000, "  leading", "trailing  ", "a b c", "สวัสดีครับ नमस्ते",
    "\x00\x01 control", "ΑΒΓ αβγ; Где? …", "x" * 5000, "\r\n\r\n", "1234567890" * 50,
]


@pytest.fixture(scope="module")
def bpe():
    return Bpe()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_library_and_back(bpe, library):
    rng = random.Random(7)
    alphabet = "abcde ,.'\n0189éßжあ漢🔥‍"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    for text in texts:
        ids = bpe.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode(ids) == text


def test_merges_against_rescanning(bpe):
    """The queue against the plain rule: again and again the leftmost pair of lowest rank."""
    rng = random.Random(1)
    for _ in range(50):
        data = bytes(rng.choice(b"aabbc th") for _ in range(rng.randrange(1, 40)))
        symbols = [bpe.single[b] for b in data]
        while True:
            pairs = [(bpe.merges[(a << 20) | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (a << 20) | b in bpe.merges]
            if not pairs:
                break
            m, i = min(pairs)
            symbols[i : i + 2] = [m & 0xFFFFF]
        assert bpe._merge(data) == symbols


def test_table(spark, bpe):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, None, 0), (3, "", 0), (None, "a", 0), (1, "Hello world", 0)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_texts(df).collect()), key=str)
    assert got == sorted([(1, bpe.encode("Hello world")), (2, []), (3, []), (None, bpe.encode("a")), (1, bpe.encode("Hello world"))], key=str)
    assert encode_texts(df.limit(0)).collect() == []
    assert rows(count_tokens(df, ["doc_id"])) == sorted([(1, 2), (2, 0), (3, 0), (None, 1), (1, 2)], key=str)
