import os
import random

import pytest
from tokenizers import Tokenizer

from tasselworks.llm.tokenize import encode_corpus, encode_text

PATH = os.environ.get("TASSELWORKS_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def truth():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


EDGES = [None, "", " ", "\n\n  \t x", "<|endoftext|>", "naïve café 🌽🌽 ñandú", "don't we'll I'VE", "a" * 5000, "ab" * 3000, "=" * 777 + " " * 500, "１２３ ½ ﬁ ​́", "\x00\x01", "日本語のテキスト" * 40]


def test_edges(truth):
    for text in EDGES:
        assert encode_text(PATH, text) == truth(text), repr(text)[:60]


def test_random_strings(truth):
    rng = random.Random(8)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ab", "aeiourstln", "éñçüaß ", "0123456789.,-", "(){}[]=+-*/_\"'", "абв中文x"):
        for _ in range(300):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
            assert encode_text(PATH, text) == truth(text), text


def test_table(spark, truth):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Corn leaf, 3 spots.", "x"), (3, "Corn leaf, 3 spots.", "y")], "doc_id long, text string, ids string")
    out = sorted((r.doc_id, r.ids) for r in encode_corpus(df, "doc_id", "text", PATH).collect())
    assert out == [(1, []), (2, []), (3, truth("Corn leaf, 3 spots.")), (3, truth("Corn leaf, 3 spots."))]
    assert encode_corpus(df.limit(0), "doc_id", "text", PATH).count() == 0
