"""Token ids against the public libraries."""

import random

import pytest
from tokenizers import Tokenizer

from quirelake.llm.tokens import LONGEST, encode_column, load

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_equal_to_public(public):
    rng = random.Random(2)
    texts = ["", " ", "\n\n\n  x", "<|endoftext|>", "a" * 5000, " " * 300, "é" * 333, "👩🏽‍⚕️" * 50, "don't we'll I'M", "1234567890" * 20, "\t\r\n mixed    blanks ", "मरीज ठीक है", "体温 37.2 度"]
    texts += ["".join(rng.choice("abcdeth \n.,é1") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    texts += ["".join(rng.choice("abcdethingos") for _ in range(n)) for n in (LONGEST - 1, LONGEST, LONGEST + 1, 200, 3000)]
    assert load().encode(texts) == public(texts)


def test_round_trip():
    bpe = load()
    back = {v: k for k, v in bpe.ranks.items()}
    for t in ("Tab. Pantop 40 mg OD x 7 days", "ünïcode\r\n x", "𝔘𝔫"):
        assert b"".join(back[i] for i in bpe.encode([t])[0]).decode() == t


def test_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello hello", "z"), (3, "hello hello", "z"), (4, "lone \\ud800".encode().decode("unicode_escape", "ignore").encode("utf-8", "replace").decode(), "w")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode_column(df, "doc_id", "text").collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got) == 5
    assert [r["n_tokens"] for r in encode_column(df, "doc_id", "text", counts_only=True).orderBy("doc_id").collect()][:3] == [0, 0, 2]
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0
