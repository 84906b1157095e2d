import random
import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from narralith.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.load(PATH), Tokenizer.from_file(PATH)


def same(both, text):
    ours, lib = both
    want = lib.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == want, text
    assert ours.decode(want) == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " \n", "Hello World don't <|startoftext|>x Éçeau  123", "a<|endoftext|>b <|endoftext|>", "ΣΑΣ ΟΔΟΣ İ ß ﬁ", "é \x1c\x1d a\x85b c", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "'s's'tit's", "\x00​中文é"])
def test_cases(both, text):
    same(both, text)


def test_random(both):
    rng = random.Random(1)
    words = list("abcdefghijklmnopqrstuvwxyz éàüñß'’.,!?<|>1234567890\n\t  ΣσABCDEİ中́")
    sylls = ["th", "tion", "ing", "er", "an", "ou", "eau", "'s", " ", "\n", "sch", "ung", "'t", "re", "on", "&", "%%%"]
    for _ in range(1500):
        same(both, "".join(rng.choice(words) for _ in range(rng.randint(0, 60))))
        same(both, "".join(rng.choice(sylls) for _ in range(rng.randint(0, 60))))


def test_any_character(both):
    rng = random.Random(2)
    for _ in range(500):
        same(both, "".join(chr(c) for c in (rng.randint(0, 0x2FFF) for _ in range(20)) if unicodedata.category(chr(c)) != "Cn"))  # unassigned there, perhaps assigned in another Unicode version


def test_digest_rows(spark, both):
    import hashlib

    rows = [(1, "Hello there"), (2, None), (3, ""), (3, ""), (None, "x" * 100_000)]
    got = bpe.digest_texts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert len(got) == 5
    for (i, text), r in zip(rows, got):
        ids = both[1].encode(text or "", add_special_tokens=False).ids
        assert r.doc_id == i and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids"), PATH).collect()
    assert full[0].ids == both[1].encode("Hello there").ids


def test_empty_table(spark):
    assert bpe.digest_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
