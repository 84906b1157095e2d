import random

import pytest
from pyspark.sql import functions as F

from narralith.functions import lexicon
from narralith.functions import text as T


def fold(raw):
    """The normal form character by character, with the place of each character."""
    out, places, gap = [], [], False
    for i, c in enumerate(raw):
        if c in T.DIACRITICS + T.TATWEEL + T.ZERO_WIDTH_JOINER:
            continue
        c = " " if c in T.SYMBOLS or c.isspace() else T.LETTERS.get(c, c)
        if c == " " and gap:
            continue
        gap = c == " "
        out.append(c)
        places.append(i)
    return "".join(out), places


def split(text):
    out, i = [], 0
    while i < len(text):
        if text[i].isspace():
            i += 1
        elif text[i] in T.PUNCTUATION:
            out.append((text[i], i, i + 1))
            i += 1
        else:
            j = i
            while j < len(text) and not text[j].isspace() and text[j] not in T.PUNCTUATION:
                j += 1
            out.append((text[i:j], i, j))
            i = j
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    chars = "ابجدأإآىؤئةَُّـ‍ \n\t  \x1c«»*()[]:،.-–ab12"
    return ["", " ", "محمد بن يحيا", *["".join(rng.choice(chars) for _ in range(rng.randint(1, 30))) for _ in range(300)]]


def test_normal_form_and_places(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", T.normalize(F.col("t")).alias("n"), T.index_map(F.col("t")).alias("m")).collect():
        assert (r.n, list(r.m)) == fold(texts[r.i]), repr(texts[r.i])


def test_tokens_with_places(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in T.with_tokens(df, "t", ["i"]).orderBy("i", "tok_idx").collect():
        got.setdefault(r.i, []).append((r.word, r.start, r.end))
    assert all(got.get(i, []) == split(t) for i, t in enumerate(texts))


def test_regex_spans(spark):
    import re

    text = "12 - ab 3- 4 -5 -"
    got = T.regex_spans(spark.createDataFrame([(1, text), (2, "none")], "i int, t string"), "t", r"[0-9]+\s*-", ["i"]).collect()
    assert [(r.i, r.pos, r.match) for r in sorted(got)] == [(1, m.start(), m[0]) for m in re.finditer(r"[0-9]+\s*-", text)]


def test_phrases_stand_alone(spark):
    df = spark.createDataFrame([("x ab, abc ab ab",)], "t string").withColumn("k", F.lit(1))
    hits = T.phrase_hits(df, "t", spark.createDataFrame([("ab",), ("ab ab",)], "phrase string"), ["k"]).collect()
    assert sorted((r.start, r.end) for r in hits) == [(2, 4), (10, 12), (10, 15), (13, 15)]


def test_similarity(spark):
    r = spark.range(1).select(
        T.edit_similarity(F.lit("محمد"), F.lit("محمود")).alias("a"),
        T.edit_similarity(F.lit(""), F.lit("")).alias("b"),
        T.cosine01(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("c"),
        T.cosine01(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("d"),
        T.to_int(F.lit("١٢")).alias("e"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (0.8, 1.0, 0.5, 0.0, 12)


def test_lexicon_is_folded(spark):
    terms = {r.term for r in lexicon.lexicon(spark).collect()}
    assert "ابنه" in terms and "ابنة" not in terms and not any(c in t for t in terms for c in T.LETTERS)
