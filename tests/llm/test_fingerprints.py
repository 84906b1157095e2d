import hashlib
import random
import re

import pytest
import xxhash

from narralith.llm import fingerprints as P
from narralith.llm import queries


def brute_fp(text, s):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    hs = set()
    for k in range(max(1, len(w) - s.words + 1) if w else 0):
        h = 42
        for x in w[k : k + s.words]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        hs.add(h - 2**64 if h >= 2**63 else h)
    low = sorted(h for h in hs if h < -(2**63) + 2**64 // s.share)
    return low or sorted(hs)[:1]


def sim(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


@pytest.mark.parametrize("rows_per_bucket", [2, 1500])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, rows_per_bucket):
    rng = random.Random(4)
    docs = [(i * 7, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 80)))) for i in range(30)]
    docs += [(300, None), (301, "Éa"), (302, ""), (303, "x"), (304, " \n"), (305, "q " * 30_000)]
    rng.shuffle(docs)
    spark.createDataFrame([(i, t, "y") for i, t in docs], "doc_id long, text string, fp string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(P.Settings, "__init__", lambda self, f=P.Settings.__init__: f(self, rows_per_bucket=rows_per_bucket))
    got = {r.doc_id: r for r in queries.op8_fingerprint(spark, str(tmp_path)).collect()}
    docs.sort()
    s = P.Settings()
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        text, nxt = text or "", docs[(k + 1) % len(docs)][1] or ""
        cut = len(text) // 4
        edited = (text[: len(text) - cut] + nxt[:cut]) if cut else text
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, n = brute_fp(text, s), brute_fp(edited, s), brute_fp(nxt, s)
        text_of = lambda fp: " ".join(f"{h % 2**64:X}" for h in fp)
        assert r.fingerprint == text_of(a) and r.edited_fingerprint == text_of(e)
        assert abs(r.near_edited - sim(a, e)) < 1e-9 and abs(r.near_next - sim(a, n)) < 1e-9


def test_merge_and_containment(spark):
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(4000))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = P.with_fingerprint(P.with_fingerprint(df, df.a, "x"), df.b, "y")
    r = df.select(P.containment(df.x, df.y).alias("c"), (P.merged(df.x, df.y) == df.y).alias("m"), P.likeness(df.x, df.y).alias("j")).first()
    assert r.c == 1.0 and r.m and abs(r.j - 0.1) < 0.04


def test_ties_nulls_and_empty_table(spark):
    schema = "doc_id long, text string"
    rows = [(1, "a"), (1, "b"), (None, "n"), (2, "c"), (2, "c")]
    got = sorted((r.id or 0, r.text, r.next_text) for r in P.with_next(spark.createDataFrame(rows, schema), "doc_id", "text").collect())
    assert got == [(0, "n", "a"), (1, "a", "b"), (1, "b", "c"), (2, "c", "c"), (2, "c", "n")]
    assert P.with_next(spark.createDataFrame([], schema), "doc_id", "text").collect() == []
    assert P.with_next(spark.createDataFrame([(5, "z")], schema), "doc_id", "text").first().next_text == "z"
