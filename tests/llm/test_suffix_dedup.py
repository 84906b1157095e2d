import hashlib
import random
import tempfile

import numpy as np
import pytest

from narralith.llm import induced_sort as I
from narralith.llm import queries
from narralith.llm import suffix_dedup as D


@pytest.mark.parametrize("seed", range(4))
def test_order_and_common_prefixes(seed, monkeypatch):
    rng = random.Random(seed)
    for _ in range(300):
        k, n = rng.choice([1, 2, 3, 5, 200]), rng.randint(1, rng.choice([5, 30, 120]))
        t = np.array([rng.randrange(k) for _ in range(n)])
        if rng.random() < 0.3:
            t = np.tile(t[: rng.randint(1, n)], 4)[:150]
        cap = rng.choice([0, 3, 10, 40])
        monkeypatch.setattr(I, "BATCH", rng.choice([1, 2, 7, 1000]))
        out = []
        with tempfile.TemporaryDirectory() as folder:
            # tiny bounds: every queue spills, every level of names goes through induction again
            I.induce(t, k, cap, folder, lambda p, x: out.append((p.copy(), np.array(x))), rng.choice([0, 4, 10**9]), rng.choice([0, 5, 10**9]))
        order, b = np.concatenate([p for p, _ in out]), t.tolist()
        cut = [b[i : i + (cap or len(b))] for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and cut == sorted(cut, reverse=True)
        if cap:
            lcp = np.concatenate([x for _, x in out])
            assert all(I.common(t, int(x), int(y), cap) == v for x, y, v in zip(order, order[1:], lcp[1:]))


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["tion", "the", "é", " ", "ing", "of", "an", "\n", "re", "ou"]
    make = lambda n: "".join(rng.choice(vocab) for _ in range(n))
    passages = [make(rng.randint(20, 90)) for _ in range(6)]
    texts = [None, "", "short", "a" * 450, "ab" * 150, "a" * 199, "a" * 200]
    for _ in range(30):
        texts.append("".join(rng.choice([make(rng.randint(0, 60)), rng.choice(passages)]) for _ in range(rng.randint(1, 5))))
    texts += rng.choices(texts, k=6)
    near = list(texts[8] or "")
    if near:
        near[len(near) // 2] = "Q"
    return [*texts, "".join(near)]


@pytest.mark.parametrize("seed,limit,piece", [(1, 48 << 20, 1 << 21), (2, 0, 300), (3, 0, 1 << 21)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, seed, limit, piece):
    monkeypatch.setattr(D.Settings, "__init__", lambda self, f=D.Settings.__init__: f(self, broadcast_bytes=limit, shard_bytes=4000, piece=piece))
    texts = corpus(seed)
    spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    want = brute(texts, 200)
    assert got == dict(enumerate(want))
    assert sum(w[1] for w in want) > 2000


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "".join(random.Random(9).choices("abcdefgh", k=300))
    u = "".join(random.Random(8).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(1, t), (1, t), (2, u), (None, u[:250]), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in D.remove_repeats(df).collect())
    assert got == [(0, 0, 0, 0), (0, 250, 250, 1), (1, 300, 300, 1), (1, 300, 300, 1), (2, 300, 250, 1)]
    assert D.remove_repeats(df.where("false")).collect() == []


def test_long_common_prefixes():
    t = np.array(([1, 2, 3, 4, 5, 6, 7] * 50)[:300] + [9] + ([1, 2, 3, 4, 5, 6, 7] * 50)[:300])
    for length in (250, 290, 300):
        want = [any(t[i : i + length].tolist() == t[j : j + length].tolist() for j in range(len(t) - length + 1) if i != j) for i in range(len(t) - length + 1)]
        assert I.repeated_starts(t, 10, length).tolist()[: len(want)] == want and any(want)
    with pytest.raises(ValueError):
        I.repeated_starts(t, 10, 70_000)
