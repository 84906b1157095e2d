import random
import re

import numpy as np
import pytest

from narralith.llm import ngram_join as J
from narralith.llm.components import components


def brute(docs, s):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + s.words]) for k in range(len(w) - s.words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= s.percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    docs, i = [], 0
    common = rng.choices(vocab, k=12)
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(1, 60)) + (common if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            docs.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in text)))
            i += 1
    docs += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "é É"), (i + 4, "é é"), (i + 5, "É é"), (i + 6, "a b"), (i + 7, "A  b")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,settings", [(1, J.Settings()), (2, J.Settings(words=5, percent=80, small=1, block=3, broadcast_ids=0)), (3, J.Settings(small=2, block=1, sketch_bits=6)), (4, J.Settings(small=1, block=50, block_bytes=2000, broadcast_ids=0))])
def test_against_brute_force(spark, seed, settings):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n string").repartition(3)
    got = {r.id: (r.n, r.component) for r in J.join_components(df, settings).collect()}
    assert got == brute(docs, settings)


def test_repeated_rows_and_null_ids(spark):
    t = "one two three four five six"
    df = spark.createDataFrame([(2, t), (2, t), (None, t), (5, t), (None, "")], "doc_id long, text string")
    got = sorted(J.join_components(df).collect(), key=str)
    assert sorted((r.id or -1, r.n, r.component or -1) for r in got) == [(-1, 0, -1), (-1, 3, -1), (2, 3, 2), (2, 3, 2), (5, 3, 2)]


def test_empty_table(spark):
    assert J.join_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_long_chains(spark):
    rng = random.Random(0)
    order = list(range(60))
    rng.shuffle(order)
    links = list(zip(order, order[1:])) + [(100 + i, 101 + i) for i in range(40)] + [(300, 300)]
    for per_task in (10**6, 8):
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), per_task).collect()}
        assert got == {i: 0 for i in range(1, 60)} | {101 + i: 100 for i in range(40)}


def test_many_near_copies(spark):
    rng = random.Random(7)
    base = [f"v{rng.randrange(400)}" for _ in range(80)]
    docs = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(30)}"
        docs.append((i, " ".join(t[: rng.choice([80, 80, 70, 50])])))
    s = J.Settings(block=40, small=6)
    got = {r.id: (r.n, r.component) for r in J.join_components(spark.createDataFrame(docs, "doc_id long, text string"), s).collect()}
    assert got == brute(docs, s)


def test_suffix_filter_never_loses_a_link():
    rng = np.random.default_rng(3)
    linked = unlinked = 0
    for _ in range(3000):
        s = J.Settings(percent=int(rng.integers(50, 100)))
        x = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 400)), dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random() ** 0.3], rng.integers(0, 2**64, int(rng.integers(0, 30)), dtype=np.uint64)]))
        if not len(y):
            continue
        same = len(np.intersect1d(x, y))
        if 100 * same >= s.percent * (len(x) + len(y) - same):
            linked += 1
            assert J.may_link(len(x), J.counts_of(x), len(y), J.counts_of(y), s)
            assert J.plausible_forest(np.array([len(x), len(y)]), [J.counts_of(x), J.counts_of(y)], np.array([True, True]), None, s)
            assert J.linked_forest([x, y], None, s) and J.linked_forest([x, y, x], None, s)
        else:
            unlinked += 1
            assert not J.linked_forest([x, y], None, s) and not J.linked_forest([y, x], np.array([0, 1]), s)
    assert min(linked, unlinked) > 300


def test_counts_that_do_not_fit_are_unknown():
    crowded = np.arange(3000, dtype=np.uint64)  # all in one range
    assert J.counts_of(crowded) is None and J.may_link(3000, None, 10, b"\0\0\0\0", J.Settings())
