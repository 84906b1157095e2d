import random

import numpy as np
import pytest

from narralith.llm import chaining as C

S = C.Settings()


def test_fenwick():
    rng = random.Random(0)
    tree, seen = C.Fenwick(20), []
    for k in range(200):
        i, v = rng.randrange(20), rng.random()
        tree.put(i, (v, k))
        seen.append((i, (v, k)))
        q = rng.randrange(21)
        assert tree.upto(q) == max([x for j, x in seen if j < q], default=(float("-inf"), -1))


def test_edits():
    assert [C.edits(list(a), list(b)) for a, b in (("", "ab"), ("kitten", "sitting"), ("same", "same"))] == [2, 3, 0]


def test_chain_skips_stray_matches():
    line = [(i, i + 100) for i in range(0, 60, 6)]
    got = C.chains([*line, (12, 400), (33, 5)], S)
    assert got[0] == line


def test_chains_of_each_copy():
    copies = [[(at + i, i) for i in range(0, 60, 6)] for at in (10, 200, 400)]
    assert sorted(C.chains(sum(copies, []), S)) == copies


def fuzzy(words, rng, every):
    out = list(words)
    for i in range(every, len(out) - 5, every):
        r = rng.random()
        out[i : i + 1] = ["edited"] if r < 0.5 else [] if r < 0.75 else [out[i], "put", "in"][:2]
    return out


@pytest.mark.parametrize("every", [10**9, 30, 23])
def test_planted_passages(spark, every):
    rng = random.Random(every)
    vocab = [f"w{i}" for i in range(3000)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [make(rng.randint(70, 140)) for _ in range(5)]
    docs, planted = [], {}
    for i in range(40):
        p = rng.randrange(5)
        if i % 2:
            a, b = make(rng.randint(0, 80)), make(rng.randint(0, 80))
            docs.append((i, " ".join([*a, *(fuzzy(passages[p], rng, every) if p in planted.values() else passages[p]), *b])))
            planted[i] = p
        else:
            docs.append((i, " ".join(make(rng.randint(0, 300)))))
    docs += [(100, None), (101, ""), (102, "a b c"), (None, docs[1][1])]
    got = C.passages(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "2 as doc")).collect()
    first = {}
    for i, p in planted.items():
        first.setdefault(p, i)
    repeats = {i for i, p in planted.items() if first[p] != i}
    assert {r.doc for r in got} == repeats
    assert {r.other for r in got} <= set(planted)
    text = dict(docs)
    for r in got:
        assert planted[r.doc] == planted[r.other] and r.other < r.doc and r.end - r.start >= S.min_words
        if every > 1000:
            assert text[r.doc].split()[r.start : r.end] == text[r.other].split()[r.other_start : r.other_end]
    for d in repeats:
        # a seed at a passage's edge may point at another copy, so there can be shorter rows beside the whole one
        longest = max((r for r in got if r.doc == d), key=lambda r: r.end - r.start)
        assert longest.end - longest.start >= 0.8 * len(passages[planted[d]])
        if every > 1000:
            assert text[d].split()[longest.start : longest.end] == passages[planted[d]]


def test_copies_and_empty_table(spark):
    rng = random.Random(1)
    t = " ".join(f"x{rng.randrange(500)}" for _ in range(300))
    df = spark.createDataFrame([(3, t), (1, t), (2, t), (2, t)], "doc_id long, text string")
    got = sorted({(r.doc, r.start, r.end, r.other) for r in C.passages(df).collect()})
    assert got == [(2, 0, 300, 1), (3, 0, 300, 1)]
    assert C.passages(df.where("false")).collect() == []


def test_passage_repeated_in_one_document(spark):
    rng = random.Random(2)
    make = lambda n: [f"y{rng.randrange(4000)}" for _ in range(n)]
    p = make(100)
    docs = [(1, " ".join(make(40) + p + make(40))), (2, " ".join(make(30) + p + make(50) + p + make(20)))]
    got = sorted((r.doc, r.start, r.end, r.other, r.other_start) for r in C.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(2, 30, 130, 1, 40), (2, 180, 280, 1, 40)]


def exact_rows(docs, rows):
    """Whether each row is a passage by the words themselves."""
    text = {i: t.split() for i, t in docs}
    for r in rows:
        a, b = text[r.doc][r.start : r.end], text[r.other][r.other_start : r.other_end]
        assert min(len(a), len(b)) >= S.min_words and 1 - C.edits(a, b) / max(len(a), len(b)) >= S.identity


@pytest.mark.parametrize("every", [12, 13, 14, 16, 18, 20])
def test_short_fuzzy_passages(spark, every):
    """Passages of 50 to 80 words with an edit every few words: every shared seed, chained and grown in full, is the brute force."""
    rng = random.Random(every)
    make = lambda n: [f"z{rng.randrange(5000)}" for _ in range(n)]
    docs, expected = [], set()
    for i in range(0, 120, 2):
        p = make(rng.randint(50, 80))
        docs += [(i, " ".join(make(rng.randint(0, 60)) + p + make(rng.randint(0, 60)))), (i + 1, " ".join(make(rng.randint(0, 60)) + fuzzy(p, rng, every) + make(rng.randint(0, 60))))]
        a, b = (C.words_of(t) for _, t in docs[-2:])
        (ha, xa), (hb, xb) = (C.seeds_of(t, S) for _, t in docs[-2:])
        for chain in C.chains([(int(x), int(y)) for h, x in zip(hb, xb) for g, y in zip(ha, xa) if g == h], S):
            s0, e0, s1, e1, same = C.align(b, a, chain, S)
            if min(e0 - s0, e1 - s1) >= S.min_words and same >= S.identity:
                expected.add(i + 1)
    got = C.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    exact_rows(docs, got)
    assert {r.doc for r in got} == expected and len(expected) >= 20


def test_single_seed_grows():
    words = [f"q{i}".encode() for i in range(60)]
    a = C.marks_of(words)
    assert C.may_reach(a, a, (30, 30), (30, 30), S)
    assert not C.may_reach(a[:49], a[:49], (30, 30), (30, 30), S)


@pytest.mark.parametrize("seed", range(3))
def test_first_holder_has_a_part_only(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    docs, expected = [], set()
    for i in range(0, 60, 3):
        p = make(rng.choice([55, 60]))
        part = p[:45] if i % 2 else p[-45:]
        docs += [(i + k, " ".join(make(30) + q + make(30))) for k, q in enumerate((part, p, p))]
        expected.add((i + 2, 30, 30 + len(p), i + 1, 30))
    got = C.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    exact_rows(docs, got)
    assert expected <= {(r.doc, r.start, r.end, r.other, r.other_start) for r in got}


@pytest.mark.parametrize("block", [1024, 2])
def test_pieces_in_earlier_documents(spark, block):
    """Two copies of a passage are found though earlier documents hold all of it in pieces too short to report."""
    rng = random.Random(5)
    make = lambda n: [f"u{rng.randrange(9000)}" for _ in range(n)]
    p = make(100)
    docs = [(k, " ".join(make(20) + p[18 * k : 18 * k + 28] + make(20))) for k in range(5)]
    docs += [(10, " ".join(make(15) + p + make(15))), (11, " ".join(make(25) + p + make(5))), (12, " ".join(p))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc, r.start, r.end, r.other, r.other_start, r.other_end) for r in C.passages(df, C.Settings(block=block)).collect())
    assert {(11, 25, 125, 10, 15, 115), (12, 0, 100, 10, 15, 115)} <= set(got)
    assert all(r[3] >= 10 for r in got)


def test_rows_that_share_an_id(spark):
    rng = random.Random(6)
    make = lambda n: [f"t{rng.randrange(9000)}" for _ in range(n)]
    p = make(80)
    docs = [(1, " ".join(p)), (2, "a " + " ".join(p)), (2, "z " + " ".join(make(90))), (2, "z"), (3, " ".join(make(5) + p))]
    got = sorted((r.doc, r.start, r.end, r.other) for r in C.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(2, 1, 81, 1), (3, 5, 85, 1)]


def test_runs_of_one_word():
    words = ["of"] * 200
    h, at = C.seeds_of(" ".join(["x1", "x2", *words, "x3"]), S)
    assert len(at) < 40
    # every window of a text keeps a place with its least hash
    rng = random.Random(8)
    for _ in range(200):
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(6, 90)))
        h, at = C.seeds_of(text, C.Settings(k=2, window=5))
        every, _ = C.seeds_of(text, C.Settings(k=2, window=1))
        kept = dict(zip(at.tolist(), h.tolist()))
        for i in range(len(every) - 4):
            least = min(every[i : i + 5].view("uint64"))
            assert any(kept.get(i + d) is not None and kept[i + d] == every[i + d] and every[i + d : i + d + 1].view("uint64")[0] == least for d in range(5))


def brute_links(docs):
    """Pairs of documents with a passage: all their common seeds, chained and aligned."""
    seeds = {i: C.seeds_of(t, S) for i, t in docs}
    words = {i: C.words_of(t) for i, t in docs}
    out = set()
    for i, _ in docs:
        for j, _ in docs:
            if j < i:
                there: dict = {}
                for h, y in zip(*(v.tolist() for v in seeds[j])):
                    there.setdefault(h, []).append(y)
                matches = [(x, y) for h, x in zip(*(v.tolist() for v in seeds[i])) for y in there.get(h, ())]
                for chain in C.chains(matches, S) if matches else ():
                    s0, e0, s1, e1, same = C.align(words[i], words[j], chain, S)
                    if min(e0 - s0, e1 - s1) >= S.min_words and same >= S.identity:
                        out.add((i, j))
    return out


def classes_of(ids, links):
    at = {i: i for i in ids}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in links:
        i, j = top(i), top(j)
        at[max(i, j)] = min(i, j)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("every", [9, 11, 13])
def test_no_class_is_split(spark, every):
    """Edited copies of passages: what brute force links stays in one class, also where the first holder's passage covers the seeds."""
    rng = random.Random(every)
    make = lambda n: [f"s{rng.randrange(5000)}" for _ in range(n)]
    line, docs = make(20), []
    for i in range(0, 160, 4):
        p = make(rng.randint(52, 75))
        for k in range(4):
            q = list(p)
            for at in range(rng.randint(4, every), len(q) - 4, every + rng.randint(0, 4)):
                q[at] = f"edit{i}-{k}-{at}"
            docs.append((i + k, " ".join([*make(rng.randint(0, 30)), *line * rng.randint(0, 2), *make(rng.randint(0, 9)), *q, *make(rng.randint(0, 9)), *line * rng.randint(0, 1)])))
    links = brute_links(docs)
    got = C.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    exact_rows(docs, got)
    ids = [i for i, _ in docs]
    found = classes_of(ids, {(r.doc, r.other) for r in got})
    assert len(links) > 20 and [(i, j) for i, j in links if found[i] != found[j]] == []


def test_equal_digits_are_not_equal_words(spark):
    """A later holder of the whole passage is found behind an earlier one whose unequal word has the same digit."""
    rng = random.Random(11)
    make = lambda n: [f"r{rng.randrange(9000)}" for _ in range(n)]
    docs, expected = [], set()
    for i in range(0, 80, 4):
        p = make(52)
        twin = next(w for k in range(10**6) if C.marks_of([(w := f"twin{k}").encode()]) == C.marks_of([p[48].encode()]))
        texts = [p[:30], [*p[:48], twin, *p[49:]], p, p]
        docs += [(i + k, " ".join(make(30) + q + make(30))) for k, q in enumerate(texts)]
        expected.add((i + 3, i + 2))
    got = C.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    exact_rows(docs, got)
    assert expected <= {(r.doc, r.other) for r in got}


def test_a_pair_of_places_is_aligned_once():
    """Places with three more common seeds nearby, too far edited for a passage: each pair is compared once, not once a seed."""
    rng = random.Random(13)
    seeds = [rng.randrange(1, 2**62) for _ in range(4)]
    n, reach = 12, C.reach_of(S)
    around = np.array([[rng.randrange(2**32) for _ in range(2 * reach)] for _ in range(n)], np.uint32).reshape(n, 2, reach)
    common = [rng.randrange(2**32) for _ in range(reach)]
    offsets = (12, 22, 32)
    for i in range(n):
        for o in offsets:  # words of a seed nearby, and a few before it
            around[i, 1, o - S.k - 2 : o] = common[o - S.k - 2 : o]
    near = [np.array(seeds[1:], np.int64).tobytes()] * n
    at = [np.array(offsets, np.int16).tobytes()] * n
    places = C.Places(np.full(n, seeds[0], np.int64), np.arange(n), np.zeros(n, bool), around, np.full((n, 2), reach), near, at, S)
    seen = []
    once = places.chained
    places.chained = lambda i, j: (seen.append((i, j)), once(i, j))[1]
    list(places.links())
    assert seen and len(seen) == len(set(seen))


def test_word_hashes_are_those_of_the_words():
    rng = random.Random(5)
    words = [bytes(rng.choice(b"abcdef\xc3\xa9\x1c\x85\x00") for _ in range(rng.randint(1, 70))) for _ in range(3000)]
    raw = b"".join(w + rng.choice([b" ", b"\t \n", b"\x0b", b"\x0c\r"]) for w in words)
    h, start = C.word_hashes(raw)
    assert h.tolist() == C.hashes_of(raw.split()).tolist() and [raw[i:].split(None, 1)[0] for i in start.tolist()] == raw.split()
    assert not len(C.word_hashes(b"")[0]) and not len(C.word_hashes(b" \n")[0])


def test_seeds_of_a_batch_are_those_of_each_text():
    rng = random.Random(6)
    texts = [None, "", "a"] + [" ".join(rng.choice(["a", "B", "cc", "é"][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    row, h, at = C.seeds_of_all([t if t is None else t.encode() for t in texts], S)
    each = [C.seeds_of(t, S) for t in texts]
    assert row.tolist() == np.repeat(np.arange(len(texts)), [len(x) for x, _ in each]).tolist()
    assert h.tolist() == np.concatenate([x for x, _ in each]).tolist() and at.tolist() == np.concatenate([x for _, x in each]).tolist()


def test_edits_of_many():
    rng = np.random.default_rng(7)
    w = rng.integers(0, 3, (400, 64)).astype(np.uint32)
    i, j, start, end, to = (rng.integers(0, m, 500) for m in (400, 400, 30, 59, 59))
    assert C.edits_of(w, i, j, start, end, to).tolist() == [C.edits(w[a, s : max(s, e)].tolist(), w[b, s : max(s, t)].tolist()) for a, b, s, e, t in zip(i, j, start, end, to)]


def test_seeds_nearby_where_words_agree_are_not_compared(monkeypatch):
    """Places in runs of one word, all of the same words but for where the run ends: the seeds nearby lie where they agree."""
    n, reach = 60, C.reach_of(S)
    rng = np.random.default_rng(8)
    around = np.full((n, 2, reach), 7, np.uint32)
    around[:, :, 40:] = rng.integers(100, 1 << 30, (n, 2, reach - 40))
    near, at = [np.repeat(np.int64(5), 3).tobytes()] * n, [np.array([8, 16, 24], np.int16).tobytes()] * n
    places = C.Places(np.full(n, 5, np.int64), np.arange(n), np.zeros(n, bool), around, np.full((n, 2), reach), near, at, S)
    seen = []
    close = C.Places.close
    monkeypatch.setattr(C.Places, "close", lambda self, i, o, a, *rest: (seen.append(len(a)), close(self, i, o, a, *rest))[1])
    list(places.apart())
    assert sum(seen) == 0


def test_buckets():
    none = np.zeros(0, np.int64)
    assert list(C.buckets(none, none, none)) == []
    got = C.buckets(np.array([3, 1, 3, 1, 2]), np.array([9, 8, 7, 6, 5]), np.array([1, 1, 2, 1, 1]))
    assert [x.tolist() for x in got] == [[7, 9]]
