import math
import random
import re

import pytest

from narralith.llm import quality_rules as R


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "one", "a b c a b c", "a a a a a", "x\nx\nx ", "\n\nq\n\nq", "é| <b> #\x0b\x0c", " nb\xa0sp ", "w " * 3000]
    out += ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "c d"]) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    return out


def test_counts(spark):
    data = texts()
    df = R.with_counts(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").selectExpr("*", "'x' as n_words", "1 as n_lines"))
    for r in df.collect():
        assert tuple(r[c] for c in R.COUNTS) == brute(data[r.doc_id]), data[r.doc_id]


@pytest.mark.parametrize("k,n,p", [(0, 100, 0.01), (3, 700, 0.01), (7, 700, 0.01), (12, 5000, 0.01), (40, 50_000, 0.001)])
def test_binomial_bound_is_exact(spark, k, n, p):
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
    from pyspark.sql import functions as F

    for level, want in ((tail * 1.0001, True), (tail * 0.9999, False)):
        got = spark.range(1).select(R._tail_below(F.lit(k).cast("long"), F.lit(n).cast("long"), p, F.lit(level)).alias("x")).first().x
        assert got == (want and k < n * p)


def cutoff_brute(steps, n_tests, s):
    limit, n = s.risk / len(R.MEASURES), len(steps)
    for c in range(s.cutoffs):
        k = sum(x > c for x in steps)
        if k >= n * limit:
            continue
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(limit) + (n - j) * math.log1p(-limit)) for j in range(k + 1))
        if tail <= s.delta / n_tests:
            return c
    return None


def test_thresholds_and_verdicts(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        n = rng.randint(50, 400)
        good = i % 5 > 0
        rows.append((i, "en" if i % 3 else None, n, n * rng.randint(4, 6), rng.randint(0, 3) if good else n, 0, 0, 5, "t"))
        labels.append((i, int(good), 0))
    rows.append((9000, "xx", 60, 240, 60, 0, 0, 5, "t"))
    rows.append((9001, "en", 60, 240, 0, 0, 31, 5, "t"))
    counts = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, measure string")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    s = R.Settings()
    got = {(r.stratum, r.measure): r.cutoff for r in R.thresholds(counts, lab, s).collect()}
    goods = {i for i, q, _ in labels if q}
    for stratum in ("en", ""):
        for m, (top, bottom, scale) in R.MEASURES.items():
            steps = []
            for r in rows:
                if r[0] in goods and (r[1] or "") == stratum:
                    env = dict(zip(("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"), r))
                    steps.append(min(s.cutoffs, math.ceil(scale * eval(top, env) / eval(bottom, env))))
            assert got.get((stratum, m)) == cutoff_brute(steps, 2 * len(R.MEASURES) * s.cutoffs, s), (stratum, m)
    out = {r.doc_id: r for r in R.verdicts(counts, R.thresholds(counts, lab, s), s).collect()}
    assert len(out) == len(rows) and out[9000].kept and out[9001].base_failed and not out[9001].kept
    assert sum(not out[i].kept for i in goods) <= s.risk * len(goods)
    assert not any(out[i].kept for i, q, _ in labels if not q and i % 3)  # the other stratum is too small for any cutoff


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    counts = R.with_counts(docs)
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert R.verdicts(counts, R.thresholds(counts, lab)).collect() == []
