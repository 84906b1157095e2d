"""What must not grow faster than the input: each new way of a step against brute force."""

import random

from pyspark.sql import functions as F

from narralith.operators import graph

from test_whole_tables import near


def links(n, m, seed=1):
    rng = random.Random(seed)
    edge = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return sorted((a, b) for a, b in edge if a != b)


def frame(spark, edge):
    return spark.createDataFrame(edge, "child long, parent long")


def test_sources_go_in_blocks(spark):
    """More sources than one block has bits, with gaps between their ids; an edge is followed once for a block."""
    edge = [(a * 1000 - 7, b * 1000 - 7) for a, b in links(600, 500)]
    df = frame(spark, edge)
    sources = graph.neighbours(df).select("a").withColumnRenamed("a", "source").distinct()
    for k in (1, 3):
        want = {(a, b, h) for a, seen in near(edge, k).items() for b, h in seen.items() if h}
        assert {tuple(r) for r in graph.within(sources, df, k).collect()} == want


def test_reachable_pairs(spark):
    edge = links(80, 60)
    three = near(edge, 3)
    pairs = [(a, b) for a in range(0, 80, 3) for b in range(80)]
    got = {(r.n1, r.n2): r.reachable for r in graph.reachable(spark.createDataFrame(pairs, "n1 long, n2 long"), frame(spark, edge), 3).collect()}
    assert got == {(a, b): a == b or b in three.get(a, {}) for a, b in pairs} and set(got.values()) == {True, False}


def test_any_reachable_asks_all_pairs(spark):
    """Answers that only the last pair of nodes gives, at every distance, and none."""
    edge = links(60, 40)
    two = near(edge, 2)
    rng = random.Random(2)
    sets = {c: {rng.randrange(60) for _ in range(rng.randrange(1, 3))} for c in range(60)}
    rows = [(c, s) for c, x in sets.items() for s in x]
    pairs = [(c, c + 1) for c in range(59)]
    got = {(r.a, r.b): r.reachable for r in graph.any_reachable(spark.createDataFrame(rows, "set long, node long"), spark.createDataFrame(pairs, "a long, b long"), frame(spark, edge), 2).collect()}
    assert got == {(a, b): any(x == y or y in two.get(x, {}) for x in sets[a] for y in sets[b]) for a, b in pairs} and set(got.values()) == {True, False}


def test_runs_end_at_a_pause_of_the_gap(spark, tmp_path):
    from narralith.plans import catalogue

    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:30:00"), (3, 1, "2024-01-01 00:59:59")]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("*", "'a' as event_type", "1.0D as value").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.stop - r.start, r.n) for r in catalogue.QUERIES["session_runs"](spark, str(tmp_path)).collect())
    assert got == [(1800, 1), (3599, 2)]


TEXTS = ["", " ", "12 - 3-4", "a12-", "12a - 7 ,8", "5 - 6 - 7 x", "عن ١٢ - 9\u00a0- 10", "x\U0001f600y 3 -", "A.B;C 1", "-", "0"]


def test_counts_of_tokens(spark, tmp_path):
    """Counts and places without making tokens, against the tokens."""
    from narralith.functions import text as T

    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    tokens = {r.id: r.w for r in df.select("id", T.tokens_of(F.col("text")).alias("w")).collect()}
    got = {r.id: tuple(r)[1:] for r in df.select("id", T.count_tokens(F.col("text")), T.count_marks(F.col("text")), F.regexp_count("text", F.lit(T.DIGITS))).collect()}
    digits = lambda w: w.isdigit() and w.isascii()
    assert got == {i: (len(w), sum(x in T.PUNCTUATION for x in w), sum(map(digits, w))) for i, w in tokens.items()}
    marks = sorted((r.id, r.tok_idx, r.word) for r in T.numbers_before(df, "text", "-", ["id"]).collect())
    assert marks == sorted((i, k, x) for i, w in tokens.items() for k, (x, y) in enumerate(zip(w, w[1:])) if digits(x) and y == "-")


def test_words_inside(spark):
    from narralith.functions import text as T
    from narralith.operators.evaluation import Words

    rows = [(t, s, e) for t in [*TEXTS, "one two (three) four/five", "\U0001f600 a b"] for s in (-1, 0, 2, 5) for e in (0, 3, 9, 40)]
    got = [r.n for r in spark.createDataFrame(rows, "t string, s long, e long").select(T.words_inside(F.col("t"), F.col("s"), F.col("e")).alias("n")).collect()]
    assert got == [Words(t, T.DELIMITERS).count(s, e) for t, s, e in rows]


def test_forms_of_pairs(spark):
    """Names and keys that repeat: each pair of different keys counts once, wherever its names come from."""
    from narralith.functions import text as T
    from narralith.operators import evaluation as V

    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(90), rng.choice(["red ring", "red bing", "ref ring", "blue bolt", "blue bold"]), rng.choice("xy")) for _ in range(120)]
    items = spark.createDataFrame(rows, "group int, key long, name string, label string")
    x, y = items.selectExpr("group", "key a", "name na", "label la"), items.selectExpr("group", "key b", "name nb", "label lb")
    pairs = x.join(y, "group").where("a < b").withColumn("equal", F.expr("la = lb")).withColumn("score", F.round(T.edit_similarity(F.col("na"), F.col("nb")), 9)).withColumn("predicted", F.expr("score > 0.75"))
    forms = V.form_pairs(items, lambda a, b: F.round(T.edit_similarity(a, b), 9)).withColumn("predicted", F.expr("score > 0.75"))
    assert V.pair_scores(forms, weight="weight").collect() == V.pair_scores(pairs).collect()
    assert sorted(V.form_errors(items, forms).collect()) == sorted(V.pair_errors(pairs).collect())
    for most in (12, 600):
        got = V.band_sample_of_forms(items, lambda a, b: F.round(T.edit_similarity(a, b), 9), 6, most)
        assert sorted(map(tuple, got.collect())) == sorted((r.a, r.b, r.band) for r in V.band_sample(pairs, 6, most).collect())


def test_nearest(spark):
    """Ties, copies, zero vectors, more queries than go at once, other lengths."""
    from narralith.functions import text as T
    from narralith.operators import names

    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-1, 2)) for _ in range(4)]) for i in range(150)] + [(150, [1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = e.where("vec_id < 40").selectExpr("vec_id query_id", "embedding q")
    all_ = e.crossJoin(q).where("vec_id <> query_id").select("query_id", "vec_id", F.round(T.cosine01(F.col("q"), F.col("embedding")), 9).alias("s")).collect()
    best = {k: sorted(((r.s, -r.vec_id) for r in all_ if r.query_id == k), reverse=True)[:5] for k in range(40)}
    got = [(r.query_id, r.vec_id, round(r.s, 9)) for r in names.nearest(e, q, 5, at_once=16).collect()]
    assert sorted(got) == sorted((k, -v, s) for k, x in best.items() for s, v in x)
