from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from narralith.operators import automata, bio, segment, tokens
from narralith.operators import evaluation as V
from narralith.functions import text as T

FLAGS = ["is_name", "is_nrc", "is_nmc", "is_ibn", "is_ab", "is_om", "is_rasoul", "is_relative", "is_punct", "is_number", "has_waw", "matn_start"]
KINDS = {"n": ["is_name"], "nrc": ["is_nrc"], "ibn": ["is_nmc", "is_ibn"], "ab": ["is_nmc", "is_ab"], "ras": ["is_rasoul"], "p": ["is_punct"], "num": ["is_number"], "rel": ["is_relative"], "w": []}


def stream(*pairs):
    out, at = [], 0
    for i, (word, kind) in enumerate(pairs):
        out.append(SimpleNamespace(tok_idx=i, word=word, start=at, end=at + len(word), pos=None, **{f: f in KINDS[kind] for f in FLAGS}))
        at += len(word) + 1
    return out


def names_of(found):
    return [[n.text for n in c[0]] for c in found.out]


def test_chain_ends_at_the_imam():
    t = stream(("حدثنا", "nrc"), ("محمد", "n"), ("بن", "ibn"), ("يحيا", "n"), ("عن", "nrc"), ("احمد", "n"), ("عن", "nrc"), ("جعفر", "n"), ("عليه", "ras"), ("السلام", "ras"), ("قال", "nrc"), ("كلام", "w"))
    found = automata.Automaton(automata.ChainParams()).run(t)
    assert names_of(found) == [["محمد بن يحيا", "احمد", "جعفر"]]
    assert found.out[0][3] == "rasoul" and found.out[0][2] == t[10].start


def test_one_chain_per_number():
    t = stream(("1", "num"), ("عن", "nrc"), ("زيد", "n"), ("النبي", "ras"), ("كلام", "w"), ("عن", "nrc"), ("عمرو", "n"), (".", "p"), ("2", "num"), ("عن", "nrc"), ("بكر", "n"))
    assert names_of(automata.Automaton(automata.ChainParams()).run(t)) == [["زيد", "النبي"], ["بكر"]]
    assert names_of(automata.Automaton(automata.ChainParams.plain()).run(t)) == [["زيد", "النبي"], ["عمرو"], ["بكر"]]


def test_overflow_between_narrators():
    t = stream(("عن", "nrc"), ("زيد", "n"), ("عن", "nrc"), *[("كلمة", "w")] * 6)
    found = automata.Automaton(automata.ChainParams())
    assert names_of(found.run(t)) == [["زيد"]] and found.out[0][3] == "overflow"


def test_confirmation_renews_the_budget():
    t = stream(*[x for i in range(4) for x in (("عن", "nrc"), (f"n{i}", "n"), *[("عن", "nrc")] * 3)])
    params = automata.ChainParams(name_slack=1, link_slack=6, least=1)
    none = automata.Automaton(params, None, prose=True).run(t)
    all_ = automata.Automaton(params, lambda n: [1], prose=True).run(t)
    assert none.broken > 0 and all_.broken == 0
    assert len(all_.mentions) == len(none.mentions) == 4


BOOK = "1 - حدثنا محمد بن يحيا عن احمد بن محمد بن عيسا عن ابن ابي عمير عن ابي عبد الله عليه السلام قال: الحمد لله رب العالمين . كتاب العقل 2 - حدثنا محمد بن يحيا عن احمد بن محمد عن ابي عبد الله عليه السلام قال: طلب العلم . "


def test_records_and_partition_invariance(spark):
    one = segment.records(spark.createDataFrame([("a", BOOK)], "book_id string, raw string")).orderBy("sanad_start").collect()
    assert [r.number for r in one] == [1, 2] and [r.kitab for r in one] == ["", one[1].kitab] and one[1].kitab.startswith("كتاب العقل")
    assert [n.name for n in one[0].narrators] == ["محمد بن يحيا", "احمد بن محمد بن عيسا", "ابن ابي عمير", "ابي عبد الله"]
    assert one[0].matn.startswith("قال")
    # numbered segments run apart from each other: the same as one automaton over the whole book
    clean = spark.createDataFrame([("a", BOOK)], "book_id string, raw string").select("book_id", T.normalize(F.col("raw")).alias("clean"))
    marked = tokens.with_segments(tokens.analyzed(clean, ["book_id"]), ["book_id"])
    apart = automata.chains(marked).orderBy("sanad_start").collect()
    whole = automata.Automaton(automata.ChainParams()).run(marked.orderBy("tok_idx").toPandas().itertuples()).out
    assert [(r.sanad_start, r.sanad_end, r.ended_by, [n.name for n in r.narrators]) for r in apart] == [(c[1], c[2], c[3], [n.text for n in c[0]]) for c in whole]


def test_promotion_runs_along_nisbas(spark):
    rows = [(0, "عن", True, False, False), (1, "الكوفي", False, True, False), (2, "الاشعري", False, True, False), (3, "كتاب", False, True, False)]
    df = spark.createDataFrame(rows, "tok_idx int, word string, is_nrc boolean, is_name_candidate boolean, is_nmc boolean").withColumn("b", F.lit(1))
    for c in ("is_name", "is_punct", "is_number", "has_enclitic"):
        df = df.withColumn(c, F.lit(False))
    assert [r.is_name for r in tokens.promote_candidates(df, ["b"]).orderBy("tok_idx").collect()] == [False, True, True, False]


def mentions(spark, persons):
    rows = [("b", i, 10 * i, 10 * i + 5, [p] if isinstance(p, int) else p, f"k{p}") for i, p in enumerate(persons)]
    return spark.createDataFrame(rows, "book_id string, idx long, start int, end int, matches array<bigint>, key string")


def test_entries(spark):
    near = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 1), (4, 5), (4, 6), (5, 4), (6, 4)], "source long, node long")
    found = bio.candidates(mentions(spark, [1, 2, 3, 9, 4, 5, 6]), near, bio.EntryParams(near=60, threshold=2))
    got = sorted((r.person_id, r.start, r.end, r.score) for r in bio.entries(found).collect())
    assert got == [(1, 0, 25, 2), (4, 40, 65, 2)]


def test_sequential_narrowing(spark):
    reach = spark.createDataFrame([(1, 2), (2, 1)], "a long, b long")
    got = bio.narrowed(mentions(spark, [[1], [2, 5], [7, 8]]), reach).orderBy("idx").collect()
    assert [r.matches for r in got] == [[1], [2], [7, 8]]


def test_two_level_pinned(spark):
    text = "محمد بن يحيا عن احمد بن محمد عن الحسن بن محبوب عن ابي جعفر"
    gold, predicted = [((0, 60), [(0, 11), (16, 27), (32, 45)])], [((0, 60), [(0, 11), (16, 20)])]
    s = V.two_level(text, gold, predicted, T.DELIMITERS)
    assert round(s["detection"][0] / s["detection"][2], 4) == 0.6667
    assert round(s["boundary_min"][0] / s["boundary_min"][2], 4) == 0.4444 and s["boundary_min"][2] == 9
    one = V.two_level(text, [((0, 60), [(0, 11)])], [((0, 60), [(0, 5), (6, 11)])], T.DELIMITERS)
    assert (one["boundary_max"][2], one["boundary_min"][2]) == (3, 6)


def test_one_to_one():
    assert V.one_to_one([(0, 5), (4, 9)], [(3, 6)]) == (1, 2)


@pytest.mark.parametrize("detected,recall", [(True, 1.0), (False, (1 / 2 + 1 / 2 + 0 + 1 + 1 + 1) / 6)])
def test_clusters(spark, detected, recall):
    gold = spark.createDataFrame(list(zip("abcdef", ["P1"] * 3 + ["P2"] * 2 + ["P3"])), "item string, label string")
    pred = spark.createDataFrame([("a", "x"), ("b", "x"), ("d", "y"), ("e", "y"), ("f", "z")], "item string, label string")
    assert V.cluster_agreement(gold, pred, detected).first().recall == pytest.approx(recall)


def test_every_row_of_the_table_names_known_things():
    states = set(automata.TABLE)
    run = automata.Automaton(automata.ChainParams())
    for rows in automata.TABLE.values():
        for _, actions, to, _ in rows:
            assert to in states
            for a in actions:
                assert a.rstrip("+").split("=")[0] in run.registers or hasattr(run, "act_" + a.split(":")[0])


def test_reader_statistics(spark):
    t = stream(*[x for i in range(4) for x in (("عن", "nrc"), (f"n{i}", "n"), *[("عن", "nrc")] * 3)])
    df = spark.createDataFrame([{"book_id": b, **{**vars(x), "pos": "noun"}} for b in "ab" for x in t])
    params = automata.ChainParams(name_slack=1, link_slack=6, least=1)
    got = {r.book_id: r for r in automata.reader_statistics(df, params=params, confirm=lambda n: [1] if n.text != "n0" else []).collect()}
    alone = automata.Automaton(params, lambda n: [1] if n.text != "n0" else [], prose=True).run(t)
    assert tuple(got["a"])[1:] == tuple(got["b"])[1:] == (20, 4, 3, 3, alone.broken)


def test_counters_and_items(spark):
    recs = segment.records(spark.createDataFrame([("a", BOOK)], "book_id string, raw string"))
    s = segment.statistics(recs, 3).first()
    assert (s.records, s.numbered, s.with_kitab, s.with_bab, s.without_matn, s.longest, s.chains_found) == (2, 2, 1, 0, 0, 4, 3) and s.narrators >= 7
    near = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 1)], "source long, node long")
    read = mentions(spark, [1, 2, 3, [7, 8], []])
    found = bio.entries(bio.candidates(read, near, bio.EntryParams(near=60, threshold=2)))
    d = bio.detector_statistics(read, found).first()
    assert (d.mentions, d.matched, d.ambiguous, d.entries, d.persons, d.best_score) == (5, 4, 1, 1, 1, 2)
    a = bio.annotation_statistics(found, spark.createDataFrame([(1,), (9,)], "person_id long")).first()
    assert (a.persons, a.annotated, a.annotations, a["mean"]) == (2, 1, 1, 1.0)
    item = bio.as_items(found, read).first()
    assert (item.s, item.e, [tuple(n) for n in item.names]) == (0, 25, [(0, 5), (10, 15), (20, 25)])
