from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from narralith.operators import graph, merge, names

PAIRS = [("محمد بن يعقوب", "محمد بن يعقوب الكليني", 1.0), ("علي بن ابراهيم", "علي بن ابراهيم بن هاشم", 2 / 3), ("عماره بن القعقاع", "عماره بن القعقاع بن شبرمه", 2 / 3), ("محمد بن يعقوب", "محمد بن الحسن", 0.0), ("احمد بن محمد", "احمد بن علي", 0.0), ("خالد بن سعيد", "خالد بن سعد", 0.0), ("ابو جعفر", "ابي جعفر", 1.0), ("محمد", "محمد علي", 1.0), ("ابن ابي عمير", "محمد بن ابي عمير", 0.5)]


@pytest.mark.parametrize("a,b,want", PAIRS)
def test_distance_in_both_forms(spark, a, b, want):
    df = names.with_canonical(names.with_canonical(spark.createDataFrame([(a, b)], "a string, b string"), "a", "ca"), "b", "cb")
    r = df.select(names.distance(F.col("ca"), F.col("cb")).alias("d"), F.to_json("ca").alias("x"), F.to_json("cb").alias("y"), "ca", "cb").first()
    assert r.d == pytest.approx(want)
    assert merge.same_name(r.ca.asDict(True), r.cb.asDict(True)) == pytest.approx(want)


def test_qualifiers_and_boost(spark):
    df = names.with_canonical(names.with_canonical(spark.createDataFrame([("محمد بن علي الكوفي", "محمد بن علي البصري")], "a string, b string"), "a", "ca"), "b", "cb")
    r = df.select(names.distance(F.col("ca"), F.col("cb"), True).alias("on"), names.distance(F.col("ca"), F.col("cb")).alias("off"), names.boosted(F.lit(0.5), F.lit(1.0)).alias("up"), names.boosted(F.lit(0.0), F.lit(1.0)).alias("no")).first()
    assert (r.on, r.off, r.up, r.no) == (0.5, 1.0, 0.65, 0.0)


def test_keys(spark):
    df = names.with_canonical(spark.createDataFrame([(1, "محمد بن علي الكوفي"), (2, "ابن ابي عمير")], "id int, name string"), "name")
    got = {(r.id, r.key): r.score for r in names.with_keys(df).groupBy("id", "key").agg(F.max("score").alias("score")).collect()}
    assert got[1, "محمد-علي:الكوفي"] == max(v for (i, _), v in got.items() if i == 1)
    assert (1, "-علي") in got and (1, "محمد") in got
    assert {k for i, k in got if i == 2} == {"-AB عمير"}
    keys = df.select("id", names.primary_key(F.col("canon")).alias("k")).collect()
    assert {r.id: r.k for r in keys} == {1: "محمد-علي:الكوفي", 2: "-AB عمير"}


def occurrences(spark, chains):
    rows, k = [], 0
    for c, chain in enumerate(chains):
        for p, n in enumerate(chain):
            rows.append((k, c, p, n))
            k += 1
    return names.with_canonical(spark.createDataFrame(rows, "occ_id long, chain_id long, position int, name string").repartition(3), "name")


CHAINS = [["محمد بن يحيا", "احمد بن محمد بن عيسا", "ابي عبد الله"], ["محمد بن يحيا", "علي بن ابراهيم", "ابي عبد الله"], ["حرب بن الحسين", "ابراهيم الشيباني", "ابي الجارود"], ["محمد بن يحيا", "علي بن ابراهيم بن هاشم", "محمد بن يحيا"]]


def test_components_do_not_change_the_greedy_result(spark):
    params = merge.MergeParams(threshold=0.5)
    occ = occurrences(spark, CHAINS)
    got = {r.occ_id: r.person_id for r in merge.assign(occ, params).collect()}
    rows = [SimpleNamespace(**r.asDict(True)) for r in occ.withColumn("key", names.primary_key(F.col("canon"))).withColumn("next_canon", F.lit(None)).orderBy("occ_id").collect()]
    founders = merge.greedy(rows, params)
    dense = {f: i for i, f in enumerate(sorted(set(founders)))}
    assert got == {r.occ_id: dense[f] for r, f in zip(rows, founders)}
    # one chain never has a person twice, nobody spans more than the radius
    g = merge.assign(occ, params)
    assert g.groupBy("person_id", "chain_id").count().where("count > 1").isEmpty()
    assert merge.groups(g).where("highest - lowest > 3").isEmpty()


def test_cycle_breaking_keeps_guards(spark):
    occ = occurrences(spark, [["علي بن ابراهيم", "احمد بن خالد", "محمد بن يحيا"], ["احمد بن خالد", "علي بن ابراهيم بن هاشم", "سعد بن عمار"], ["محمد بن يحيا", "علي بن ابراهيم"]])
    found = merge.assign(occ, merge.MergeParams(threshold=0.1))
    canon = occ.select(names.primary_key(F.col("canon")).alias("key"), "canon").dropDuplicates(["key"])
    after = merge.break_cycles(found, canon, 0.1)
    assert after.count() == occ.count()
    assert after.select("person_id").distinct().count() >= found.select("person_id").distinct().count()
    # the partition only gets finer
    both = found.select("occ_id", F.col("person_id").alias("p")).join(after.select("occ_id", F.col("person_id").alias("q")), "occ_id")
    assert both.groupBy("q").agg(F.countDistinct("p").alias("n")).where("n > 1").isEmpty()


def test_small_graph(spark):
    edge = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 4)], "child long, parent long")
    one = spark.createDataFrame([(0,)], "source long")
    reach = lambda k: {r.node for r in graph.within(one, edge, k, undirected=False).collect()}
    assert reach(1) == {1, 4} and reach(2) == {1, 2, 4} and reach(3) == {1, 2, 3, 4}
    assert {r.node: r["rank"] for r in graph.ranks(edge).collect()} == {3: 0, 4: 0, 2: 1, 1: 2, 0: 3}
    ring = edge.union(spark.createDataFrame([(3, 1), (9, 0)], "child long, parent long"))
    assert {(r.child, r.parent) for r in graph.cyclic_core(ring).collect()} == {(1, 2), (2, 3), (3, 1)}
    assert set(graph.ranks(ring).toPandas()["node"]) == {4}
    assert graph.violations(edge, graph.ranks(edge)).isEmpty()


def test_known_names(spark):
    from narralith.operators import names as N

    make = lambda rows, key: N.with_canonical(spark.createDataFrame(rows, f"{key} long, name string"), "name").select(key, "canon")
    persons = make([(1, "محمد بن يحيا"), (2, "احمد بن محمد بن عيسا")], "person_id")
    asked = make([(10, "محمد بن يحيا"), (11, "احمد بن محمد"), (12, "زياد بن مروان")], "mention_id")
    assert sorted(r.mention_id for r in N.known(asked, persons, 0.5).collect()) == [10, 11]
