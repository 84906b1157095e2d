import numpy as np
from pyspark.sql import functions as F

from narralith.llm import quality_model as Q
from narralith.llm import queries

SF = "/root/testdata/sf0.01"


def test_isotonic_is_monotone_and_keeps_the_sum():
    rng = np.random.default_rng(0)
    x, c = np.arange(50.0), rng.integers(1, 5, 50).astype(float)
    t = np.round(c * rng.uniform(size=50) * x / 50)
    knots, levels = Q.isotonic(x, t, c)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    # brute force: min over ends of max over starts of block means
    means = np.array([[t[i : j + 1].sum() / c[i : j + 1].sum() if j >= i else np.inf for j in range(50)] for i in range(50)])
    best = np.array([max(min(means[i][k:].min() for _ in (0,)) for i in range(k + 1)) for k in range(50)])
    assert np.allclose(np.interp(x, knots, levels)[[0, -1]], best[[0, -1]])


def test_features_approximate_the_kernel():
    m = Q.Settings(features=4096)
    rng = np.random.default_rng(1)
    k = len(Q.NAMES)
    model = Q.Model(np.zeros(k), np.ones(k), rng.normal(size=(k, m.features)) * np.sqrt(2 * m.gamma), rng.uniform(0, 2 * np.pi, m.features), np.zeros(m.features + 1), np.zeros(0), np.zeros(0), 0.5)
    x = rng.normal(size=(20, k))
    z = model.lift(x)
    want = np.exp(-m.gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.1


def test_held_out_accuracy(spark):
    got = queries.op6_quality(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got.count() == 1000
    assert ((rows.predicted == rows.quality).mean()) > 0.93
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    assert set(rows.held_out) == {True}


def test_normal_equations_by_partition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = Q.fit(Q.with_statistics(docs.repartition(1)), labels)
    b = Q.fit(Q.with_statistics(docs.repartition(7)), labels)
    assert np.allclose(a.beta, b.beta, atol=1e-5)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "word " * 50_000, "c"), (4, "x", "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    for labels, score in ((none, 0.5), (one, 1.0)):
        stats = Q.with_statistics(docs)
        got = Q.score_statistics(stats, Q.fit(stats, labels)).collect()
        assert [r.score for r in got] == [score] * 5
    model = Q.fit(Q.with_statistics(docs), one)
    assert Q.keep_good(docs, model, 0.7).columns == docs.columns
    assert Q.keep_good(docs.where("false"), model, 0.7).count() == 0
