import corpus_pipeline as P
from narralith.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        now = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(now) and now.keys() <= seen.keys()
        gone = seen.keys() - now.keys()
        if name.startswith("quality"):
            # clean documents stay, but for the few that are too short for the base rules
            lost = [i for i in gone if quality.get(i) == 1 and len(seen[i].split()) >= 50]
            assert len(lost) <= 2
            assert all(now[i] == seen[i] for i in now)
        if name == "quality classifier":
            assert sum(quality.get(i) == 0 for i in now) <= 2
        if name == "n-gram Jaccard join":
            found = {r.id: r.component for r in P.ngram_join.join_components(docs, P.ngram_join.Settings(words=5, percent=80)).collect()}
            assert now.keys() == {i for i, c in found.items() if i == c}
        if name == "suffix-array dedup":
            again = {r.doc_id: r.n_removed for r in P.suffix_dedup.remove_repeats(docs).collect()}
            assert all((len(now[i].encode()) == len(seen[i].encode()) - again[i]) or "�" not in now[i] for i in now)
        docs, seen = spark.createDataFrame(rows, docs.schema), now
    bins = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {i for b in bins for i in b.doc_ids} == set(seen)
    assert sum(b.n_tokens for b in bins) == sum(len(t.split()) for t in seen.values())


def test_run_is_the_stages(spark):
    assert P.run(spark, SF).count() > 0
    assert P.ORACLE_SQL is None
    assert set(queries.QUERIES) == {f"op{k}_{n}" for k, n in enumerate(("packing", "bpe", "rules", "html", "suffix_dedup", "quality", "chaining", "fingerprint", "ngram_join", "chat"), 1)}


def test_repeated_rows_and_rows_without_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400).collect()
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r for r in docs if labels.get(r.doc_id) == 1 and len(r.text.split()) >= 80]
    df = spark.createDataFrame(good, schema)
    alone = [r.asDict() for r in P.unrepeated(spark, P.distinct(spark, P.ruled(spark, df, SF), SF), SF).orderBy("doc_id").collect()][:12]
    row = lambda r, **k: {**r, **k}
    rows = [*alone, *alone[:4], *alone[:2]]  # repeated under one id
    rows += [row(r, doc_id=None) for r in alone[2:6]]  # copies without id
    mixed = [r["text"] + " " + s["text"] for r, s in zip(alone[6:8], alone[8:10])]
    bare = [row(alone[0], doc_id=None, text=" ".join(reversed(x.split()))) for x in mixed]
    rows += bare * 3  # texts that only rows without id have
    rows += [row(alone[0], text="too short"), row(alone[0], doc_id=None, text="short too")]
    given = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)
    want = sorted([(str(r["doc_id"]), r["text"]) for r in alone] + [("None", r["text"]) for r in bare])
    kept = P.ruled(spark, given, SF)
    passed = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert {r[1] for r in passed}.isdisjoint({"too short", "short too"}) and {t for _, t in want[:-2]} & {t for _, t in passed}
    one = P.distinct(spark, kept, SF)
    assert sorted((str(r.doc_id), r.text) for r in one.collect()) == [r for r in want if r in passed] and len(one.collect()) >= 10
    assert all(r.text for r in P.unrepeated(spark, one, SF).collect())
