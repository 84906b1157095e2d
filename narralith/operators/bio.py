"""Biography entries: where prose names a person together with the person's neighbours in the graph."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narralith.operators.joins import overlaps


@dataclass(frozen=True)
class EntryParams:
    near: int = 100
    threshold: float = 5.0
    most: int = 3
    k: int = 1


def positions(mentions: DataFrame) -> DataFrame:
    """(book_id, person_id, idx): mentions by the persons they may be."""
    return mentions.select("book_id", F.explode("matches").alias("person_id"), "idx")


def subjects(mentions: DataFrame) -> DataFrame:
    """Persons in the order of their first mention; names whose first name is unknown do not count."""
    return mentions.where(~F.col("key").startswith("-")).select("book_id", F.explode("matches").alias("person_id"), "idx").groupBy("book_id", "person_id").agg(F.min("idx").alias("first_idx"))


def are_near(a_start, a_end, b_start, b_end, near):
    return (F.abs(a_end - b_start) < near) | (F.abs(a_start - b_end) < near)


def narrowed(mentions: DataFrame, reach: DataFrame) -> DataFrame:
    """Of ambiguous mentions keep the persons within reach of the mention before, where any is.

    ``reach`` is (a, b), both ways and with each node itself. A recurrence along the book, so a fold per
    book; only the pairs of persons that the book's ambiguous mentions ask about travel with it.
    """
    asked = mentions.where(F.size("matches") > 0).withColumn("before", F.lag("matches").over(W.partitionBy("book_id").orderBy("idx")))
    pairs = asked.where((F.size("matches") > 1) & F.col("before").isNotNull()).select("book_id", "idx", F.explode("matches").alias("a"), "before").select("book_id", "idx", "a", F.explode("before").alias("b"))
    known = pairs.join(reach, ["a", "b"], "left_semi").groupBy("book_id", "idx").agg(F.collect_set(F.struct("a", "b")).alias("links"))
    rows = mentions.join(known, ["book_id", "idx"], "left").select("book_id", "idx", "matches", "links")

    def run(frames):
        book, before = None, []
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.book_id != book:
                    book, before = r.book_id, []
                now = [int(m) for m in r.matches]
                if len(now) > 1 and before:
                    links = {(x["a"], x["b"]) for x in r.links} if r.links is not None else set()
                    kept = [m for m in now if any(m == b or (m, b) in links for b in before)]
                    now = kept or now
                if now:
                    before = now
                out.append((r.book_id, r.idx, now))
            yield pd.DataFrame(out, columns=["book_id", "idx", "resolved"])

    kind = mentions.schema["book_id"].dataType.simpleString()
    done = rows.repartition("book_id").sortWithinPartitions("book_id", "idx").mapInPandas(run, f"book_id {kind}, idx bigint, resolved array<bigint>")
    return mentions.drop("matches").join(done.withColumnRenamed("resolved", "matches"), ["book_id", "idx"])


def candidates(mentions: DataFrame, neighbours: DataFrame, params: EntryParams = EntryParams()) -> DataFrame:
    """(book_id, person_id, center, start, end, score, idxs, rank): entries around each mention of a person.

    For every neighbour, in order of id, the closest mention at or after the centre, else the one before,
    counts when it is near and not yet claimed. The two closest come from windows over the positions of
    a neighbour; only the claims are settled in a fold per centre, over as many rows as there are neighbours.
    """
    pos = positions(mentions)
    centers = pos.withColumnRenamed("idx", "center").join(neighbours.select(F.col("source").alias("person_id"), F.col("node").alias("neighbour")), "person_id")
    probes = centers.select("book_id", F.col("neighbour").alias("n"), F.col("center").alias("at"), "person_id")
    from narralith.operators.joins import asof

    marks = pos.select("book_id", F.col("person_id").alias("n"), F.col("idx").alias("at"), F.col("idx").alias("i"))
    near = asof(asof(probes, marks, ["book_id", "n"], "at", ["i"], forward=True, prefix="f_").drop("f_at"), marks, ["book_id", "n"], "at", ["i"], strict=True, prefix="b_")
    place = mentions.select("book_id", F.col("idx"), "start", "end")
    for c in ("f", "b"):
        near = near.join(place.select("book_id", F.col("idx").alias(f"{c}_i"), F.col("start").alias(f"{c}_s"), F.col("end").alias(f"{c}_e")), ["book_id", f"{c}_i"], "left")
    near = near.join(place.select("book_id", F.col("idx").alias("at"), F.col("start").alias("c_s"), F.col("end").alias("c_e")), ["book_id", "at"])
    option = lambda c: F.when(are_near(F.col("c_s"), F.col("c_e"), F.col(f"{c}_s"), F.col(f"{c}_e"), params.near), F.struct(F.col(f"{c}_i").alias("i"), F.col(f"{c}_s").alias("s"), F.col(f"{c}_e").alias("e")))
    rows = near.select("book_id", "person_id", "at", "n", "c_s", "c_e", option("f").alias("f"), option("b").alias("b"))
    listed = rows.groupBy("book_id", "person_id", "at", "c_s", "c_e").agg(F.array_sort(F.collect_list(F.struct("n", "f", "b"))).alias("o"))
    start = F.struct(F.array(F.struct(F.col("at").alias("i"), F.col("c_s").alias("s"), F.col("c_e").alias("e"))).alias("taken"))
    free = lambda a, x: x.isNotNull() & ~F.exists(a["taken"], lambda t: t["i"] == x["i"])
    add = lambda a, x: F.struct(F.concat(a["taken"], F.array(x)).alias("taken"))
    taken = F.aggregate("o", start, lambda a, x: F.when(free(a, x["f"]), add(a, x["f"])).when(free(a, x["b"]), add(a, x["b"])).otherwise(a))["taken"]
    done = listed.withColumn("taken", taken).withColumn("score", F.size("taken") - 1).where(F.col("score") >= params.threshold)
    done = done.select("book_id", "person_id", F.col("at").alias("center"), F.array_min(F.transform("taken", lambda t: t["s"])).alias("start"), F.array_max(F.transform("taken", lambda t: t["e"])).alias("end"), "score", F.array_sort(F.transform("taken", lambda t: t["i"])).alias("idxs"))
    rank = F.row_number().over(W.partitionBy("book_id", "person_id").orderBy(F.desc("score"), "center"))
    return done.withColumn("rank", rank).where(F.col("rank") <= params.most)


def entries(found: DataFrame) -> DataFrame:
    """Best candidates, best first, that do not overlap one taken before: a greedy fold per book."""

    def run(frames):
        book, starts, ends = None, [], []
        for f in frames:
            keep = []
            for r in f.itertuples(index=False):
                if r.book_id != book:
                    book, starts, ends = r.book_id, [], []
                k = bisect_left(starts, r.start)
                clash = (k < len(starts) and starts[k] <= r.end) or (k > 0 and ends[k - 1] >= r.start)
                if not clash:
                    starts.insert(k, r.start)
                    ends.insert(k, r.end)
                keep.append(not clash)
            yield f[keep]

    best = found.where("rank = 1").repartition("book_id").sortWithinPartitions("book_id", F.desc("score"), "start", "person_id")
    return best.mapInPandas(run, best.schema)


def hits(annotations: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row: persons with gold, annotated, hit within the first k, and the two ratios."""
    first = annotations.where(F.col("rank") <= k)
    hit = gold.join(first, "person_id").where(overlaps(F.col("start"), F.col("end"), F.col("gold_start"), F.col("gold_end"))).select("person_id").distinct().withColumn("hit", F.lit(1))
    known = gold.select("person_id").distinct().withColumn("gold", F.lit(1)).join(annotations.select("person_id").distinct().withColumn("found", F.lit(1)), "person_id", "full").join(hit, "person_id", "left")
    n = known.agg(F.count("gold").alias("gold"), F.count("found").alias("annotated"), F.count("hit").alias("hits"))
    return n.select("*", F.try_divide(F.col("hits"), F.col("gold")).alias("recall"), F.try_divide(F.col("hits"), F.col("annotated")).alias("precision"))


def detector_statistics(mentions: DataFrame, found: DataFrame) -> DataFrame:
    """One row: mentions, matched and ambiguous ones, and entries with their persons and scores."""
    size = F.coalesce(F.size("matches"), F.lit(0))
    read = mentions.agg(F.count("*").alias("mentions"), F.count_if(size > 0).alias("matched"), F.count_if(size > 1).alias("ambiguous"))
    made = found.agg(F.count("*").alias("entries"), F.countDistinct("person_id").alias("persons"), F.max("score").alias("best_score"), F.avg("score").alias("mean_score"))
    return read.crossJoin(F.broadcast(made))  # one row each


def annotation_statistics(annotations: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: persons asked for (person_id), annotated ones, their annotations and the mean for each."""
    n = annotations.groupBy("person_id").agg(F.count("*").alias("n"))
    rows = asked.select("person_id").distinct().join(n, "person_id", "left")
    return rows.agg(F.count("*").alias("persons"), F.count("n").alias("annotated"), F.coalesce(F.sum("n"), F.lit(0)).alias("annotations"), F.avg("n").alias("mean"))


def as_items(found: DataFrame, mentions: DataFrame) -> DataFrame:
    """(book_id, s, e, names): entries with the spans of the mentions they are made of, as two-level items."""
    spans = mentions.select("book_id", F.col("idx").alias("i"), F.col("start").alias("ms"), F.col("end").alias("me"))
    rows = found.select("book_id", "person_id", "center", F.col("start").alias("s"), F.col("end").alias("e"), F.explode("idxs").alias("i")).join(spans, ["book_id", "i"])
    return rows.groupBy("book_id", "person_id", "center", "s", "e").agg(F.array_sort(F.collect_list(F.struct(F.col("ms").alias("s"), F.col("me").alias("e")))).alias("names")).select("book_id", "s", "e", "names")
