"""Scores of predictions against gold: weighted agreement, clusters, pairs, span sweeps, validation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weighted(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall, precision and F of (common, correct, detected), each row weighted by what is correct."""
    rows = rows.where("correct > 0")
    share = F.coalesce(F.try_divide(F.col("common"), F.col("detected")), F.lit(0.0)) * F.col("correct")
    n = rows.groupBy(*(by or [])).agg(F.sum("common").alias("c"), F.sum(share).alias("p"), F.sum("correct").alias("units"))
    r, p = F.coalesce(F.col("c") / F.col("units"), F.lit(0.0)), F.coalesce(F.col("p") / F.col("units"), F.lit(0.0))
    return n.select(*(by or []), r.alias("recall"), p.alias("precision"), F.coalesce(F.try_divide(2 * r * p, r + p), F.lit(0.0)).alias("f_score"), F.coalesce("units", F.lit(0)).cast("long").alias("units"))


def cluster_agreement(gold: DataFrame, predicted: DataFrame, detected_only: bool = True) -> DataFrame:
    """Mean share of companions kept per item of (item, label) tables; items alone count 1.

    Without ``detected_only`` an item that was not predicted is a cluster of its own. Sizes are counted
    with one aggregate per grouping and joined back, so that a huge cluster is not one task's work.
    """
    both = gold.select("item", F.col("label").alias("g")).join(predicted.select("item", F.col("label").alias("p")), "item", "inner" if detected_only else "left")
    both = both.withColumn("p", F.coalesce(F.concat(F.lit("p"), F.col("p").cast("string")), F.concat(F.lit("alone"), F.col("item").cast("string"))))
    cell = both.groupBy("g", "p").agg(F.count("*").alias("n"))
    cell = cell.withColumn("ng", F.sum("n").over(W.partitionBy("g"))).withColumn("np", F.sum("n").over(W.partitionBy("p")))
    kept = lambda size: F.when(F.col(size) == 1, 1.0).otherwise((F.col("n") - 1) / F.nullif(F.col(size) - 1, F.lit(0)))
    total = F.sum("n")
    r, p = F.sum(kept("ng") * F.col("n")) / total, F.sum(kept("np") * F.col("n")) / total
    return cell.agg(total.alias("items"), r.alias("recall"), p.alias("precision")).select("*", F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")).alias("f_score"))


def pair_scores(pairs: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Counts, recall, precision and F of (equal, predicted); pairs without a label do not count. A row counts ``weight`` times."""
    count = (lambda c: F.coalesce(F.sum(F.when(c, F.col(weight))), F.lit(0)).cast("long")) if weight else F.count_if
    n = pairs.where("equal is not null").groupBy(*(by or [])).agg(*[count(c).alias(a) for a, c in (("tp", F.col("equal") & F.col("predicted")), ("fp", ~F.col("equal") & F.col("predicted")), ("fn", F.col("equal") & ~F.col("predicted")), ("tn", ~F.col("equal") & ~F.col("predicted")))])
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    n = n.withColumn("recall", ratio("tp", "fn")).withColumn("precision", ratio("tp", "fp"))
    return n.withColumn("f_score", F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0)))


def pair_errors(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, equal, predicted) that were judged wrongly, ``kind`` false or missed."""
    return pairs.where("equal <> predicted").select("a", "b", F.when(F.col("equal"), "missed").otherwise("false").alias("kind"))


def occurrence_labels(occurrences: DataFrame, chain: str, position: str, person: str) -> DataFrame:
    """(item, label): each occurrence as ``chain#position`` with the person it was given to."""
    return occurrences.select(F.concat_ws("#", F.col(chain).cast("string"), F.col(position).cast("string")).alias("item"), F.col(person).alias("label"))


def sweep(scored: DataFrame, thresholds: list[float], weight: str | None = None) -> DataFrame:
    """:func:`pair_scores` of (equal, score) at each threshold."""
    rows = scored.select("equal", "score", *([weight] if weight else []), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return pair_scores(rows.withColumn("predicted", F.col("score") > F.col("threshold")), ["threshold"], weight)


def _forms(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by, "name", "label").agg(F.count("*").alias("n"))


def form_pairs(items: DataFrame, score) -> DataFrame:
    """(group, na, la, nb, lb, equal, score, weight): pairs of the forms (name, label) of a group; ``weight`` pairs of items have them.

    Pairs of items (group, key, name, label) of one group with different keys are meant, each once; what depends on
    name and label only is worked out once for all items that share these. Items that share a key are taken off by
    rows of a negative weight.
    """
    shared = items.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    whole, twice = _forms(items, ["group"]).withColumn("key", F.lit(None).cast(items.schema["key"].dataType)).withColumn("sign", F.lit(1)), _forms(items.join(shared, "key", "left_semi"), ["group", "key"]).withColumn("sign", F.lit(-1))
    forms = whole.unionByName(twice).withColumn("form", F.struct("name", "label"))
    side = lambda x: forms.select("group", "key", "sign", F.col("form").alias(f"f{x}"), F.col("n").alias(f"n{x}"))
    a, b = side("a"), side("b").withColumnRenamed("key", "other").withColumnRenamed("sign", "sign_b")
    both = a.join(b, (a["group"] == b["group"]) & (a.sign == b.sign_b) & F.col("key").eqNullSafe(F.col("other"))).where("fa <= fb").drop(b["group"])
    weight = F.col("sign") * F.when(F.col("fa") == F.col("fb"), F.expr("na * (na - 1) div 2")).otherwise(F.expr("na * nb"))
    both = both.select("group", "fa", "fb", weight.cast("long").alias("weight")).where("weight <> 0")
    names = both.select("group", F.col("fa.name").alias("na"), F.col("fa.label").alias("la"), F.col("fb.name").alias("nb"), F.col("fb.label").alias("lb"), "weight")
    return names.withColumn("equal", F.col("la") == F.col("lb")).withColumn("score", score(F.col("na"), F.col("nb")))


def form_errors(items: DataFrame, judged: DataFrame) -> DataFrame:
    """:func:`pair_errors` of the items of judged :func:`form_pairs`; only pairs that were judged wrongly become rows."""
    wrong = judged.where("equal <> predicted and weight > 0").select("group", "na", "la", "nb", "lb", F.when(F.col("equal"), "missed").otherwise("false").alias("kind"))
    x = items.select("group", F.col("key").alias("x"), F.col("name").alias("na"), F.col("label").alias("la"))
    y = items.select("group", F.col("key").alias("y"), F.col("name").alias("nb"), F.col("label").alias("lb"))
    pairs = wrong.join(x, ["group", "na", "la"]).join(y, ["group", "nb", "lb"]).where("x <> y and not (na = nb and la = lb and x > y)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "kind")


def band_sample_of_forms(items: DataFrame, score, bands: int, most: int) -> DataFrame:
    """:func:`band_sample` of all pairs of items (group, key, name, label) with a < b, without making them.

    The pairs of each key and band are counted by the forms of its group; running sums over the keys tell which keys
    have the pairs to take, and only theirs are made.
    """
    from narralith.operators.graph import cut

    items = cut(items.select("group", "key", "name"))
    per = max(1, most // bands)
    band = F.when((F.col("score") < 1) & (F.col("score") >= 0), F.floor(F.col("score") * bands).cast("int"))
    forms = items.select("group", "name").distinct()
    a, b = forms.select(F.col("group"), F.col("name").alias("na")), forms.select(F.col("group").alias("g2"), F.col("name").alias("nb"))
    known = a.join(b, F.col("group") == F.col("g2")).select("group", "na", "nb", score(F.col("na"), F.col("nb")).alias("score"))
    known = cut(known.select("group", "na", "nb", band.alias("band")).where("band is not null"))

    def count(rows, pairs):
        group = rows.sort_values("key", ascending=False)
        names = {n: i for i, n in enumerate(dict.fromkeys(group["name"]))}
        of = np.full((len(names), len(names)), bands, np.int8)
        at = pairs["na"].map(names), pairs["nb"].map(names)
        of[at[0].to_numpy(np.int64), at[1].to_numpy(np.int64)] = pairs["band"]
        after, out = np.zeros(len(names)), np.zeros((len(group), bands), np.int64)
        form, keys = group["name"].map(names).to_numpy(np.int64), group["key"].to_numpy()
        new = np.append(True, keys[1:] != keys[:-1])
        first = 0
        for i in range(len(keys)):
            if new[i]:  # items of the key before come after this one, those of its own key do not
                np.add.at(after, form[first:i], 1)
                first = i
            out[i] = np.bincount(of[form[i]], after, bands + 1)[:bands]
        i, k = np.nonzero(out)
        return pd.DataFrame({"a": keys[i], "band": k.astype(np.int32), "c": out[i, k]})

    kind = f"a {items.schema['key'].dataType.simpleString()}, band int, c long"
    named = items.where("name is not null")
    counts = named.groupBy("group").cogroup(known.groupBy("group")).applyInPandas(count, kind).groupBy("a", "band").agg(F.sum("c").alias("c"))
    ranged = cut(counts.repartitionByRange("a").withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy("__part", "band").agg(F.sum("c").alias("in_part"))
    w = W.partitionBy("band")  # a row for each partition and band
    parts = parts.select("__part", "band", (F.sum("in_part").over(w.orderBy("__part")) - F.col("in_part")).alias("start"), F.sum("in_part").over(w).alias("all"))
    placed = ranged.join(F.broadcast(parts), ["__part", "band"]).withColumn("before", F.col("start") + F.sum("c").over(W.partitionBy("__part", "band").orderBy("a")) - F.col("c"))
    placed = placed.withColumn("stride", F.greatest(F.lit(1), F.floor(F.col("all") / per)))
    some = cut(placed.where(F.least(F.floor((F.col("before") + F.col("c") - 1) / F.col("stride")), F.lit(per - 1)) >= F.ceil(F.col("before") / F.col("stride"))).select("a", "band", "before", "stride"))
    x = items.select("group", F.col("key").alias("a"), F.col("name").alias("na")).join(some.select("a").distinct(), "a", "left_semi")
    made = x.join(items.select("group", F.col("key").alias("b"), F.col("name").alias("nb")), "group").where("a < b").select("a", "b", score(F.col("na"), F.col("nb")).alias("score"))
    ranked = made.withColumn("band", band).join(some, ["a", "band"]).withColumn("n", F.col("before") + F.row_number().over(W.partitionBy("a", "band").orderBy("b")) - 1)
    return ranked.where((F.col("n") % F.col("stride") == 0) & (F.floor(F.col("n") / F.col("stride")) < per)).select("a", "b", "band")


def band_sample(scored: DataFrame, bands: int, most: int) -> DataFrame:
    """At most ``most`` pairs spread over score bands [i / bands, (i + 1) / bands); a score of 1 is in none."""
    b = scored.where("score < 1 and score >= 0").withColumn("band", F.floor(F.col("score") * bands).cast("int"))
    per = max(1, most // bands)
    size = b.groupBy("band").agg(F.count("*").alias("c"))
    ranked = b.withColumn("n", F.row_number().over(W.partitionBy("band").orderBy("a", "b")) - 1).join(F.broadcast(size), "band")
    stride = F.greatest(F.lit(1), F.floor(F.col("c") / per))
    return ranked.where((F.col("n") % stride == 0) & (F.floor(F.col("n") / stride) < per)).drop("n", "c")


def one_to_one(gold: list, predicted: list, equal: Callable | None = None) -> tuple[int, int]:
    """Gold names that claim a predicted one of their own, in order, and gold names with any equal one."""
    equal = equal or (lambda a, b: a[0] <= b[1] and b[0] <= a[1])
    free, own, some = list(predicted), 0, 0
    for g in gold:
        some += any(equal(g, p) for p in predicted)
        mine = next((k for k, p in enumerate(free) if equal(g, p)), None)
        if mine is not None:
            del free[mine]
            own += 1
    return own, some


class Words:
    """Counts words between offsets of a text."""

    def __init__(self, text: str, delimiters: str):
        gap = set(delimiters)
        self.starts = [i for i, c in enumerate(text) if c not in gap and (not i or text[i - 1] in gap)]

    def count(self, s: int, e: int) -> int:
        from bisect import bisect_left, bisect_right

        return 1 + bisect_left(self.starts, e) - bisect_right(self.starts, s) if s < e else 0

    def total(self, spans) -> int:
        return sum(self.count(s, e) for s, e in spans)

    def shared(self, a, b) -> int:
        return sum(self.count(max(s, x), min(e, y)) for s, e in a for x, y in b)


def runs(a: list, b: list):
    """Walk two ordered lists of spans together: ("pair", i, j) for each meeting, ("end",) where a run of meetings closes."""
    i = j = 0
    while i < len(a) and j < len(b):
        (s, e), (x, y) = a[i], b[j]
        meets = s <= y and x <= e and s != y
        if meets:
            yield ("pair", i, j)
            i, j = i + (e <= y), j + (y <= e)
            if e == y:
                yield ("end",)
        else:
            yield ("end",)
            if x >= e:
                i += 1
            else:
                j += 1
    yield ("end",)


def _tally(total: list, common: float, correct: float, detected: float) -> None:
    if correct > 0:
        total[0] += common
        total[1] += common / detected * correct if detected else 0.0
        total[2] += correct


def word_level(words: Words, gold: list, predicted: list, least: list, most: list) -> None:
    """Word agreement of each meeting pair (``least``) and of each run of meetings (``most``)."""
    seen, seen_p, g, p = set(), set(), {}, {}
    for step in runs(gold, predicted):
        if step[0] == "pair":
            _, i, j = step
            if i not in seen:
                g[i] = gold[i]
            if j not in seen_p:
                p[j] = predicted[j]
            seen.add(i)
            seen_p.add(j)
            _tally(least, words.shared([gold[i]], [predicted[j]]), words.total([gold[i]]), words.total([predicted[j]]))
        elif g or p:
            _tally(most, words.shared(g.values(), p.values()), words.total(g.values()), words.total(p.values()))
            g, p = {}, {}
    for i, span in enumerate(gold):
        if i not in seen:
            n = words.total([span])
            _tally(least, 0, n, 0)
            _tally(most, 0, n, 0)


def two_level(text: str, gold: list, predicted: list, delimiters: str, equal: Callable | None = None) -> dict[str, tuple]:
    """Sums for segmentation, detection and word boundaries of units ((s, e), names)."""
    words = Words(text, delimiters)
    gold, predicted = sorted(gold, key=lambda x: x[0]), sorted(predicted, key=lambda x: x[0])
    sums = {k: [0.0, 0.0, 0.0] for k in ("detection", "boundary_min", "boundary_max")}
    hit_g, hit_p, g, p = set(), set(), [], []
    for step in runs([x[0] for x in gold], [x[0] for x in predicted]):
        if step[0] == "pair":
            _, i, j = step
            if i not in hit_g:
                g += gold[i][1]
            if j not in hit_p:
                p += predicted[j][1]
            hit_g.add(i)
            hit_p.add(j)
        elif g or p:
            _tally(sums["detection"], one_to_one(g, p, equal)[0], len(g), len(p))
            word_level(words, g, p, sums["boundary_min"], sums["boundary_max"])
            g, p = [], []
    i = j = 0
    while i < len(gold) and j < len(predicted):  # how far the walk over the gold units came
        (s, e), (x, y) = gold[i][0], predicted[j][0]
        if s <= y and x <= e and s != y:
            i, j = i + (e <= y), j + (y <= e)
        else:
            i, j = (i + 1, j) if x >= e else (i, j + 1)
    for unit in gold[i:]:
        if unit[1]:
            _tally(sums["detection"], 0, len(unit[1]), 0)
            word_level(words, unit[1], [], sums["boundary_min"], sums["boundary_max"])
    return {"segmentation": (len(hit_g), len(hit_p), len(gold), len(predicted)), **{k: tuple(v) for k, v in sums.items()}}


def two_level_scores(docs: DataFrame, delimiters: str) -> DataFrame:
    """(measure, recall, precision, f_score, units) over documents (doc, text, gold, predicted).

    Documents are swept apart from each other; their sums are added before any division.
    """

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                units = lambda x: [((u["s"], u["e"]), [(n["s"], n["e"]) for n in u["names"]]) for u in x]
                found = two_level(r.text, units(r.gold), units(r.predicted), delimiters)
                hit_g, hit_p, n_g, n_p = found.pop("segmentation")
                rows.append(("segmentation", float(hit_g), float(hit_p), float(n_g), float(n_p)))
                rows += [(k, a, b, c, c) for k, (a, b, c) in found.items()]
            yield pd.DataFrame(rows, columns=["measure", "r", "p", "units", "p_units"])

    sums = docs.mapInPandas(run, "measure string, r double, p double, units double, p_units double").groupBy("measure").agg(*[F.sum(c).alias(c) for c in ("r", "p", "units", "p_units")])
    r, p = F.coalesce(F.try_divide(F.col("r"), F.col("units")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("p"), F.col("p_units")), F.lit(0.0))
    return sums.select("measure", r.alias("recall"), p.alias("precision"), F.coalesce(F.try_divide(2 * r * p, r + p), F.lit(0.0)).alias("f_score"), F.col("units").cast("long").alias("units"))


def problems(units: DataFrame, names: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, problem, at) of gold units (doc, unit, s, e) and names (doc, unit, s, e)."""
    size = texts.select("doc", F.length("text").alias("n"))
    outside = units.join(size, "doc").where("s < 0 or e > n or s > e").select("doc", F.lit("outside").alias("problem"), F.col("s").alias("at"))
    u = units.select("doc", "unit", F.col("s").alias("us"), F.col("e").alias("ue"))
    stray = names.join(u, ["doc", "unit"]).where("s < us or e > ue").select("doc", F.lit("name outside unit").alias("problem"), F.col("s").alias("at"))
    clash = lambda df, by, what: df.withColumn("last", F.lag("e").over(W.partitionBy(*by).orderBy("s", "e"))).where("last >= s").select("doc", F.lit(what).alias("problem"), F.col("s").alias("at"))
    return outside.unionByName(stray).unionByName(clash(names, ["doc", "unit"], "names overlap")).unionByName(clash(units, ["doc"], "units overlap"))


def clusters(labels: DataFrame, most: int = 15, forms: int = 6) -> DataFrame:
    """(label, size, names): the largest clusters of (item, label, name) with a few of their forms."""
    top = labels.groupBy("label").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "label").limit(most)
    shown = labels.join(F.broadcast(top), "label").select("label", "size", "name").distinct()
    first = shown.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("name"))).where(F.col("n") <= forms)
    return first.groupBy("label", "size").agg(F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("names"))
