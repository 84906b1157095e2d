"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Counts of each text give a few measures. For each stratum and measure a fixed grid of cutoffs is
tried on the labelled good documents: a cutoff is safe when the exact binomial test says that it
rejects more than ``risk / measures`` of the good documents with a chance below ``delta`` divided
by the number of tests made (strata x measures x cutoffs, Bonferroni). The lowest safe cutoff of
each stratum and measure is used; where none is safe the measure rejects nothing there. So, with
probability 1 - delta, no stratum loses more than ``risk`` of those of its good documents that pass the
base rules (what these reject is fixed beforehand and not in the holdout). The bounds take labelled
documents as independent; exact copies among them count as several.

Cases: a null text has no words; a null stratum is a stratum of its own; a stratum without labels
rejects nothing beyond the base rules; ties lie at or below a cutoff and are kept; repeated rows
repeat their verdict; very long texts are counted whole; an empty table gives an empty table; columns
of the input pass through, but for those named like an output column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space between words and symbols counted: fixed by the contract.
BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Settings:
    risk: float = 0.05  # good documents that a stratum may lose
    delta: float = 0.05  # chance that any stratum loses more
    cutoffs: int = 60  # cutoff i is the value i / scale of a measure
    min_words: int = 50
    repeat_percent: int = 50


#: Each measure is a ratio of counts; the grid has ``cutoffs`` steps of 1 / scale.
MEASURES = {
    "symbols_per_word": ("n_symbols", "n_words", 40),
    "symbol_share": ("n_symbols", "n_symbols + word_chars", 120),
    "repeated_words": ("n_repeat_words", "n_words", 60),
    "repeated_lines": ("n_dup_lines", "n_lines", 60),
    "word_length": ("word_chars", "n_words", 3),
}


def _window_keys(words: Column) -> tuple[Column, Column]:
    """The place bits' size and, per 3-word window, one sortable long: a hash of its words above, its place in the lowest bits.

    As many low bits as the text has words need, so nearly all of the hash stays. The argument must
    be a column: a lambda computes anything else anew for each element.
    """
    size = F.expr("shiftleft(1L, cast(ceil(log2(size(__words) + 1)) as int))")
    key = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(-F.col("__size")).bitwiseOR(i.cast("long"))
    return size, F.when(F.size(words) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), key)))


def _repeated(keys: Column, words: Column, size: Column) -> Column:
    """Sorted places of the windows that occur more than once; equal hashes count only with equal words."""
    place = lambda x: x.bitwiseAND(size - 1).cast("int")

    def same(x: Column, y: Column) -> Column:
        at, to = place(x), place(y)
        return (x.bitwiseXOR(y).bitwiseAND(-size) == 0) & (F.get(words, at) == F.get(words, to)) & (F.get(words, at + 1) == F.get(words, to + 1)) & (F.get(words, at + 2) == F.get(words, to + 2))

    hit = F.filter(keys, lambda x, k: F.coalesce(same(x, F.get(keys, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(keys, k + 1)), F.lit(False)))
    return F.sort_array(F.transform(hit, place))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base counts of each whole text (and ``n_lines``, lines that hold a word)."""
    rest = [c for c in docs.columns if c not in (*COUNTS, "n_lines")]
    text = F.coalesce(F.col("__text"), F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    df = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).alias("__text"))
    df = df.select(
        "*",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK + "+")).alias("__words"),
        F.filter(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(" \t\x0b\x0c\r")) != "").alias("__lines"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    size, keys = _window_keys(F.col("__words"))
    df = df.select("*", size.alias("__size")).select("*", keys.alias("__keys"))
    df = df.select("*", _repeated(F.col("__keys"), F.col("__words"), F.col("__size")).alias("__at"))
    at = F.col("__at")
    repeat = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1), F.lit(2**31 - 1)) - x)), F.lit(0), lambda a, x: a + x)
    return df.select(
        *[F.col(f"`{c}`") for c in rest],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )


def base_failed(s: Settings) -> Column:
    return (F.col("n_words") < s.min_words) | (100 * F.col("n_repeat_words") > s.repeat_percent * F.col("n_words"))


def _step(top: str, bottom: str, scale: int, s: Settings) -> Column:
    """The least cutoff number that keeps a document: ceil(scale * top / bottom), in whole numbers."""
    num, den = F.expr(top) * scale, F.expr(bottom)
    return F.least(F.lit(s.cutoffs), F.when(den > 0, F.expr(f"({scale} * ({top}) + ({bottom}) - 1) div ({bottom})")).otherwise(0)).cast("int")


def _tail_below(k: Column, n: Column, p: float, level: Column) -> Column:
    """P(X <= k) <= level for X ~ Binomial(n, p), the terms summed one from the other in logarithms."""
    import math

    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).cast("double").alias("t"), F.exp(n * math.log1p(-p)).cast("double").alias("s"))
    step = lambda a, j: F.struct((a["t"] + F.log((n - j + 1) / j) + odds).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - j + 1) / j) + odds)).alias("s"))
    total = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), start, step)["s"]).otherwise(start["s"])
    # beyond the mean the tail is over a half and never safe: no need to sum it
    return F.when(k >= n * p, F.lit(False)).otherwise(total <= level)


def thresholds(counts: DataFrame, labels: DataFrame, s: Settings = Settings(), stratum_col: str = "lang", id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, measure, cutoff): the lowest safe cutoff number of each stratum and measure, where there is one."""
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("__id"))
    rows = counts.where(~base_failed(s)).join(good, F.col(id_col) == F.col("__id"), "left_semi")
    stack = F.array(*[F.struct(F.lit(m).alias("measure"), _step(top, bottom, scale, s).alias("step")) for m, (top, bottom, scale) in MEASURES.items()])
    # how many good documents need at least each cutoff number
    steps = rows.select(F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.inline(stack)).groupBy("stratum", "measure", "step").agg(F.count("*").alias("c"))
    tall = steps.groupBy("stratum", "measure").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "c"))).alias("of"))
    strata = F.count("*").over(W.partitionBy("measure"))  # at most a few: one row per stratum and measure
    tall = tall.withColumn("level", F.lit(s.delta) / (strata * len(MEASURES) * s.cutoffs))
    tall = tall.withColumn("above", F.transform(F.sequence(F.lit(0), F.lit(s.cutoffs - 1)), lambda c: F.aggregate(F.filter(F.map_entries("of"), lambda e: e["key"] > c), F.lit(0).cast("long"), lambda a, e: a + e["value"])))
    limit = s.risk / len(MEASURES)
    safe = tall.select("stratum", "measure", "n", "level", F.posexplode("above").alias("cutoff", "k")).where(_tail_below(F.col("k"), F.col("n"), limit, F.col("level")))
    return safe.groupBy("stratum", "measure").agg(F.min("cutoff").alias("cutoff"))


#: Strata whose cutoffs are broadcast; more are joined.
BROADCAST_STRATA = 20_000


def verdicts(counts: DataFrame, cutoffs: DataFrame, s: Settings = Settings(), stratum_col: str = "lang") -> DataFrame:
    """Add ``base_failed`` and ``kept``."""
    wide = cutoffs.groupBy(F.col("stratum").alias("__stratum")).agg(*[F.min(F.when(F.col("measure") == m, F.col("cutoff"))).alias(f"__{m}") for m in MEASURES])
    wide = F.broadcast(wide) if cutoffs.count() <= BROADCAST_STRATA * len(MEASURES) else wide
    passes = F.lit(True)
    for m, (top, bottom, scale) in MEASURES.items():
        passes = passes & F.coalesce(_step(top, bottom, scale, s) <= F.col(f"__{m}"), F.lit(True))
    df = counts.withColumn("__key", F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))).join(wide, F.col("__key") == F.col("__stratum"), "left")
    df = df.withColumn("base_failed", base_failed(s)).withColumn("kept", ~base_failed(s) & passes)
    return df.drop("__key", "__stratum", *[f"__{m}" for m in MEASURES])
