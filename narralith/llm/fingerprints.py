"""Threshold-scaled document fingerprints, in DataFrame functions alone.

A fingerprint is the sorted distinct hashes of a text's word shingles that lie below a fixed share
of the hash range. Which hashes stay does not depend on the text's length, so the fingerprints of
two parts merge by union, and the overlap of two fingerprints estimates both the Jaccard likeness
and the containment of texts of very unequal length. A text none of whose hashes is low enough
keeps its least one, so that no text with words has an empty fingerprint.

Cases: null and empty texts, and texts without words, have the empty fingerprint, which is like
another empty one (1) and unlike any other (0); a text with fewer words than a shingle has one
shingle, the whole sequence; words are compared in lower case; equal texts have equal fingerprints; very
long texts are read whole and have fingerprints in proportion; other columns do not matter.

For successors (:func:`with_next`): rows are ordered by id, then text, null ids first; the row after
the last is the first, so a lone row follows itself; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    words: int = 5
    share: int = 4  # one hash in so many is kept
    rows_per_bucket: int = 1500
    max_buckets: int = 50_000


def words_of(text: Column) -> Column:
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))


def hashes_of(words: Column, s: Settings) -> Column:
    """``words`` must be a column: a lambda computes anything else anew for each element."""
    one = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(s.words)])
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - s.words, F.when(F.size(words) > 0, 0).otherwise(-1)), F.lit(1)), one)


def _top(s: Settings) -> int:
    return -(2**63) + 2**64 // s.share


def with_fingerprint(df: DataFrame, text: Column, name: str, s: Settings = Settings()) -> DataFrame:
    """Add the fingerprint of ``text`` as an array of longs."""
    df = df.withColumn("__w", words_of(text))
    df = df.withColumn("__h", F.when(F.size("__w") > 0, hashes_of(F.col("__w"), s)))
    df = df.withColumn("__low", F.sort_array(F.array_distinct(F.filter("__h", lambda x: x < F.lit(_top(s))))))
    kept = F.when(F.col("__h").isNull(), F.array().cast("array<bigint>")).when(F.size("__low") > 0, F.col("__low")).otherwise(F.array(F.array_min("__h")))
    return df.withColumn(name, kept).drop("__w", "__h", "__low")


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, F.hex), " ")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard measure of the two texts' shingle sets."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, s: Settings = Settings()) -> Column:
    """Fingerprint of the two texts' shingles together: a least hash that stood in for low ones goes where there are such."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda x: x < F.lit(_top(s)))
    return F.when(F.size(low) > 0, F.sort_array(low)).when(F.size(both) > 0, F.array(F.array_min(both))).otherwise(both)


def _bucketed(df: DataFrame, id_col: str, s: Settings) -> DataFrame:
    """Add ``__bucket``: ranges of ids with about as many rows each, found by a binary search over their bounds."""
    rows = df.count()
    n = max(1, min(s.max_buckets, rows // s.rows_per_bucket))
    bounds = df.agg(F.percentile_approx(id_col, [k / n for k in range(1, n)], max(10_000, 4 * n)).alias("b")).first().b if n > 1 else None
    bounds = sorted(set(bounds or []))
    size = 1 << max(1, len(bounds).bit_length())
    bounds += [None] * (size - len(bounds))
    steps, step = [], size // 2
    while step:
        steps.append(step)
        step //= 2
    table = F.array(*[F.lit(b).cast(df.schema[id_col].dataType) for b in bounds]) if any(b is not None for b in bounds) else None
    if table is None:
        return df.withColumn("__bucket", F.lit(0))
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, k: F.when(F.get(table, lo + k - 1) < F.col(id_col), lo + k).otherwise(lo))
    return df.withColumn("__bucket", found)


def with_next(docs: DataFrame, id_col: str, text_col: str, s: Settings = Settings()) -> DataFrame:
    """(id, text, fp, next_text, next_fp): each text with its fingerprint and those of the next document.

    The texts move once, to ranges of ids; only the first text of each range crosses to the one before.
    """
    df = _bucketed(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")), "id", s)
    order = W.partitionBy("__bucket").orderBy(F.col("id").asc_nulls_first(), "text")
    firsts = df.groupBy("__bucket").agg(F.min_by("text", F.struct(F.col("id").isNotNull().alias("k"), "id", "text")).alias("text"))
    firsts = with_fingerprint(firsts, F.col("text"), "fp", s)
    ring = W.orderBy("__bucket")  # numbers of ranges alone: bounded
    after = df.select("__bucket").distinct().select("__bucket", F.coalesce(F.lead("__bucket").over(ring), F.first("__bucket").over(ring)).alias("__next"))
    firsts = after.join(firsts.select(F.col("__bucket").alias("__next"), F.col("text").alias("first_text"), F.col("fp").alias("first_fp")), "__next").drop("__next")
    df = with_fingerprint(df, F.col("text"), "fp", s)
    df = df.select("*", F.lead("text").over(order).alias("t"), F.lead("fp").over(order).alias("f")).join(firsts, "__bucket", "left")
    return df.select("id", "text", "fp", F.coalesce("t", "first_text").alias("next_text"), F.coalesce("f", "first_fp").alias("next_fp"))
