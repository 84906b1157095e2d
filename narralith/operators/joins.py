"""As-of and interval joins as unions, windows and bucketed equi-joins: no pair that cannot match is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(probes: DataFrame, markers: DataFrame, keys: list[str], at: str, values: list[str], forward: bool = False, strict: bool = False, tolerance=None, prefix: str = "m_") -> DataFrame:
    """Each probe with the nearest marker at or before its place (``forward``: at or after; ``strict``: not at).

    Of markers at one place the one with the largest values counts. One shuffle by key: probes and
    markers are sorted together and the last marker seen is carried along.
    """
    cols = [F.col(at).alias("__at"), F.struct(F.col(at).alias("__m_at"), *values).alias("__m")]
    left = probes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(at).alias("__at"), F.struct(*probes.columns).alias("__p"))
    right = markers.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *cols)
    both = left.unionByName(right, allowMissingColumns=True)
    # At one place markers come before the probes that may use them and after those that may not.
    probe_first = strict != forward
    rank = F.when(F.col("__p").isNotNull(), 0 if probe_first else 1).otherwise(1 if probe_first else 0)
    order = W.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__at", rank, F.col("__m"))
    if forward:
        found = F.first("__m", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    else:
        found = F.last("__m", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    out = both.withColumn("__found", found).where("__p is not null")
    if tolerance is not None:
        out = out.withColumn("__found", F.when(F.abs(F.col("__at") - F.col("__found.__m_at")) <= tolerance, F.col("__found")))
    return out.select("__p.*", F.col("__found.__m_at").alias(prefix + at), *[F.col(f"__found.{v}").alias(prefix + v) for v in values])


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Closed intervals share a place; touching counts."""
    return (s1 <= e2) & (s2 <= e1)


def after(s1: Column, e2: Column) -> Column:
    return s1 >= e2


def interval_pairs(left: DataFrame, right: DataFrame, keys: list[str], width: int, ls: str = "s", le: str = "e", rs: str = "s2", re: str = "e2") -> DataFrame:
    """Pairs of overlapping closed intervals of a key.

    Both sides are laid on buckets of ``width``; a pair is kept in the bucket where its overlap begins,
    so it comes out once.
    """
    cover = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    a = left.where(F.col(ls) <= F.col(le)).withColumn("__b", cover(ls, le))
    b = right.where(F.col(rs) <= F.col(re)).withColumn("__b", cover(rs, re))
    both = a.join(b, [*keys, "__b"])
    return both.where(overlaps(F.col(ls), F.col(le), F.col(rs), F.col(re)) & (F.col("__b") == F.floor(F.greatest(ls, rs) / width))).drop("__b")


def interval_semi(left: DataFrame, right: DataFrame, keys: list[str], width: int, ls: str = "s", le: str = "e", rs: str = "s2", re: str = "e2") -> DataFrame:
    """Intervals of the left that overlap any of the right."""
    hit = interval_pairs(left, right.select(*keys, rs, re), keys, width, ls, le, rs, re)
    return left.join(hit.select(*keys, ls, le).distinct(), [*keys, ls, le], "left_semi")
