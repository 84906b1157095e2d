"""Best-fit packing of texts into sequences of several permitted lengths.

Items are dealt out to shards by a hash of their id, so many to a shard that what the last bins of
each leave free does not count. In a shard the longest item comes first and goes to the open bin
that it fills best. Where none has room, a bin is opened whose size has the least cost for what it
can hold of the items still to come; at the end each bin shrinks to the cheapest size that holds
its contents. An item longer than the largest size is cut into pieces of that size and a rest.

Cases: a null id or a length of null counts as it comes (null as length 0); items of length 0 take a
place in the fullest bin; ties go to the bin opened first and the id that is lower; repeated rows
are items of their own; a very long text is cut as any long item; an empty table gives no bins; only id
and length are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narralith.llm._shared import released


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (512, 1024, 2048, 4096)
    per_bin: float = 32.0  # cost of a bin beside its tokens
    quadratic: float = 1 / 65536  # cost of a token pair, as attention has it
    items_per_shard: int = 50_000

    def cost(self, size: int) -> float:
        return self.per_bin + size + self.quadratic * size * size


@dataclass
class Bin:
    size: int
    used: int
    items: list[tuple[int, int, int]]  # item, start, length


def open_size(need: int, left: int, s: Settings) -> int:
    """The size that costs least for each token it can still get; ``left`` counts this item and all to come."""
    return min((c for c in sorted(s.sizes) if c >= need), key=lambda c: (s.cost(c) / max(1, min(c, left)), c))


def fitting_size(used: int, s: Settings) -> int:
    return min((c for c in s.sizes if c >= used), key=lambda c: (s.cost(c), c))


def pack(lengths: list[int], s: Settings) -> list[Bin]:
    """Bins of the items 0, 1, ... of these lengths."""
    largest = max(s.sizes)
    pieces = []
    for i, n in enumerate(lengths):
        pieces += [(min(largest, n - at), i, at) for at in range(0, n, largest)] or [(0, i, 0)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    left = sum(p[0] for p in pieces)
    bins: list[Bin] = []
    free: list[int] = []  # distinct free spaces of the open bins, ascending
    having: dict[int, deque[int]] = {}
    for n, i, at in pieces:
        k = bisect_left(free, n)
        if k < len(free):
            space = free[k]
            b = having[space].popleft()
            if not having[space]:
                del having[space], free[k]
        else:
            space = open_size(n, left, s)
            bins.append(Bin(space, 0, []))
            b = len(bins) - 1
        bins[b].items.append((i, at, n))
        bins[b].used += n
        left -= n
        rest = space - n
        if rest in having:
            having[rest].append(b)
        else:
            having[rest] = deque([b])
            insort(free, rest)
    for b in bins:
        b.size = fitting_size(b.used, s)
    return bins


def word_count(text: str = "text") -> Column:
    """Tokens of a text, counted as words between blanks."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


#: Rows alike that are numbered at once.
ALIKE = 10_000


def sequences(bins: DataFrame, texts: DataFrame, id_col: str = "doc_id", tokens_col: str = "ids") -> DataFrame:
    """(bin_id, bin_size, tokens, starts, doc_ids): the token sequence of each bin, with the place where each piece begins.

    ``texts`` has one row per id, with its tokens (array). A piece goes where its bin is; a bin's tokens are
    bounded by its size. Pieces of length 0, and ids without tokens, add nothing but their place.
    """
    pieces = bins.select("bin_id", "bin_size", F.posexplode(F.arrays_zip("doc_ids", "starts", "lengths")).alias("place", "p"))
    cut_ = F.coalesce(F.slice(F.col("__tokens"), (F.col("p.starts") + 1).cast("int"), F.col("p.lengths").cast("int")), F.array().cast(texts.schema[tokens_col].dataType))
    right = texts.select(F.col(id_col).alias("__id"), F.col(tokens_col).alias("__tokens"))
    held = pieces.join(right, F.col("p.doc_ids").eqNullSafe(F.col("__id")), "left").select("bin_id", "bin_size", "place", F.col("p.doc_ids").alias("doc"), cut_.alias("part"))
    one = held.groupBy("bin_id", "bin_size").agg(F.array_sort(F.collect_list(F.struct("place", "doc", "part"))).alias("of"))
    begins = F.transform("of", lambda x, k: F.aggregate(F.slice("of", F.lit(1), k), F.lit(0), lambda n, y: n + F.size(y["part"])))
    return one.select("bin_id", "bin_size", F.flatten(F.transform("of", lambda x: x["part"])).alias("tokens"), begins.alias("starts"), F.transform("of", lambda x: x["doc"]).alias("doc_ids"))


def pack_table(items: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """One row per bin: its size, what it holds, and the items with the part of each (start and length)."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n"))
    shards = max(1, -(-rows.count() // s.items_per_shard))
    # Rows alike in id and length, such as those without id, are numbered, so that they spread over the shards.
    alike = rows.groupBy("id", "n").agg((F.count("*") - 1).alias("last"))
    parts = alike.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(ALIKE).cast("long"))))
    rows = parts.select("id", "n", F.explode(F.sequence("from", F.least("last", F.col("from") + (ALIKE - 1)))).alias("nth"))
    kind = rows.schema["id"].dataType
    many = lambda t: T.ArrayType(t)
    schema = T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("bin_size", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("doc_ids", many(kind)), T.StructField("starts", many(T.LongType())), T.StructField("lengths", many(T.LongType()))])

    def shard_rows(shard: int, ids: list, n: np.ndarray):
        bins = pack(n.tolist(), s)
        for at in range(0, len(bins), 4096):
            part = bins[at : at + 4096]
            columns = [
                pa.array([(shard << 32) + at + k for k in range(len(part))], pa.int64()),
                pa.array([b.size for b in part], pa.int64()),
                pa.array([b.used for b in part], pa.int64()),
                pa.array([len(b.items) for b in part], pa.int64()),
                pa.array([[ids[i] for i, _, _ in b.items] for b in part]),
                *(pa.array([[x[k] for x in b.items] for b in part], pa.list_(pa.int64())) for k in (1, 2)),
            ]
            yield columns

    def run(batches):
        shard, ids, n, kind_ = None, [], [], None

        def done():
            for columns in shard_rows(shard, ids, np.array(n)):
                columns[4] = columns[4].cast(pa.list_(kind_))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

        for b in batches:
            kind_ = b.column(1).type
            for sh, i, k in zip(*(c.to_pylist() for c in b.columns)):
                if sh != shard:
                    if ids:
                        yield from done()
                    shard, ids, n = sh, [], []
                ids.append(i)
                n.append(k)
        if ids:
            yield from done()

    dealt = rows.select(F.pmod(F.xxhash64("id", "n", "nth"), F.lit(shards)).alias("shard"), "id", "n").repartition(shards, "shard").sortWithinPartitions("shard", F.desc("n"), "id")
    return dealt.mapInArrow(released(run), schema)
