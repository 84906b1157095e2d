"""Similarity self-join of texts by the Jaccard measure of their word n-gram sets.

1. A first pass counts all shingles; a table of fixed size then orders them rare first.
2. A second pass reduces every text to its set's size and signature, to its prefix, the n - ceil(t n) + 1
   rarest shingles (two sets of similarity t share one of these), and to the counts of its shingles in
   ranges of the hash, about three a range.
3. Texts with equal sets form a class, represented by its least id. Classes are joined on prefix
   shingles under the length and positional filters, then held to the suffix filter: the overlap of two
   sets is at most the sum of the lesser counts of their ranges. Where more than ``small`` classes share
   a shingle they are not joined with one another: those of one hub (the class with most such shingles)
   meet by size in blocks of bounded bytes, where the filter runs on the counts and only a forest of
   the plausible pairs leaves the task.
4. The plausible pairs make families. Each set is sent to its family once, and there every pair is
   verified once, by counting overlaps in a matrix product; a forest of the links leaves the task. A
   family beyond one block meets block by block, so groups of thousands of near copies never become
   rows of pairs and no task holds more than two blocks.

The result has one row per text with the least id reachable by links.

Cases: null and empty texts, or texts without words, have an empty set and are linked with nothing;
texts with fewer words than n have one shingle, the whole sequence; very long texts are read whole, one
at a time, and are a block of their own; repeated rows are one class; rows that share an id count as
one document, linked by any of their texts; a null id gets a null component but still has its set
size; an empty table gives an empty table; only id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narralith.llm._shared import block_pairs, cut, drop_cut, released
from narralith.llm.components import components

MEMO_WORDS = 150_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # an odd constant for the rolling combination
PER_RANGE = 4  # shingles of a set that meet in one range of the suffix filter, at most on average


@dataclass(frozen=True)
class Settings:
    words: int = 4
    percent: int = 85  # linked when 100 * intersection >= percent * union
    sketch_bits: int = 20
    broadcast_ids: int = 400_000  # ids of one pass that may be broadcast; more are joined
    small: int = 24  # classes that share a shingle and are still paired with one another
    block: int = 2048  # classes of one hub or family that a task holds on either side
    block_bytes: int = 8 << 20  # and the bytes of their counts or sets
    chunk: int = 1 << 20  # shingles that a task counts at once


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text (A-Z lower-cased)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    if not size:
        return w
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * MULTIPLIER + w[k : len(w) - size + 1 + k]
    return np.unique(_mix(h))


def rarity(docs: DataFrame, s: Settings, text_col: str) -> np.ndarray:
    """Level of each bucket of shingles: twice the logarithm of the count of its most frequent shingle.

    Each task counts all shingles of its texts and passes on those it saw more than once; their sums
    are exact enough to tell frequent from rare, which is all that the order needs (any order is
    correct). The result has a fixed size, whatever the corpus.
    """
    size, chunk = 1 << s.sketch_bits, s.chunk

    def count(batches):
        held, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c > 1], c[c > 1]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for b in batches:
            for t in b.column(0):
                held.append(shingles(t.as_py(), s.words))
                n += len(held[-1])
                if n >= chunk:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    often = docs.select(text_col).mapInArrow(released(count), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c >= 4")
    level = np.zeros(size, np.uint8)
    for r in often.groupBy(F.shiftrightunsigned("h", 64 - s.sketch_bits).alias("at")).agg(F.max("c").alias("c")).toLocalIterator():
        level[r["at"]] = round(2 * math.log2(r["c"]))
    return level


def counts_of(h: np.ndarray) -> bytes | None:
    """Counts of a set's shingles in equal ranges of the hash, a byte each; None where one does not fit."""
    bits = max(2, (max(len(h), 1) // PER_RANGE).bit_length())
    c = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else None


def reduced(docs: DataFrame, level: np.ndarray, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, n, sig, prefix, counts) of every row."""
    shift = np.uint64(64 - s.sketch_bits)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("counts", T.BinaryType())])
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        rank = shared.value
        for b in batches:
            n, sig, prefix, counts = [], [], [], []
            for t in b.column(1):
                h = shingles(t.as_py(), s.words)
                n.append(len(h))
                sig.append(blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                p = len(h) + (-len(h) * s.percent) // 100 + 1  # n - ceil(t n) + 1
                prefix.append(h[np.lexsort((h, rank[(h >> shift).astype(np.int64)]))[:p]].view(np.int64) if len(h) else None)
                counts.append(counts_of(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(counts, pa.binary())], names=[f.name for f in schema])

    return docs.select(id_col, text_col).mapInArrow(released(run), schema)


def _needed(n: Column, m: Column, s: Settings) -> Column:
    """Least overlap of linked sets of these sizes: ceil(t (n + m) / (1 + t))."""
    return F.ceil((n + m) * s.percent / (100 + s.percent) - 1e-9)


def _possible(a: str, b: str, s: Settings) -> Column:
    """Length and positional filters on (n, pos) structs of the two sides."""
    n, m, i, j = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    length = 100 * F.least(n, m) >= s.percent * F.greatest(n, m)
    return length & (F.least(i, j) + 1 + F.least(n - i, m - j) - 1 >= _needed(n, m, s))


def least_overlap(n, m, s: Settings):
    """As :func:`_needed`, for whole numbers and arrays of them."""
    return -(-(n + m) * s.percent // (100 + s.percent))


def folded(counts: bytes, ranges: int) -> np.ndarray:
    c = np.frombuffer(counts, np.uint8).astype(np.uint16)
    return c.reshape(ranges, -1).sum(1, dtype=np.uint16)


def may_link(n: int, x: bytes | None, m: int, y: bytes | None, s: Settings) -> bool:
    """The suffix filter: whether sets of sizes n and m with these counts can overlap enough."""
    if x is None or y is None:
        return True
    ranges = min(len(x), len(y))
    return int(np.minimum(folded(x, ranges), folded(y, ranges)).sum(dtype=np.int64)) >= least_overlap(n, m, s)


class Forest:
    """Union-find over the places 0 to n - 1 that keeps the edges which joined two trees."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def join(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)
            self.edges.append((int(i), int(j)))


def plausible_forest(n: np.ndarray, counts: list[bytes | None], home: np.ndarray, side: np.ndarray | None, s: Settings) -> list[tuple[int, int]]:
    """A forest that connects all members of which a pair passes the suffix filter.

    ``side`` tells two blocks apart, of which only pairs across count; so do only pairs of which one is at ``home``.
    """
    found = Forest(len(n))
    ranges = min((len(c) for c in counts if c is not None), default=1)
    x = np.zeros((len(n), ranges), np.uint16)
    for i, c in enumerate(counts):
        x[i] = folded(c, ranges) if c is not None else np.iinfo(np.uint16).max
    for i in np.flatnonzero(home):
        others = found.root != found.root[i]
        if side is not None:
            others &= side != side[i]
        at = np.flatnonzero(others)
        bound = np.minimum(x[at], x[i]).sum(1, dtype=np.int64)
        for j in at[bound >= least_overlap(n[at], n[i], s)]:
            found.join(i, j)
    return found.edges


def linked_forest(grams: list[np.ndarray], side: np.ndarray | None, s: Settings) -> list[tuple[int, int]]:
    """A forest that connects all members of which a pair is linked; ``side`` as above."""
    n = np.array([len(g) for g in grams])
    if len(n) == 2:
        same = len(np.intersect1d(grams[0], grams[1], assume_unique=True))
        return [(0, 1)] if 100 * same >= s.percent * (n.sum() - same) else []
    owner = np.repeat(np.arange(len(grams)), n)
    _, place, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    shared = times[place] > 1
    owner, column = owner[shared], column[place[shared]]
    if not len(owner):
        return []
    rows = np.flatnonzero(side == 0) if side is not None else np.arange(len(grams))
    cols = np.flatnonzero(side == 1) if side is not None else rows
    at, to = np.full(len(grams), -1), np.full(len(grams), -1)
    at[rows], to[cols] = np.arange(len(rows)), np.arange(len(cols))
    same = np.zeros((len(rows), len(cols)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(1, (4 << 20) // max(len(rows), len(cols), 1))
    for lo in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        left, right = (np.zeros((k, min(width, int(column[-1]) + 1 - lo)), np.float32) for k in same.shape)
        o, c = owner[a:b], column[a:b] - lo
        left[at[o][at[o] >= 0], c[at[o] >= 0]] = 1
        right[to[o][to[o] >= 0], c[to[o] >= 0]] = 1
        same += left @ right.T
    found = Forest(len(grams))
    for k, i in enumerate(rows):
        hit = cols[100 * same[k] >= s.percent * (n[i] + n[cols] - same[k]) - 1e-3]
        for j in hit[found.root[hit] != found.root[i]]:
            found.join(i, j)
    return found.edges


def _in_blocks(rows: DataFrame, key: list[str], make) -> DataFrame:
    """(a, b): the forest edges that ``make(members, side)`` finds in each (key, i, j); members are the rows' other columns.

    Rows must come with columns key, i, j, mine, node and what ``make`` reads.
    """
    order = [*key, "i", "j"]
    dealt = rows.repartition(*order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("a", rows.schema["node"].dataType), T.StructField("b", rows.schema["node"].dataType)])

    def run(batches):
        at, held, kind = None, [], None

        def found():
            if len(held) < 2:
                return
            side = None if at[-1] == at[-2] else np.array([int(r["mine"] == at[-1]) for r in held])
            edges = make(held, side)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([held[e[k]]["node"] for e in edges], kind) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            kind = b.schema.field("node").type
            for row in b.to_pylist() if "grams" not in b.schema.names else _rows_with_sets(b):
                now = tuple(row[c] for c in order)
                if now != at:
                    yield from found()
                    at, held = now, []
                held.append(row)
        yield from found()

    return dealt.mapInArrow(released(run), schema)


def _rows_with_sets(b: pa.RecordBatch):
    at = b.schema.get_field_index("grams")
    sets, ends = b.column(at).flatten().to_numpy(), b.column(at).offsets.to_numpy()
    ends = ends - ends[0]
    for k, row in enumerate(b.drop_columns("grams").to_pylist()):
        yield row | {"grams": sets[ends[k] : ends[k + 1]].copy()}


def plausible_pairs(classes: DataFrame, s: Settings) -> DataFrame:
    """(a, b): edges that connect all classes (node, n, prefix, counts) of which a pair passes the filters."""
    grams = classes.select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    many = grams.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    # Rows of shared shingles only; few are, so what follows moves little.
    shared = cut(grams.join(many, "gram").select("gram", "c", F.struct("n", "node", "pos").alias("me")))
    few, large = shared.where(F.col("c") <= s.small), shared.where(F.col("c") > s.small)
    x, y = few.select("gram", F.col("me").alias("x")), few.select("gram", F.col("me").alias("y"))
    pairs = x.join(y, "gram").where((F.col("x.node") < F.col("y.node")) & _possible("x", "y", s)).select(F.col("x.node").alias("a"), F.col("x.n").alias("n"), F.col("y.node").alias("b"), F.col("y.n").alias("m")).distinct()
    own = classes.select("node", F.col("n").alias("own"), "counts")
    left, right = (own.select(F.col("node").alias(k), F.col("own").alias(n), F.col("counts").alias(c)) for k, n, c in (("a", "n", "x"), ("b", "m", "y")))
    kind = classes.schema["node"].dataType
    edge = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def test(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("n", "x", "m", "y")))
            yield b.select(["a", "b"]).take(pa.array([k for k, row in enumerate(rows) if may_link(*row, s)], pa.int32()))

    near = pairs.join(left, ["a", "n"]).join(right, ["b", "m"]).select("a", "b", "n", "x", "m", "y").mapInArrow(released(test), edge)

    weight = large.groupBy("me.node").agg(F.count("*").alias("w"))
    hubs = large.select("gram", "me.node").join(weight, "node").groupBy("gram").agg(F.max(F.struct("w", "node")).alias("hub"))
    # A class is in the cell of its own size and in the next, so that sizes which may link share one.
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / s.percent) * (1 + 1e-6))).cast("int")
    members = large.join(hubs, "gram").select(F.col("hub.node").alias("hub"), F.col("me.node").alias("node"), F.col("me.n").alias("n")).distinct()
    members = members.join(own.withColumnRenamed("own", "n"), ["node", "n"]).withColumn("band", band).withColumn("cell", F.explode(F.array("band", F.col("band") + 1)))
    cells = cut(members.select("hub", "cell", "node", "n", (F.col("band") == F.col("cell")).alias("home"), "counts", F.coalesce(F.octet_length("counts"), F.lit(1)).alias("bytes")))

    def make(held, side):
        return plausible_forest(np.array([r["n"] for r in held]), [r["counts"] for r in held], np.array([r["home"] for r in held]), side, s)

    out = cut(near.unionByName(_in_blocks(block_pairs(cells, ["hub", "cell"], s.block, s.block_bytes), ["hub", "cell"], make)).where("a <> b").distinct())
    drop_cut(shared)
    drop_cut(cells)
    return out


def verified_links(edges: DataFrame, classes: DataFrame, docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(a, b): a forest of the links among the families that ``edges`` connect."""
    found = cut(components(edges))
    members = found.select("node", F.col("root").alias("family")).unionByName(found.select(F.col("root").alias("node"), F.col("root").alias("family")).distinct())
    # Rows that share an id have several sets.
    sized = cut(members.join(classes.groupBy("node").agg(F.sum(8 * F.col("n")).alias("bytes")), "node"))
    few = sized.count() <= s.broadcast_ids
    placed = cut(block_pairs(sized, ["family"], s.block, s.block_bytes).groupBy("family", "node", "mine").agg(F.collect_list(F.struct("i", "j")).alias("at")))
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    wanted = texts.join(F.broadcast(placed) if few else placed, "node").select("node", "family", "mine", "at", "text")
    schema = T.StructType([*wanted.schema.fields[:4], T.StructField("grams", T.ArrayType(T.LongType()))])

    def build(batches):
        for b in batches:
            found = [shingles(t.as_py(), s.words).view(np.int64) for t in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.list_(pa.int64()))], names=schema.names)

    sets = wanted.mapInArrow(released(build), schema).where(F.size("grams") > 0)
    rows = sets.withColumn("at", F.explode("at")).select("node", "family", "mine", "grams", "at.i", "at.j")

    def make(held, side):
        return linked_forest([r["grams"] for r in held], side, s)

    links = cut(_in_blocks(rows, ["family"], make).where("a <> b"))
    for used in (found, sized, placed):
        drop_cut(used)
    return links


def join_components(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component) of every row."""
    level = rarity(docs, s, text_col)
    base = cut(reduced(docs, level, s, id_col, text_col))
    # One row of each class, prefix and counts with it: of repeated rows any, as they are equal.
    classes = base.where("n > 0").groupBy("sig").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("counts").alias("counts")).where("node is not null")
    classes = cut(classes)
    rows = cut(base.select("id", "n", "sig"))
    drop_cut(base)
    edges = plausible_pairs(classes, s)
    links = verified_links(edges, classes, docs, s, id_col, text_col)
    drop_cut(edges)
    roots = components(links)
    owner = rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    owner = owner.join(roots.select(F.col("node").alias("__n"), "root"), F.col("node") == F.col("__n"), "left").where("copies > 1 or root is not null").select("sig", F.coalesce("root", "node").alias("root"))
    drop_cut(classes)
    # A class of thousands of copies is one row here, so the larger side can be split.
    return rows.join(owner, "sig", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component"))
