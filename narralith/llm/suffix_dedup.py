"""Removal of byte strings that occur more than once, by suffix sorting.

A string of ``length`` bytes is removed wherever it starts, when it starts at another place too, in
the same text or in another; texts are judged as they came in.

Dealing out. Each start of a ``length``-byte window belongs to the window's anchor, the place of
its least ``gram``-byte hash. What a window's anchor is depends on its bytes alone, so equal
windows have equal anchor grams and lie at equal distances from them. The starts that share an
anchor are neighbours and make one segment: so each start is in one segment, and equal windows are
in segments with one key. Keys that occur once need no further look. Equal segments of a key are
collapsed with their count (all their windows repeat); what remains, segments of one key with
different bytes, is dealt out by key.

Sorting. Each task writes its segments to one text on disk, with a separator between, and sorts its
suffixes by external induction (:mod:`narralith.llm.induced_sort`): windows that share ``length``
bytes with a neighbour in that order repeat. The task's scratch files are gone when it ends, and a
lost task starts over.

Cases: null is the empty text; a text shorter than ``length`` bytes keeps all; overlapping and
touching repeats are one span; repeated rows are removed whole when long enough, as each is
elsewhere too; a null id is an id of its own; an empty table gives an empty table; columns of the
input pass through, but one named like an output column is replaced.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narralith.llm import induced_sort
from narralith.llm._shared import cut, drop_cut, released

OUTPUT = ["n_bytes", "n_removed", "n_spans", "kept"]


@dataclass(frozen=True)
class Settings:
    length: int = 200
    gram: int = 64  # a power of two below length
    piece: int = 1 << 20  # bytes hashed at once, at most 2^22
    shard_bytes: int = 8 << 20
    broadcast_bytes: int = 48 << 20  # of all spans; more are joined by id



_BITS = 23
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE)])
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _INVERSE)])


def segments(buf: np.ndarray, offset: np.ndarray, size: np.ndarray, s: Settings):
    """Segments of texts that lie one after the other in ``buf``: (key, content hash, text number, first start, last start)."""
    n, w = len(buf), s.length - s.gram + 1
    starts = np.concatenate([np.arange(o, o + z - s.length + 1) for o, z in zip(offset.tolist(), size.tolist()) if z >= s.length] or [np.zeros(0, np.int64)])
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    coded = _BYTE[buf]
    h, m, power = coded, 1, _BASE
    while m < s.gram:
        h = h[:-m] * power + h[m:]
        m, power = 2 * m, power * power
    h = _mix(h)
    low = np.uint64((1 << _BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    m = 1
    while 2 * m <= w:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    if w > m:
        least = np.minimum(least[: len(least) - (w - m)], least[w - m :])
    owner = (least[starts] & low).astype(np.int64)
    fresh = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)])
    a, b = starts[fresh], starts[np.r_[fresh[1:], len(starts)] - 1]
    _Powers.reach(n + 1)
    total = np.r_[np.uint64(0), np.cumsum(coded * _Powers.up[:n])]
    content = _mix((total[b + s.length] - total[a]) * _Powers.down[a] + (b - a).astype(np.uint64))
    text = np.searchsorted(offset, a, side="right") - 1
    return h[owner[fresh]].view(np.int64), content.view(np.int64), text, a - offset[text], b - offset[text]


def _pieces(texts, s: Settings):
    """Groups of (row, place in the text, bytes) of bounded size; a very long text comes in pieces that overlap by length - 1."""
    group, held = [], 0
    for row, raw in enumerate(texts):
        for at in range(0, max(1, len(raw)), s.piece):
            part = raw[at : at + s.piece + s.length - 1]
            if len(part) >= s.length:
                group.append((row, at, part))
                held += len(part)
            if held >= s.piece:
                yield group
                group, held = [], 0
    if group:
        yield group


def anchored(docs: DataFrame, s: Settings) -> DataFrame:
    """(key, content, id, v, a, b): every segment of every text of (id, v, text)."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("content", T.LongType()), docs.schema["id"], T.StructField("v", T.LongType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])

    def run(batches):
        for batch in batches:
            # one text at a time: a batch of long ones is not held twice
            texts = ((t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(2))
            for group in _pieces(texts, s):
                size = np.array([len(p) for _, _, p in group])
                offset = np.r_[0, np.cumsum(size)[:-1]]
                key, content, text, a, b = segments(np.frombuffer(b"".join(p for _, _, p in group), np.uint8), offset, size, s)
                rows = np.array([r for r, _, _ in group])[text] if len(text) else text
                place = np.array([p for _, p, _ in group])[text] if len(text) else text
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), batch.column(0).take(take), batch.column(1).take(take), pa.array((a + place).astype(np.int32)), pa.array((b + place).astype(np.int32))], names=[f.name for f in schema])

    return docs.select("id", "v", "text").mapInArrow(released(run), schema)


def repeated_runs(rows: DataFrame, s: Settings) -> DataFrame:
    """(key, content, lo, hi): runs of window starts, within each segment of (key, content, bytes), that start elsewhere too."""

    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            path, names, ends, size = os.path.join(folder, "text"), [], [], 0
            with open(path, "wb") as f:
                for batch in batches:
                    for key, content, raw in zip(*(c.to_pylist() for c in batch.columns)):
                        (np.frombuffer(raw, np.uint8).astype(np.uint16) + 1).tofile(f)
                        np.zeros(1, np.uint16).tofile(f)  # the separator
                        names.append((key, content))
                        size += len(raw) + 1
                        ends.append(size - 1)
            if not names:
                return
            text = np.memmap(path, np.uint16, "r")
            flags = np.memmap(os.path.join(folder, "flags"), bool, "w+", shape=(size,))
            induced_sort.repeated_starts(text, 257, s.length, flags=flags)
            end = np.array(ends)
            start = np.r_[0, end[:-1] + 1]
            for at in range(0, len(names), 4096):
                out = []
                for k in range(at, min(at + 4096, len(names))):
                    on = flags[start[k] : end[k] - s.length + 1]
                    edge = np.flatnonzero(np.diff(np.r_[False, on, False]))
                    out += [(*names[k], lo, hi - 1) for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "content", "lo", "hi"])

    return rows.mapInArrow(released(run), "key long, content long, lo int, hi int")


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _merged_spans(spans: DataFrame) -> DataFrame:
    """One row per (id, v) with its spans sorted and joined; a text's spans are bounded by the text."""
    lists = spans.groupBy("id", "v").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    schema = T.StructType([*lists.schema.fields[:2], T.StructField("s", T.ArrayType(T.IntegerType())), T.StructField("e", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for b in batches:
            done = [_merge(list(zip(s, e))) for s, e in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[x for x, _ in d] for d in done], pa.list_(pa.int32())), pa.array([[y for _, y in d] for d in done], pa.list_(pa.int32()))], names=["id", "v", "s", "e"])

    return lists.mapInArrow(released(run), schema)


def repeated_spans(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, v, s, e): byte spans to remove of each text that has any; v is a 64-bit hash of the text, which tells rows of one id apart."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("v"), F.col(text_col).alias("text"))
    every = cut(anchored(texts, s))
    often = every.groupBy("key").agg(F.count("*").alias("c"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("c > 1").select("key", (F.col("lo") == F.col("hi")).alias("one"))
    some = cut(every.join(often, "key"))
    drop_cut(every)
    span = lambda lo, hi: (lo.alias("s"), (hi + s.length).alias("e"))
    spans = some.where("one").select("id", "v", *span(F.col("a"), F.col("b")))
    mixed = some.where("not one")
    kinds = cut(mixed.groupBy("key", "content").agg(F.count("*").alias("c"), F.min(F.struct("id", "v", "a", "b")).alias("at")))
    whole = kinds.where("c > 1").select("key", "content", F.lit(0).alias("lo"), (F.col("at.b") - F.col("at.a")).alias("hi"))
    total = kinds.agg(F.sum(F.col("at.b") - F.col("at.a") + s.length)).first()[0] or 0

    wanted = kinds.groupBy("at.id", "at.v").agg(F.collect_list(F.struct("key", "content", "at.a", "at.b")).alias("of"))
    size = wanted.agg(F.sum(64 + 40 * F.size("of"))).first()[0] or 0
    few = size <= s.broadcast_bytes
    right = wanted.select(F.col("id").alias("__id"), F.col("v").alias("__v"), "of")
    rows = texts.join(F.broadcast(right) if few else right, F.col("id").eqNullSafe(F.col("__id")) & (F.col("v") == F.col("__v"))).select("text", "of")

    def fetch(batches):
        for b in batches:
            for text, of in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for at in range(0, len(of), 8192):
                    part = of[at : at + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([x["key"] for x in part], pa.int64()), pa.array([x["content"] for x in part], pa.int64()), pa.array([raw[x["a"] : x["b"] + s.length] for x in part], pa.binary())], names=["key", "content", "bytes"])

    shards = max(1, -(-total // s.shard_bytes))
    runs = repeated_runs(rows.mapInArrow(released(fetch), "key long, content long, bytes binary").repartition(shards, "key"), s)
    runs = runs.join(kinds.where("c = 1").select("key", "content"), ["key", "content"], "left_semi").unionByName(whole)
    found = mixed.join(runs, ["key", "content"]).select("id", "v", *span(F.col("a") + F.col("lo"), F.col("a") + F.col("hi")))
    return cut(_merged_spans(spans.unionByName(found)))


def remove_repeats(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """The input's columns plus ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``: the bytes that stay.

    With ``as_text`` these come as a string, without the rest of a character that a span has cut in two.
    """
    spans = repeated_spans(docs, s, id_col, text_col)
    size = spans.agg(F.sum(64 + 8 * F.size("s"))).first()[0] or 0
    right = spans.select(F.col("id").alias("__id"), F.col("v").alias("__v"), F.col("s").alias("__s"), F.col("e").alias("__e"))
    rest = [f for f in docs.schema if f.name not in OUTPUT]
    left = docs.select(*[F.col(f"`{f.name}`") for f in rest])
    joined = left.join(F.broadcast(right) if size <= s.broadcast_bytes else right, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__v")), "left").drop("__id", "__v")
    schema = T.StructType([*rest, *[T.StructField(c, T.LongType()) for c in OUTPUT[:3]], T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    at = [f.name for f in rest].index(text_col)

    def run(batches):
        for b in batches:
            n, gone, spans_, kept = [], [], [], []
            for text, s_, e_ in zip(b.column(at).to_pylist(), b.column(len(rest)).to_pylist(), b.column(len(rest) + 1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                parts, last = [], 0
                for x, y in zip(s_ or (), e_ or ()):
                    parts.append(raw[last:x])
                    last = y
                stays = b"".join([*parts, raw[last:]])
                n.append(len(raw))
                gone.append(len(raw) - len(stays))
                spans_.append(len(s_ or ()))
                kept.append(stays.decode("utf-8", "ignore") if as_text else stays)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans_, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary())], names=[f.name for f in schema])

    return joined.mapInArrow(released(run), schema)
