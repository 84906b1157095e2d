"""Fuzzy passages that documents share, by collinear chaining of k-mer seeds.

1. Winnowed seeds: of each ``window`` successive k-word hashes the least is a seed, so that texts
   that agree on window + k - 1 words share one.
   Where one seed is selected again and again, as in a run of one word, a place a window is kept.
2. Seeds are joined with the first place in the corpus that has the same one (least document, then
   least place), not with each other: a passage in thousands of documents gives one match per
   seed and document. Places of a seed that no such passage joins with the first one are then held to all
   places in other documents: the places of a seed meet in one task, each with hashes of the words around it
   and the seeds nearby. Hash joins on equal surroundings give the pairs that agree on ``min_words`` words, that
   agree after an edit, or that have a further seed in reach. A pair that makes a passage joins the classes of
   its places, and places of one class are not compared: rows connect them already, if not each with each.
   A match that joined two classes and lies in no row, since its documents' chain is no passage with all their
   matches, is chained with the matches nearby alone. A pair of places is aligned once.
3. The matches of a pair of documents are chained in one sweep by a Fenwick tree of prefix maxima:
   a chain's score is the words its seeds cover less a cost for the gaps on both sides. Best chains
   are taken off one after the other.
4. The words of both sides are fetched for the chains alone. For a narrow chain (a single seed, mostly)
   they come as sketches of four bits a word first; only a chain that grows to ``min_words`` in these
   goes on. No chain that could grow to a passage is dropped before.
5. Chains are aligned: seeds grow while words agree, what lies between them is aligned by edit
   distance, and passages of at least ``min_words`` words on both sides with ``identity`` or more are
   reported.

Cases: null, empty and short texts have no passages; very long texts are read whole; equal texts are one
passage from end to end; a document repeats in itself only by way of other documents (pairs with
itself are not reported); rows that share an id count as one document, of which the least text is
read; a null id is left out; an empty table gives an empty table; only id and text are read, whatever
other columns there are.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narralith.llm._shared import BATCH_ROWS, cut, drop_cut, released

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Settings:
    k: int = 6
    window: int = 16
    min_words: int = 50
    identity: float = 0.8
    gap: float = 0.25  # cost of each word passed over on either side
    flank: int = 64  # words that a chain may grow by beyond its outer seeds, at each end
    block: int = 16384  # places that are compared in one go; those of one seed always are


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def hashes_of(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def marks_of(words: list[bytes]) -> str:
    """A hexadecimal digit for each word: equal words have equal digits."""
    return DIGITS[hashes_of(words, 1) & 15].tobytes().decode()


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return h << np.uint64(bits) | h >> np.uint64(64 - bits)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``hashes_of(raw.split())`` and where the words start: XXH64 of all words at once, of those of 32 bytes or more one by one."""
    edge = np.flatnonzero(np.diff(np.r_[True, BLANK[np.frombuffer(raw, np.uint8)], True].view(np.int8)))
    start, end = edge[::2], edge[1::2]
    size = end - start
    data = np.frombuffer(raw + bytes(16 + -len(raw) % 8), "<u8")

    def eight(at):
        bits = (at & 7).astype(np.uint64) << np.uint64(3)
        return data[at >> 3] >> bits | data[(at >> 3) + 1] << (np.uint64(63) - bits) << np.uint64(1)

    h, at, left = P5 + size.astype(np.uint64), start.copy(), size.copy()
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        h[on] = _turned(h[on] ^ (_turned(eight(at[on]) * P2, 31) * P1), 27) * P1 + P4
        at[on] += 8
        left[on] -= 8
    rest = eight(at)
    on = np.flatnonzero(left >= 4)
    h[on] = _turned(h[on] ^ ((rest[on] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    rest[on] >>= np.uint64(32)
    left[on] -= 4
    for k in range(3):
        on = np.flatnonzero(left > k)
        h[on] = _turned(h[on] ^ ((rest[on] >> np.uint64(8 * k) & np.uint64(255)) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]])
    return h, start


def hashed(texts: list[bytes | None], room: int = 1 << 20):
    """(hashes of the words of some successive texts, where each text's words start and the last's end): ``room`` bytes or one text at a time."""
    held, size = [], 0
    for last, text in enumerate(texts, 1 - len(texts)):
        held.append(text or b"")
        size += len(held[-1]) + 1
        if size >= room or not last:
            h, start = word_hashes(b"\n".join(held).translate(LOWER))
            yield h, np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in held)]))
            held, size = [], 0


def seeds_of(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word place) of the winnowed seeds of a text."""
    return seeds_of_all([(text or "").encode("utf-8", "surrogatepass")], s)[1:]


def seeds_of_all(texts: list[bytes | None], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which text, hash, word place) of the winnowed seeds of texts, in order."""
    found, row = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for w, edge in hashed(texts):
        size = np.diff(edge)
        h, at, lo = _winnowed(w, edge, s)
        of = np.repeat(np.arange(len(size)), np.diff(lo))
        found.append((row + of, h, at - edge[:-1][of]))
        row += len(size)
    row_, h, at = (np.concatenate(c) for c in zip(*found))
    return row_, h.view(np.int64), at


def _winnowed(w: np.ndarray, edge: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place) of the seeds of successive texts with these word hashes, and where each text's seeds start and the last's end."""
    end = np.repeat(edge[1:], np.diff(edge))  # of the text, for each word
    n = max(len(w) - s.k + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(s.k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : n + i]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    at = np.zeros(0, np.int64)
    if n >= s.window:
        least = _slid(h, s.window, np.minimum)
        whole = np.arange(len(least)) + s.window - 1 + s.k <= end[: len(least)]
        none = np.zeros(s.window - 1, np.uint64)
        most = _slid(np.r_[none, np.where(whole, least, np.uint64(0)), none], s.window, np.maximum)
        at = np.flatnonzero((h == most) & (np.arange(n) + s.k <= end[:n]))  # least in some window
    lo = np.searchsorted(at, edge)
    every, parts, count = h[at].tolist(), [], []
    for a, b, i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), lo[:-1].tolist(), lo[1:].tolist()):
        grams = max(b - a - s.k + 1, 0)
        got = at[i:j]
        if grams < s.window:
            got = a + np.argmin(h[a : a + grams])[None] if grams else at[:0]
        elif len(set(every[i:j])) < j - i:  # the first of equal ones in each window
            rows = np.lib.stride_tricks.sliding_window_view(h[a : a + grams], s.window)
            got = a + np.unique(rows.argmin(1) + np.arange(grams - s.window + 1))
            got = got[thinned(h[got], got, s.window)]
        parts.append(got)
        count.append(len(got))
    at = np.concatenate(parts) if parts else at
    return h[at], at, np.cumsum([0, *count])


def _slid(h: np.ndarray, span: int, of: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``span`` successive numbers."""
    wide = 1
    while 2 * wide <= span:
        h, wide = of(h[:-wide], h[wide:]), 2 * wide
    return of(h[: len(h) - (span - wide)], h[span - wide :]) if wide < span else h


def thinned(h: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Which of the selected places to keep where one hash is selected again and again, as in a run of one word.

    Each window keeps a place with its least hash: the next one kept is the last within ``span`` of the one before, or else the next.
    """
    keep = np.ones(len(at), bool)
    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
    for a, b in zip(edge[:-1], edge[1:]):
        if b - a > 2:
            keep[a + 1 : b] = False
            i = a
            while i < b - 1:
                i = max(i + 1, int(np.searchsorted(at[a:b], at[i] + span, side="right")) + a - 1)
                keep[i] = True
    return keep


class Fenwick:
    """Prefix maxima of (score, item)."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """Maximum over the places below ``i``."""
        out = (float("-inf"), -1)
        while i:
            out = max(out, self.best[i])
            i -= i & -i
        return out


def chains(matches: list[tuple[int, int]], s: Settings) -> list[list[tuple[int, int]]]:
    """Disjoint collinear chains of matches (place here, place there), best first.

    With the cost of a gap linear in the words passed over, the best chain that ends before a match
    is the one of greatest score + gap * (its end here + its end there): a prefix maximum.
    """
    left, out = sorted(set(matches)), []
    while left:
        there = sorted({y for _, y in left})
        place = {y: i for i, y in enumerate(there)}
        tree, score, before = Fenwick(len(there)), [0.0] * len(left), [-1] * len(left)
        waiting: deque[int] = deque()
        for i, (x, y) in enumerate(left):
            while waiting and left[waiting[0]][0] < x:
                j = waiting.popleft()
                tree.put(place[left[j][1]], (score[j] + s.gap * sum(left[j]), j))
            value, j = tree.upto(place[y])
            score[i] = s.k
            if j >= 0:
                dx, dy = x - left[j][0], y - left[j][1]
                gain = min(s.k, dx, dy)
                linked = score[j] + gain - s.gap * (max(0, dx - s.k) + max(0, dy - s.k)) if dx != dy else score[j] + gain - s.gap * max(0, dx - s.k - s.window) * 2
                if linked > s.k:
                    score[i], before[i] = linked, j
            waiting.append(i)
        gone = bytearray(len(left))
        for i in sorted(range(len(left)), key=lambda t: (-score[t], t)):
            if gone[i]:
                continue
            line = []
            while i >= 0 and not gone[i]:
                line.append(i)
                i = before[i]
            if i >= 0:
                break  # the best that is left has lost its start to a better chain: score anew
            chain = [left[j] for j in reversed(line)]
            out.append(chain)
            # what lies in the chain's places here belongs to it or contradicts it; the same place there may be met again
            for step in (-1, 1):
                j = line[0] if step > 0 else line[-1]
                while 0 <= j < len(left) and chain[0][0] <= left[j][0] <= chain[-1][0]:
                    gone[j] = 1
                    j += step
            for j in range(line[-1], line[0] + 1):
                gone[j] = 1
        left = [m for m, g in zip(left, gone) if not g]
    return out


def edits(a: list, b: list) -> int:
    """Edit distance of two word lists: a column of the table at a time, as bits of its steps up and down."""
    if not a or not b:
        return len(a) + len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    top, up, down, out = 1 << len(a) - 1, every, 0, len(a)
    for y in b:
        same = at.get(y, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | (every & ~(diagonal | up)), up & diagonal
        out += bool(more & top) - bool(less & top)
        more = more << 1 | 1
        up, down = ((less << 1) | (every & ~(diagonal | more))) & every, more & diagonal
    return out


def edits_of(w: np.ndarray, i: np.ndarray, j: np.ndarray, start: np.ndarray, end: np.ndarray, to: np.ndarray) -> np.ndarray:
    """``edits`` of the words w[i, start:end] and w[j, start:to] of many rows, of up to 62 words each."""
    a, b = np.maximum(end - start, 0), np.maximum(to - start, 0)
    step = np.arange(64)
    most = w.shape[1] - 1
    mine = w[i[:, None], np.minimum(start[:, None] + step, most)]
    one = np.uint64(1)
    every = (one << a.astype(np.uint64)) - one
    top, up, down, out = (every >> one) + one, every, np.zeros(len(a), np.uint64), a.copy()
    for y in range(int(b.max(initial=0))):
        same = np.packbits(mine == w[j, np.minimum(start + y, most)][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0] & every
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | (every & ~(diagonal | up)), up & diagonal
        out += np.where(y < b, ((more & top) > 0).astype(np.int64) - ((less & top) > 0), 0)
        more = more << one | one
        up, down = ((less << one) | (every & ~(diagonal | more))) & every, more & diagonal & every
    return np.where(a > 0, out, b)


def grow(a: list, b: list, s: Settings, agree: int = 8) -> tuple[int, int, int]:
    """How far both lists agree from their starts, with single words changed where ``agree`` agree after: (words of a, words of b, edits)."""
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 2)):
            x, y = a[i + di : i + di + agree], b[j + dj : j + dj + agree]
            if len(x) == agree and x == y:
                i, j, cost = i + di, j + dj, cost + max(di, dj)
                break
        else:
            break
    return i, j, cost


def align(a: list, b: list, chain: list[tuple[int, int]], s: Settings) -> tuple[int, int, int, int, float]:
    """The passage around a chain whose places refer to ``a`` and ``b``: (start, end) in a, in b, identity."""
    cost = 0
    x, y = chain[0]
    back_a, back_b, c = grow(a[:x][::-1], b[:y][::-1], s)
    cost += c
    start_a, start_b = x - back_a, y - back_b
    end_a, end_b = x + s.k, y + s.k
    for x, y in chain[1:]:
        if x >= end_a and y >= end_b:
            i, j, c = grow(a[end_a:x], b[end_b:y], s)
            cost += c + edits(a[end_a + i : x], b[end_b + j : y])
            end_a, end_b = x + s.k, y + s.k
        else:
            step = max(x + s.k - end_a, y + s.k - end_b)
            if x - y == end_a - end_b:
                end_a, end_b = max(end_a, x + s.k), max(end_b, y + s.k)
            elif step > 0:
                cost += abs((x - y) - (end_a - end_b))
                end_a, end_b = max(end_a, x + s.k), max(end_b, y + s.k)
    i, j, c = grow(a[end_a:], b[end_b:], s)
    cost += c
    end_a, end_b = end_a + i, end_b + j
    return start_a, end_a, start_b, end_b, 1 - cost / max(end_a - start_a, end_b - start_b, 1)


def may_reach(a: str, b: str, first: tuple[int, int], last: tuple[int, int], s: Settings) -> bool:
    """Whether a chain could grow to ``min_words`` on both sides, by the words' digits.

    Equal digits of unequal words let growth go on for too long, and may move an edit by a word or two; so
    five digits are enough after an edit where the words themselves need eight.
    """
    (x0, y0), (x1, y1) = first, last
    for agree in (5, 8):
        left_a, left_b, c = grow(a[:x0][::-1], b[:y0][::-1], s, agree)
        right_a, right_b, d = grow(a[x1 + s.k :], b[y1 + s.k :], s, agree)
        if min(x1 + s.k - x0 + left_a + right_a, y1 + s.k - y0 + left_b + right_b) >= s.min_words:
            return True
        if not c + d:
            break  # without edits both grow alike
    return False


def _pairs(matches: DataFrame, s: Settings, id_type) -> DataFrame:
    """(doc, other, chain, narrow): all chains; a pair's matches meet in one task."""
    schema = T.StructType([T.StructField("doc", id_type), T.StructField("other", id_type), T.StructField("xs", T.ArrayType(T.IntegerType())), T.StructField("ys", T.ArrayType(T.IntegerType())), T.StructField("narrow", T.BooleanType())])

    def found(pair, rows):
        for chain in chains(rows, s):
            wide = min(chain[-1][0] - chain[0][0], chain[-1][1] - chain[0][1]) + s.k
            yield (*pair, [x for x, _ in chain], [y for _, y in chain], wide < 2 * s.k)

    def run(batches):
        pair, rows = None, []
        for b in batches:
            out = []
            for d, o, x, y in zip(*(c.to_pylist() for c in b.columns)):
                if (d, o) != pair:
                    if rows:
                        out += found(pair, rows)
                    pair, rows = (d, o), []
                rows.append((x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds(b))], names=schema.names)
            kept = b
        if rows:
            out = list(found(pair, rows))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds(kept))], names=schema.names)

    def kinds(b):
        return b.column(0).type, b.column(1).type, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()

    return matches.select("doc", "other", "x", "y").repartition("doc", "other").sortWithinPartitions("doc", "other").mapInArrow(released(run), schema)


def _with_words(chained: DataFrame, texts: DataFrame, side: str, places: str, name: str, s: Settings, sketch: bool = False) -> DataFrame:
    """Add the words around a chain on one side and the place of the first of them; of a narrow chain their digits, if ``sketch``.

    A narrow chain that has its digits of the other side already goes on only if it may reach ``min_words``.
    """
    key = texts.select(F.col("id").alias(side), F.col("text").alias("__text"))
    joined = key.join(chained, side)  # Spark broadcasts the chains while they are small and splits a text with very many
    rest = [f for f in joined.schema if f.name != "__text"]
    tested = "mine" in chained.columns and sketch
    schema = T.StructType([*rest, T.StructField(name, T.BinaryType()), T.StructField(f"{name}_at", T.IntegerType())])
    reach = s.min_words + s.k  # what growth to min_words can read, and eight words after an edit

    def run(batches):
        last, words, digits = None, [], ""
        for b in batches:
            t, p = b.schema.get_field_index("__text"), b.schema.get_field_index(places)
            others = zip(*(b.column(c).to_pylist() for c in ("xs", "mine", "mine_at"))) if tested else iter(lambda: (None, None, None), 0)
            parts, at, kept = [], [], []
            for row, (text, place, narrow, (xs, mine, mine_at)) in enumerate(zip(b.column(t).to_pylist(), b.column(p).to_pylist(), b.column("narrow").to_pylist(), others)):
                if text != last:
                    last, words, digits = text, words_of(text), ""
                if narrow and sketch:
                    digits = digits or marks_of(words)
                    lo = max(0, place[0] - reach)
                    part = digits[lo : place[-1] + s.k + reach]
                    if not tested:
                        at.append(lo)
                        parts.append(bytes.fromhex(part + "0" * (len(part) % 2)))
                        continue
                    if not may_reach(mine.hex(), part, (xs[0] - mine_at, place[0] - lo), (xs[-1] - mine_at, place[-1] - lo), s):
                        continue
                lo = max(0, place[0] - s.flank)
                at.append(lo)
                kept.append(row)
                parts.append(b" ".join(words[lo : place[-1] + s.k + s.flank]))
            if tested:
                b = b.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(parts, pa.binary()), pa.array(at, pa.int32())], names=schema.names)

    return joined.mapInArrow(released(run), schema)


def _aligned(chained: DataFrame, texts: DataFrame, s: Settings, id_type, part: bool = False) -> DataFrame:
    """The passages around chains (doc, other, xs, ys, narrow); ``part``: those of few documents, whose texts are set apart first."""
    chained = cut(chained)
    if part:
        ids = cut(chained.select(F.col("doc").alias("id")).union(chained.select("other")).distinct())
        texts = cut(texts.join(ids, "id", "left_semi"))
    mine = cut(_with_words(chained, texts, "doc", "xs", "mine", s, sketch=True))
    theirs = cut(_with_words(mine, texts, "other", "ys", "theirs", s, sketch=True))
    drop_cut(chained)
    drop_cut(mine)
    grown = _with_words(theirs.where("narrow").drop("mine", "mine_at"), texts, "doc", "xs", "mine", s)
    both = theirs.where("not narrow").unionByName(grown)
    out = T.StructType([T.StructField("doc", id_type), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("other", id_type), T.StructField("other_start", T.IntegerType()), T.StructField("other_end", T.IntegerType()), T.StructField("identity", T.DoubleType())])

    def aligned(batches):
        for b in batches:
            rows = []
            for d, o, xs, ys, mine, ma, theirs, ta in zip(*(b.column(c).to_pylist() for c in ("doc", "other", "xs", "ys", "mine", "mine_at", "theirs", "theirs_at"))):
                s0, e0, s1, e1, same = align(mine.split(b" "), theirs.split(b" "), [(x - ma, y - ta) for x, y in zip(xs, ys)], s)
                if min(e0 - s0, e1 - s1) >= s.min_words and same >= s.identity:
                    rows.append((d, s0 + ma, e0 + ma, o, s1 + ta, e1 + ta, same))
            types = [b.schema.field("doc").type, pa.int32(), pa.int32(), b.schema.field("other").type, pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=out.names)

    return both.select("doc", "other", "xs", "ys", "mine", "mine_at", "theirs", "theirs_at").mapInArrow(released(aligned), out).distinct()


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = ((h ^ (h >> np.uint64(31))) + w.astype(np.uint64)) * M1
    return (h ^ (h >> np.uint64(29))) * M2


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = np.r_[False, keys[order][1:] == keys[order][:-1], False]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def buckets(keys: np.ndarray, rows: np.ndarray, label: np.ndarray):
    """The rows of each key that has more than one label, in order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, rows, label = keys[order], rows[order], label[order]
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    first = edge[:-1]
    two = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
    for a, b in zip(first[two].tolist(), edge[1:][two].tolist()):
        yield np.sort(rows[a:b])


class Places:
    """Places of some seeds, all of each, in order of (seed, document, place): which of them share a passage.

    Places that a passage with the seed's first place covers are one class to begin with, and each link found
    joins two classes. Places of one class are not compared: rows join them already.
    """

    AGREE = 8  # words that agree after an edit, as in ``grow``
    TRIED = 1 << 20  # pairs remembered, so as not to be aligned again

    def __init__(self, h, doc, linked, around, room, near, offsets, s: Settings):
        self.s, self.n, self.h, self.doc = s, len(h), h, doc
        self.words, self.room = around, room  # (n, side, reach) from the seed outwards; (n, side)
        self.owner = np.repeat(np.arange(self.n), [len(x) // 8 for x in near])
        self.near, self.offset = np.frombuffer(b"".join(near), np.int64), np.frombuffer(b"".join(offsets), np.int16).astype(np.int64)
        self.mine = np.searchsorted(self.owner, np.arange(self.n + 1))
        self.cls = list(range(self.n))
        self.tops: np.ndarray | None = None  # classes() until the next join
        lead: dict[int, int] = {}
        for i in np.flatnonzero(linked).tolist():
            self.cls[i] = lead.setdefault(int(h[i]), i)
        reach = around.shape[2]
        self.prefix = np.empty((2, reach + 1, self.n), np.uint64)
        for side in (0, 1):
            self.prefix[side, 0] = mixed(h.view(np.uint64), np.zeros(1, np.uint32))
            for d in range(reach):
                self.prefix[side, d + 1] = mixed(self.prefix[side, d], around[:, side, d])
        self.tried: set[int] = set()

    def of(self, i: int) -> int:
        while self.cls[i] != i:
            self.cls[i] = i = self.cls[self.cls[i]]
        return i

    def classes(self) -> np.ndarray:
        if self.tops is None:
            out = np.array(self.cls, np.int64)
            while (out != (top := out[out])).any():
                out = top
            self.tops = out
        return self.tops

    def join(self, i: int, j: int) -> bool:
        """Whether the classes were two; they are one after."""
        i, j = self.of(i), self.of(j)
        if i != j:
            self.cls[max(i, j)] = min(i, j)
            self.tops = None
        return i != j

    def again(self, i: int, j: int) -> bool:
        """Whether the pair has been here before, as far as remembered: what is near two places decides alike each time."""
        pair = i * self.n + j
        if pair in self.tried:
            return True
        if len(self.tried) >= self.TRIED:
            self.tried.clear()
        self.tried.add(pair)
        return False

    def links(self):
        """(i, j, dx, dy, sure): places i < j whose documents share a passage (``sure``, of the match at 0, 0) or might, as matches at dx and dy from them."""
        for i, j in self.whole():
            yield i, j, 0, 0, True
        for i, j in self.edited():
            if self.of(i) != self.of(j) and not self.again(i, j):
                if self.grows(i, j):
                    self.join(i, j)
                    yield i, j, 0, 0, True
                else:
                    yield from self.marked(i, j)
        for i, j in self.apart():
            if self.of(i) != self.of(j) and not self.again(i, j):
                yield from self.marked(i, j)

    def marked(self, i: int, j: int):
        out = self.chained(i, j)
        joined = self.of(i) == self.of(j)
        for _, _, dx, dy in out:
            yield i, j, dx, dy, joined and dx == dy == 0

    def chained(self, i: int, j: int) -> list[tuple[int, int, int, int]]:
        """The matches of the seed and those nearby if their chain makes a passage, or if that is not to be seen from the words here."""
        near = self.beside(i, j)
        if not near or self.of(i) == self.of(j):
            return []
        k, reach, out = self.s.k, self.words.shape[2], [(i, j, 0, 0), *near]
        seed = [-1 - m for m in range(k)]  # equal in both
        a, b = (self.words[p, 0, : self.room[p, 0]].tolist()[::-1] + seed + self.words[p, 1, : self.room[p, 1]].tolist() for p in (i, j))
        x, y = int(self.room[i, 0]), int(self.room[j, 0])
        inside = [(x + dx, y + dy) for _, _, dx, dy in out if 0 <= x + dx <= len(a) - k and 0 <= y + dy <= len(b) - k]
        for chain in chains(inside, self.s):
            if (x, y) in chain:
                break
        else:
            return out  # other matches contradict it: the whole pair decides
        s0, e0, s1, e1, same = align(a, b, chain, self.s)
        if min(e0 - s0, e1 - s1) >= self.s.min_words and same >= self.s.identity:
            self.join(i, j)
            return out
        edge = self.AGREE + 2  # growth reads so far ahead
        cut_off = len(inside) < len(out) or (min(s0, s1) < edge and max(x, y) == reach) or (min(len(a) - e0, len(b) - e1) < edge and max(self.room[i, 1], self.room[j, 1]) == reach)
        return out if cut_off else []

    def whole(self):
        """Places that agree on ``min_words`` words, each with the earliest that has the same ones."""
        need = self.s.min_words - self.s.k
        for left in range(need + 1):
            rows = np.flatnonzero((self.room[:, 0] >= left) & (self.room[:, 1] >= need - left))
            keys = mixed(self.prefix[0, left, rows], np.zeros(1, np.uint32)) ^ self.prefix[1, need - left, rows]
            again = repeated(keys)
            rows, keys = rows[again], keys[again]
            if not len(rows):
                continue
            for group in buckets(keys, rows, self.classes()[rows]):
                other = np.flatnonzero(self.doc[group] != self.doc[group[0]])
                if not len(other):
                    continue
                group = group.tolist()
                for j in group[1:]:
                    i = group[0] if self.doc[j] != self.doc[group[0]] else group[other[0]]
                    if self.join(i, j):
                        yield min(i, j), max(i, j)

    def edited(self):
        """Pairs of classes' places that agree on eight words after an edit, next to where their agreement ends."""
        n, need = self.AGREE, self.s.min_words - self.s.k
        for side in (0, 1):
            w, room = self.words[:, side], self.room[:, side]
            run = np.zeros((w.shape[1] + 1, self.n), np.uint64)  # hash of the eight words from a place on
            for d in range(w.shape[1] - n + 1):
                h = np.zeros(self.n, np.uint64)
                for k in range(n):
                    h = mixed(h, w[:, d + k])
                run[d] = h
            rows = np.arange(self.n)
            for d in range(need):
                rows = rows[room[rows] >= d + n]
                rows, alone = self._agreeing(side, d, rows)
                if not len(rows):
                    break
                fork = rows[~alone]
                if not len(fork):
                    continue
                key = lambda shift, at: mixed(self.prefix[side, d, at], np.zeros(1, np.uint32)) ^ run[d + shift, at]  # noqa: E731,B023
                deep = [fork[room[fork] >= d + shift + n] for shift in range(3)]
                for a, b in ((1, 1), (2, 2), (1, 0)):
                    at = deep[a] if a == b else np.r_[deep[a], deep[b]]
                    keys = key(a, deep[a]) if a == b else np.r_[key(a, deep[a]), key(b, deep[b])]
                    for group in buckets(keys, at, w[at, d]):
                        group = group[np.r_[True, group[1:] != group[:-1]]]
                        yield from (self._across if len(group) > 24 else self._across_few)(group, w[group, d])

    def _agreeing(self, side: int, d: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose prefix others have too, and whether one word follows in all of these."""
        if not len(rows):
            return rows, np.zeros(0, bool)
        now, then = self.prefix[side, d, rows], self.prefix[side, d + 1, rows]
        order = np.argsort(now, kind="stable")
        first = np.flatnonzero(np.r_[True, now[order][1:] != now[order][:-1]])
        size = np.diff(np.r_[first, len(rows)])
        one = np.minimum.reduceat(then[order], first) == np.maximum.reduceat(then[order], first)
        again, alone = np.empty(len(rows), bool), np.empty(len(rows), bool)
        again[order], alone[order] = np.repeat(size > 1, size), np.repeat(one, size)
        return rows[again], alone[again]

    def _across_few(self, group: np.ndarray, word: np.ndarray):
        """As ``_across``, for short groups."""
        items = list(zip(group.tolist(), word.tolist(), map(self.of, group.tolist()), self.doc[group].tolist()))
        times: dict[int, int] = {}
        for _, v, _, _ in items:
            times[v] = times.get(v, 0) + 1
        common = min(times, key=lambda v: (-times[v], v))
        for i, v, c, d in items:
            if v != common:
                for j, u, e, f in items:
                    if c != e and d != f and v != u and (u == common or j > i):
                        yield min(i, j), max(i, j)

    def _across(self, group: np.ndarray, word: np.ndarray):
        """Pairs of different next words, classes and documents; places with the commonest word only meet the rest."""
        cls, doc = self.classes()[group], self.doc[group]
        value, times = np.unique(word, return_counts=True)
        rest = word != value[times.argmax()]
        for a in np.flatnonzero(rest).tolist():
            good = (cls != cls[a]) & (doc != doc[a]) & (word != word[a]) & (~rest | (group > group[a]))
            for b in group[good].tolist():
                yield min(int(group[a]), b), max(int(group[a]), b)

    def grows(self, i: int, j: int) -> bool:
        """Whether growth around the seed alone makes a passage."""
        a, b = ([self.words[p, side, : self.room[p, side]].tolist() for side in (0, 1)] for p in (i, j))
        (left_a, left_b, c), (right_a, right_b, d) = (grow(a[side], b[side], self.s) for side in (0, 1))
        x, y = left_a + right_a + self.s.k, left_b + right_b + self.s.k
        return min(x, y) >= self.s.min_words and 1 - (c + d) / max(x, y) >= self.s.identity

    def beside(self, i: int, j: int) -> list[tuple[int, int, int, int]]:
        """Matches of the seeds nearby."""
        at: dict[int, list[int]] = {}
        for m in range(self.mine[i], self.mine[i + 1]):
            at.setdefault(int(self.near[m]), []).append(int(self.offset[m]))
        return [(i, j, x, int(self.offset[m])) for m in range(self.mine[j], self.mine[j + 1]) for x in at.get(int(self.near[m]), ()) if x * self.offset[m] > 0]

    def apart(self):
        """Pairs of classes' places with a further common seed nearby, beyond where they agree, that a passage may join.

        In a passage of runs that agree (A words, less than ``min_words`` each) and gaps (of l words that cost c), the costs come to
        at most t = 1 - identity of all words. With half of each inner run put to either gap, one gap has
        c <= t l + t/2 (A + A') + t/2 (first A + last A) / (number of gaps): that gap is enough to find the pair.
        """
        s, t = self.s, 1 - self.s.identity
        most = s.min_words - 1
        farthest = int(t * s.flank + 2 * t * most)
        for side in (0, 1):
            mine = np.flatnonzero((self.offset > 0) if side else (self.offset < 0))
            sums = self.sums(side)
            i, o = self.owner[mine], np.abs(self.offset[mine])
            key = mixed(self.h[i].view(np.uint64), np.zeros(1, np.uint32)) ^ mixed(self.near[mine].view(np.uint64), np.full(1, side + 1, np.uint32))
            again = repeated(key)
            i, o, key = i[again], o[again], key[again]
            if not len(i):
                continue
            # the same offset and the same words up to it: the seed lies where they agree
            path = self.prefix[side, np.clip(o - s.k, 0, s.flank - s.k), i]
            order = np.lexsort((path, o, key))
            i, o, key, path = i[order], o[order], key[order], path[order]
            at = np.arange(len(i))
            new_key = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (o[1:] != o[:-1]) | (path[1:] != path[:-1])])
            lo = np.r_[new, len(i)][np.searchsorted(new, at, side="right")]
            ordinal = np.searchsorted(new_key, at, side="right")
            line = ordinal * 1024 + o
            hi = np.searchsorted(line, line + np.minimum(farthest, 1023 - o), side="right")
            # places of a key's largest class meet the rest only
            rest = self.classes()[i] != self._largest(ordinal, self.classes()[i])
            few = np.flatnonzero(rest)
            lo, hi = np.where(rest, lo, np.searchsorted(few, lo)), np.where(rest, hi, np.searchsorted(few, hi))
            size = np.maximum(hi - lo, 0)
            doc, total = self.doc[i], np.r_[0, np.cumsum(size)]
            start = 0
            while start < len(i):
                stop = max(start + 1, int(np.searchsorted(total, total[start] + (1 << 17), side="right")) - 1)
                for low in range(0, int(size[start]), 1 << 17) if stop == start + 1 else (0,):
                    part = size[start:stop] if stop > start + 1 else np.minimum(size[start:stop] - low, 1 << 17)
                    a = np.repeat(at[start:stop], part)
                    b = np.arange(len(a)) + np.repeat(lo[start:stop] + low - np.cumsum(part) + part, part)
                    if len(few):
                        b = np.where(rest[a], b, few[np.minimum(b, len(few) - 1)])
                    cls = self.classes()[i]
                    good = np.flatnonzero((cls[a] != cls[b]) & (doc[a] != doc[b]))
                    a, b = a[good], b[good]
                    # the same words up to the nearer seed's end: it lies where they agree
                    good = np.flatnonzero(self.prefix[side, o[a], i[a]] != self.prefix[side, o[a], i[b]])
                    a, b = a[good], b[good]
                    for at_ in range(0, len(a), 1 << 14):
                        yield from self.close(i, o, a[at_ : at_ + (1 << 14)], b[at_ : at_ + (1 << 14)], side, sums)
                start = stop

    def _largest(self, key: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """For each row the class that most rows of its key have; keys are in order."""
        order = np.lexsort((cls, key))
        new = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]) | (cls[order][1:] != cls[order][:-1])])
        size, of = np.diff(np.r_[new, len(key)]), key[order][new]
        by = np.lexsort((-size, of))
        best = by[np.r_[True, of[by][1:] != of[by][:-1]]]
        return np.repeat(cls[order][new][best], np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]))

    def sums(self, side: int) -> np.ndarray:
        """How many of the words up to each have each of 32 values of their hash: a byte for each value, eight in a number."""
        w = self.words[:, side]
        out = np.zeros((self.n, w.shape[1] + 1, 4), np.uint64)
        byte = np.uint64(1) << ((w & 7).astype(np.uint64) << np.uint64(3))
        for part in range(4):
            np.cumsum(np.where((w >> 3) & 3 == part, byte, np.uint64(0)), axis=1, out=out[:, 1:, part])
        return out

    def run(self, i: np.ndarray, j: np.ndarray, side: int) -> np.ndarray:
        """Words that agree from the seeds on."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.room[i, side], self.room[j, side]).astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefix[side, mid, i] == self.prefix[side, mid, j]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def close(self, i: np.ndarray, o: np.ndarray, a: np.ndarray, b: np.ndarray, side: int, sums: np.ndarray):
        """Of pairs of seeds nearby, a and b, those where the gap from the run to them costs no more than a passage allows: their places."""
        s, t = self.s, 1 - self.s.identity
        most, k, reach = s.min_words - 1, s.k, self.words.shape[2]
        i, j, x, y = i[a], i[b], o[a] - k, o[b] - k
        run, other = self.run(i, j, side), self.run(i, j, 1 - side)

        def keep(good):
            nonlocal i, j, x, y, run, other
            i, j, x, y, run, other = i[good], j[good], x[good], y[good], run[good], other[good]

        room = t / 2 * (run + other + k + most)
        gap = np.maximum(x, y) - run
        keep((x + k > run) & (y + k > run) & (np.abs(x - y) <= t * gap + np.maximum(2 * room, room + t / 2 * most) + 1e-9))
        if not len(i):
            return
        # words of either gap that the other has not: no fewer than these
        in_a, in_b = (np.ascontiguousarray(sums[v, np.maximum(z, run)] - sums[v, run]).view(np.uint8).astype(np.int16) for v, z in ((i, x), (j, y)))
        more = np.maximum(in_a - in_b, 0).sum(1)
        least = np.maximum(more, more - in_a.sum(1) + in_b.sum(1))
        room = t / 2 * (run + other + k + most)
        good = least <= t * np.maximum(np.maximum(x, y) - run, 0) + np.maximum(2 * room, room + t / 2 * most) + 1e-9
        least = least[good]
        keep(good)
        if not len(i):
            return
        w, there = self.words[:, side], self.room[:, side]
        step = np.arange(most - k)
        # words that agree after the seeds nearby, and before them down to the run
        p, q = (x + k)[:, None] + step, (y + k)[:, None] + step
        same = (p < there[i][:, None]) & (q < there[j][:, None])
        same &= w[i[:, None], np.minimum(p, reach - 1)] == w[j[:, None], np.minimum(q, reach - 1)]
        after = np.where(same.all(1), len(step), same.argmin(1))
        p, q = (x - 1)[:, None] - step, (y - 1)[:, None] - step
        same = np.minimum(p, q) >= run[:, None]
        same &= w[i[:, None], np.maximum(p, 0)] == w[j[:, None], np.maximum(q, 0)]
        before = np.where(same.all(1), len(step), same.argmin(1))
        ends = np.maximum(x, y) + k + after >= reach
        room = t / 2 * (run + other + k + np.where(ends, most, np.minimum(k + after + before, most)))
        cost = t * np.maximum(np.maximum(x, y) - run, 0) + np.maximum(2 * room, room + t / 2 * most) + 1e-9
        good = least <= cost
        keep(good)
        cost = cost[good]
        known = edits_of(w, i, j, run, x, y) if len(i) > 12 else None
        for at, (p, q, x, y, r, c) in enumerate(zip(*(v.tolist() for v in (i, j, x, y, run, cost)))):
            pair = (p, q) if p < q else (q, p)
            if self.of(p) != self.of(q) and pair[0] * self.n + pair[1] not in self.tried and (edits(w[p, r : max(x, r)].tolist(), w[q, r : max(y, r)].tolist()) if known is None else known[at]) <= c:
                yield pair


def reach_of(s: Settings) -> int:
    """Words on each side of a seed that decide whether growth comes to ``min_words``, and that hold the seeds nearby."""
    return max(s.min_words + 2 * s.k, s.flank)


def _with_surroundings(occurrences: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(h, doc, x, linked) of open ones, with the words around (hashes of 32 bits, from the place outwards), the words there are on each side, and the shared seeds nearby."""
    # A text's places are bounded by the text.
    lists = occurrences.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("x", "h", "linked", "open"))).alias("of")).where(F.exists("of", lambda o: o["open"]))
    rows = texts.select(F.col("id").alias("doc"), "text").join(lists, "doc")
    reach = reach_of(s)
    schema = T.StructType([T.StructField("h", T.LongType()), texts.schema["id"], T.StructField("x", T.IntegerType()), T.StructField("linked", T.BooleanType()), T.StructField("around", T.BinaryType()), T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()), T.StructField("near", T.BinaryType()), T.StructField("offsets", T.BinaryType())])
    schema = T.StructType([T.StructField("doc", f.dataType) if f.name == "id" else f for f in schema])

    def binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])

    def run(batches):
        for b in batches:
            of, texts_ = b.column(2), b.column(1).cast(pa.binary()).to_pylist()
            edge = of.offsets.to_numpy()
            every = {c: of.values.field(c).to_numpy(zero_copy_only=False) for c in ("h", "x", "linked", "open")}
            held, count = [], 0
            for row, words in enumerate(h[lo:hi] for h, place in hashed(texts_) for lo, hi in zip(place[:-1], place[1:])):
                marks = np.zeros(len(words) + 2 * reach, np.uint32)
                marks[reach : reach + len(words)] = words.astype(np.uint32)
                h, at, linked, open_ = (every[c][edge[row] : edge[row + 1]] for c in ("h", "x", "linked", "open"))
                at = at.astype(np.int64)
                places = np.flatnonzero(open_)
                for lo in range(0, len(places), BATCH_ROWS):
                    part = places[lo : lo + BATCH_ROWS]
                    x = at[part]
                    a, z = np.searchsorted(at, x - s.flank), np.searchsorted(at, x + s.flank, side="right")
                    near = np.arange((z - a).sum()) + np.repeat(a - np.r_[0, np.cumsum(z - a)[:-1]], z - a)
                    offset = at[near] - np.repeat(x, z - a)
                    size = np.add.reduceat(offset != 0, np.r_[0, np.cumsum(z - a)[:-1]])
                    held.append((h[part], np.full(len(part), row), x, linked[part], marks[(x + reach)[:, None] + outward], np.minimum(x, reach), np.clip(len(words) - x - s.k, 0, reach), size, h[near[offset != 0]], offset[offset != 0].astype(np.int16)))
                    count += len(part)
                    if count >= BATCH_ROWS:
                        yield table(b.column(0), held)
                        held, count = [], 0
            if held:
                yield table(b.column(0), held)

    outward = np.r_[-1 - np.arange(reach), s.k + np.arange(reach)]

    def table(docs, held):
        h, row, x, linked, around, left, right, size, near, offset = (np.concatenate(c) for c in zip(*held))
        columns = [pa.array(h), docs.take(pa.array(row)), pa.array(x.astype(np.int32)), pa.array(linked), binary(around, np.full(len(h), 8 * reach)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), binary(near, 8 * size), binary(offset, 2 * size)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(released(run), schema)


def uncovered_matches(again: DataFrame, found: DataFrame, texts: DataFrame, s: Settings, id_type) -> DataFrame:
    """(doc, other, x, y): places of a seed that no passage of ``found`` joins with its first place, and the places in all other documents that could share one."""
    spans = found.groupBy("doc").agg(F.collect_set(F.struct("other", "start", "end", "other_start", "other_end")).alias("spans"))
    joined = lambda p: (p["other"] == F.col("other")) & (F.col("x") >= p["start"]) & (F.col("x") + s.k <= p["end"]) & (F.col("y") >= p["other_start"]) & (F.col("y") + s.k <= p["other_end"])
    own = F.col("doc") == F.col("other")
    linked = (own & (F.col("x") == F.col("y"))) | (~own & F.coalesce(F.exists("spans", joined), F.lit(False)))
    marked = cut(again.join(spans, "doc", "left").select("h", "doc", "x", linked.alias("linked"), (~own & ~linked).alias("bare")))
    open_ = marked.where("bare").select("h").distinct().withColumn("open", F.lit(True))
    places = cut(_with_surroundings(marked.drop("bare").join(open_, "h", "left").withColumn("open", F.coalesce("open", F.lit(False))), texts, s))
    drop_cut(marked)
    order = ["h", "doc", "x"]
    dealt = places.repartition("h").sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("doc", id_type), T.StructField("other", id_type), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("sure", T.BooleanType())])

    def found_in(table: pa.Table):
        col = {c: table.column(c).combine_chunks() for c in table.column_names}
        n = len(table)
        coded = col["doc"].dictionary_encode()
        ids, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        codes_, x_ = codes.tolist(), col["x"].to_pylist()
        around = np.frombuffer(b"".join(col["around"].to_pylist()), np.uint32).reshape(n, 2, reach_of(s))
        group = Places(col["h"].to_numpy(), codes, col["linked"].to_numpy(zero_copy_only=False), around, np.stack([col["left"].to_numpy(), col["right"].to_numpy()], axis=1), col["near"].to_pylist(), col["offsets"].to_pylist(), s)
        rows: set = set()

        def batch():
            got = np.array(sorted(rows), np.int64).reshape(-1, 5)
            rows.clear()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(got[:, 0])), ids.take(pa.array(got[:, 1])), pa.array(got[:, 2].astype(np.int32)), pa.array(got[:, 3].astype(np.int32)), pa.array(got[:, 4].astype(bool))], names=schema.names)

        for i, j, dx, dy, sure in group.links():
            rows.add((codes_[j], codes_[i], x_[j] + dy, x_[i] + dx, sure))
            if len(rows) == 262144:
                yield batch()
        if rows:
            yield batch()

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column("h").to_numpy()
            if sum(x.num_rows for x in held) >= s.block:
                # all places of a seed are read together
                end = int(np.argmax(h != held[-1].column("h")[-1].as_py())) if (h != held[-1].column("h")[-1].as_py()).any() else len(h)
                held.append(b.slice(0, end))
                if end < len(h):
                    yield from found_in(pa.Table.from_batches(held))
                    held = [b.slice(end)]
            else:
                held.append(b)
        if held:
            yield from found_in(pa.Table.from_batches(held))

    matches = cut(dealt.mapInArrow(released(run), schema).groupBy("doc", "other", "x", "y").agg(F.max("sure").alias("sure")))
    drop_cut(places)
    return _not_in(matches, found, s)


def _not_in(matches: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """The matches that no passage of ``found`` with the same documents holds."""
    spans = found.select("doc", "other", "start", "end", "other_start", "other_end")
    known = matches.join(spans, ["doc", "other"]).where((F.col("x") >= F.col("start")) & (F.col("x") + s.k <= F.col("end")) & (F.col("y") >= F.col("other_start")) & (F.col("y") + s.k <= F.col("other_end")))
    return matches.join(known.select("doc", "other", "x", "y").distinct(), ["doc", "other", "x", "y"], "left_anti")


def _chain_of_each(sure: DataFrame, matches: DataFrame, s: Settings) -> DataFrame:
    """(doc, other, chain, narrow): for each match of ``sure`` its chain with the matches nearby alone, as its places were joined by it."""
    one = sure.select("doc", "other", F.col("x").alias("x0"), F.col("y").alias("y0"))
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    close = one.join(matches.select("doc", "other", "x", "y"), ["doc", "other"]).where((F.abs(dx) <= s.flank) & (F.abs(dy) <= s.flank) & ((dx * dy > 0) | ((dx == 0) & (dy == 0))))
    lists = close.groupBy("doc", "other", "x0", "y0").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))
    schema = T.StructType([*lists.select("doc", "other", "xs", "ys").schema, T.StructField("narrow", T.BooleanType())])

    def run(batches):
        for b in batches:
            col = {c: b.column(c).to_pylist() for c in ("x0", "y0", "xs", "ys")}
            got = [next((c for c in chains(list(zip(xs, ys)), s) if (x, y) in c), [(x, y)]) for x, y, xs, ys in zip(*col.values())]
            narrow = [min(c[-1][0] - c[0][0], c[-1][1] - c[0][1]) + s.k < 2 * s.k for c in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[x for x, _ in c] for c in got], pa.list_(pa.int32())), pa.array([[y for _, y in c] for c in got], pa.list_(pa.int32())), pa.array(narrow, pa.bool_())], names=schema.names)

    return lists.mapInArrow(released(run), schema)


def single_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): of rows that share an id the least text; rows without id are left out."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    repeated = cut(texts.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"))
    n = repeated.count()
    if not n:
        return texts
    right = F.broadcast(repeated) if n <= 400_000 else repeated
    return texts.join(right, "id", "left_anti").unionByName(texts.join(right, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))


def passages(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, start, end, other, other_start, other_end, identity), places in words; ``other`` has the earlier copy."""
    id_type = docs.schema[id_col].dataType
    texts = single_texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("doc", id_type), T.StructField("x", T.IntegerType())])

    def seeds(batches):
        for b in batches:
            rows, h, x = seeds_of_all(b.column(1).cast(pa.binary()).to_pylist(), s)
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(pa.array(rows)), pa.array(x.astype(np.int32))], names=schema.names)

    every = cut(texts.mapInArrow(released(seeds), schema))
    first = every.groupBy("h").agg(F.min(F.struct("doc", "x")).alias("p"), F.count("*").alias("c")).where("c > 1")
    again = cut(every.join(first, "h").select("h", "doc", "x", F.col("p.doc").alias("other"), F.col("p.x").alias("y")))
    drop_cut(every)
    found = cut(_aligned(_pairs(again.where("doc <> other").select("doc", "other", "x", "y"), s, id_type), texts, s, id_type))
    rest = cut(uncovered_matches(again, found, texts, s, id_type))
    more = cut(_aligned(_pairs(rest, s, id_type), texts, s, id_type, part=True))
    # a match that joined two classes is in a row, if need be without the pair's other matches
    bare = cut(_not_in(rest.where("sure"), more, s))
    if not bare.isEmpty():
        more = more.unionByName(_aligned(_chain_of_each(bare, rest, s), texts, s, id_type, part=True))
    return found.unionByName(more).distinct()
