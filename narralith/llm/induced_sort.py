"""External induced sorting of suffixes with their common prefixes.

The suffixes of a text are sorted by induction from its LMS suffixes (those that start a local
minimum): one pass over the buckets of first symbols upwards places the L-type suffixes, one pass
downwards the S-type ones. What is still to be placed waits in a priority queue of tuples (position,
common prefix with the tuple before it), one bucket per first symbol, whose buckets go to disk when
they outgrow their memory. The common prefix of two suffixes placed one after the other is one
more than the least common prefix between the suffixes that they were induced from, so it travels
with the tuples and no text is compared again.

The LMS suffixes themselves are sorted by naming the LMS substrings and sorting the string of names:
by prefix doubling when it fits in memory, else by the same induction one level down.

Everything moves in batches of bounded size; the text and the flags per position may be memory maps.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict

import numpy as np

#: Tuples handled at once, tuples a queue holds in memory, names sorted in memory.
BATCH, HELD, BASE = 1 << 18, 2 << 20, 4 << 20
#: Common prefixes as they travel; the greatest value stands for no bound.
LCP = np.uint16
NEVER = 65535


class Queue:
    """Tuples by first symbol, in the order they came; the memory of all buckets together is bounded."""

    def __init__(self, folder: str, held: int):
        self.folder, self.limit, self.held = folder, held, 0
        self.chunks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self.files: dict[int, str] = {}
        self.kind = np.dtype([("pos", "<i8"), ("lcp", LCP)])

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.chunks[symbol].append((pos, lcp))
        self.held += len(pos)
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        for symbol, parts in self.chunks.items():
            path = self.files.setdefault(symbol, os.path.join(self.folder, f"{id(self)}-{symbol}"))
            with open(path, "ab") as f:
                for pos, lcp in parts:
                    rows = np.empty(len(pos), self.kind)
                    rows["pos"], rows["lcp"] = pos, lcp
                    rows.tofile(f)
        self.chunks.clear()
        self.held = 0

    def has(self, symbol: int) -> bool:
        return symbol in self.chunks or symbol in self.files

    def take(self, symbol: int):
        """Batches of a bucket in order; what is pushed to it meanwhile is for the next call."""
        path, parts = self.files.pop(symbol, None), self.chunks.pop(symbol, [])
        self.held -= sum(len(p) for p, _ in parts)
        if path:
            size = os.path.getsize(path) // self.kind.itemsize
            moved = path + f"-{size}"
            os.rename(path, moved)
            for at in range(0, size, BATCH):
                rows = np.fromfile(moved, self.kind, BATCH, offset=at * self.kind.itemsize)
                yield rows["pos"].copy(), rows["lcp"].copy()
            os.remove(moved)
        for pos, lcp in _joined(parts):
            yield pos, lcp

    def take_reversed(self, symbol: int):
        """Batches of a bucket from its end."""
        path, parts = self.files.pop(symbol, None), self.chunks.pop(symbol, [])
        self.held -= sum(len(p) for p, _ in parts)
        for pos, lcp in reversed(list(_joined(parts))):
            yield pos[::-1], lcp[::-1]
        if path:
            size = os.path.getsize(path) // self.kind.itemsize
            for end in range(size, 0, -BATCH):
                at = max(0, end - BATCH)
                rows = np.fromfile(path, self.kind, end - at, offset=at * self.kind.itemsize)
                yield rows["pos"][::-1].copy(), rows["lcp"][::-1].copy()
            os.remove(path)


def _joined(parts):
    """Small chunks put together, large ones cut, to batches of bounded size."""
    some, n = [], 0
    for pos, lcp in parts:
        for at in range(0, len(pos), BATCH):
            some.append((pos[at : at + BATCH], lcp[at : at + BATCH]))
            n += len(some[-1][0])
            if n >= BATCH:
                yield np.concatenate([p for p, _ in some]), np.concatenate([x for _, x in some])
                some, n = [], 0
    if some:
        yield np.concatenate([p for p, _ in some]), np.concatenate([x for _, x in some])


class Minima:
    """Least value between any two places of an array, from tables of powers of two."""

    def __init__(self, values: np.ndarray):
        self.table = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minimum over [start, end), which must not be empty."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.table[0].dtype)
        for k in np.unique(level):
            at = level == k
            t = self.table[k]
            out[at] = np.minimum(t[start[at]], t[end[at] - (1 << k)])
        return out


class Inducer:
    """One induction pass: takes batches of placed suffixes, queues the suffixes before them."""

    def __init__(self, text: np.ndarray, symbols: int, queue: Queue, cap: int):
        self.text, self.queue, self.cap = text, queue, cap
        self.since = np.full(symbols, NEVER, LCP) if cap else None
        self.seen = np.zeros(symbols, bool) if cap else None

    def feed(self, pos: np.ndarray, lcp: np.ndarray, keep) -> None:
        if not len(pos):
            return
        at = np.flatnonzero(pos > 0)
        before = self.text[pos[at] - 1]
        ok = keep(before, at)
        at, before = at[ok], before[ok]
        if len(at):
            order = np.argsort(before, kind="stable")
            at, before = at[order], before[order]
            first = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
            group = before[first].astype(np.int64)
        if self.cap:
            low = Minima(lcp)
            whole = lcp.min()
            if len(at):
                start = np.empty_like(at)
                start[1:] = at[:-1] + 1
                start[first] = 0
                least = low.between(start, at + 1)
                least[first] = np.minimum(least[first], self.since[group])
                value = np.minimum(least.astype(np.int32) + 1, self.cap).astype(LCP)
                value[first] = np.where(self.seen[group], value[first], 0)
            self.since = np.minimum(self.since, whole)
            if len(at):
                self.seen[group] = True
                last = at[np.r_[first[1:], len(at)] - 1]
                rest = np.full(len(last), NEVER, LCP)
                inner = last + 1 < len(pos)
                rest[inner] = low.between(last[inner] + 1, np.full(inner.sum(), len(pos)))
                self.since[group] = rest
        elif len(at):
            value = np.zeros(len(at), LCP)
        if len(at):
            ends = np.r_[first[1:], len(at)]
            for g, a, b in zip(group.tolist(), first.tolist(), ends.tolist()):
                self.queue.push(g, pos[at[a:b]] - 1, value[a:b])


def common(text: np.ndarray, i: int, j: int, cap: int) -> int:
    n = min(cap, len(text) - i, len(text) - j)
    differ = np.flatnonzero(text[i : i + n] != text[j : j + n])
    return int(differ[0]) if len(differ) else n


def commons(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes, up to ``cap``, of suffix pairs."""
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    while len(alive):
        x, y = a[alive] + out[alive], b[alive] + out[alive]
        ok = (x < len(text)) & (y < len(text)) & (out[alive] < cap)
        alive, x, y = alive[ok], x[ok], y[ok]
        alive = alive[text[x] == text[y]]
        out[alive] += 1
    return out.astype(LCP)


def lms_positions(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the LMS suffixes, and which positions are S-type."""
    n = len(text)
    # type follows the next differing symbol; the last position is L, being followed by the end
    up = np.zeros(n, bool)
    differ = np.flatnonzero(text[1:] != text[:-1])
    rising = text[differ] < text[differ + 1]
    runs = np.diff(np.r_[-1, differ])
    up[: differ[-1] + 1 if len(differ) else 0] = np.repeat(rising, runs)
    return np.flatnonzero(up[1:] & ~up[:-1]) + 1, up


def name_substrings(text: np.ndarray, symbols: int, lms: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings: symbols with their types, up to and with the next LMS position."""
    n = len(text)
    bits = int(2 * symbols + 2).bit_length()
    per = max(1, 62 // bits)
    length = np.r_[np.diff(lms) + 1, n - lms[-1]]

    def word(rows: np.ndarray, depth: int) -> np.ndarray:
        key = np.zeros(len(rows), np.int64)
        for k in range(depth, depth + per):
            at = lms[rows] + k
            inside = k < length[rows]
            at = np.minimum(at, n - 1)
            key = (key << bits) | np.where(inside, 2 * text[at].astype(np.int64) + up[at] + 1, 0)
        return key

    _, rank = np.unique(word(np.arange(len(lms)), 0), return_inverse=True)
    depth = per
    rows = np.flatnonzero(length > depth)
    while len(rows):
        # a longer substring can tie only with substrings as long: the types make them prefix-free
        key = word(rows, depth)
        order = np.lexsort((key, rank[rows]))
        r, k = rank[rows][order], key[order]
        fresh = np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])]
        head = np.r_[True, r[1:] != r[:-1]]
        # spread ranks to make room for the new ones behind the old
        extra = np.cumsum(fresh & ~head)
        base = np.maximum.accumulate(np.where(head, extra, 0))
        split_at, split_n = r[head], np.add.reduceat((fresh & ~head).astype(np.int64), np.flatnonzero(head))
        shift = np.zeros(int(rank.max()) + 2, np.int64)
        shift[split_at + 1] = split_n
        shift = np.cumsum(shift)
        moved = rank + shift[rank]
        moved[rows[order]] = r + shift[r] + (extra - base)
        rank = moved
        depth += per
        rows = rows[length[rows] > depth]
    return rank


def doubled(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Suffix order of a string of names in memory, by prefix doubling; up to ``depth`` names if given."""
    _, rank = np.unique(names, return_inverse=True)
    n, k = len(names), 1
    while rank.max() < n - 1 and (depth is None or k < depth):
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + nxt, return_inverse=True)
        k *= 2
    return np.argsort(rank, kind="stable")


def induce(text: np.ndarray, symbols: int, cap: int, folder: str, visit, base: int = BASE, held: int = HELD) -> None:
    """Sort the suffixes of ``text`` (values below ``symbols``); order past ``cap`` symbols is left open if cap > 0.

    ``visit(pos, lcp)`` gets batches in descending order; lcp[i] (up to cap) is that with the suffix visited before.
    """
    n = len(text)
    if not n:
        return
    lms, up = lms_positions(text)
    seeds = Queue(folder, held)
    if len(lms):
        rank = name_substrings(text, symbols, lms, up)
        if rank.max() == len(lms) - 1:
            order = np.argsort(rank)
        elif len(rank) <= base:
            order = doubled(rank, cap or None)
        else:
            parts: list[np.ndarray] = []
            induce(rank, int(rank.max()) + 1, 0, folder, lambda p, _: parts.append(p.copy()), base, held)
            order = np.concatenate(parts)[::-1]
        at = lms[order]
        lcp = np.r_[LCP(0), commons(text, at[:-1], at[1:], cap)] if cap else np.zeros(len(at), LCP)
        sym = text[at]
        cuts = np.flatnonzero(np.r_[True, sym[1:] != sym[:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            seeds.push(int(sym[a]), at[a:b], lcp[a:b])
    del up

    waiting, placed = Queue(folder, held), Queue(folder, held)
    inducer = Inducer(text, symbols, waiting, cap)
    used = np.unique(text).tolist()
    if int(text[-1]) in used:
        waiting.push(int(text[-1]), np.array([n - 1]), np.zeros(1, LCP))  # the end precedes everything
        if cap:
            inducer.seen[int(text[-1])] = True
            inducer.since[int(text[-1])] = 0
    for c in used:
        last = -1
        if cap:
            inducer.since[:] = 0  # nothing is shared across first symbols
        while waiting.has(c):
            for pos, lcp in waiting.take(c):
                placed.push(c, pos, lcp)
                last = int(pos[-1])
                inducer.feed(pos, lcp, lambda before, at: before >= c)
        for pos, lcp in seeds.take(c):
            lcp = lcp.copy()
            if cap and lcp[0] == 0:
                lcp[0] = common(text, last, int(pos[0]), cap) if last >= 0 else 0
            inducer.feed(pos, lcp, lambda before, at: before > c)

    waiting = Queue(folder, held)
    inducer = Inducer(text, symbols, waiting, cap)
    for c in reversed(used):
        last, link = -1, 0
        if cap:
            inducer.since[:] = 0
        while waiting.has(c):
            for pos, lcp in waiting.take(c):
                visit(pos, lcp)
                last = int(pos[-1])
                inducer.feed(pos, lcp, lambda before, at: before <= c)
        for pos, above in placed.take_reversed(c):
            # a placed tuple's value is that with the one below it, which is visited next
            if cap:
                link = link if last < 0 or link is None else link
                lead = common(text, last, int(pos[0]), cap) if last >= 0 and link == 0 else link
                lcp = np.r_[LCP(lead), above[:-1]]
                link, last = int(above[-1]), int(pos[-1])
            else:
                lcp = above
            visit(pos, lcp)
            inducer.feed(pos, lcp, lambda before, at: before < c)


def repeated_starts(text: np.ndarray, symbols: int, length: int, base: int = BASE, held: int = HELD, flags: np.ndarray | None = None) -> np.ndarray:
    """Flags of the positions whose ``length`` symbols also start at another position."""
    if not 0 < length < NEVER:
        raise ValueError(f"length must be from 1 to {NEVER - 1}")
    found = flags if flags is not None else np.zeros(len(text), bool)
    last = [-1]

    def visit(pos, lcp):
        hit = np.flatnonzero(lcp >= length)
        found[pos[hit]] = True
        found[pos[hit[hit > 0] - 1]] = True
        if len(hit) and hit[0] == 0 and last[0] >= 0:
            found[last[0]] = True
        last[0] = int(pos[-1])

    with tempfile.TemporaryDirectory() as folder:
        induce(text, symbols, length, folder, visit, base, held)
    return found
