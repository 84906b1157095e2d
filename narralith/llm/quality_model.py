"""Quality classifier: kernel ridge on document statistics.

Each text is reduced to a few statistics. Random Fourier features approximate a Gaussian kernel on
them; every partition adds up its share of the normal equations, the shares are summed in two
levels, and the driver solves one small system (features + 1 unknowns). Raw scores of a fold kept
out of that fit are binned on a fixed grid and calibrated by isotonic regression.

Labels enter by their own column alone; identifiers, language and source are never inputs.

Cases: null and empty texts have the statistics of a text without words; a null label, or one that
no document has, is not learned from; several labels of one document all count; without any label,
or with one class only, every score is that class's rate (0.5 without labels); repeated rows repeat
their score; very long texts are read whole, their statistics are numbers of fixed count; an empty table
gives an empty table; other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narralith.llm._shared import cut, drop_cut, released

#: Bytes whose shares are statistics of their own.
BYTE_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "mark": b"!?",
    "bar": b"|<>{}[]\\^~_=+/",
    "symbol": b"#$%&*@",
    "stop": b".,;:",
    "quote": b"\"'()-",
    "line": b"\n",
}
NAMES = [*BYTE_GROUPS, "log_words", "word_len", "distinct", "stutter", "shout", "short", "capital", "bare_end", "repeat_pairs"]
_MASKS = np.stack([np.isin(np.arange(256), np.frombuffer(g, np.uint8)) for g in BYTE_GROUPS.values()], axis=1).astype(float)


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, shares on a square-root scale."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    shares = np.bincount(raw, minlength=256) @ _MASKS / max(1, len(raw))
    words = text.split()
    n = len(words)
    if not n:
        return [*np.sqrt(shares), *[0.0] * (len(NAMES) - len(BYTE_GROUPS))]
    sizes = list(map(len, words))
    pairs = list(zip(words, words[1:]))
    return [
        *np.sqrt(shares),
        np.log1p(n),
        np.log1p(sum(sizes) / n),
        len(set(words)) / n,
        np.sqrt(sum(map(eq, words, words[1:])) / n),
        np.sqrt(sum(map(str.isupper, words)) / n),
        sum(1 for s in sizes if s <= 3) / n,
        np.sqrt(sum(map(str.istitle, words)) / n),
        sum(map(str.isalnum, words)) / n,
        np.sqrt(1 - len(set(pairs)) / len(pairs)) if pairs else 0.0,
    ]


@dataclass(frozen=True)
class Settings:
    features: int = 256
    gamma: float = 0.02  # of the Gaussian kernel exp(-gamma |x - y|^2) on standardised statistics
    ridge: float = 1e-4  # per labelled row
    seed: int = 11
    grid: int = 400  # calibration bins per unit of raw score


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    base: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.beta[:-1] + self.beta[-1] if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if not len(self.knots):
            return np.full(len(raw), self.base)
        # A thousandth of a plain squash keeps the order of documents on one calibrated level.
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 / (1 + np.exp(-4 * (np.clip(raw, -5, 5) - 0.5))), 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots and their non-decreasing levels."""
    blocks: list[list[float]] = []  # sum, count, weighted x
    for a, t, c in zip(x, total, count):
        blocks.append([t, c, a * c])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, c2, x2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + c2, blocks[-1][2] + x2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array): one pass over the texts; only the numbers move on."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "stats"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(released(run), schema)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(NAMES))


def _sum_blobs(df: DataFrame, width: int) -> np.ndarray:
    """Sum of one array of doubles per row, in two levels, so the driver gets a few arrays at most."""

    def add(batches):
        total = np.zeros(width)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["blob"])

    parts = df.repartition(8).mapInArrow(released(add), "blob binary").collect()
    return sum((np.frombuffer(r.blob) for r in parts), np.zeros(width))


def fit(stats: DataFrame, labels: DataFrame, settings: Settings = Settings(), label_col: str = "quality", label_id: str = "doc_id", fold: str = "crc32(cast(id as string))") -> Model:
    """Learn from (id, stats) and labels; three quarters by ``fold`` fit the ridge, the rest the calibration."""
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("double").alias("y")).dropna()
    rows = cut(stats.join(known, "id").select("stats", "y", (F.expr(f"{fold} div 4 % 4") == 3).alias("later")))
    k, d = len(NAMES), settings.features

    def moments(batches):
        total = np.zeros(2 * k + 2)
        for b in batches:
            x, y = _matrix(b.column(0)), b.column(1).to_numpy()
            total += np.concatenate([x.sum(0), (x * x).sum(0), [len(x), y.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["blob"])

    m = _sum_blobs(rows.select("stats", "y").mapInArrow(released(moments), "blob binary"), 2 * k + 2)
    n, positive = m[-2], m[-1]
    mean = m[:k] / max(n, 1)
    scale = np.sqrt(np.maximum(m[k : 2 * k] / max(n, 1) - mean**2, 0))
    scale[scale < 1e-6] = 1
    rng = np.random.default_rng(settings.seed)
    model = Model(mean, scale, rng.normal(size=(k, d)) * np.sqrt(2 * settings.gamma), rng.uniform(0, 2 * np.pi, d), np.zeros(d + 1), np.zeros(0), np.zeros(0), positive / n if n else 0.5)
    if not 0 < positive < n:
        drop_cut(rows)
        return model

    def normal(batches):
        a, b_ = np.zeros((d + 1, d + 1)), np.zeros(d + 1)
        for b in batches:
            z = model.lift(_matrix(b.column(0)))
            z = np.column_stack([z, np.ones(len(z))])
            a += z.T @ z
            b_ += z.T @ b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel(), b_]).tobytes()], pa.binary())], names=["blob"])

    sums = _sum_blobs(rows.where("not later").select("stats", "y").mapInArrow(released(normal), "blob binary"), (d + 1) * (d + 2))
    a, b_ = sums[: (d + 1) ** 2].reshape(d + 1, d + 1), sums[(d + 1) ** 2 :]
    fitted = Model(mean, scale, model.omega, model.phase, np.linalg.solve(a + settings.ridge * max(a[-1, -1], 1) * np.diag([1.0] * d + [1e-6]) + 1e-9 * np.eye(d + 1), b_), np.zeros(0), np.zeros(0), model.base)

    def bins(batches):
        for b in batches:
            at = np.round(np.clip(fitted.raw(_matrix(b.column(0))), -1, 2) * settings.grid).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], names=["bin", "y"])

    table = rows.where("later").select("stats", "y").mapInArrow(released(bins), "bin long, y double").groupBy("bin").agg(F.sum("y").alias("t"), F.count("*").alias("c")).orderBy("bin").collect()
    if not table:
        table = rows.select("stats", "y").mapInArrow(released(bins), "bin long, y double").groupBy("bin").agg(F.sum("y").alias("t"), F.count("*").alias("c")).orderBy("bin").collect()
    drop_cut(rows)
    knots, levels = isotonic(np.array([r.bin / settings.grid for r in table]), np.array([r.t for r in table]), np.array([float(r.c) for r in table]))
    return Model(mean, scale, fitted.omega, fitted.phase, fitted.beta, knots, levels, model.base)


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) from (id, stats)."""
    schema = T.StructType([stats.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["id", "score"])

    return stats.select("id", "stats").mapInArrow(released(run), schema)


def keep_good(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, in one pass and without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(at).to_pylist()]).reshape(-1, len(NAMES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(released(run), docs.schema)
