"""Binary annotation files: big-endian counts, integers and UTF-16 strings, one layout per file.

``read`` takes any path Spark reads. Layouts: ``flat`` (spans), ``two_level`` (a main span, name spans
and the annotator's chain), ``equal`` (name pairs with a judgement), ``auto`` (flat, else two_level).
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

NULL = 0xFFFFFFFF


class FormatError(ValueError):
    """The bytes are not in the layout asked for."""


class Cursor:
    """A place in a buffer; reads advance it and never pass the end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def unpack(self, form: str):
        size = struct.calcsize(">" + form)
        if self.at + size > len(self.data):
            raise FormatError(f"byte {self.at}: {size} bytes wanted, {len(self.data) - self.at} left")
        out = struct.unpack_from(">" + form, self.data, self.at)
        self.at += size
        return out if len(out) > 1 else out[0]

    def string(self) -> str | None:
        n = self.unpack("I")
        if n == NULL:
            return None
        if n % 2:
            raise FormatError(f"byte {self.at}: a string of {n} bytes, which is odd")
        raw = self.unpack(f"{n}s") if n else b""
        return raw.decode("utf-16-be")

    def span(self) -> tuple[int, int]:
        return self.unpack("ii")

    def spans(self) -> list[tuple[int, int]]:
        return [self.span() for _ in range(self.unpack("I"))]

    def end(self) -> None:
        if self.at < len(self.data):
            raise FormatError(f"{len(self.data) - self.at} bytes after the end")

    def tag(self, known: str) -> str:
        at, got = self.at, chr(self.unpack("B"))
        if got not in known:
            raise FormatError(f"byte {at}: tag {got!r} where one of {known!r} belongs")
        return got

    def chain(self) -> list[tuple[int, int]]:
        """Narrator spans of a serialized chain: tags A (chain), a (narrator), p (link), N (name), c (connector)."""
        self.tag("A")
        out = []
        for _ in range(self.unpack("i")):
            if self.tag("ap") == "p":
                self.unpack("qq")
                continue
            self.unpack("B")
            parts = []
            for _ in range(self.unpack("i")):
                self.unpack("B" if self.tag("Nc") == "N" else "qqB")
                parts.append(self.span())
            if parts:
                out.append((parts[0][0], parts[-1][1]))
        return out


def flat(data: bytes) -> list[tuple[int, int]]:
    c = Cursor(data)
    out = c.spans()
    c.end()
    return out


def two_level(data: bytes) -> list[tuple]:
    c = Cursor(data)
    return [(c.span(), c.spans(), c.chain()) for _ in range(c.unpack("i"))]


def equal(data: bytes) -> list[tuple]:
    c = Cursor(data)
    found = {(c.string(), c.string()): bool(c.unpack("B")) for _ in range(c.unpack("I"))}
    return [(a, b, e) for (a, b), e in found.items()]


def either(data: bytes) -> list[tuple]:
    try:
        return [(s, [], []) for s in flat(data)]
    except FormatError:
        return two_level(data)


SPANS = "array<struct<s:int,e:int>>"
COLUMNS = {"flat": ["path", "idx", "s", "e"], "two_level": ["path", "idx", "s", "e", "names", "chain"], "equal": ["path", "idx", "a", "b", "equal"]}
SCHEMAS = {"flat": "path string, idx int, s int, e int", "two_level": f"path string, idx int, s int, e int, names {SPANS}, chain {SPANS}", "equal": "path string, idx int, a string, b string, equal boolean"}


def read(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """Rows of the annotation files at ``path``."""
    parse = {"flat": flat, "two_level": two_level, "equal": equal, "auto": either}[layout]
    as_spans = lambda x: [{"s": s, "e": e} for s, e in x]

    def run(frames):
        for f in frames:
            rows = []
            for p, data in zip(f["path"], f["content"]):
                for i, x in enumerate(parse(bytes(data))):
                    rows.append((p, i, *x) if layout in ("flat", "equal") else (p, i, *x[0], as_spans(x[1]), as_spans(x[2])))
            yield pd.DataFrame(rows, columns=COLUMNS["two_level" if layout == "auto" else layout])

    schema = SCHEMAS["two_level" if layout == "auto" else layout]
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
