"""BPE encoding and decoding.

Encoding is the backtracking form: an Aho-Corasick automaton lists the vocabulary tokens that
start at each position of a word, the encoder takes the longest one that may follow the token
before it, and steps back where none may. Whether two tokens may stand side by side is looked up
in a pair-compatibility table, filled on demand: a pair is compatible when merging by rank would
never join a part of the left token to a part of the right one. A position that was given up is
never tried again, so the work is linear in the word's length and the tokens are those of the
merge-by-merge procedure.

Decoding reads an offset table: token i is ``blob[offset[i]:offset[i + 1]]``.

Cases: a null or empty text has no tokens and decodes to the empty string; a text of any length
is encoded whole; rows are independent, so repeated rows repeat their result; columns other than
the text pass through under their own names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from narralith.llm._shared import released

#: Words and pairs of tokens that a Python worker remembers at most, some 300 MB.
MEMO_WORDS = 800_000
MEMO_PAIRS = 1_000_000

#: White space as the tokenizer's own regular expressions see it (control characters 1C to 1F are not).
SPACE = regex.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next free character from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    at = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [at[b] for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary (tokenizers JSON with an end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.special_starts = {s[0] for s in self.special}
        self.bytes_to = byte_alphabet()

        vocab = model["vocab"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: rank of each merged pair, the parts of each merged token
        self.joins: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = {i: -1 for i in vocab.values()}
        for r, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            self.joins.setdefault((vocab[a], vocab[b]), r)
            if whole not in self.parts:
                self.parts[whole] = (vocab[a], vocab[b])
                self.rank[whole] = r
        #: words are matched as strings in which the last character carries the end-of-word mark
        self.marked = {c: chr(0xE000 + i) for i, c in enumerate(self.bytes_to)}
        self.machine = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self.parts or len(token.removesuffix(self.suffix)) == 1:
                self.machine.add_word(self._key(token), (len(self._key(token)), i))
        self.machine.make_automaton()
        #: the pair-compatibility table, as far as pairs were met, and the ids of words
        self.compatible = Recent(lambda pair: self._border_stays(*pair), MEMO_PAIRS)
        self.known = Recent(self.encode_word, MEMO_WORDS)

        text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pieces = [text.get(i, "").encode() for i in range(self.size)]
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.blob = b"".join(pieces)

    def _key(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + self.marked[body[-1]]
        return token

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between the two tokens open."""
        return self.compatible[left, right]

    def _border_stays(self, left: int, right: int) -> bool:
        # Undo the latest merge on either side until both are single symbols. A join across the
        # border happens when its rank comes before the merges that have consumed its two parts.
        done_l = done_r = len(self.joins)
        while True:
            r = self.joins.get((left, right))
            if r is not None and r < done_l and r <= done_r:
                return False
            rank_l, rank_r = self.rank[left], self.rank[right]
            if rank_l < 0 and rank_r < 0:
                return True
            # At equal rank the left merge runs first.
            if rank_l >= rank_r and rank_l >= 0 and not (rank_l == rank_r):
                done_l, left = rank_l, self.parts[left][1]
            elif rank_r >= 0:
                done_r, right = rank_r, self.parts[right][0]
            else:
                done_l, left = rank_l, self.parts[left][1]

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-tokenized word."""
        # printable ASCII stands for itself
        symbols = word if word.isascii() and word.isprintable() and " " not in word else "".join([self.bytes_to[b] for b in word.encode("utf-8")])
        if self.suffix:
            symbols = symbols[:-1] + self.marked[symbols[-1]]
        n = len(symbols)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, token) in self.machine.iter(symbols):
            at[end - length + 1].append((length, token))  # shorter tokens end, and so come, first
        out: list[tuple[int, int]] = []
        left = [len(x) for x in at]  # candidates not tried yet at each position
        dead = bytearray(n + 1)
        pos = 0
        while pos < n:
            before = out[-1][1] if out else -1
            for k in range(left[pos] - 1, -1, -1):
                length, token = at[pos][k]
                if not dead[pos + length] and (before < 0 or self.may_follow(before, token)):
                    left[pos] = k
                    out.append((length, token))
                    pos += length
                    break
            else:
                if not out:
                    raise ValueError(f"no tokens for {word!r}")
                dead[pos] = 1
                pos -= out.pop()[0]
                continue
            if pos < n:
                left[pos] = len(at[pos])
        return [t for _, t in out]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a piece of text without white space."""
        out: list[int] = []
        for piece in self.specials.split(chunk) if not self.special_starts.isdisjoint(chunk) else [chunk]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                # lower case is taken character by character, so a final sigma is an ordinary one
                low = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                for word in self.words.findall(low):
                    out += self.known[word]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for c in chunks(text or "") for i in self.encode_chunk(c)]

    def decode(self, ids) -> str:
        """The tokens' strings with a space between, specials included."""
        blob, off = self.blob, self.offset
        return b" ".join([blob[off[i] : off[i + 1]] for i in ids]).decode()


def chunks(text: str) -> list[str]:
    if ODD_SPACE.search(text):
        return [c for c in SPACE.split(text) if c]
    return text.split()


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


class Recent(dict):
    """What ``make`` gives for a key, of at most ``most`` keys; when full, the older half goes that was not asked for since."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.half, self.old = make, max(1, most // 2), {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def Memo(bpe: WordBpe) -> Recent:
    """Chunk to (ids as text, decoded text)."""

    def make(chunk: str) -> tuple[str, str]:
        ids = bpe.encode_chunk(chunk)
        return " ".join(map(str, ids)), bpe.decode(ids)

    return Recent(make, MEMO_WORDS)


@lru_cache(maxsize=4)
def memo(path: str) -> Memo:
    return Memo(load(path))


def encode_texts(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the token ids (array of int) and the decoded text of ``text_col``."""
    schema = T.StructType([f for f in df.schema if f.name not in (ids_col, decoded_col)] + [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())])
    keep = [f.name for f in schema][:-2]

    def run(batches):
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())], names=[f.name for f in schema])

    return df.mapInArrow(released(run), schema)


def digest_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: token count, SHA-256 of the ids and of the decoded text, without shipping the tokens themselves."""
    df = df.select(id_col, text_col)
    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        known = memo(path)
        sha = hashlib.sha256
        for b in batches:
            n, a, d = [], [], []
            for text in b.column(1).to_pylist():
                found = [known[c] for c in chunks(text or "")]
                ids = " ".join([x[0] for x in found])
                n.append(ids.count(" ") + 1 if found else 0)
                a.append(sha(ids.encode()).hexdigest())
                d.append(sha(" ".join([x[1] for x in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=[f.name for f in schema])

    return df.mapInArrow(released(run), schema)
