"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is a run of lines in which speakers may be marked in many ways, or not at all. Hidden
states are (role, first line of a turn or a later one). A line is seen through its speaker marker
and a few features: blank, a question, code or list, long, after a blank line. Viterbi's
algorithm finds the likeliest states; runs of lines become turns, without their markers, rendered in
one canonical form.

The lines of a conversation are not brought together. Viterbi's step is a matrix product over
(max, +), so each block of ``block`` rows is first reduced to one matrix of best scores between its
outer states; those few matrices are folded in order per conversation, which fixes the states at
the blocks' borders; then each block is decoded alone. A turn that runs on over a border is put
together by the place of its first line.

Cases: null text is an empty line; a null conversation key is a conversation of its own; rows with
equal order are taken in the order of their text, and each is a turn of its own if it is marked, repeated rows too; a conversation whose first
line has no marker begins with the likeliest role; very long texts are read whole, a line at a time; rows
without order are all at 0; blank lines at a turn's ends are left out; an
empty table gives an empty table; only key, order and text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narralith.llm._shared import cut, released

ROLES = ["system", "user", "assistant", "tool"]

#: Names that transcripts give to speakers.
SPEAKERS = {
    "system": "system sys instructions instruction context",
    "user": "user human customer client student q question prompt me person speaker_a you asker",
    "assistant": "assistant ai bot gpt model agent a answer response reply support teacher speaker_b helper chatbot",
    "tool": "tool function tool_result function_result observation output",
}
ROLE_OF = {name.replace("_", ""): r for r, names in enumerate(SPEAKERS.values()) for name in names.split()}
_NAMES = "|".join(sorted(" ".join(SPEAKERS.values()).split(), key=len, reverse=True)).replace("_", "[ _]?")
MARKER = re.compile(rf"^\s*(?:(?P<strong><\|(?:im_start\|>)?\s*|\[INST\]|\[|<|#{{1,4}}\s*|\*\*|>+\s*)?(?P<name>{_NAMES})\s*\d{{0,3}}\s*(?P<end>\|?>|\]|\*\*\s*:?|:\*\*|:|-|—|\)|$)\s*)", re.I | re.A)


@dataclass(frozen=True)
class Settings:
    block: int = 256  # rows (turns as they came) that are decoded together
    change: float = 0.9  # chance that a new turn has another speaker than the one before
    longer: float = 0.8  # chance that a turn goes on after a line


N = 2 * len(ROLES)  # states of lines; state N stands before the first one
_LOG = lambda p: np.log(np.maximum(p, 1e-9))


@lru_cache
def step_scores(s: Settings) -> np.ndarray:
    """log P(next | state): a turn goes on, or another begins, mostly by another speaker who is likely to answer this one.

    The last row is the state before a conversation; nothing leads back to it.
    """
    follow = np.array([[0.05, 0.75, 0.15, 0.05], [0.02, 0.05, 0.83, 0.10], [0.02, 0.83, 0.05, 0.10], [0.02, 0.08, 0.85, 0.05]])
    t = np.zeros((N + 1, N + 1))
    for r in range(len(ROLES)):
        turn = follow[r] * np.where(np.arange(len(ROLES)) == r, 1 - s.change, s.change)
        for state in (2 * r, 2 * r + 1):
            t[state, 2 * r + 1] = s.longer
            t[state, :N:2] += (1 - s.longer) * turn / turn.sum()
    t[N, :N:2] = [0.2, 0.6, 0.15, 0.05]
    # a millionth of a preference for each step, so that paths of equal score do not depend on where blocks end
    return _LOG(t) + 1e-6 * np.sin(np.arange(1, t.size + 1)).reshape(t.shape)


def read_marker(line: str) -> tuple[int, float, int]:
    """(role or -1, how sure, length of the marker)."""
    m = MARKER.match(line)
    if not m:
        return -1, 0.0, 0
    role = ROLE_OF[m["name"].lower().replace(" ", "").replace("_", "")]
    end, strong = m["end"].strip(), bool(m["strong"])
    if end == "" and not strong and m.end() < len(line):
        return -1, 0.0, 0
    if not strong and end in ("", "-", "—", ")", "]", ">"):
        return (role, 0.6, m.end()) if len(m["name"]) > 2 and end else (-1, 0.0, 0)
    return role, 0.98 if strong or len(m["name"]) > 1 else 0.9, m.end()


def line_scores(line: str, after_blank: bool) -> np.ndarray:
    """log P(line | state) of each state, up to what is common to all."""
    role, sure, _ = read_marker(line)
    text = line.strip()
    p = np.ones(N + 1)
    p[N] = 0
    first, later = p[:N:2], p[1:N:2]
    if role >= 0:
        first *= (1 - sure) / len(ROLES)
        first[role] = sure
        later *= (1 - sure) / 40
    else:
        first *= 0.06
        later *= 0.94
    if not text:
        first *= 0.02
        return _LOG(p)
    if after_blank and role < 0:
        first *= 4
    if text.endswith("?"):
        p[:N] *= np.repeat([0.3, 2.0, 0.7, 0.2], 2)
    if re.match(r"```|\s{4}\S|[-*] |\d+[.)] ", line):
        p[:N] *= np.repeat([0.6, 0.6, 1.8, 1.0], 2)
    if text[0] in "{[" and text[-1] in "}]":
        p[:N] *= np.repeat([0.3, 0.3, 0.5, 4.0], 2)
    if len(text) > 400:
        p[:N] *= np.repeat([1.0, 0.7, 1.4, 1.0], 2)
    return _LOG(p)


def block_matrix(lines: list[str], s: Settings) -> np.ndarray:
    """Best score from each state before the first line to each state of the last one: after a line with text, and after a blank one."""
    step = step_scores(s)
    m = np.stack([step + line_scores(lines[0], blank)[None] for blank in (False, True)])
    for before, line in zip(lines, lines[1:]):
        m = (m[:, :, :, None] + (step + line_scores(line, not before.strip())[None])[None, None]).max(2)
    return m


def viterbi(lines: list[str], s: Settings, entry: int, last: int | None = None, blank: bool = False) -> list[int]:
    """States of the lines, given the state before the first one, whether it was blank, and perhaps the last one's state."""
    step, back, score = step_scores(s), [], None
    for line in lines:
        if score is None:
            score = step[entry] + line_scores(line, blank)
        else:
            way = score[:, None] + step
            back.append(way.argmax(0))
            score = way.max(0) + line_scores(line, blank)
        blank = not line.strip()
    state = int(score.argmax()) if last is None else last
    out = [state]
    for b in reversed(back):
        state = int(b[state])
        out.append(state)
    return out[::-1]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


def _by_block(rows: DataFrame, make, schema: T.StructType) -> DataFrame:
    """Feed each block's rows, in order, to ``make(key, block, extra, rows)``; yields its output rows."""

    def run(batches):
        at, held, types = None, [], None

        def flush():
            out = make(at, held)
            return [pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=schema.names)] if out else []

        for b in batches:
            if types is None:
                types = [b.column(0).type, *[{"LongType": pa.int64(), "IntegerType": pa.int32(), "StringType": pa.string()}.get(type(f.dataType).__name__, pa.list_(pa.float64())) for f in schema.fields[1:]]]
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:2] != at:
                    if held:
                        yield from flush()
                    at, held = row[:2], []
                held.append(row[2:])
        if held:
            yield from flush()

    return rows.mapInArrow(released(run), schema)


def turns(rows: DataFrame, s: Settings = Settings(), key_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(key, row, nth, line, role, n_lines, text, rendered): one row per turn recovered, with the place of its first line."""
    base = rows.select(F.col(key_col).alias("key"), F.expr(f"cast(floor(coalesce(`{order_col}`, 0) / {s.block}) as bigint)").alias("block"), F.coalesce(F.col(order_col).cast("long"), F.lit(0)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["key", "block", "row", "text"]
    dealt = lambda df: df.repartition("key", "block").sortWithinPartitions(*order)
    key = base.schema["key"]
    split = lambda held: [(r[0], i, k, line) for i, r in enumerate(held) for k, line in enumerate(r[1].split("\n"))]

    matrix = T.StructType([key, T.StructField("block", T.LongType()), T.StructField("blank", T.LongType()), T.StructField("m", T.ArrayType(T.DoubleType()))])

    def reduce(at, held):
        lines = [x[3] for x in split(held)]
        return [(*at, int(not lines[-1].strip()), block_matrix(lines, s).ravel().tolist())]

    sums = cut(_by_block(dealt(base), reduce, matrix))

    # Fold: best scores up to each block's end, then the states at the borders from the last back.
    borders = T.StructType([key, *[T.StructField(c, T.LongType()) for c in ("block", "entry", "last", "after_blank")]])

    def fold(at, held):
        score, best, blank, after = np.full(N + 1, -np.inf), [], 0, []
        score[N] = 0
        for _, ends_blank, m in held:
            way = score[:, None] + np.array(m).reshape(2, N + 1, N + 1)[blank]
            best.append(way.argmax(0))
            score = way.max(0)
            after.append(blank)
            blank = ends_blank
        state, out = int(score.argmax()), []
        for (block, _, _), b, was_blank in zip(reversed(held), reversed(best), reversed(after)):
            out.append((at[0], block, int(b[state]), state, was_blank))
            state = int(b[state])
        return out

    folded = _by_block(sums.select("key", F.lit(0).cast("long").alias("z"), "block", "blank", "m").repartition("key").sortWithinPartitions("key", "block"), fold, borders)
    placed = base.join(cut(folded).withColumnRenamed("key", "k2").withColumnRenamed("block", "b2"), F.col("key").eqNullSafe(F.col("k2")) & (F.col("block") == F.col("b2"))).drop("k2", "b2")

    parts = T.StructType([key, T.StructField("block", T.LongType()), T.StructField("row", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("line", T.LongType()), T.StructField("part", T.LongType()), T.StructField("role", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("text", T.StringType())])

    def decode(at, held):
        lines = split(held)
        entry, last, blank = held[0][2:]
        out: list[list] = []
        # nth: which of the block's rows; rows of equal order, and repeated ones, are turns of their own
        for (row, nth, k, line), state in zip(lines, viterbi([x[3] for x in lines], s, entry, last, bool(blank))):
            if state % 2 == 0 or not out:
                # a part without a first line of its own goes on with the turn before it
                place = (row, nth, k) if state % 2 == 0 or entry == N else (None, None, None)
                out.append([*at, *place, len(out), ROLES[state // 2], 0, []])
            out[-1][7] += 1
            out[-1][8].append(line[read_marker(line)[2] :] if state % 2 == 0 else line)
        return [(*p[:8], "\n".join(p[8])) for p in out]

    found = cut(_by_block(dealt(placed.select(*order, "entry", "last", "after_blank")), decode, parts))
    # A turn's parts get the place of its first line; one summary row per block is enough to carry it over.
    tail = found.groupBy("key", "block").agg(F.max(F.when(F.col("row").isNotNull(), F.struct("part", "row", "nth", "line"))).alias("t"))
    before = tail.select(F.col("key").alias("k2"), F.col("block").alias("b2"), F.last(F.col("t"), True).over(W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    whole = found.join(before, F.col("key").eqNullSafe(F.col("k2")) & (F.col("block") == F.col("b2")), "left")
    whole = whole.select("key", *[F.coalesce(c, f"before.{c}").alias(c) for c in ("row", "nth", "line")], "block", "part", "role", "n_lines", "text")
    made = whole.groupBy("key", "row", "nth", "line").agg(F.min_by("role", F.struct("block", "part")).alias("role"), F.sum("n_lines").alias("n_lines"), F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("t"))
    text = F.regexp_replace(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), r"^\s+|\s+$", "")
    made = made.select("key", "row", "nth", "line", "role", "n_lines", text.alias("text"))
    return made.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))
