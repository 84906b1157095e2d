import itertools
import random

import numpy as np
import pytest

from narralith.llm import chat_format as C
from narralith.llm import queries

S = C.Settings()


@pytest.mark.parametrize("line,role", [("User: hi", 1), ("Human: hi", 1), ("<|assistant|> x", 2), ("### System", 0), ("[tool] {}", 3), ("**AI:** hello", 2), ("Q: why?", 1), ("a cat sat", -1), ("user", -1), ("The model is good", -1), ("> Bot: yes", 2), ("tool result: 4", 3)])
def test_markers(line, role):
    assert C.read_marker(line)[0] == role


def path_score(lines, states, entry=C.N):
    step, total, blank, before = C.step_scores(S), 0.0, False, entry
    for line, state in zip(lines, states):
        total += step[before, state] + C.line_scores(line, blank)[state]
        blank, before = not line.strip(), state
    return total


def test_viterbi_is_the_best_path_and_blocks_agree():
    rng = random.Random(1)
    for _ in range(20):
        lines = [rng.choice(["User: a", "Bot: b", "", "why?", "plain", "- item", '{"a": 1}']) for _ in range(4)]
        got = C.viterbi(lines, S, C.N)
        best = max(path_score(lines, p) for p in itertools.product(range(C.N), repeat=4))
        assert abs(path_score(lines, got) - best) < 1e-9
        # fold of two blocks, the second after what ends the first
        m = C.block_matrix(lines[:2], S)[0, C.N][:, None] + C.block_matrix(lines[2:], S)[int(not lines[1].strip())]
        assert abs(m.max() - best) < 1e-9


@pytest.mark.parametrize("line,role", [("toolresult: x", 3), ("functionresult: y", 3), ("speakera: q", 1), ("u\u017fer: hi", -1), ("Tool_Result: z", 3), ("SPEAKER B: z", 2), ("tool  result: x", -1)])
def test_markers_written_otherwise(line, role):
    assert C.read_marker(line)[0] == role


def whole(rows):
    """Turns of one conversation by one Viterbi over all its lines: (role, text)."""
    lines = [line for _, text in sorted(rows) for line in text.split("\n")]
    out = []
    for line, state in zip(lines, C.viterbi(lines, S, C.N)):
        if state % 2 == 0 or not out:
            out.append((C.ROLES[state // 2], []))
        out[-1][1].append(line[C.read_marker(line)[2] :] if state % 2 == 0 else line)
    return [(role, "\n".join(x).strip()) for role, x in out]


@pytest.mark.parametrize("block", range(1, 8))
def test_blank_and_unmarked_lines_at_borders(spark, block):
    rng = random.Random(block)
    pool = ["User: a", "Bot: b", "", " ", "why?", "plain", "- item", '{"a": 1}', "AI", "tool: 3", "user", "Q: what?"]
    rows = [(c, k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 3)))) for c in range(4) for k in range(23)]
    got = C.turns(spark.createDataFrame(rows, "conv_id long, turn long, text string"), C.Settings(block=block)).collect()
    for c in range(4):
        mine = [(r.role, r.text) for r in sorted((r for r in got if r.key == c), key=lambda r: (r.row, r.nth, r.line))]
        assert mine == whole([(k, t) for i, k, t in rows if i == c])


def test_rows_of_one_turn_stay_apart(spark):
    rows = [(1, 0, "User: hi"), (1, 0, "Assistant: yo"), (1, 0, "User: hi")]
    got = sorted((r.nth, r.role, r.text) for r in C.turns(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect())
    assert got == [(0, "assistant", "yo"), (1, "user", "hi"), (2, "user", "hi")]


def rendered(rows):
    return [(r.key, r.row, r.line, r.role, r.n_lines, r.text) for r in sorted(rows, key=lambda r: (r.key is not None, r.key or 0, r.row, r.line))]


def test_blocks_do_not_change_the_result(spark):
    rng = random.Random(2)
    rows = []
    for conv in (1, 2, None):
        for turn in range(60):
            who = ["User", "Assistant"][turn % 2]
            rows.append((conv, turn, f"{who}: " + "\n".join(rng.choice(["so it goes", "and on", "is it?", "- one"]) for _ in range(rng.randint(1, 4)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    one, many = (rendered(C.turns(df, C.Settings(block=b)).collect()) for b in (1000, 7))
    assert one == many and len(one) == 180
    assert [r[3] for r in one[:4]] == ["user", "assistant"] * 2 and not one[0][5].startswith("User")
    # a turn without a marker goes on with the one before, over a border of blocks too
    long = spark.createDataFrame([(1, i, "User: start" if not i else f"more {i}") for i in range(30)], "conv_id long, turn long, text string")
    got = rendered(C.turns(long, C.Settings(block=7)).collect())
    assert got == rendered(C.turns(long, C.Settings(block=1000)).collect()) and len(got) == 1 and got[0][4] == 30


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None, None), (1, 0, ""), (1, 0, ""), (2, 0, "x" * 200_000)], "conv_id long, turn long, text string").selectExpr("*", "'r' as role", "1 as block")
    got = C.turns(df).collect()
    assert sum(r.n_lines for r in got) == 4 and {r.key for r in got} == {None, 1, 2}
    assert C.turns(df.where("false")).collect() == []


def test_roles_recovered_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.conv_id, r.turn, r.line): r.role for r in queries.op10_chat(spark, sf).collect()}
    want = [(r.conv_id, r.turn, r.role) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    right = sum(got.get((c, t, 0)) == role for c, t, role in want)
    assert right > 0.97 * len(want)
    assert len(got) < 1.05 * len(want)
