"""Queries over whole tables against brute force, where the SQL of their namesakes reads a part."""

import random

import pytest

from narralith.functions import text as T
from narralith.operators import graph
from narralith.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_word_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "n_chars").collect()
    want = []
    for r in docs:
        s, e = 10, r.n_chars // 2
        starts = [i for i, c in enumerate(r.text) if c not in T.DELIMITERS and (i == 0 or r.text[i - 1] in T.DELIMITERS)]
        want.append((r.doc_id, s, e, 1 + sum(s < i < e for i in starts) if s < e else 0))
    got = [(r.doc_id, r.s, r.e, r.n_words) for r in catalogue.QUERIES["word_counts_whole"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and max(r.n_chars for r in docs) > 4000


def line_edges(spark):
    chains = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        chains.setdefault(r.l_orderkey, []).append((r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_quantity, r.l_extendedprice))
    steps = [[x[2] for x in sorted(c)] for c in chains.values()]
    return {(a, b) for c in steps for a, b in zip(c, c[1:]) if a != b}


def relaxed(edge):
    """Longest paths where there is no cycle, then at most ten passes in order of id."""
    nodes = sorted({x for e in edge for x in e})
    up = {n: sorted(p for c, p in edge if c == n) for n in nodes}
    rank, free = dict.fromkeys(nodes, 0), []
    left = {n: len(up[n]) for n in nodes}
    ready = [n for n in nodes if not left[n]]
    while ready:
        n = ready.pop()
        free.append(n)
        for c, p in edge:
            if p == n:
                rank[c] = max(rank[c], rank[n] + 1)
                left[c] -= 1
                if not left[c]:
                    ready.append(c)
    rest = [n for n in nodes if left[n]]
    for _ in range(min(len(rest), 10)):
        for n in rest:
            rank[n] = max([rank[n], *(rank[p] + 1 for p in up[n])])
    return rank


def near(edge, k):
    hop = {}
    for a, b in edge:
        hop.setdefault(a, set()).add(b)
        hop.setdefault(b, set()).add(a)
    out = {}
    for a in hop:
        seen = {a: 0}
        for i in range(1, k + 1):
            for x in [x for x, h in seen.items() if h == i - 1]:
                for y in hop[x]:
                    seen.setdefault(y, i)
        out[a] = seen
    return out


@pytest.mark.parametrize("seed", range(3))
def test_relaxed_ranks(spark, seed):
    rng = random.Random(seed)
    edge = {(rng.randrange(25), rng.randrange(25)) for _ in range(30)}
    edge = {(a, b) for a, b in edge if a != b}
    got = {r.node: r["rank"] for r in graph.relaxed_ranks(spark.createDataFrame(sorted(edge), "child long, parent long")).collect()}
    assert got == relaxed(edge)


def test_whole_graph(spark):
    edge = line_edges(spark)
    run = lambda name: catalogue.QUERIES[name](spark, SF).collect()
    rank = relaxed(edge)
    assert {r.node: r["rank"] for r in run("dag_rank_whole")} == rank
    v = run("rank_violations_whole")[0]
    assert (v.edges, v.violations, v.max_rank) == (len(edge), sum(rank[c] <= rank[p] for c, p in edge), max(rank[c] for c, _ in edge))
    core = set(edge)
    while (inner := {(c, p) for c, p in core if p in {x for x, _ in core} and c in {y for _, y in core}}) != core:
        core = inner
    c = run("cyclic_core_whole")[0]
    assert (c.edges, c.cyclic_nodes) == (len(edge), len({x for x, _ in core})) and c.cyclic_nodes > 0
    assert {(r.source, r.node, r.hops) for r in run("k_reachable_whole")} == {(a, b, h) for a, seen in near(edge, 2).items() for b, h in seen.items() if h}
    three = near(edge, 3)
    assert {(r.n1, r.n2, r.reachable) for r in run("reach_pair_whole")} == {(a, b, b in three.get(a, {a: 0})) for a, b in edge}


def test_any_reachable(spark):
    edge = line_edges(spark)
    two, mine = near(edge, 2), {}
    cust = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        if r.l_orderkey in cust:
            mine.setdefault(cust[r.l_orderkey], set()).add(r.l_suppkey)
    want = {(c, c + 1, any(b in two.get(a, {a: 0}) for a in mine[c] for b in mine[c + 1])) for c in mine if c + 1 in mine}
    assert {(r.c1, r.c2, r.reachable) for r in catalogue.QUERIES["any_reachable_whole"](spark, SF).collect()} == want


def test_edit_similarity(spark):
    names = sorted({r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()})
    want = {(a, b) for a in names for b in names if a < b and a.split(" ")[0] == b.split(" ")[0]}
    assert {(r.a, r.b) for r in catalogue.QUERIES["edit_similarity_whole"](spark, SF).collect()} == want


def acyclic(edge):
    edge = set(edge)
    while True:
        ends = {n for e in edge for n in e} - {c for c, _ in edge}
        kept = {(c, p) for c, p in edge if p not in ends}
        if kept == edge:
            return not edge
        edge = kept


def test_back_edges_break_every_cycle(spark):
    for seed in range(4):
        rng = random.Random(seed)
        edge = {(rng.randrange(30), rng.randrange(30)) for _ in range(50)}
        edge = {(a, b) for a, b in edge if a != b}
        back = {tuple(r) for r in graph.back_edges(spark.createDataFrame(sorted(edge), "child long, parent long")).collect()}
        assert back <= edge and acyclic(edge - back) and (acyclic(edge) == (not back))
        # each one alone closes a cycle with what stays
        assert all(not acyclic((edge - back) | {e}) for e in back)
    whole = line_edges(spark)
    back = {tuple(r) for r in catalogue.QUERIES["back_edges_whole"](spark, SF).collect()}
    assert back <= whole and acyclic(whole - back)
