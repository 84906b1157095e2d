"""Connected components of a table of links.

Tasks of bounded size first contract what links they hold to a forest, in as few tasks as the links
need; when one task can hold them all that is the result. Otherwise alternating large and small
stars take over: every round is two grouped minima and joins spread over the links, until the links
no longer change, at which point each node points at the least node it can reach. Nothing is collected.

Cases: a link with a null end or with itself joins nothing; repeated links count once; an empty table gives
an empty table; nodes without links have no row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralith.llm._shared import cut, drop_cut, released


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        out = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
    return out.where("u > v").distinct()


def _contract(batches):
    """Union-find over a task's links (u, v): each node and the least node that it reaches here."""
    root: dict = {}

    def find(x):
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
                root.setdefault(min(u, v), min(u, v))
    rows = [(x, r) for x in list(root) if (r := find(x)) != x]
    for at in range(0, len(rows), 100_000):
        part = rows[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], kind), pa.array([r for _, r in part], kind)], names=["u", "v"])


#: Links that one task contracts: some 200 MB of its memory at most.
LINKS_PER_TASK = 1_000_000


def components(links: DataFrame, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(node, root) for every linked node; ``links`` has two columns of one type."""
    a, b = links.columns
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v"))
    rows, least = edges.count(), None
    while least is None or rows < 0.7 * least:
        tasks = max(1, -(-rows // per_task))
        forest = cut(edges.repartition(tasks).mapInArrow(released(_contract), edges.schema))
        drop_cut(edges)
        edges, least = forest, rows
        if tasks == 1:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        rows = edges.count()
    before = None
    while True:
        after = cut(_star(_star(edges, True), False))
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(2**40 - 1))).first())
        drop_cut(edges)
        edges = after
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
