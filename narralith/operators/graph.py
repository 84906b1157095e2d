"""The transmission graph: occurrences, edges, reach, generations, cycles, invariants, export."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder; iterations stay small plans. A checkpoint would compute its last stage twice."""
    spark = df.sparkSession
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    where = set_.get() if set_.isDefined() else spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{where or '/tmp/narralith-checkpoints'}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(occurrences: DataFrame, chain: str, order: list[str], node: str) -> DataFrame:
    """(child, parent): each occurrence with the next one of its chain."""
    w = W.partitionBy(chain).orderBy(*order)
    return occurrences.select(F.col(node).alias("child"), F.lead(node).over(w).alias("parent")).where("parent is not null and parent <> child")


def edges(occurrences: DataFrame, chain: str, order: list[str], node: str) -> DataFrame:
    return steps(occurrences, chain, order, node).distinct()


def positions(occurrences: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """Add ``position`` in the chain, from 0."""
    return occurrences.withColumn("position", F.row_number().over(W.partitionBy(chain).orderBy(*order)) - 1)


def numbered(df: DataFrame, order: list[str], name: str = "occ_id") -> DataFrame:
    """Add a dense number over a total order without bringing the rows together.

    Rows are sorted by range; counts per range give each its offset, and only those are summed in one place.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    offsets = ranged.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, (place + F.col("__before")).cast("long")).drop("__part", "__n", "__before")


def neighbours(edge: DataFrame, undirected: bool = True) -> DataFrame:
    """(a, b): one hop."""
    out = edge.select(F.col("child").alias("a"), F.col("parent").alias("b"))
    return out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct() if undirected else out.distinct()


#: Sources that one row of a front stands for: a bit each, in words of 64.
WORDS = 4


def within(sources: DataFrame, edge: DataFrame, k: int, undirected: bool = True) -> DataFrame:
    """(source, node, hops) for the nodes within k hops of each source (column ``source``), itself left out.

    Sources go together in blocks by their order; a row of a front is a block, a node and a bit for each source
    that has come to it. So an edge is followed once for a block, and not once for each source and way.
    """
    hop = cut(neighbours(edge, undirected))
    at = numbered(sources.select("source").where("source is not null").distinct(), ["source"], "__at")
    at = cut(at.select("source", F.expr(f"__at div {64 * WORDS}").alias("block"), F.expr(f"cast(__at % {64 * WORDS} as int)").alias("bit")))
    masks = [f"m{j}" for j in range(WORDS)]
    merged = lambda df: df.groupBy("block", "node").agg(*[F.bit_or(m).alias(m) for m in masks])
    own = [F.expr(f"if(bit div 64 = {j}, shiftleft(1L, bit % 64), 0L)").alias(m) for j, m in enumerate(masks)]
    front = seen = at.select("block", F.col("source").alias("node"), *own).groupBy("block", "node").agg(*[F.bit_or(m).alias(m) for m in masks])
    out = []
    for i in range(1, k + 1):
        came = merged(front.join(hop, front.node == hop.a).select("block", F.col("b").alias("node"), *masks))
        past = seen.select("block", "node", *[F.col(m).alias(f"past_{m}") for m in masks])
        fresh = [F.col(m).bitwiseAND(F.bitwise_not(F.coalesce(f"past_{m}", F.lit(0).cast("long")))).alias(m) for m in masks]
        front = cut(came.join(past, ["block", "node"], "left").select("block", "node", *fresh).where(" or ".join(f"{m} <> 0" for m in masks)))
        seen = merged(seen.unionByName(front))
        out.append(front.withColumn("hops", F.lit(i)))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    members = at.groupBy("block").agg(F.collect_list(F.struct("bit", "source")).alias("members"))
    found = found.select("block", "node", "hops", F.array(*masks).alias("m")).join(members, "block")
    came = F.explode(F.expr("filter(members, x -> (shiftright(m[x.bit div 64], x.bit % 64) & 1L) = 1L)")).alias("x")
    return found.select("node", "hops", came).select("x.source", "node", "hops")


def reachable(pairs: DataFrame, edge: DataFrame, k: int) -> DataFrame:
    """Add ``reachable`` to pairs (n1, n2): whether they are the same or within k hops. Only sources of pairs that no edge joins are walked from."""
    hop = neighbours(edge).select(F.col("a").alias("n1"), F.col("b").alias("n2"), F.lit(True).alias("__next"))
    known = cut(pairs.join(hop, ["n1", "n2"], "left"))
    rest = known.where("__next is null and n1 <> n2").select(F.col("n1").alias("source")).distinct()
    near = within(rest, edge, k).select(F.col("source").alias("n1"), F.col("node").alias("n2"), F.lit(True).alias("__near"))
    return known.join(near, ["n1", "n2"], "left").withColumn("reachable", F.coalesce("__next", "__near", F.col("n1") == F.col("n2"))).drop("__next", "__near")


def any_reachable(sets: DataFrame, pairs: DataFrame, edge: DataFrame, k: int) -> DataFrame:
    """Add ``reachable`` to pairs (a, b) of sets (set, node): whether a node of one is, or is within k hops of, a node of the other.

    The cheaper questions come first, of all pairs; each next one is asked of the pairs that are still open, so every
    pair of nodes is looked at where no answer is found before.
    """
    sets = cut(sets.distinct())
    left, right = sets.select(F.col("set").alias("a"), F.col("node").alias("n1")), sets.select(F.col("set").alias("b"), F.col("node").alias("n2"))
    first = left.groupBy("a").agg(F.min("n1").alias("n1"))
    pairs = cut(pairs.distinct())
    hop = cut(neighbours(edge).select(F.col("a").alias("n1"), F.col("b").alias("n2")))
    both = lambda of, some: of.join(some, "a").join(right, "b")
    same = pairs.join(left, "a").join(right.withColumnRenamed("n2", "n1"), ["b", "n1"]).select("a", "b").distinct()
    open_ = cut(pairs.join(same, ["a", "b"], "left_anti"))
    for some in (first, left):
        if open_.isEmpty():
            break
        hit = both(open_, some).join(hop, ["n1", "n2"], "left_semi").select("a", "b").distinct()
        open_ = cut(open_.join(hit, ["a", "b"], "left_anti"))
    if k > 1 and not open_.isEmpty():
        sources = open_.select("a").distinct().join(left, "a").select(F.col("n1").alias("source"))
        near = cut(within(sources, edge, k).select(F.col("source").alias("n1"), F.col("node").alias("n2")))
        for some in (first, left):
            hit = both(open_, some).join(near, ["n1", "n2"], "left_semi").select("a", "b").distinct()
            open_ = cut(open_.join(hit, ["a", "b"], "left_anti"))
    return pairs.join(open_.withColumn("__open", F.lit(True)), ["a", "b"], "left").select("a", "b", F.col("__open").isNull().alias("reachable"))


def ranks(edge: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, rank): longest path from nodes without a parent; nodes on or below a cycle get none.

    Topological waves: a node's rank is known when all its parents' are. Each wave joins only the nodes
    of the wave before, so the work over all waves is one pass over the edges.
    """
    edge = cut(edge.select("child", "parent").where("child <> parent").distinct())
    nodes = edge.select(F.col("child").alias("node")).union(edge.select("parent")).distinct()
    wave = cut(nodes.join(edge.select(F.col("child").alias("node")), "node", "left_anti").withColumn("rank", F.lit(0)))
    done, waiting = wave, cut(edge.groupBy("child").agg(F.count("*").alias("left")))
    for i in range(1, most):
        freed = edge.join(wave.select(F.col("node").alias("parent")), "parent").groupBy("child").agg(F.count("*").alias("n"))
        waiting = cut(waiting.join(freed, "child", "left").select("child", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left")))
        wave = waiting.where("left = 0").select(F.col("child").alias("node"), F.lit(i).alias("rank"))
        waiting = waiting.where("left > 0")
        if wave.isEmpty():
            break
        done = cut(done.unionByName(wave))
    else:
        raise RuntimeError(f"ranks are deeper than {most}")
    return done


def by_component(links: DataFrame, rows: DataFrame, fold, kind: T.StructType) -> DataFrame:
    """Fold the rows (child, ...) of each connected component of ``links`` (child, parent), in order of child and parent.

    ``fold`` gets the columns of a component as arrays and returns those of ``kind``. A task holds one component at a
    time, so memory follows the largest one; components go to different tasks.
    """
    from narralith.operators.merge import labels

    nodes = links.select(F.col("child").alias("node")).union(links.select("parent")).distinct()
    root = labels(links.select(F.col("child").alias("a"), F.col("parent").alias("b")), nodes)
    placed = rows.join(root.select(F.col("node").alias("child"), F.col("root").alias("__root")), "child").select("__root", *rows.columns)
    names = [f.name for f in kind.fields]

    def run(batches):
        held, of = [], None

        def done():
            if held:
                arrays = [pa.chunked_array([h.column(k) for h in held]) for k in range(1, held[0].num_columns)]
                kinds = [arrays[0].type if f.name != "rank" else pa.int32() for f in kind.fields]
                out = fold(*[x.to_numpy() for x in arrays])
                held.clear()
                for at in range(0, len(out[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000], k) for x, k in zip(out, kinds)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            roots = b.column(0).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(roots[1:] != roots[:-1]) + 1).tolist(), b.num_rows]
            for s, e in zip(starts, starts[1:]):
                if held and roots[s] != of:
                    yield from done()
                of = roots[s]
                held.append(b.slice(s, e - s))
        yield from done()

    return placed.repartition("__root").sortWithinPartitions("__root", "child", "parent").mapInArrow(run, kind)


def relaxed_ranks(edge: DataFrame, passes: int = 10) -> DataFrame:
    """(node, rank) of all nodes: :func:`ranks`, and for nodes on or below a cycle a bounded relaxation.

    At most ``passes`` passes over these nodes in order of id, each using the ranks set before in the same
    pass. The order makes it one fold of each connected component of these nodes; components do not touch each other.
    """
    edge = cut(edge.select("child", "parent").where("child <> parent").distinct())
    done = cut(ranks(edge))
    known = done.select(F.col("node").alias("parent"), F.col("rank").alias("above"))
    left = cut(edge.join(done.select(F.col("node").alias("child")), "child", "left_anti").join(known, "parent", "left").select("child", "parent", "above"))
    most = min(left.select("child").distinct().count(), passes)

    def fold(child, parent, above):
        nodes, starts = np.unique(child, return_index=True)
        above = np.nan_to_num(above.astype(float), nan=-1).astype(np.int64)
        inner = above < 0
        at = np.where(inner, np.searchsorted(nodes, parent), 0)
        ends = np.append(starts[1:], len(child))
        base = np.maximum.reduceat(above, starts) + 1
        rank = base.copy()
        inside = [at[s:e][inner[s:e]] for s, e in zip(starts, ends)]
        for _ in range(most):
            before = rank.copy()
            for i, up in enumerate(inside):
                rank[i] = max(rank[i], rank[up].max() + 1 if len(up) else 0)
            if (rank == before).all():
                break
        return nodes, rank.astype(np.int32)

    kind = T.StructType([T.StructField("node", edge.schema["child"].dataType), T.StructField("rank", T.IntegerType())])
    return done.unionByName(by_component(left.where("above is null").select("child", "parent"), left, fold, kind))


def violations(edge: DataFrame, rank: DataFrame) -> DataFrame:
    """Edges whose child does not come after its parent."""
    r = rank.select(F.col("node").alias("n"), "rank")
    child, parent = r.select(F.col("n").alias("child"), F.col("rank").alias("child_rank")), r.select(F.col("n").alias("parent"), F.col("rank").alias("parent_rank"))
    return edge.join(child, "child").join(parent, "parent").where("child_rank <= parent_rank")


def cyclic_core(edge: DataFrame, most: int = 10_000) -> DataFrame:
    """(child, parent) edges left when nodes without parents or without children are taken off again and again.

    What remains are the cycles and the paths between them.
    """
    core = cut(edge.where("child <> parent").select("child", "parent").distinct())
    size = core.count()
    for _ in range(most):
        inner = core.join(core.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(core.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        core = cut(inner.select("child", "parent"))
        now = core.count()
        if now == size:
            break
        size = now
    else:
        raise RuntimeError(f"more than {most} rounds of ends to take off")
    return core


def back_edges(edge: DataFrame) -> DataFrame:
    """(child, parent): edges that a depth-first search from child to parent, in order of ids, finds leading back into its own path.

    They lie in the cyclic core, which alone is searched; a search does not leave its connected component, so
    components are searched side by side.
    """
    core = cyclic_core(edge)

    def search(child, parent):
        nodes, starts = np.unique(child, return_index=True)
        ends = np.append(starts[1:], len(child)).tolist()
        up = np.searchsorted(nodes, parent).astype(np.int32)
        state = bytearray(len(nodes))  # 1 on the path, 2 done
        at, found = starts.tolist(), []
        for first in range(len(nodes)):
            if state[first]:
                continue
            path, state[first] = [first], 1
            while path:
                node = path[-1]
                k = at[node]
                if k == ends[node]:
                    state[path.pop()] = 2
                    continue
                at[node] = k + 1
                to = up[k]
                if state[to] == 1:
                    found.append(k)
                elif not state[to]:
                    state[to] = 1
                    path.append(to)
        return child[found], parent[found]

    return by_component(core, core, search, core.schema)


def statistics(edge: DataFrame, rank: DataFrame, top: int = 5) -> DataFrame:
    """One row: nodes with a rank, the greatest rank, and the nodes with most children (ties by id)."""
    best = edge.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children")).orderBy(F.desc("children"), "node").limit(top)
    best = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("children")).alias("less"), "node"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["node"].alias("node"), (-x["less"]).alias("children"))).alias("top"))
    return rank.agg(F.count("rank").alias("ranked"), F.max("rank").alias("max_rank")).crossJoin(F.broadcast(best))  # one row each


def ego_tree(edge: DataFrame, roots: DataFrame, widths: tuple[int, ...] = (10, 3)) -> DataFrame:
    """(root, depth, parent, node): the first neighbours by id, hop by hop, as many as each width says.

    A node's first neighbours are the same in every tree, so they are ranked once and only these are joined.
    """
    first = edge.withColumn("n", F.row_number().over(W.partitionBy("child").orderBy("parent"))).where(F.col("n") <= max(widths))
    first = cut(first.select(F.col("child").alias("via"), F.col("parent").alias("next"), "n"))
    front = roots.select(F.col("root"), F.col("root").alias("node"))
    out = None
    for depth, width in enumerate(widths, 1):
        hop = front.join(first.where(F.col("n") <= width), front.node == first.via)
        level = hop.select("root", F.lit(depth).alias("depth"), "via", F.col("next").alias("node"))
        out = level if out is None else out.unionByName(level)
        front = level.select("root", "node").distinct()
    return out


def dot_lines(edge: DataFrame, labels: DataFrame, most: int = 60) -> DataFrame:
    """(line): Graphviz statements of the subgraph of the nodes with most edges; ``labels`` is (node, label)."""
    ends = edge.select(F.col("child").alias("node")).union(edge.select("parent"))
    top = ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(most)
    named = top.join(labels, "node", "left")
    keep = top.select("node")
    inner = edge.join(F.broadcast(keep.withColumnRenamed("node", "child")), "child", "left_semi").join(F.broadcast(keep.withColumnRenamed("node", "parent")), "parent", "left_semi")
    lines = named.select(F.concat(F.lit("  n"), F.col("node"), F.lit(' [label="'), F.regexp_replace(F.coalesce(F.col("label").cast("string"), F.lit("")), '"', "'"), F.lit('"];')).alias("line"))
    return lines.unionByName(inner.select(F.concat(F.lit("  n"), F.col("child"), F.lit(" -> n"), F.col("parent"), F.lit(";")).alias("line")))
