"""Queries over the transmission graph of line items: chain = order, person = supplier."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narralith.operators import evaluation, graph
from narralith.plans.registry import register, table

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
STEP = """step AS (SELECT l_suppkey AS child, lead(l_suppkey) OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS parent FROM lineitem),
edge AS (SELECT DISTINCT child, parent FROM step WHERE parent IS NOT NULL AND parent <> child)"""
#: A sparse acyclic part of the graph: teachers have larger ids of the same ten, few per student.
SPARSE = "sparse AS (SELECT child, parent FROM edge WHERE parent > child AND parent - child <= 3 AND parent // 10 = child // 10)"


def line_edges(spark, d):
    return graph.edges(table(spark, d, "lineitem").select("l_orderkey", *ORDER), "l_orderkey", ORDER, "l_suppkey")


def sparse_edges(spark, d):
    return line_edges(spark, d).where("parent > child and parent - child <= 3 and parent div 10 = child div 10")


@register(f"WITH {STEP} SELECT parent AS person_id, count(*) AS students FROM edge GROUP BY parent ORDER BY students DESC, person_id LIMIT 10")
def top_connected(spark, d):
    return line_edges(spark, d).groupBy(F.col("parent").alias("person_id")).agg(F.count("*").alias("students")).orderBy(F.desc("students"), "person_id").limit(10)


@register("""SELECT l_orderkey AS chain_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS position,
 l_suppkey AS node, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS occ_id FROM lineitem""")
def chain_occurrences(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", *ORDER)
    rows = graph.numbered(graph.positions(rows, "l_orderkey", ORDER), ["l_orderkey", *ORDER])
    return rows.select(F.col("l_orderkey").alias("chain_id"), F.col("position").cast("long").alias("position"), F.col("l_suppkey").alias("node"), "occ_id")


@register(f"WITH {STEP} SELECT child, parent FROM edge")
def edges_distinct(spark, d):
    return line_edges(spark, d)


@register(f"""WITH {STEP}, node AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT (SELECT count(*) FROM lineitem) AS occurrences, count(*) AS persons, count(*) FILTER (n > 1) AS merged, (SELECT count(*) FROM edge) AS edges FROM node""")
def graph_build_stats(spark, d):
    node = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    stats = node.agg(F.sum("n").alias("occurrences"), F.count("*").alias("persons"), F.count_if(F.expr("n > 1")).alias("merged"))
    return stats.crossJoin(F.broadcast(line_edges(spark, d).agg(F.count("*").alias("edges"))))  # one row each


@register("SELECT l_suppkey AS person_id, string_agg(DISTINCT CAST(year(l_shipdate) AS VARCHAR), ',' ORDER BY CAST(year(l_shipdate) AS VARCHAR)) AS books FROM lineitem GROUP BY 1")
def multi_source_provenance(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("person_id"), F.year("l_shipdate").cast("string").alias("book"))
    return rows.groupBy("person_id").agg(F.array_join(F.sort_array(F.collect_set("book")), ",").alias("books"))


@register("SELECT l_suppkey AS person_id, count(DISTINCT year(l_shipdate)) AS n_books, count(*) AS occurrences FROM lineitem GROUP BY 1 HAVING count(DISTINCT year(l_shipdate)) > 1 ORDER BY occurrences DESC, person_id LIMIT 10")
def shared_persons_topk(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("person_id"), F.year("l_shipdate").alias("book")).agg(F.count("*").alias("n"))
    return per.groupBy("person_id").agg(F.count("*").alias("n_books"), F.sum("n").alias("occurrences")).where("n_books > 1").orderBy(F.desc("occurrences"), "person_id").limit(10)


@register("""WITH form AS (SELECT l_suppkey AS person_id, p_name AS name, count(*) AS size, min(l_orderkey) AS first_seen FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY size DESC, length(name) DESC, first_seen, name) AS rn FROM form)
 SELECT person_id, name AS primary_name, size AS occurrences FROM r WHERE rn = 1""")
def primary_name_argmax(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    form = rows.groupBy(F.col("l_suppkey").alias("person_id"), F.col("p_name").alias("name")).agg(F.count("*").alias("size"), F.min("l_orderkey").alias("first_seen"))
    best = F.min_by(F.struct("name", "size"), F.struct(-F.col("size"), -F.length("name"), "first_seen", "name"))
    return form.groupBy("person_id").agg(best.alias("b")).select("person_id", F.col("b.name").alias("primary_name"), F.col("b.size").alias("occurrences"))


@register("SELECT l_suppkey AS person_id, l_orderkey AS chain_id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def same_chain_violations(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("chain_id")).agg(F.count("*").alias("n")).where("n > 1")


@register("SELECT l_suppkey AS person_id, CAST(min(l_linenumber) AS BIGINT) AS lowest, CAST(max(l_linenumber) AS BIGINT) AS highest FROM lineitem GROUP BY 1 HAVING max(l_linenumber) - min(l_linenumber) > 3")
def span_violations(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("person_id")).agg(F.min("l_linenumber").cast("long").alias("lowest"), F.max("l_linenumber").cast("long").alias("highest"))
    return per.where("highest - lowest > 3")


@register(f"""WITH RECURSIVE {STEP}, {SPARSE}, reach AS (SELECT child AS a, parent AS b FROM sparse UNION SELECT r.a, s.parent FROM reach r JOIN sparse s ON r.b = s.child)
 SELECT (SELECT count(*) FROM sparse) AS edges, (SELECT count(*) FROM reach WHERE a = b) AS cyclic_nodes""")
def cyclic_core(spark, d):
    return _cyclic_core(sparse_edges(spark, d))


@register()
def cyclic_core_whole(spark, d):
    """As its namesake, over all edges; so are the other queries named ``_whole``."""
    return _cyclic_core(graph.cut(line_edges(spark, d)))


def _cyclic_core(edge):
    core = graph.cyclic_core(edge)
    return edge.agg(F.count("*").alias("edges")).crossJoin(F.broadcast(core.select(F.countDistinct("child").alias("cyclic_nodes"))))  # one row each


@register(f"""WITH RECURSIVE {STEP}, {SPARSE}, node AS (SELECT child AS id FROM sparse UNION SELECT parent FROM sparse),
 walk AS (SELECT id, 0 AS depth FROM node WHERE id NOT IN (SELECT child FROM sparse) UNION SELECT s.child, w.depth + 1 FROM walk w JOIN sparse s ON s.parent = w.id)
 SELECT id AS node, CAST(max(depth) AS BIGINT) AS rank FROM walk GROUP BY id""")
def dag_rank(spark, d):
    return graph.ranks(sparse_edges(spark, d)).select("node", F.col("rank").cast("long").alias("rank"))


@register()
def dag_rank_whole(spark, d):
    return graph.relaxed_ranks(line_edges(spark, d)).select("node", F.col("rank").cast("long").alias("rank"))


@register(f"""WITH RECURSIVE {STEP}, {SPARSE}, node AS (SELECT child AS id FROM sparse UNION SELECT parent FROM sparse),
 walk AS (SELECT id, 0 AS depth FROM node WHERE id NOT IN (SELECT child FROM sparse) UNION SELECT s.child, w.depth + 1 FROM walk w JOIN sparse s ON s.parent = w.id),
 r AS (SELECT id, max(depth) AS rank FROM walk GROUP BY id)
 SELECT count(*) AS edges, count(*) FILTER (c.rank <= p.rank) AS violations, CAST(max(c.rank) AS BIGINT) AS max_rank FROM edge JOIN r c ON c.id = child JOIN r p ON p.id = parent""")
def rank_violations(spark, d):
    return _rank_violations(line_edges(spark, d), graph.cut(graph.ranks(sparse_edges(spark, d))))


@register()
def rank_violations_whole(spark, d):
    edge = graph.cut(line_edges(spark, d))
    return _rank_violations(edge, graph.cut(graph.relaxed_ranks(edge)))


def _rank_violations(edge, rank):
    r = rank.select(F.col("node").alias("n"), "rank")
    pairs = edge.join(r.select(F.col("n").alias("child"), F.col("rank").alias("rc")), "child").join(r.select(F.col("n").alias("parent"), F.col("rank").alias("rp")), "parent")
    return pairs.agg(F.count("*").alias("edges"), F.count_if(F.expr("rc <= rp")).alias("violations"), F.max("rc").cast("long").alias("max_rank"))


REACH = f"""WITH RECURSIVE {STEP}, {SPARSE}, hop AS (SELECT child AS a, parent AS b FROM sparse UNION SELECT parent, child FROM sparse),
 walk AS (SELECT DISTINCT a AS source, a AS node, 0 AS hops FROM hop UNION SELECT w.source, h.b, w.hops + 1 FROM walk w JOIN hop h ON h.a = w.node WHERE w.hops < {{k}})"""


@register(REACH.format(k=2) + " SELECT source, node, CAST(min(hops) AS BIGINT) AS hops FROM walk WHERE node <> source GROUP BY 1, 2")
def k_reachable(spark, d):
    return _k_reachable(graph.cut(sparse_edges(spark, d)))


@register()
def k_reachable_whole(spark, d):
    return _k_reachable(graph.cut(line_edges(spark, d)))


def _k_reachable(edge):
    sources = graph.neighbours(edge).select(F.col("a").alias("source")).distinct()
    return graph.within(sources, edge, 2).select("source", "node", F.col("hops").cast("long").alias("hops"))


@register(REACH.format(k=3) + ", p AS (SELECT child AS n1, parent AS n2 FROM edge WHERE child <= 20) SELECT n1, n2, EXISTS (SELECT 1 FROM walk WHERE source = n1 AND node = n2) OR n1 = n2 AS reachable FROM p")
def reach_pair(spark, d):
    return _reach_pair(graph.cut(sparse_edges(spark, d)), line_edges(spark, d).where("child <= 20"))


@register()
def reach_pair_whole(spark, d):
    edge = graph.cut(line_edges(spark, d))
    return _reach_pair(edge, edge)


def _reach_pair(edge, pairs):
    return graph.reachable(pairs.select(F.col("child").alias("n1"), F.col("parent").alias("n2")), edge, 3).select("n1", "n2", "reachable")


@register(REACH.format(k=2) + """, mine AS (SELECT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <= 60),
 q AS (SELECT a.c AS c1, b.c AS c2, a.s AS s1, b.s AS s2 FROM mine a JOIN mine b ON b.c = a.c + 1)
 SELECT c1, c2, bool_or(s1 = s2 OR w.node IS NOT NULL) AS reachable FROM q LEFT JOIN (SELECT DISTINCT source, node FROM walk) w ON w.source = s1 AND w.node = s2 GROUP BY 1, 2""")
def any_reachable(spark, d):
    return _any_reachable(spark, d, graph.cut(sparse_edges(spark, d)), table(spark, d, "orders").where("o_custkey <= 60"))


@register()
def any_reachable_whole(spark, d):
    return _any_reachable(spark, d, graph.cut(line_edges(spark, d)), table(spark, d, "orders"))


def _any_reachable(spark, d, edge, orders):
    mine = orders.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("set"), F.col("l_suppkey").alias("node"))
    mine = graph.cut(mine.where("set is not null and node is not null").distinct())
    a = mine.select(F.col("set").alias("a"), (F.col("set") + 1).alias("b")).distinct()
    pairs = a.join(mine.select(F.col("set").alias("b")).distinct(), "b")
    return graph.any_reachable(mine, pairs.select("a", "b"), edge, 2).select(F.col("a").alias("c1"), F.col("b").alias("c2"), "reachable")


@register(f"""WITH {STEP}, one AS (SELECT child AS root, parent AS node, row_number() OVER (PARTITION BY child ORDER BY parent) AS n FROM edge),
 l1 AS (SELECT root, CAST(1 AS BIGINT) AS depth, root AS via, node FROM one WHERE n <= 10),
 l2 AS (SELECT x.root, CAST(2 AS BIGINT) AS depth, x.node AS via, o.node FROM (SELECT DISTINCT root, node FROM l1) x JOIN one o ON o.root = x.node WHERE o.n <= 3)
 SELECT * FROM l1 UNION ALL SELECT * FROM l2""")
def ego_tree_topn(spark, d):
    edge = graph.cut(line_edges(spark, d))
    roots = edge.select(F.col("child").alias("root")).distinct()
    return graph.ego_tree(edge, roots, (10, 3)).select("root", F.col("depth").cast("long").alias("depth"), "via", "node")


@register(f"""WITH {STEP}, deg AS (SELECT n AS node, count(*) AS degree FROM (SELECT child AS n FROM edge UNION ALL SELECT parent FROM edge) GROUP BY 1),
 top AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 60)
 SELECT '  n' || node || ' [label="' || coalesce(s_name, '') || '"];' AS line FROM top LEFT JOIN supplier ON s_suppkey = node
 UNION ALL SELECT '  n' || child || ' -> n' || parent || ';' FROM edge WHERE child IN (SELECT node FROM top) AND parent IN (SELECT node FROM top)""")
def dot_export(spark, d):
    labels = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("label"))
    return graph.dot_lines(graph.cut(line_edges(spark, d)), labels, 60)


@register("SELECT p_partkey AS person_id, p_name AS name FROM part WHERE contains(p_name, 'an') ORDER BY p_retailprice DESC, p_partkey LIMIT 200")
def person_picker(spark, d):
    return table(spark, d, "part").where(F.col("p_name").contains("an")).orderBy(F.desc("p_retailprice"), "p_partkey").limit(200).select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"))


@register("""WITH RECURSIVE pair AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem WHERE l_quantity >= 49),
 base AS (SELECT n_nationkey AS id, n_regionkey AS r FROM nation) SELECT r AS component, count(*) AS n FROM base GROUP BY r""")
def component_sizes(spark, d):
    from narralith.operators.merge import labels

    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("hub"))
    edge = nation.join(first, "n_regionkey").select(F.col("n_nationkey").alias("a"), F.col("hub").alias("b")).where("a <> b")
    root = labels(edge, nation.select(F.col("n_nationkey").alias("node")))
    named = root.join(nation.select(F.col("n_nationkey").alias("root"), "n_regionkey"), "root")
    return named.groupBy(F.col("n_regionkey").alias("component")).agg(F.count("*").alias("n"))


@register("""SELECT concat(l_orderkey, '#', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1) AS item, l_suppkey AS label FROM lineitem""")
def occurrence_labels(spark, d):
    rows = graph.positions(table(spark, d, "lineitem").select("l_orderkey", *ORDER), "l_orderkey", ORDER)
    return evaluation.occurrence_labels(rows, "l_orderkey", "position", "l_suppkey")


@register(f"WITH {STEP} SELECT (SELECT count(DISTINCT n) FROM (SELECT child AS n FROM edge UNION ALL SELECT parent FROM edge)) AS ranked, parent AS node, count(*) AS children FROM edge GROUP BY parent ORDER BY children DESC, node LIMIT 5")
def graph_stats_top(spark, d):
    edge = graph.cut(line_edges(spark, d))
    nodes = edge.select(F.col("child").alias("node")).union(edge.select("parent")).distinct().withColumn("rank", F.lit(0))
    return graph.statistics(edge, nodes).select("ranked", F.explode("top").alias("t")).select("ranked", "t.node", "t.children")


@register()
def back_edges_whole(spark, d):
    return graph.back_edges(graph.cut(line_edges(spark, d)))


@register(f"""WITH {STEP}, one AS (SELECT parent AS root, child AS node, row_number() OVER (PARTITION BY parent ORDER BY child) AS n FROM edge),
 l1 AS (SELECT root, CAST(1 AS BIGINT) AS depth, root AS via, node FROM one WHERE n <= 10),
 l2 AS (SELECT x.root, CAST(2 AS BIGINT) AS depth, x.node AS via, o.node FROM (SELECT DISTINCT root, node FROM l1) x JOIN one o ON o.root = x.node WHERE o.n <= 4)
 SELECT * FROM l1 UNION ALL SELECT * FROM l2""")
def ego_tree_students(spark, d):
    edge = graph.cut(line_edges(spark, d)).select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    roots = edge.select(F.col("child").alias("root")).distinct()
    return graph.ego_tree(edge, roots, (10, 4)).select("root", F.col("depth").cast("long").alias("depth"), "via", "node")
