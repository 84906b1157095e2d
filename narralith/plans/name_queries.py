"""Queries over person names: canonical levels, keys, blocking, distance, matching, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from narralith.functions import text as T
from narralith.operators import merge, names
from narralith.plans.registry import register, table, values
from narralith.plans.text_queries import _cls

NAMES = [(1, "محمد بن يعقوب"), (2, "محمد بن يعقوب الكليني"), (3, "علي بن ابراهيم"), (4, "علي بن ابراهيم بن هاشم"), (5, "عماره بن القعقاع"), (6, "عماره بن القعقاع بن شبرمه"), (7, "محمد بن الحسن"), (8, "احمد بن محمد"), (9, "احمد بن علي"), (10, "خالد بن سعيد"), (11, "خالد بن سعد"), (12, "ابو عبد الله"), (13, "ابي عبد الله"), (14, "ابن ابي عمير"), (15, "احمد بن محمد بن عيسا الاشعري القمي")]
#: Words, their roles and their level, as SQL: a level ends at each "son of".
SLOTS = f"""nm AS (SELECT * FROM (VALUES {values(NAMES)}) t(id, name)),
w AS (SELECT id, unnest(string_split(name, ' ')) AS word, generate_subscripts(string_split(name, ' '), 1) AS i FROM nm),
r AS (SELECT *, CASE WHEN word IN {_cls('ibn')} THEN 'ibn' WHEN word IN {_cls('ab')} THEN 'AB' WHEN word IN {_cls('om')} THEN 'OM' WHEN starts_with(word, 'ال') AND ends_with(word, 'ي') AND length(word) > 3 THEN 'nisba' WHEN word IN {_cls('family')} THEN 'family' ELSE 'name' END AS kind FROM w),
l AS (SELECT *, CAST(sum(CASE WHEN kind = 'ibn' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS BIGINT) AS lvl FROM r),
slot AS (SELECT id, lvl, row_number() OVER (PARTITION BY id, lvl ORDER BY i) - 1 AS slot, word, kind FROM l WHERE kind NOT IN ('ibn', 'nisba')),
top AS (SELECT nm.id, coalesce(max(lvl), 0) + 1 AS n FROM nm LEFT JOIN slot ON slot.id = nm.id GROUP BY nm.id),
qual AS (SELECT nm.id, coalesce(string_agg(word, ' ' ORDER BY word), '') AS q FROM nm LEFT JOIN l ON l.id = nm.id AND kind = 'nisba' GROUP BY nm.id)"""
KEYS = f"""{SLOTS}, lv AS (SELECT id, lvl, string_agg(CASE WHEN kind IN ('AB', 'OM') THEN kind ELSE word END, ' ' ORDER BY slot) AS txt FROM slot GROUP BY 1, 2),
grid AS (SELECT t.id, t.n, g.lvl, coalesce(lv.txt, '') AS txt FROM top t JOIN range(0, 10) g(lvl) ON g.lvl < t.n LEFT JOIN lv ON lv.id = t.id AND lv.lvl = g.lvl),
head AS (SELECT g.id, n, txt = '' AS bare, q <> '' AS hq, q FROM grid g JOIN qual USING (id) WHERE lvl = 0),
frm AS (SELECT h.*, z.size, nis.nis, sk.sk FROM head h JOIN range(1, 11) z(size) ON z.size <= h.n AND z.size >= CASE WHEN bare THEN 2 ELSE 1 END CROSS JOIN (VALUES (false), (true)) nis(nis) CROSS JOIN (VALUES (false), (true)) sk(sk) WHERE (NOT nis OR hq) AND (NOT sk OR (size > 1 AND NOT bare))),
k AS (SELECT f.id, f.size, f.nis, f.sk, string_agg(CASE WHEN f.sk AND g.lvl = 0 THEN '' ELSE g.txt END, '-' ORDER BY g.lvl) || CASE WHEN f.nis THEN ':' || any_value(f.q) ELSE '' END AS key,
 any_value(CASE WHEN sk THEN size - 1 ELSE (size - CASE WHEN bare THEN 2 ELSE 1 END + 1) * CASE WHEN bare THEN 1 ELSE 2 END + CASE WHEN bare THEN 2 ELSE 1 END - 2 END * CASE WHEN nis THEN 2 ELSE 1 END) AS v,
 any_value(greatest(1, (f.n - 1) * CASE WHEN hq THEN 2 ELSE 1 END + CASE WHEN bare THEN 0 ELSE f.n * CASE WHEN hq THEN 2 ELSE 1 END END)) AS total FROM frm f JOIN grid g ON g.id = f.id AND g.lvl < f.size GROUP BY 1, 2, 3, 4),
nk AS (SELECT id, key, max(CAST(v AS DOUBLE) / total) AS score FROM k GROUP BY 1, 2)"""
PAIRS = f"""{KEYS}, bp AS (SELECT x.id AS a, y.id AS b, max(least(x.score, y.score)) AS confidence FROM nk x JOIN nk y ON x.key = y.key AND x.id < y.id GROUP BY 1, 2)"""
DIST = """ids AS (SELECT x.id AS a, y.id AS b FROM nm x JOIN nm y ON x.id < y.id),
 sp AS (SELECT p.a, p.b, s.lvl, count(*) FILTER (s.kind = 'name' OR t.kind = 'name') AS real, count(*) FILTER ((s.kind = 'name' OR t.kind = 'name') AND regexp_replace(s.word, '^[أإآى]', 'ا') <> regexp_replace(t.word, '^[أإآى]', 'ا')) AS clash FROM ids p JOIN slot s ON s.id = p.a JOIN slot t ON t.id = p.b AND t.lvl = s.lvl AND t.slot = s.slot GROUP BY 1, 2, 3),
 em AS (SELECT p.a, p.b, g.lvl FROM ids p JOIN grid g ON g.id = p.a AND g.txt = '' JOIN grid h ON h.id = p.b AND h.lvl = g.lvl AND h.txt = ''),
 d0 AS (SELECT p.a, p.b, coalesce((SELECT count(*) FILTER (real > 0) FROM sp WHERE sp.a = p.a AND sp.b = p.b), 0) + (SELECT count(*) FROM em WHERE em.a = p.a AND em.b = p.b) AS eq, coalesce((SELECT sum(clash) FROM sp WHERE sp.a = p.a AND sp.b = p.b), 0) AS clash, greatest(x.n, y.n) AS mx FROM ids p JOIN top x ON x.id = p.a JOIN top y ON y.id = p.b),
 dist AS (SELECT a, b, CASE WHEN clash > 0 THEN 0.0 ELSE CAST(eq AS DOUBLE) / mx END AS d FROM d0)"""


def canon(spark):
    return names.with_canonical(spark.createDataFrame(NAMES, "id int, name string"), "name")


@register(f"WITH {SLOTS} SELECT id, lvl, slot, word, CASE WHEN kind IN ('name', 'family') THEN regexp_replace(word, '^[أإآى]', 'ا') ELSE word END AS text, kind FROM slot")
def canon_levels(spark, d):
    c = canon(spark).select("id", F.posexplode("canon.levels").alias("lvl", "items")).select("id", "lvl", F.posexplode("items").alias("slot", "x"))
    return c.select("id", F.col("lvl").cast("long").alias("lvl"), F.col("slot").cast("long").alias("slot"), F.col("x.text").alias("word"), F.col("x.text").alias("text"), F.col("x.kind").alias("kind"))


@register(f"WITH {KEYS} SELECT id, key, round(score, 6) AS score FROM nk")
def name_keys(spark, d):
    return names.with_keys(canon(spark)).groupBy("id", "key").agg(F.round(F.max("score"), 6).alias("score"))


@register(f"WITH {PAIRS} SELECT a, b, round(confidence, 6) AS confidence FROM bp")
def blocking_pairs(spark, d):
    pairs = names.blocked_pairs(names.with_keys(canon(spark)).select("id", "key", "score"), "id", salts=4)
    return pairs.select("a", "b", F.round("confidence", 6).alias("confidence"))


@register(f"WITH {KEYS}, {DIST} SELECT a, b, round(d, 6) AS d FROM dist WHERE d > 0")
def structural_distance(spark, d):
    c = canon(spark)
    a, b = c.select(F.col("id").alias("a"), F.col("canon").alias("ca")), c.select(F.col("id").alias("b"), F.col("canon").alias("cb"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))  # fifteen inline names
    return pairs.select("a", "b", F.round(names.distance(F.col("ca"), F.col("cb")), 6).alias("d")).where("d > 0")


@register(f"WITH {KEYS}, {DIST}, c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM nk x JOIN nk y ON x.key = y.key AND x.id < y.id) SELECT a AS mention_id, b AS person_id, round(d, 6) AS similarity FROM c JOIN dist USING (a, b) WHERE d > 0.5")
def graph_match_best(spark, d):
    c = canon(spark)
    found = names.match_index(c.select(F.col("id").alias("mention_id"), "canon"), c.select(F.col("id").alias("person_id"), "canon"), 0.5)
    return found.where("mention_id < person_id").select("mention_id", "person_id", F.round("similarity", 6).alias("similarity"))


@register("""WITH n AS (SELECT DISTINCT p_name FROM part WHERE p_size <= 10), p AS (SELECT a.p_name AS a, b.p_name AS b FROM n a JOIN n b ON string_split(a.p_name, ' ')[1] = string_split(b.p_name, ' ')[1] AND a.p_name < b.p_name)
 SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity, 1 - levenshtein(a, b) / greatest(length(a), length(b)) > 0.75 AS same FROM p""")
def edit_similarity(spark, d):
    return _edit_similarity(table(spark, d, "part").where("p_size <= 10"))


@register()
def edit_similarity_whole(spark, d):
    """``edit_similarity`` of all parts."""
    return _edit_similarity(table(spark, d, "part"))


def _edit_similarity(part):
    n = part.select("p_name").distinct().withColumn("k", F.split("p_name", " ")[0])
    pairs = n.select("k", F.col("p_name").alias("a")).join(n.select("k", F.col("p_name").alias("b")), "k").where("a < b")
    s = T.edit_similarity(F.col("a"), F.col("b"))
    return pairs.select("a", "b", F.round(s, 6).alias("similarity"), (s > 0.75).alias("same"))


@register("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, (list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) + 1) / 2 AS s FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rn FROM s) SELECT query_id, vec_id, round(s, 6) AS similarity FROM r WHERE rn <= 5""")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return names.nearest(e, q, 5).select("query_id", "vec_id", F.round("s", 6).alias("similarity"))


CHAINS = [["محمد بن يحيا", "احمد بن محمد بن عيسا", "ابي عبد الله"], ["محمد بن يحيا", "علي بن ابراهيم", "ابي عبد الله"], ["حرب بن الحسين", "ابراهيم الشيباني", "ابي الجارود"], ["محمد بن يحيا", "احمد بن محمد", "علي بن ابراهيم بن هاشم"]]


def occurrences(spark, chains=CHAINS):
    rows, k = [], 0
    for c, chain in enumerate(chains):
        for p, name in enumerate(chain):
            rows.append((k, c, p, name))
            k += 1
    return names.with_canonical(spark.createDataFrame(rows, "occ_id long, chain_id long, position int, name string"), "name")


#: The persons of the twelve occurrences, read off the output and checked by hand; two names with two of three levels alike are one.
PERSONS = list(enumerate([0, 1, 2, 0, 3, 2, 4, 5, 6, 0, 1, 3]))
KEYS = ["محمد-يحيا", "احمد-محمد-عيسا", "AB عبد الله", "محمد-يحيا", "علي-ابراهيم", "AB عبد الله", "حرب-الحسين", "ابراهيم:الشيباني", "AB الجارود", "محمد-يحيا", "احمد-محمد", "علي-ابراهيم-هاشم"]


@register(f"SELECT * FROM (VALUES {values([(i, p, k) for (i, p), k in zip(PERSONS, KEYS)])}) t(occ_id, person_id, key)")
def greedy_merge(spark, d):
    return merge.assign(occurrences(spark), merge.MergeParams(threshold=0.5)).select("occ_id", "person_id", "key").orderBy("occ_id")


#: The fifth occurrence leaves its person, which breaks one of the two cycles; the other has nothing to split.
UNBROKEN = [(0, 0, "علي-ابراهيم"), (1, 1, "احمد-خالد"), (2, 2, "محمد-يحيا"), (3, 1, "احمد-خالد"), (4, 3, "علي-ابراهيم-هاشم"), (5, 4, "سعد-عمار"), (6, 2, "محمد-يحيا"), (7, 0, "علي-ابراهيم")]


@register(f"SELECT * FROM (VALUES {values(UNBROKEN)}) t(occ_id, person_id, key)")
def cycle_break(spark, d):
    occ = occurrences(spark, [["علي بن ابراهيم", "احمد بن خالد", "محمد بن يحيا"], ["احمد بن خالد", "علي بن ابراهيم بن هاشم", "سعد بن عمار"], ["محمد بن يحيا", "علي بن ابراهيم"]])
    found = merge.assign(occ, merge.MergeParams(threshold=0.1))
    canon_of = occ.select(names.primary_key(F.col("canon")).alias("key"), "canon").dropDuplicates(["key"])
    return merge.break_cycles(found, canon_of, 0.1).select("occ_id", "person_id", "key")


