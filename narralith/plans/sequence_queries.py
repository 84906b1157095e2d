"""Ordered queries over events: as-of joins, band joins, budgets; a user's events are a mention stream."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narralith.operators.joins import asof, interval_pairs, interval_semi
from narralith.plans.registry import register, table

SEC = "epoch_us(ts) // 1000000"
E = f"e AS (SELECT event_id, user_id, event_type, value, {SEC} AS sec FROM events)"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


def _halves(spark, d):
    e = events(spark, d)
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "at"), e.where("event_type = 'signup'").select("user_id", "at", F.col("event_id").alias("marker"))


MARK = "m AS (SELECT user_id, sec, max(event_id) AS marker FROM e WHERE event_type = 'signup' GROUP BY 1, 2), p AS (SELECT event_id, user_id, sec FROM e WHERE event_type = 'purchase')"


@register(f"WITH {E}, {MARK} SELECT p.event_id, p.user_id, CASE WHEN p.sec - m.sec <= 86400 THEN m.marker ELSE -1 END AS marker FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.sec >= m.sec".replace("ELSE -1", "ELSE CAST(-1 AS BIGINT)"))
def asof_number_tolerance(spark, d):
    p, m = _halves(spark, d)
    return asof(p, m, ["user_id"], "at", ["marker"], tolerance=86400).select("event_id", "user_id", F.coalesce("m_marker", F.lit(-1)).cast("long").alias("marker"))


@register(f"WITH {E}, {MARK} SELECT p.event_id, coalesce(CAST(m.marker AS VARCHAR), '') AS header FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.sec >= m.sec")
def asof_header(spark, d):
    p, m = _halves(spark, d)
    return asof(p, m, ["user_id"], "at", ["marker"]).select("event_id", F.coalesce(F.col("m_marker").cast("string"), F.lit("")).alias("header"))


@register(f"""WITH {E}, {MARK}, n AS (SELECT p.*, m.sec AS nm FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.sec < m.sec),
 l AS (SELECT *, lead(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS nx FROM n) SELECT event_id, least(coalesce(nm, sec + 4000000), coalesce(nx, sec + 4000000), sec + 4000000) AS stop FROM l""")
def asof_forward_next(spark, d):
    p, m = _halves(spark, d)
    df = asof(p, m, ["user_id"], "at", ["marker"], forward=True, strict=True)
    nxt = F.lead("at").over(W.partitionBy("user_id").orderBy("at", "event_id"))
    return df.select("event_id", F.least(F.coalesce("m_at", F.col("at") + 4000000), F.coalesce(nxt, F.col("at") + 4000000), F.col("at") + 4000000).alias("stop"))


@register(f"""WITH {E}, r AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS run FROM e),
 n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY sec, event_id) - 1 AS spent FROM r)
 SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS words, count(*) FILTER (spent > 5) AS over_budget, max(spent) > 5 AS ended_by_budget FROM n GROUP BY 1, 2""")
def budget_runs(spark, d):
    order = W.partitionBy("user_id").orderBy("at", "event_id")
    df = events(spark, d).withColumn("run", F.count_if(F.col("event_type") == "purchase").over(order))
    df = df.withColumn("spent", F.row_number().over(W.partitionBy("user_id", "run").orderBy("at", "event_id")) - 1)
    return df.groupBy("user_id", "run").agg(F.count("*").alias("words"), F.count_if(F.expr("spent > 5")).alias("over_budget"), (F.max("spent") > 5).alias("ended_by_budget"))


@register(f"""WITH {E}, i AS (SELECT user_id AS book_id, event_type AS person, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) - 1 AS idx FROM e)
 SELECT book_id, person, min(idx) AS first_idx, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS positions FROM i GROUP BY 1, 2""")
def mention_positions(spark, d):
    df = events(spark, d).select(F.col("user_id").alias("book_id"), F.col("event_type").alias("person"), (F.row_number().over(W.partitionBy("user_id").orderBy("at", "event_id")) - 1).cast("long").alias("idx"))
    return df.groupBy("book_id", "person").agg(F.min("idx").alias("first_idx"), F.array_join(F.array_sort(F.collect_list("idx")), ",").alias("positions"))


@register(f"WITH {E} SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.sec - b.sec) < 3600")
def near_band_join(spark, d):
    e = events(spark, d)
    a = e.select("user_id", F.col("event_id").alias("a"), F.col("at").alias("s"), (F.col("at") + 3599).alias("e"))
    b = e.select("user_id", F.col("event_id").alias("b"), F.col("at").alias("s2"), F.col("at").alias("e2"))
    c = e.select("user_id", F.col("event_id").alias("a"), (F.col("at") - 3599).alias("s"), F.col("at").alias("e"))
    # later or at the same second, and earlier: each pair from the side whose interval reaches the other
    later = interval_pairs(a, b, ["user_id"], 3600).where("a < b").select("a", "b")
    earlier = interval_pairs(c, b, ["user_id"], 3600).where("a < b and s2 < e").select("a", "b")
    return later.unionByName(earlier)


@register(f"""WITH {E}, c AS (SELECT event_id, user_id, sec FROM e WHERE event_type = 'purchase'), n AS (SELECT user_id, event_type AS kind, sec FROM e WHERE event_type <> 'purchase'), k AS (SELECT DISTINCT event_type AS kind FROM e WHERE event_type <> 'purchase'),
 q AS (SELECT c.*, k.kind FROM c CROSS JOIN k),
 f AS (SELECT q.*, n.sec AS fa FROM q ASOF LEFT JOIN n ON q.user_id = n.user_id AND q.kind = n.kind AND q.sec <= n.sec),
 b AS (SELECT f.*, n.sec AS ba FROM f ASOF LEFT JOIN n ON f.user_id = n.user_id AND f.kind = n.kind AND f.sec > n.sec)
 SELECT event_id, count(*) FILTER (coalesce(fa - sec < 43200, false) OR coalesce(sec - ba < 43200, false)) AS score FROM b GROUP BY 1""")
def nearest_neighbour_scores(spark, d):
    e = events(spark, d)
    kinds = [r[0] for r in e.where("event_type <> 'purchase'").select("event_type").distinct().orderBy("event_type").collect()]  # a closed set of types
    q = e.where("event_type = 'purchase'").select("event_id", "user_id", "at", F.explode(F.array(*map(F.lit, kinds)) if kinds else F.array().cast("array<string>")).alias("kind"))
    n = e.where("event_type <> 'purchase'").select("user_id", F.col("event_type").alias("kind"), "at", F.lit(1).alias("v"))
    df = asof(asof(q, n, ["user_id", "kind"], "at", ["v"], forward=True, prefix="f_"), n, ["user_id", "kind"], "at", ["v"], strict=True, prefix="b_")
    near = F.coalesce(F.col("f_at") - F.col("at") < 43200, F.lit(False)) | F.coalesce(F.col("at") - F.col("b_at") < 43200, F.lit(False))
    return df.groupBy("event_id").agg(F.count_if(near).alias("score"))


SPANS = f"""{E}, g AS (SELECT user_id AS doc, sec AS s, sec + 1800 AS e FROM e WHERE event_type = 'purchase'), p AS (SELECT user_id AS doc, sec AS s2, sec + 900 AS e2 FROM e WHERE event_type = 'click')"""


def _spans(spark, d):
    e = events(spark, d)
    gold = e.where("event_type = 'purchase'").select(F.col("user_id").alias("doc"), F.col("at").alias("s"), (F.col("at") + 1800).alias("e"))
    pred = e.where("event_type = 'click'").select(F.col("user_id").alias("doc"), F.col("at").alias("s2"), (F.col("at") + 900).alias("e2"))
    return gold, pred


@register(f"WITH {SPANS} SELECT doc, s, e FROM g WHERE EXISTS (SELECT 1 FROM p WHERE p.doc = g.doc AND s2 <= e AND s <= e2)")
def span_semi_join(spark, d):
    gold, pred = _spans(spark, d)
    return interval_semi(gold, pred, ["doc"], 1800)


@register(f"WITH {SPANS} SELECT doc, s, e FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc = g.doc AND s2 <= e AND s <= e2)")
def span_anti_join(spark, d):
    gold, pred = _spans(spark, d)
    hit = interval_semi(gold, pred, ["doc"], 1800).distinct()
    return gold.join(hit, ["doc", "s", "e"], "left_anti")


@register(f"""WITH {E}, b AS (SELECT event_type, value, user_id % 7 = 0 AS hit FROM e), t AS (SELECT 'without' AS condition, event_type, count(*) AS mentions, CAST(0 AS BIGINT) AS confirmed FROM b GROUP BY 2 UNION ALL SELECT 'with', event_type, count(*), count(*) FILTER (hit) FROM b GROUP BY 2) SELECT * FROM t""")
def two_condition_union(spark, d):
    e = events(spark, d)
    one = e.groupBy("event_type").agg(F.count("*").alias("mentions")).select(F.lit("without").alias("condition"), "event_type", "mentions", F.lit(0).cast("long").alias("confirmed"))
    two = e.groupBy("event_type").agg(F.count("*").alias("mentions"), F.count_if(F.expr("user_id % 7 = 0")).alias("confirmed")).select(F.lit("with").alias("condition"), "event_type", "mentions", "confirmed")
    return one.unionByName(two)


@register("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register(f"""WITH {E}, g AS (SELECT *, CASE WHEN sec - lag(sec) OVER o < 1800 THEN 0 ELSE 1 END AS fresh FROM e WINDOW o AS (PARTITION BY user_id ORDER BY sec, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS sid FROM g)
 SELECT user_id, min(sec) AS start, max(sec) + 1800 AS stop, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_runs(spark, d):
    """A pause of exactly the gap starts a new run; a session window would join the two."""
    o = W.partitionBy("user_id").orderBy("at", "event_id")
    e = events(spark, d).withColumn("fresh", F.when(F.col("at") - F.lag("at").over(o) < 1800, 0).otherwise(1))
    s = e.withColumn("sid", F.sum("fresh").over(o)).groupBy("user_id", "sid").agg(F.min("at").alias("start"), (F.max("at") + 1800).alias("stop"), F.count("*").alias("n"))
    return s.select("user_id", "start", "stop", "n")


@register("SELECT event_type, CAST(year(ts) AS BIGINT) AS y, count(*) AS n, grouping(event_type) AS g FROM events GROUP BY ROLLUP (event_type, CAST(year(ts) AS BIGINT))".replace("grouping(event_type) AS g", "CAST(grouping(event_type) AS BIGINT) AS g"))
def rollup_counts(spark, d):
    e = table(spark, d, "events").select("event_type", F.year("ts").cast("long").alias("y"))
    return e.rollup("event_type", "y").agg(F.count("*").alias("n"), F.grouping("event_type").cast("long").alias("g"))
