"""Queries on descriptors and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.operators import descriptors
from tessera.queries.adapters import PTS_SQL, image, numbered, pts, r, table

_SC = f"""WITH {PTS_SQL}, b AS (SELECT frame, least(19, CAST(floor(sqrt(x*x+y*y)/80*20) AS INT)) AS ring, least(59, CAST(floor((CASE WHEN atan2(y,x) < 0 THEN atan2(y,x)+2*pi() ELSE atan2(y,x) END)/(2*pi())*60) AS INT)) AS sector, z FROM pts WHERE sqrt(x*x+y*y) > 0 AND sqrt(x*x+y*y) <= 80),
sc AS (SELECT frame, ring, sector, max(z) AS h FROM b GROUP BY ALL HAVING max(z) > 0)
"""


@register("scan_context", _SC + "SELECT frame, ring, sector, round(h, 6) + 0.0 AS h FROM sc")
def scan_context(spark, sf_dir):
    return descriptors.scan_context(pts(spark, sf_dir)).withColumn("h", r(F.col("h"), 6))


@register("ring_key", _SC + "SELECT frame, ring, round(sum(h)/60, 6) + 0.0 AS key FROM sc GROUP BY ALL")
def ring_key(spark, sf_dir):
    return descriptors.ring_key(descriptors.scan_context(pts(spark, sf_dir))).withColumn("key", r(F.col("key"), 6))


@register("scan_context_distance", _SC + """, n AS (SELECT frame, ring, sqrt(sum(h*h)) AS n FROM sc GROUP BY ALL), f AS (SELECT DISTINCT frame AS a, frame + 1 AS b FROM sc WHERE frame + 1 IN (SELECT frame FROM sc)),
d AS (SELECT a, b, x.ring, (y.sector - x.sector + 60) % 60 AS s, sum(x.h*y.h) AS dot FROM f JOIN sc x ON x.frame = a JOIN sc y ON y.frame = b AND y.ring = x.ring GROUP BY ALL),
g AS (SELECT a, b, r.ring, s, na.n AS na, nb.n AS nb FROM f, range(20) r(ring), range(60) t(s) LEFT JOIN n na ON na.frame = a AND na.ring = r.ring LEFT JOIN n nb ON nb.frame = b AND nb.ring = r.ring),
m AS (SELECT g.a, g.b, g.s, sum(CASE WHEN na IS NULL AND nb IS NULL THEN 0 WHEN na IS NULL OR nb IS NULL THEN 1 ELSE 1 - coalesce(dot, 0)/(na*nb) END)/20 AS distance FROM g LEFT JOIN d ON d.a = g.a AND d.b = g.b AND d.ring = g.ring AND d.s = g.s GROUP BY ALL)
SELECT a, b, round(min(distance), 6) + 0.0 AS distance FROM m GROUP BY a, b""")
def scan_context_distance(spark, sf_dir):
    sc = descriptors.scan_context(pts(spark, sf_dir))
    f = sc.select("frame").distinct()
    pairs = f.select(F.col("frame").alias("a"), (F.col("frame") + 1).alias("b")).join(f.withColumnRenamed("frame", "b"), "b")
    return descriptors.scan_context_distance(sc, pairs).select("a", "b", r(F.col("distance"), 6).alias("distance"))


@register("scan_context_query", _SC + """, n AS (SELECT frame, ring, sqrt(sum(h*h)) AS n FROM sc GROUP BY ALL), fr AS (SELECT DISTINCT frame FROM pts),
k AS (SELECT fr.frame, r.ring, coalesce(sum(h), 0)/60 AS key FROM fr CROSS JOIN range(20) r(ring) LEFT JOIN sc ON sc.frame = fr.frame AND sc.ring = r.ring GROUP BY ALL),
l AS (SELECT x.frame AS a, y.frame AS b, round(sum(abs(x.key - y.key)), 9) AS l1 FROM k x JOIN k y ON y.ring = x.ring AND y.frame < x.frame - 5 GROUP BY ALL),
f AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY l1, b) AS i FROM l) WHERE i <= 10),
d AS (SELECT a, b, x.ring, (y.sector - x.sector + 60) % 60 AS s, sum(x.h*y.h) AS dot FROM f JOIN sc x ON x.frame = a JOIN sc y ON y.frame = b AND y.ring = x.ring GROUP BY ALL),
g AS (SELECT a, b, r.ring, s, na.n AS na, nb.n AS nb FROM f, range(20) r(ring), range(60) t(s) LEFT JOIN n na ON na.frame = a AND na.ring = r.ring LEFT JOIN n nb ON nb.frame = b AND nb.ring = r.ring),
m AS (SELECT g.a, g.b, g.s, sum(CASE WHEN na IS NULL AND nb IS NULL THEN 0 WHEN na IS NULL OR nb IS NULL THEN 1 ELSE 1 - coalesce(dot, 0)/(na*nb) END)/20 AS distance FROM g LEFT JOIN d ON d.a = g.a AND d.b = g.b AND d.ring = g.ring AND d.s = g.s GROUP BY ALL),
e AS (SELECT a, b, round(min(distance), 12) AS distance FROM m GROUP BY a, b)
SELECT a, arg_min(b, (distance, b)) AS b, round(min(distance), 6) + 0.0 AS distance FROM e GROUP BY a""")
def scan_context_query(spark, sf_dir):
    """For every scan the one most like it among those inserted more than five before it."""
    sc = descriptors.scan_context(pts(spark, sf_dir))
    order = pts(spark, sf_dir).select("frame").distinct().withColumn("position", F.col("frame"))
    return descriptors.nearest_places(sc, order, exclusion_window=5, candidate_pool=10).select("a", "b", r(F.col("distance"), 6).alias("distance"))


_COS = "SELECT q.vec_id AS query, e.vec_id AS id, 1 - list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))) AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id < q.vec_id - 10"


@register("image_query", f"WITH d AS ({_COS}), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d) SELECT query, id, round(distance, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 3")
def image_query(spark, sf_dir):
    """Every twentieth image asks all images inserted more than ten before it."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("position"), F.col("embedding").alias("descriptor"))
    q = descriptors.nearest_descriptors(e, e.where("id % 20 = 0"), exclusion_window=10, top_k=3)
    return q.select("query", "id", r(F.col("distance"), 6).alias("distance"), "rank")


_MATCH = """WITH l AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 0), s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 1),
d AS (SELECT l.vec_id AS a, s.vec_id AS b, sqrt(list_dot_product(l.v,l.v)+list_dot_product(s.v,s.v)-2*list_dot_product(l.v,s.v)) AS d FROM l, s),
n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d)
SELECT x.a, x.b, round(x.d, 6) + 0.0 AS distance FROM n x JOIN n y ON x.a = y.a AND x.k = 1 AND y.k = 2 WHERE x.d / y.d < 0.98"""


@register("match_features", _MATCH)
def match_features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("descriptor"), "label")
    return descriptors.match_features(e.where("label = 0"), e.where("label = 1"), 0.98).withColumn("distance", r(F.col("distance"), 6))


@register("m2dp")
def m2dp(spark, sf_dir):
    return descriptors.m2dp(numbered(spark, sf_dir)).select("frame", "descriptor")


@register("image_descriptor")
def image_descriptor(spark, sf_dir):
    return descriptors.image_descriptors(image(spark, sf_dir)).select("img", "descriptor")
