"""Queries on images and stereo."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.operators import rasters, vision
from tessera.queries.adapters import image, numbered, r
from tessera.queries.geometry import KEYED, KEYED_SQL, KEYS, _points

E = [[0.0, -0.1, 0.2], [0.1, 0.0, -1.0], [-0.2, 1.0, 0.0]]
_PIX = "px AS (SELECT CAST(p_partkey // 1600 AS INTEGER) AS img, CAST((p_partkey % 1600) // 40 AS INTEGER) AS \"row\", CAST(p_partkey % 40 AS INTEGER) AS col, CAST(p_size AS DOUBLE) AS v FROM part)"


@register("sampson", f"WITH {KEYED_SQL}, n AS (SELECT {KEYED}, x/25 AS a, y/50 AS b, x/25+0.01 AS c, z/5 AS d FROM p), l AS (SELECT *, -0.1*b+0.2 AS e0, 0.1*a-1.0 AS e1, -0.2*a+1.0*b AS e2, 0.1*d-0.2 AS f0, -0.1*c+1.0 AS f1 FROM n) SELECT {KEYED}, round((c*e0+d*e1+e2)*(c*e0+d*e1+e2)/greatest(e0*e0+e1*e1+f0*f0+f1*f1, 1e-12), 8) + 0.0 AS error FROM l")
def sampson(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select(*KEYS, r(vision.sampson(E, F.col("x") / 25, F.col("y") / 50, F.col("x") / 25 + 0.01, F.col("z") / 5), 8).alias("error"))


@register("reprojection", f"WITH {KEYED_SQL} SELECT {KEYED}, round(pow(500*(x+1)/(z+20.3)+320 - (310+y), 2) + pow(500*y/(z+20.3)+240 - 250, 2), 2) + 0.0 AS error FROM p")
def reprojection(spark, sf_dir):
    k = np.array([[500, 0, 320], [0, 500, 240], [0, 0, 1.0]])
    e = vision.reprojection_sq(np.eye(3), [1.0, 0.0, 20.3], k, F.col("x"), F.col("y"), F.col("z"), F.col("y") + 310, F.lit(250.0))
    return _points(spark, sf_dir).select(*KEYS, r(e, 2).alias("error"))


def _matches(spark, sf_dir):
    """Points before two cameras, the second half a unit to the right."""
    z = F.col("z") + 20
    p = numbered(spark, sf_dir)
    return p.select(F.col("frame").alias("pair"), "seq", (500 * F.col("x") / z + 320).alias("u1"), (500 * F.col("y") / z + 240).alias("v1"), (500 * (F.col("x") - 0.5) / z + 320).alias("u2"), (500 * F.col("y") / z + 240).alias("v2"), "x", "y", z.alias("z"))


@register("triangulate", "SELECT l_suppkey AS pair, round(l_quantity - 25, 5) + 0.0 AS x, round(l_extendedprice/1000 - 50, 5) + 0.0 AS y, round(l_discount*100 + 15, 5) + 0.0 AS z FROM lineitem")
def triangulate(spark, sf_dir):
    k = np.array([[500, 0, 320], [0, 500, 240], [0, 0, 1.0]])
    t = vision.triangulate(_matches(spark, sf_dir).drop("x", "y", "z"), k @ np.eye(3, 4), k @ np.c_[np.eye(3), [-0.5, 0, 0]])
    return t.select("pair", *[r(F.col(c), 5).alias(c) for c in "xyz"])


@register("essential")
def essential(spark, sf_dir):
    k = [[500, 0, 320], [0, 500, 240], [0, 0, 1.0]]
    return vision.essential(_matches(spark, sf_dir).drop("x", "y", "z"), k)


@register("pnp")
def pnp(spark, sf_dir):
    k = [[500, 0, 320], [0, 500, 240], [0, 0, 1.0]]
    m = _matches(spark, sf_dir).select(F.col("pair").alias("view"), "seq", "x", "y", "z", F.col("u2").alias("u"), F.col("v2").alias("v"))
    return vision.pnp(m, k)


@register("stereo_points", f"WITH {_PIX}, d AS (SELECT *, 60.0/v AS z FROM px WHERE v > 1e-12) SELECT img, row_number() OVER (PARTITION BY img ORDER BY \"row\", col) - 1 AS seq, round((col-20)*z/500, 8) + 0.0 AS x, round((\"row\"-20)*z/500, 8) + 0.0 AS y, round(z, 8) + 0.0 AS z FROM d")
def stereo_points(spark, sf_dir):
    d = image(spark, sf_dir).withColumnRenamed("v", "d")
    p = vision.stereo_points(d, 500.0, 20.0, 20.0, 0.12)
    return p.select("img", F.col("seq").cast("long").alias("seq"), *[r(F.col(c), 8).alias(c) for c in "xyz"])


@register("sobel", f"WITH {_PIX}, o(dr, dc) AS (SELECT * FROM range(-1, 2) a, range(-1, 2) b), j AS (SELECT c.img, c.\"row\", c.col, sum(n.v * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END) AS gx, sum(n.v * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END) AS gy, count(*) FILTER (dr <> 0 OR dc <> 0) AS k FROM (SELECT DISTINCT img, \"row\" + dr AS \"row\", col + dc AS col FROM px, o) c, o JOIN px n ON n.img = c.img AND n.\"row\" = c.\"row\" + dr AND n.col = c.col + dc GROUP BY ALL) SELECT img, CAST(\"row\" AS INTEGER) AS \"row\", CAST(col AS INTEGER) AS col, gx + 0.0 AS gx, gy + 0.0 AS gy FROM j WHERE k = 8")
def sobel(spark, sf_dir):
    return vision.sobel(image(spark, sf_dir)).select("img", "row", "col", (F.col("gx") + 0.0).alias("gx"), (F.col("gy") + 0.0).alias("gy"))


@register("harris")
def harris(spark, sf_dir):
    return vision.corners(image(spark, sf_dir), radius=2)


@register("patch_descriptor")
def patch_descriptor(spark, sf_dir):
    px = image(spark, sf_dir)
    return vision.patches(px, vision.corners(px, radius=2).select("img", "row", "col"), 5).select("img", "row", "col", F.transform("descriptor", lambda v: r(v, 6)).alias("descriptor"))


@register("disparity", f"""WITH {_PIX}, size AS (SELECT img, max("row") + 1 AS h, max(col) + 1 AS w FROM px GROUP BY img),
both_ AS (SELECT l.img, l."row", l.col, l.v AS lv, coalesce(r.v, 0) AS rv FROM px l LEFT JOIN px r ON r.img = l.img AND r."row" = l."row" AND r.col = l.col + 3),
ad AS (SELECT a.img, a."row", a.col, d, abs(a.lv - coalesce(m.rv, 0)) AS v FROM both_ a CROSS JOIN range(0, 8) s(d) LEFT JOIN both_ m ON m.img = a.img AND m."row" = a."row" AND m.col = a.col - d),
c AS (SELECT p.img, p."row", p.col, n.d, sum(n.v) AS v FROM px p JOIN size USING (img) JOIN ad n ON n.img = p.img AND n."row" BETWEEN p."row" - 2 AND p."row" + 2 AND n.col BETWEEN p.col - 2 AND p.col + 2
 WHERE p."row" >= 2 AND p."row" < h - 2 AND p.col >= 2 AND p.col < w - 2 GROUP BY ALL),
b AS (SELECT img, "row", col, arg_min(d, v * 1000 + d) AS d FROM c GROUP BY ALL)
SELECT px.img, px."row", px.col, CAST(coalesce(b.d, 0) AS DOUBLE) AS d FROM px LEFT JOIN b ON b.img = px.img AND b."row" = px."row" AND b.col = px.col""")
def disparity(spark, sf_dir):
    px = image(spark, sf_dir)
    right = px.select("img", "row", (F.col("col") - 3).alias("col"), F.col("v").alias("right"))
    both = px.withColumnRenamed("v", "left").join(right, ["img", "row", "col"], "left").fillna(0.0, ["right"])
    return vision.disparity(both, block=5, num=8)


@register("color_points", f"WITH {KEYED_SQL}, {_PIX}, u AS (SELECT {KEYED}, x + 25 AS u, z + 6 AS v FROM p), w AS (SELECT *, u >= 0 AND u < 40 AND v >= 0 AND v < 40 AS valid FROM u) SELECT {KEYED}, CAST(CASE WHEN valid THEN px.v ELSE 0 END AS SMALLINT) AS r FROM w LEFT JOIN px ON px.img = 0 AND px.\"row\" = least(39, greatest(0, CAST(round_even(w.v, 0) AS INT))) AND px.col = least(39, greatest(0, CAST(round_even(u, 0) AS INT)))")
def color_points(spark, sf_dir):
    px = image(spark, sf_dir).where("img = 0").select("row", "col", *[F.col("v").cast("short").alias(c) for c in "rgb"])
    p = _points(spark, sf_dir).withColumn("u", F.col("x") + 25).withColumn("v", F.col("z") + 6)
    p = p.withColumn("valid", (F.col("u") >= 0) & (F.col("u") < 40) & (F.col("v") >= 0) & (F.col("v") < 40))
    return rasters.colour_points(p, px, 40, 40).select(*KEYS, "r")


@register("open3d_export", f"WITH {KEYED_SQL} SELECT round(sum(x), 3) + 0.0 AS sx, count(*) AS n FROM p")
def open3d_export(spark, sf_dir):
    p = rasters.open3d_points(_points(spark, sf_dir))
    return p.agg(r(F.sum(F.col("points")[0]), 3).alias("sx"), F.count("*").alias("n"))


@register("rviz_markers", "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS id, CAST(o_totalprice/1000 AS DOUBLE) AS x, 'SPHERE' AS type FROM orders")
def rviz_markers(spark, sf_dir):
    from pyspark.sql import Window

    from tessera.queries.adapters import table

    o = table(spark, sf_dir, "orders")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    p = o.select("o_custkey", seq.cast("long").alias("seq"), F.lit(0.0).alias("timestamp"), (F.col("o_totalprice") / 1000).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("qw"), *[F.lit(0.0).alias(c) for c in ("qx", "qy", "qz")])
    # rviz_markers takes poses of one trajectory; here each customer is one
    m = rasters.rviz_markers(p.withColumn("timestamp", F.struct("o_custkey")))
    return m.select(F.col("stamp.o_custkey").alias("o_custkey"), "id", F.col("position.x").alias("x"), "type")


#: A pair of cameras whose baseline is their x axis; both are turned about it by the same half, so that SQL can write the rectification with sines.
_HALF = 0.02
_PAIR = dict(k1=[[30.0, 0, 20], [0, 32.0, 19], [0, 0, 1]], d1=(0.05, -0.01, 0.002, -0.001), k2=[[31.0, 0, 21], [0, 31.0, 20], [0, 0, 1]], d2=(0.03,), t=[-0.5, 0, 0], image_size=(40, 40))
_RECTIFIED = """cam(side, k11, k22, cx, cy, a, b, p, q, turn) AS (VALUES (1, 30.0::DOUBLE, 32.0::DOUBLE, 20.0::DOUBLE, 19.0::DOUBLE, 0.05::DOUBLE, -0.01::DOUBLE, 0.002::DOUBLE, -0.001::DOUBLE, 0.0::DOUBLE), (2, 31.0, 31.0, 21.0, 20.0, 0.03, 0.0, 0.0, 0.0, 0.04)),
grid AS (SELECT side, r AS "row", c AS col, k11, k22, cx, cy, a, b, p, q, (c - 20.5) / 31.0 AS gx, (r - 19.5) / 31.0 AS gy, turn FROM cam, range(40) t(r), range(40) s(c)),
-- the baseline points to -x: the new axes are those of the first camera turned about z by half a circle, and the second camera's turn about x remains
ray AS (SELECT *, -gx AS x, -gy * cos(turn) - sin(turn) AS y, cos(turn) - gy * sin(turn) AS z FROM grid),
flat AS (SELECT *, x/z AS m, y/z AS n, x/z*x/z + y/z*y/z AS rr FROM ray),
map AS (SELECT side, "row", col, k11*(m*(1 + a*rr + b*rr*rr) + 2*p*m*n + q*(rr + 2*m*m)) + cx AS u, k22*(n*(1 + a*rr + b*rr*rr) + p*(rr + 2*n*n) + 2*q*m*n) + cy AS v FROM flat)"""


def _pair():
    turn = np.array([[1, 0, 0], [0, np.cos(2 * _HALF), -np.sin(2 * _HALF)], [0, np.sin(2 * _HALF), np.cos(2 * _HALF)]])
    return vision.stereo_rectify(r=turn, **_PAIR)


@register("rectify", f"WITH {_PIX}, {_RECTIFIED} SELECT DISTINCT m.side, img, m.\"row\", m.col, round(m.u, 6) + 0.0 AS u, round(m.v, 6) + 0.0 AS v FROM map m, px")
def rectify(spark, sf_dir):
    """Where the pixels of both rectified images lie in the images of the cameras, for every image."""
    pair = _pair()
    images = image(spark, sf_dir).select("img").distinct()
    both = [vision.rectification_map(spark, pair, s).withColumn("side", F.lit(s)) for s in (1, 2)]
    return both[0].unionByName(both[1]).crossJoin(images).select("side", "img", "row", "col", r(F.col("u"), 6).alias("u"), r(F.col("v"), 6).alias("v"))


@register("remap", f"""WITH {_PIX}, {_RECTIFIED},
four AS (SELECT side, "row", col, floor(v)::INT + i AS r, floor(u)::INT + j AS c, CASE WHEN i = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END * CASE WHEN j = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END AS w FROM map, range(2) a(i), range(2) b(j))
SELECT side, img, f."row", f.col, round(sum(w * px.v), 4) + 0.0 AS v FROM four f JOIN px ON px."row" = f.r AND px.col = f.c WHERE w > 0 GROUP BY side, img, f."row", f.col HAVING sum(w) > 1 - 1e-9""")
def remap(spark, sf_dir):
    """Images as the rectified cameras would have taken them."""
    pair, px = _pair(), image(spark, sf_dir)
    both = [vision.remap(px, vision.rectification_map(spark, pair, s)).withColumn("side", F.lit(s)) for s in (1, 2)]
    return both[0].unionByName(both[1]).select("side", "img", "row", "col", r(F.col("v"), 4).alias("v"))
