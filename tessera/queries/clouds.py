"""Queries on clouds and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.operators import clouds, estimation, grids, rasters
from tessera.queries.adapters import PTS_SQL, numbered, pts, r, table
from tessera.queries.geometry import KEYED, KEYED_SQL, KEYS


#: Sums of exact decimals can lie midway between two roundings, where the last bit would decide.
OFF_TIES = 1.23457e-5


@register("ground_height", f"WITH {KEYED_SQL} SELECT {KEYED}, z < 0.3 AS ground FROM p")
def ground_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts(spark, sf_dir).select("seq.*", clouds.is_ground_by_height(F.col("z")).alias("ground"))


@register("doppler_static", f"WITH {KEYED_SQL} SELECT {KEYED}, abs(x / 10) <= 0.5 AS static FROM p")
def doppler_static(spark, sf_dir):
    return pts(spark, sf_dir).select("seq.*", clouds.is_static(F.col("x") / 10).alias("static"))


@register("consistency", f"""WITH {PTS_SQL}, a AS (SELECT DISTINCT frame, x, y, z FROM pts), b AS (SELECT DISTINCT frame - 1 AS frame, x AS u, y AS v, z AS w FROM pts)
 SELECT a.frame, a.x, a.y, a.z, coalesce(bool_or((x-u)*(x-u)+(y-v)*(y-v)+(z-w)*(z-w) <= 12.25), false) AS keep FROM a LEFT JOIN b ON a.frame = b.frame AND abs(a.x-u) <= 3.5 AND abs(a.y-v) <= 3.5 GROUP BY ALL""")
def consistency(spark, sf_dir):
    """Points with a point of the next frame within 3.5."""
    p = pts(spark, sf_dir)
    ref = p.select((F.col("frame") - 1).alias("frame"), "x", "y", "z")
    return clouds.within_distance(p.select("frame", "x", "y", "z").distinct(), ref, 3.5, by=("frame",)).select("frame", "x", "y", "z", "keep")


def _voxel_sql(ox: str, oy: str, oz: str, extra: str = "") -> str:
    return f"""WITH {PTS_SQL}{extra} SELECT frame, CAST(floor((x-{ox})/4.0) AS BIGINT) AS ix, CAST(floor((y-{oy})/4.0) AS BIGINT) AS iy, CAST(floor((z-{oz})/4.0) AS BIGINT) AS iz,
 round(avg(x), 9) + 0.0 AS x, round(avg(y), 9) + 0.0 AS y, round(avg(z), 9) + 0.0 AS z, count(*) AS n FROM {{src}} GROUP BY ALL"""


def _rounded_voxels(v: DataFrame) -> DataFrame:
    return v.select("frame", "ix", "iy", "iz", *[r(F.col(c), 9).alias(c) for c in "xyz"], "n")


@register("voxel_zero_origin", _voxel_sql("0", "0", "0").format(src="pts"))
def voxel_zero_origin(spark, sf_dir):
    return _rounded_voxels(clouds.voxel_downsample(pts(spark, sf_dir), 4.0, ("frame",), origin="zero"))


@register("voxel_min_origin", _voxel_sql("x0", "y0", "z0", ", m AS (SELECT *, min(x) OVER (PARTITION BY frame) AS x0, min(y) OVER (PARTITION BY frame) AS y0, min(z) OVER (PARTITION BY frame) AS z0 FROM pts)").format(src="m"))
def voxel_min_origin(spark, sf_dir):
    return _rounded_voxels(clouds.voxel_downsample(pts(spark, sf_dir), 4.0, ("frame",)))


@register("voxel_first_wins", f"WITH {PTS_SQL}, k AS (SELECT *, CAST(floor(x/4) AS BIGINT) AS ix, CAST(floor(y/4) AS BIGINT) AS iy, CAST(floor(z/4) AS BIGINT) AS iz FROM pts), n AS (SELECT *, row_number() OVER (PARTITION BY frame, ix, iy, iz ORDER BY seq) AS k FROM k) SELECT frame, ix, iy, iz, x, y, z FROM n WHERE k = 1")
def voxel_first_wins(spark, sf_dir):
    return clouds.voxel_first(pts(spark, sf_dir), 4.0, ("frame",)).drop("seq")


_M = ", ".join(f"round(avg({c}), 9) + 0.0 AS m{c}" for c in "xyz") + ", " + ", ".join(f"round(covar_pop({a},{b})*count(*) + 1.23457e-5, 4) + 0.0 AS s{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


@register("plane_moments", f"WITH {PTS_SQL} SELECT frame, count(*) AS n, {_M} FROM pts GROUP BY frame")
def plane_moments(spark, sf_dir):
    m = clouds.plane_moments(pts(spark, sf_dir), ("frame",))
    return m.select("frame", "n", *[r(F.col(f"m{c}"), 9).alias(f"m{c}") for c in "xyz"], *[r(F.col(f"s{k}") + OFF_TIES, 4).alias(f"s{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")])


PLANES = [(0, 0.0, 0.0, 1.0, 0.0), (1, 0.6, 0.0, 0.8, 1.0), (2, 0.0, 0.6, 0.8, -2.0), (3, 1.0, 0.0, 0.0, 5.0)]


@register("ransac_inliers", f"WITH {PTS_SQL}, h(hyp, nx, ny, nz, d) AS (VALUES " + ", ".join(f"({h}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for h, a, b, c, d in PLANES) + ") SELECT hyp, count(*) AS inliers FROM pts, h WHERE abs(nx*x+ny*y+nz*z-d) <= 1.503 GROUP BY hyp")
def ransac_inliers(spark, sf_dir):
    planes = spark.createDataFrame(PLANES, "hyp int, nx double, ny double, nz double, d double")
    return clouds.count_inliers(pts(spark, sf_dir), planes, 1.503)


@register("ransac_plane")
def ransac_plane(spark, sf_dir):
    normal, d, cloud = clouds.ransac_plane(pts(spark, sf_dir), threshold=2.0, seed=1)
    plane = [F.lit(round(float(v), 6)).alias(c) for c, v in zip(("nx", "ny", "nz", "d"), (*normal, d), strict=True)]
    return cloud.groupBy("frame").agg(F.count("*").alias("n"), F.sum(F.col("inlier").cast("long")).alias("inliers")).select("*", *plane)


@register("ransac_ground")
def ransac_ground(spark, sf_dir):
    normal, d, cloud = clouds.ransac_ground(pts(spark, sf_dir), threshold=2.0, normal_threshold=0.5, seed=1)
    plane = [F.lit(round(float(v), 6)).alias(c) for c, v in zip(("nx", "ny", "nz", "d"), (*normal, d), strict=True)]
    return cloud.groupBy("frame").agg(F.count("*").alias("n"), F.sum(F.col("ground").cast("long")).alias("ground")).select("*", *plane)


@register("normals")
def normals(spark, sf_dir):
    return clouds.normals(numbered(spark, sf_dir), 12).select("frame", "seq", "nx", "ny", "nz")


@register("ground_normals")
def ground_normals(spark, sf_dir):
    return clouds.ground_by_normals(numbered(spark, sf_dir), 12, 0.5).select("frame", "seq", "nz", "ground")


@register("map_scans", f"WITH {PTS_SQL} SELECT frame, round(sum(-y + 0.5*frame), 5) + 0.0 AS sx, round(sum(x), 5) + 0.0 AS sy, round(sum(z), 5) + 0.0 AS sz, count(*) AS n FROM pts GROUP BY frame")
def map_scans(spark, sf_dir):
    from tessera.functions import se3

    p = pts(spark, sf_dir)
    poses = p.select("frame").distinct().withColumn("transform", se3.rigid(se3.matrix([0, -1, 0, 1, 0, 0, 0, 0, 1]), F.col("frame") * 0.5, 0.0, 0.0))
    return clouds.add_scans(p, poses).groupBy("frame").agg(*[r(F.sum(c), 5).alias(f"s{c}") for c in "xyz"], F.count("*").alias("n"))


@register("local_map", f"WITH {PTS_SQL}, l AS (SELECT DISTINCT frame FROM pts ORDER BY frame DESC LIMIT 10) SELECT frame, count(*) AS n, round(sum(x), 3) + 0.0 AS sx FROM pts JOIN l USING (frame) GROUP BY frame")
def local_map(spark, sf_dir):
    """The last ten keyframes are the feature."""
    return clouds.local_map(pts(spark, sf_dir)).groupBy("frame").agg(F.count("*").alias("n"), r(F.sum("x"), 3).alias("sx"))


_PAIR = ", ".join(f"round(avg({k}), 9) + 0.0 AS m{n}" for n, k in (("sx", "x"), ("sy", "y"), ("sz", "z"), ("tx", "-y+1"), ("ty", "x+2"), ("tz", "z+3"))) + ", " + ", ".join(f"round(covar_pop({a}, {t})*count(*) + 1.23457e-5, 4) + 0.0 AS c{a}{b}" for a in "xyz" for b, t in (("x", "-y+1"), ("y", "x+2"), ("z", "z+3")))


def _pairs(spark, sf_dir):
    return pts(spark, sf_dir).select("frame", *[F.col(c).alias(f"s{c}") for c in "xyz"], (1 - F.col("y")).alias("tx"), (F.col("x") + 2).alias("ty"), (F.col("z") + 3).alias("tz"))


@register("kabsch_moments", f"WITH {PTS_SQL} SELECT frame, count(*) AS n, {_PAIR} FROM pts GROUP BY frame")
def kabsch_moments(spark, sf_dir):
    m = estimation.kabsch_moments(_pairs(spark, sf_dir), ("frame",))
    return m.select("frame", "n", *[r(F.col(f"m{k}{c}"), 9).alias(f"m{k}{c}") for k in "st" for c in "xyz"], *[r(F.col(f"c{a}{b}") + OFF_TIES, 4).alias(f"c{a}{b}") for a in "xyz" for b in "xyz"])


@register("kabsch", "SELECT * FROM (VALUES (0, 0.0::DOUBLE, -1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), (1, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 2.0::DOUBLE), (2, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 3.0::DOUBLE)) v(\"row\", a, b, c, t)")
def kabsch(spark, sf_dir):
    """A quarter turn and a shift are recovered from all points."""
    m = estimation.kabsch(_pairs(spark, sf_dir).drop("frame"))
    return spark.createDataFrame([(i, *[round(float(v), 6) + 0.0 for v in m[i]]) for i in range(3)], "row int, a double, b double, c double, t double")


_EGO = "WITH d AS (SELECT l_suppkey AS frame, -(l_quantity - 20) AS w, cos(radians(l_tax*100))*cos(radians(l_discount*900)) AS x, cos(radians(l_tax*100))*sin(radians(l_discount*900)) AS y, sin(radians(l_tax*100)) AS z FROM lineitem WHERE l_extendedprice / 5000 >= 3) SELECT frame, count(*) AS n, " + ", ".join(f"round(sum({a}*{b}), 5) + 0.0 AS a{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + ", " + ", ".join(f"round(sum(w*{a}), 4) + 0.0 AS b{a}" for a in "xyz") + " FROM d GROUP BY frame"


@register("ego_velocity_moments", _EGO)
def ego_velocity_moments(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS frame", "l_discount * 900 AS azimuth", "l_tax * 100 AS elevation", "l_quantity - 20 AS velocity", "l_extendedprice / 5000 AS snr")
    m = estimation.ego_velocity_moments(d, 3.0, ("frame",))
    return m.select("frame", "n", *[r(F.col(f"a{k}"), 5).alias(f"a{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")], *[r(F.col(f"b{k}"), 4).alias(f"b{k}") for k in "xyz"])


@register("bresenham", """WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_quantity AS BIGINT) AS x1, CAST(l_tax*100 AS BIGINT) AS y1 FROM lineitem),
 m AS (SELECT *, greatest(x1, y1) AS big, least(x1, y1) AS small FROM l), e AS (SELECT *, unnest(range(0, big + 1)) AS k FROM m),
 c AS (SELECT *, CAST(floor((k*small - floor(big/2.0) + big - 1) / greatest(big, 1)) AS BIGINT) AS s FROM e)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, count(*) AS cells, CAST(sum(CASE WHEN x1 >= y1 THEN k ELSE s END) AS BIGINT) AS sx, CAST(sum(CASE WHEN x1 >= y1 THEN s ELSE k END) AS BIGINT) AS sy FROM c GROUP BY ALL""")
def bresenham(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("c", F.explode(grids.bresenham(F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("l_quantity").cast("long"), F.round(F.col("l_tax") * 100).cast("long"))))
    return t.groupBy(*KEYS).agg(F.count("*").alias("cells"), F.sum("c.x").alias("sx"), F.sum("c.y").alias("sy"))


_OCC = f"""WITH {PTS_SQL}, ray AS (SELECT frame, seq, CAST(floor((x+25)/5) AS BIGINT) AS cx, CAST(floor((y+50)/10) AS BIGINT) AS cy FROM pts WHERE z >= -4.5),
 m AS (SELECT *, cx - 5 AS dx, cy - 5 AS dy, greatest(abs(cx-5), abs(cy-5)) AS big, least(abs(cx-5), abs(cy-5)) AS small FROM ray),
 e AS (SELECT *, unnest(range(0, big + 1)) AS k FROM m),
 s AS (SELECT *, CAST(floor((k*small - floor(big/2.0) + big - 1) / greatest(big, 1)) AS BIGINT) AS o FROM e),
 c AS (SELECT frame, seq, k, 5 + CAST(sign(dx) AS BIGINT) * CASE WHEN abs(dx) >= abs(dy) THEN k ELSE o END AS col, 5 + CAST(sign(dy) AS BIGINT) * CASE WHEN abs(dx) >= abs(dy) THEN o ELSE k END AS "row", CASE WHEN k = big THEN 0.85 ELSE -0.4 END::DOUBLE AS delta FROM s),
 l AS (SELECT frame AS grid, col, "row", list(delta ORDER BY seq, k) AS d FROM c WHERE col >= 0 AND col < 11 AND "row" >= 0 AND "row" < 11 GROUP BY ALL),
 f AS (SELECT grid, col, "row", round(list_reduce(d, lambda a, u: greatest(-5.0, least(5.0, a + u)), 0.0::DOUBLE), 6) + 0.0 AS log_odds FROM l)
"""


def _occupancy(spark, sf_dir):
    p = pts(spark, sf_dir).withColumn("grid", F.col("frame"))
    # cells of 5 by 10, so the axes are scaled to cells first
    scaled = p.withColumn("x", (F.col("x") + 25) / 5).withColumn("y", (F.col("y") + 50) / 10).withColumn("ox", F.lit(5.5)).withColumn("oy", F.lit(5.5))
    return grids.scan_occupancy(scaled, 1.0, 11, 11, z_range=(-4.5, 1e9), by=("grid",)).withColumn("log_odds", r(F.col("log_odds"), 6))


@register("occupancy", _OCC + "SELECT * FROM f")
def occupancy(spark, sf_dir):
    return _occupancy(spark, sf_dir)


@register("occupancy_ros", _OCC + "SELECT grid, col, \"row\", CAST(CASE WHEN log_odds > 0 THEN 100 WHEN log_odds < 0 THEN 0 ELSE -1 END AS TINYINT) AS value, round(1/(1+exp(-log_odds)), 6) + 0.0 AS p FROM f")
def occupancy_ros(spark, sf_dir):
    o = _occupancy(spark, sf_dir)
    return o.select("grid", "col", "row", grids.to_ros(F.col("log_odds")).alias("value"), r(grids.to_probability(F.col("log_odds")), 6).alias("p"))


_TSDF = f"""WITH {PTS_SQL}, p AS (SELECT frame, x, y, z, sqrt(x*x+y*y+(z-10)*(z-10)) AS d FROM pts),
 b AS (SELECT *, unnest(range(greatest(0, CAST(floor((x-2+25)/4) AS BIGINT)), CAST(ceil((x+2+25)/4) AS BIGINT)+1)) AS ix FROM p WHERE d > 1e-9),
 c AS (SELECT *, unnest(range(greatest(0, CAST(floor((y-2+50)/4) AS BIGINT)), CAST(ceil((y+2+50)/4) AS BIGINT)+1)) AS iy FROM b),
 e AS (SELECT *, unnest(range(greatest(0, CAST(floor((z-2+6)/4) AS BIGINT)), CAST(ceil((z+2+6)/4) AS BIGINT)+1)) AS iz FROM c),
 s AS (SELECT *, d - ((-25+(ix+0.5)*4)*x/d + (-50+(iy+0.5)*4)*y/d + (-6+(iz+0.5)*4-10)*(z-10)/d) AS sdf FROM e),
 v AS (SELECT frame, ix, iy, iz, avg(greatest(-1.0, least(1.0, sdf/2))) AS tsdf, CAST(count(*) AS DOUBLE) AS weight FROM s WHERE abs(sdf) <= 2 GROUP BY ALL)
"""


def _tsdf(spark, sf_dir):
    p = pts(spark, sf_dir).withColumn("ox", F.lit(0.0)).withColumn("oy", F.lit(0.0)).withColumn("oz", F.lit(10.0))
    return grids.tsdf(p, 4.0, 2.0, (-25.0, -50.0, -6.0), by=("frame",))


@register("tsdf", _TSDF + "SELECT frame, ix, iy, iz, round(tsdf, 6) + 0.0 AS tsdf, weight FROM v")
def tsdf(spark, sf_dir):
    return _tsdf(spark, sf_dir).withColumn("tsdf", r(F.col("tsdf"), 6))


@register("tsdf_surface", _TSDF + "SELECT frame, CAST(-25+(ix+0.5)*4 AS DOUBLE) AS x, CAST(-50+(iy+0.5)*4 AS DOUBLE) AS y, CAST(-6+(iz+0.5)*4 AS DOUBLE) AS z FROM v WHERE abs(tsdf) <= 0.1")
def tsdf_surface(spark, sf_dir):
    return grids.surface(_tsdf(spark, sf_dir), 4.0, (-25.0, -50.0, -6.0))


_JET = "CAST(trunc(greatest(0.0, least(1.0, 4*t-2))*255) AS SMALLINT) AS r, CAST(trunc(greatest(0.0, least(1.0, least(4*t, 4-4*t)))*255) AS SMALLINT) AS g, CAST(trunc(greatest(0.0, least(1.0, 2-4*t))*255) AS SMALLINT) AS b"


@register("birdseye", f"""WITH {PTS_SQL}, c AS (SELECT CAST(floor((x+25)/0.5) AS BIGINT) AS col, CAST(199-floor((y+50)/0.5) AS BIGINT) AS "row", seq, (z+5)/10 AS t FROM pts),
 n AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY seq DESC) AS k FROM c WHERE "row" >= 0 AND "row" < 200 AND col >= 0 AND col < 100) SELECT "row", col, {_JET} FROM n WHERE k = 1""")
def birdseye(spark, sf_dir):
    return rasters.birdseye(pts(spark, sf_dir), 100, 200, 0.5, (-25.0, -50.0), (-5.0, 5.0))


@register("trajectory_raster", f"""WITH {PTS_SQL}, m AS (SELECT DISTINCT CAST(floor((avg(x)+5)/0.05) AS BIGINT) AS c0, CAST(199-floor((avg(y)+20)/0.2) AS BIGINT) AS r0 FROM pts GROUP BY frame),
 d AS (SELECT DISTINCT r0 + dr AS "row", c0 + dc AS col FROM m, range(-2, 3) a(dr), range(-2, 3) b(dc)) SELECT "row", col, CAST(255 AS SMALLINT) AS r, CAST(127 AS SMALLINT) AS g, CAST(0 AS SMALLINT) AS b FROM d WHERE "row" >= 0 AND "row" < 200 AND col >= 0 AND col < 200""")
def trajectory_raster(spark, sf_dir):
    m = pts(spark, sf_dir).groupBy("frame").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select(((F.col("x") + 5) / 0.05).alias("x"), ((F.col("y") + 20) / 0.2).alias("y"))
    return rasters.trajectory(m, 200, 200, 1.0)


@register("overlay", f"""WITH {PTS_SQL}, c AS (SELECT seq, CAST(round_even(8*x/(z+6)+50, 0) AS BIGINT) AS c0, CAST(round_even(8*y/(z+6)+50, 0) AS BIGINT) AS r0, (z+5)/10 AS t FROM pts),
 d AS (SELECT r0 + dr AS "row", c0 + dc AS col, seq, t FROM c, range(-1, 2) a(dr), range(-1, 2) b(dc)),
 n AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY seq DESC) AS k FROM d WHERE "row" >= 0 AND "row" < 100 AND col >= 0 AND col < 100) SELECT "row", col, {_JET} FROM n WHERE k = 1""")
def overlay(spark, sf_dir):
    z = F.col("z") + 6
    p = pts(spark, sf_dir).select("seq", (8 * F.col("x") / z + 50).alias("u"), (8 * F.col("y") / z + 50).alias("v"), F.lit(True).alias("valid"), F.col("z").alias("depth"))
    return rasters.overlay(p, 100, 100, 1, (-5.0, 5.0))
