"""Queries of column expressions: transforms, cameras, geodesy, sentences, colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.functions import camera, colour, geo, nmea, se3
from tessera.operators import rig
from tessera.queries.adapters import FIX_SQL, PTS_SQL, fixes, pts, r, table

T = [0.0, -1.0, 0.0, 1.5, 1.0, 0.0, 0.0, -2.0, 0.0, 0.0, 1.0, 0.25, 0.0, 0.0, 0.0, 1.0]
K = camera.camera_matrix(500.0, 510.0, 320.0, 240.0)
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
KEYED_SQL = "p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_quantity - 25 AS DOUBLE) AS x, CAST(l_extendedprice / 1000 - 50 AS DOUBLE) AS y, CAST(l_discount * 100 - 5 AS DOUBLE) AS z FROM lineitem)"
KEYED = ", ".join(KEYS)
#: Parts of a name in a join of pairs, and the tasks of that join and of sentences.
SPREAD, TASKS = 8, 96


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pts(spark, sf_dir)
    return p.select("seq.*", "x", "y", "z")


@register("transform_points", f"WITH {KEYED_SQL} SELECT {KEYED}, round(-y + 1.5, 6) + 0.0 AS x, round(x - 2, 6) + 0.0 AS y, round(z + 0.25, 6) + 0.0 AS z FROM p")
def transform_points(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("q", se3.apply_to_point(se3.matrix(T), F.col("x"), F.col("y"), F.col("z")))
    return p.select(*KEYS, *[r(F.col(f"q.{c}"), 6).alias(c) for c in "xyz"])


def _sensors(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    q = F.array(F.lit(1.0), F.col("s_acctbal") / 10000.0, F.lit(0.1), F.lit(-0.2))
    m = se3.from_quaternion(q, (F.col("s_suppkey") / 10.0, F.lit(1.0), F.lit(-0.5)))
    return s.select(F.concat(F.lit("sensor"), F.col("s_nationkey")).alias("name"), "s_suppkey", m.alias("transform"), (F.col("s_nationkey") / 100.0).alias("time_offset"), q.alias("q"))


_Q_SQL = """
q AS (SELECT s_suppkey, s_nationkey, 1.0::DOUBLE AS w0, CAST(s_acctbal / 10000.0 AS DOUBLE) AS x0, 0.1::DOUBLE AS y0, -0.2::DOUBLE AS z0 FROM supplier),
u AS (SELECT *, w0 / n AS w, x0 / n AS x, y0 / n AS y, z0 / n AS z FROM (SELECT *, sqrt(w0*w0 + x0*x0 + y0*y0 + z0*z0) AS n FROM q)),
m AS (SELECT s_suppkey, s_nationkey, w, x, y, z, 1-2*(y*y+z*z) AS r0, 2*(x*y-z*w) AS r1, 2*(x*z+y*w) AS r2, 2*(x*y+z*w) AS r3, 1-2*(x*x+z*z) AS r4, 2*(y*z-x*w) AS r5, 2*(x*z-y*w) AS r6, 2*(y*z+x*w) AS r7, 1-2*(x*x+y*y) AS r8,
  CAST(s_suppkey / 10.0 AS DOUBLE) AS tx, 1.0::DOUBLE AS ty, -0.5::DOUBLE AS tz FROM u)
"""


@register("quaternion_to_matrix", f"WITH {_Q_SQL} SELECT s_suppkey, " + ", ".join(f"round(r{i}, 8) + 0.0 AS r{i}" for i in range(9)) + " FROM m")
def quaternion_to_matrix(spark, sf_dir):
    return _sensors(spark, sf_dir).withColumn("m", se3.quaternion_to_matrix(F.col("q"))).select("s_suppkey", *[r(F.col("m")[i], 8).alias(f"r{i}") for i in range(9)])


@register("matrix_to_quaternion", f"WITH {_Q_SQL} SELECT s_suppkey, round(w, 7) + 0.0 AS w, round(x, 7) + 0.0 AS x, round(y, 7) + 0.0 AS y, round(z, 7) + 0.0 AS z FROM m")
def matrix_to_quaternion(spark, sf_dir):
    m = _sensors(spark, sf_dir).withColumn("p", se3.matrix_to_quaternion(se3.quaternion_to_matrix(F.col("q"))))
    return m.select("s_suppkey", *[r(F.col("p")[i], 7).alias(c) for i, c in enumerate("wxyz")])


@register("inverse_transform", f"WITH {_Q_SQL} SELECT s_suppkey, " + ", ".join(f"round({e}, 6) + 0.0 AS m{i}" for i, e in enumerate(["r0", "r3", "r6", "-(r0*tx+r3*ty+r6*tz)", "r1", "r4", "r7", "-(r1*tx+r4*ty+r7*tz)", "r2", "r5", "r8", "-(r2*tx+r5*ty+r8*tz)"])) + " FROM m")
def inverse_transform(spark, sf_dir):
    m = _sensors(spark, sf_dir).withColumn("i", se3.inverse(F.col("transform")))
    return m.select("s_suppkey", *[r(F.col("i")[i], 6).alias(f"m{i}") for i in range(12)])


@register("compose_transforms", f"WITH {_Q_SQL} SELECT s_suppkey, " + ", ".join(f"round({e}, 6) + 0.0 AS m{i}" for i, e in enumerate(["-r3", "-r4", "-r5", "-ty+1.5", "r0", "r1", "r2", "tx-2", "r6", "r7", "r8", "tz+0.25"])) + " FROM m")
def compose_transforms(spark, sf_dir):
    m = _sensors(spark, sf_dir).withColumn("i", se3.multiply(se3.matrix(T), F.col("transform")))
    return m.select("s_suppkey", *[r(F.col("i")[i], 6).alias(f"m{i}") for i in range(12)])


@register("sensor_pair_matrix", f"""WITH {_Q_SQL} SELECT a.s_suppkey AS source, b.s_suppkey AS target, round((b.s_nationkey - a.s_nationkey) / 100.0, 6) + 0.0 AS time_offset,
  round(b.r0*(a.tx-b.tx) + b.r3*(a.ty-b.ty) + b.r6*(a.tz-b.tz), 6) + 0.0 AS tx, round(b.r0*a.r0 + b.r3*a.r3 + b.r6*a.r6, 6) + 0.0 AS r0 FROM m a JOIN m b ON a.s_suppkey <> b.s_suppkey AND a.s_nationkey = b.s_nationkey""")
def sensor_pair_matrix(spark, sf_dir):
    """A matrix is inverted once a sensor. Few names hold all pairs, so a name is dealt in SPREAD parts, and the parts over as many tasks."""
    s = _sensors(spark, sf_dir)
    part = F.pmod(F.xxhash64("source"), F.lit(SPREAD)).cast("int")
    a = s.select("name", F.col("s_suppkey").alias("source"), F.col("transform").alias("ta"), F.col("time_offset").alias("oa")).withColumn("part", part)
    b = s.select("name", F.col("s_suppkey").alias("target"), se3.inverse(F.col("transform")).alias("tb"), F.col("time_offset").alias("ob")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    p = a.repartition(TASKS, "name", "part").join(b.repartition(TASKS, "name", "part").hint("merge"), ["name", "part"]).where("source <> target")
    entry = lambda i, j: se3.product_entry(F.col("tb"), F.col("ta"), i, j)
    return p.select("source", "target", r(F.col("ob") - F.col("oa"), 6).alias("time_offset"), r(entry(0, 3), 6).alias("tx"), r(entry(0, 0), 6).alias("r0"))


@register("exp_log_so3", f"WITH {KEYED_SQL} SELECT {KEYED}, round(x / 25, 8) + 0.0 AS a, round(y / 100, 8) + 0.0 AS b, round(z / 10, 8) + 0.0 AS c FROM p")
def exp_log_so3(spark, sf_dir):
    v = F.array(F.col("x") / 25, F.col("y") / 100, F.col("z") / 10)
    p = _points(spark, sf_dir).withColumn("v", se3.log_so3(se3.exp_so3(v)))
    return p.select(*KEYS, *[r(F.col("v")[i], 8).alias(n) for i, n in enumerate("abc")])


@register("quaternion_product", f"WITH {_Q_SQL} SELECT s_suppkey, round(w*w-x*x-y*y-z*z, 8) + 0.0 AS w, round(2*w*x, 8) + 0.0 AS x, round(2*w*y, 8) + 0.0 AS y, round(2*w*z, 8) + 0.0 AS z FROM m")
def quaternion_product(spark, sf_dir):
    q = _sensors(spark, sf_dir).withColumn("p", se3.matrix_to_quaternion(se3.quaternion_to_matrix(F.col("q")))).withColumn("s", se3.quaternion_multiply(F.col("p"), F.col("p")))
    return q.select("s_suppkey", *[r(F.col("s")[i], 8).alias(c) for i, c in enumerate("wxyz")])


@register("focal_fov", "SELECT p_partkey, round(p_size / 2.0 / tan(radians(p_retailprice / 20.0) / 2), 6) + 0.0 AS focal, round(p_retailprice * p_size / 36.0, 6) + 0.0 AS sensor_focal, round(p_size / 2.0 / (radians(p_retailprice / 10.0) / 2), 6) + 0.0 AS fisheye, round(degrees(2 * atan(p_size / 2.0 / p_retailprice)), 6) + 0.0 AS fov FROM part")
def focal_fov(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return p.select("p_partkey", r(camera.focal_length_from_fov(size, price / 20.0), 6).alias("focal"), r(camera.focal_length_from_sensor(size, F.lit(36.0), price), 6).alias("sensor_focal"), r(camera.fisheye_focal_length_from_fov(size, price / 10.0), 6).alias("fisheye"), r(camera.fov_from_focal_length(price, size), 6).alias("fov"))


@register("project_points", f"""WITH {KEYED_SQL}, c AS (SELECT *, CASE WHEN z > 0 THEN 500.0*x/z + 320 END AS u0, CASE WHEN z > 0 THEN 510.0*y/z + 240 END AS v0 FROM p),
 i AS (SELECT *, coalesce(u0 >= 0 AND u0 < 640 AND v0 >= 0 AND v0 < 480, false) AS valid FROM c)
 SELECT {KEYED}, valid, round(CASE WHEN valid THEN u0 ELSE 0 END, 6) + 0.0 AS u, round(CASE WHEN valid THEN v0 ELSE 0 END, 6) + 0.0 AS v, z AS depth FROM i""")
def project_points(spark, sf_dir):
    identity = se3.matrix([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])
    p = rig.project(_points(spark, sf_dir), identity, K, 640, 480)
    return p.select(*KEYS, "valid", r(F.col("u"), 6).alias("u"), r(F.col("v"), 6).alias("v"), "depth")


@register("unproject", f"WITH {KEYED_SQL} SELECT {KEYED}, round((x*10-320)/500*5, 6) + 0.0 AS x, round((y*10-240)/510*5, 6) + 0.0 AS y, round(5.0::DOUBLE, 6) + 0.0 AS z FROM p")
def unproject(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("q", camera.unproject_pixel(K, F.col("x") * 10, F.col("y") * 10, F.lit(5.0)))
    return p.select(*KEYS, *[r(F.col(f"q.{c}"), 6).alias(c) for c in "xyz"])


DIST = (-0.1, 0.02, 0.001, -0.002, 0.003)


@register("distort", f"""WITH {KEYED_SQL}, n AS (SELECT {KEYED}, x/50 AS a, y/100 AS b FROM p), d AS (SELECT *, a*a+b*b AS q FROM n)
 SELECT {KEYED}, round(a*(1-0.1*q+0.02*q*q+0.003*q*q*q) + 2*0.001*a*b - 0.002*(q+2*a*a), 8) + 0.0 AS x, round(b*(1-0.1*q+0.02*q*q+0.003*q*q*q) + 0.001*(q+2*b*b) - 2*0.002*a*b, 8) + 0.0 AS y FROM d""")
def distort(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("q", camera.distort_point(F.col("x") / 50, F.col("y") / 100, DIST))
    return p.select(*KEYS, r(F.col("q.x"), 8).alias("x"), r(F.col("q.y"), 8).alias("y"))


@register("undistort", f"WITH {KEYED_SQL} SELECT {KEYED}, round(x/50, 7) + 0.0 AS x, round(y/100, 7) + 0.0 AS y FROM p")
def undistort(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("q", camera.distort_point(F.col("x") / 50, F.col("y") / 100, DIST))
    p = p.withColumn("w", camera.undistort_point(F.col("q.x"), F.col("q.y"), DIST))
    return p.select(*KEYS, r(F.col("w.x"), 7).alias("x"), r(F.col("w.y"), 7).alias("y"))


FISH = (0.05, -0.01, 0.002, -0.0005)


@register("fisheye_round_trip", f"WITH {KEYED_SQL} SELECT {KEYED}, round(x/50, 7) + 0.0 AS x, round(y/100, 7) + 0.0 AS y FROM p")
def fisheye_round_trip(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("q", camera.fisheye_distort_point(F.col("x") / 50, F.col("y") / 100, FISH))
    p = p.withColumn("w", camera.fisheye_undistort_point(F.col("q.x"), F.col("q.y"), FISH))
    return p.select(*KEYS, r(F.col("w.x"), 7).alias("x"), r(F.col("w.y"), 7).alias("y"))


@register("fisheye_project", f"""WITH {KEYED_SQL}, a AS (SELECT *, sqrt(x*x+y*y) AS d, atan2(sqrt(x*x+y*y), z) AS th FROM p),
 b AS (SELECT *, CASE WHEN d < 1e-8 THEN 0 ELSE th*(1+0.05*pow(th,2)-0.01*pow(th,4)+0.002*pow(th,6)-0.0005*pow(th,8))/d END AS s FROM a)
 SELECT {KEYED}, round(500*x*s+320, 4) + 0.0 AS u, round(510*y*s+240, 4) + 0.0 AS v FROM b""")
def fisheye_project(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("q", camera.fisheye_project_point(K, F.col("x"), F.col("y"), F.col("z"), FISH))
    return p.select(*KEYS, r(F.col("q.u"), 4).alias("u"), r(F.col("q.v"), 4).alias("v"))


@register("fisheye_unproject", f"WITH {KEYED_SQL} SELECT {KEYED}, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(60 + z, 5) + 0.0 AS z FROM p")
def fisheye_unproject(spark, sf_dir):
    z = F.col("z") + 60
    p = _points(spark, sf_dir).withColumn("q", camera.fisheye_project_point(K, F.col("x"), F.col("y"), z, FISH))
    reach = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + z * z)
    p = p.withColumn("w", camera.fisheye_unproject_pixel(K, F.col("q.u"), F.col("q.v"), reach, FISH))
    return p.select(*KEYS, *[r(F.col(f"w.{c}"), 5).alias(c) for c in "xyz"])


@register("rolling_shutter", f"WITH {KEYED_SQL}, t AS (SELECT *, (x + 25) / 479 * 0.03 AS s FROM p) SELECT {KEYED}, round(s, 9) + 0.0 AS row_time, round(x - s*(1.0 + 0.2*z - 0.3*y), 6) + 0.0 AS x, round(y - s*(2.0 + 0.3*x - 0.1*z), 6) + 0.0 AS y, round(z - s*(0.5 + 0.1*y - 0.2*x), 6) + 0.0 AS z FROM t")
def rolling_shutter(spark, sf_dir):
    t = camera.rolling_shutter_row_time(F.col("x") + 25, 480, 0.03)
    p = _points(spark, sf_dir).withColumn("s", t).withColumn("q", camera.rolling_shutter_correct_point((F.col("x"), F.col("y"), F.col("z")), (1.0, 2.0, 0.5), (0.1, 0.2, 0.3), F.col("s")))
    return p.select(*KEYS, r(F.col("s"), 9).alias("row_time"), *[r(F.col(f"q.{c}"), 6).alias(c) for c in "xyz"])


@register("rolling_shutter_still", f"WITH {KEYED_SQL} SELECT {KEYED}, round(500.0*x/(z+60.7)+320, 6) + 0.0 AS u, round(510.0*y/(z+60.7)+240, 6) + 0.0 AS v FROM p")
def rolling_shutter_still(spark, sf_dir):
    """A camera at rest sees what a global shutter sees."""
    p = _points(spark, sf_dir).withColumn("q", camera.rolling_shutter_project_point(K, (F.col("x"), F.col("y"), F.col("z") + 60.7), (0, 0, 0), (0, 0, 0), 480, 0.03))
    return p.select(*KEYS, r(F.col("q.u"), 6).alias("u"), r(F.col("q.v"), 6).alias("v"))


_ECEF_SQL = f"""WITH {FIX_SQL}, n AS (SELECT *, 6378137.0 / sqrt(1 - {geo.E2!r} * pow(sin(radians(lat)), 2)) AS nn FROM fix),
e AS (SELECT c_custkey, lat, lon, alt, (nn+alt)*cos(radians(lat))*cos(radians(lon)) AS x, (nn+alt)*cos(radians(lat))*sin(radians(lon)) AS y, (nn*(1-{geo.E2!r})+alt)*sin(radians(lat)) AS z FROM n)
"""


@register("geodetic_ecef", _ECEF_SQL + "SELECT c_custkey, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z FROM e")
def geodetic_ecef(spark, sf_dir):
    f = fixes(spark, sf_dir).withColumn("p", geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("alt")))
    return f.select("c_custkey", *[r(F.col(f"p.{c}"), 4).alias(c) for c in "xyz"])


@register("ecef_geodetic", f"WITH {FIX_SQL} SELECT c_custkey, round(lat, 7) + 0.0 AS lat, round(lon, 7) + 0.0 AS lon, round(alt, 3) + 0.0 AS alt FROM fix")
def ecef_geodetic(spark, sf_dir):
    f = fixes(spark, sf_dir).withColumn("p", geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))).withColumn("g", geo.ecef_to_geodetic(F.col("p.x"), F.col("p.y"), F.col("p.z")))
    lon = r(F.col("g.lon"), 7)
    return f.select("c_custkey", r(F.col("g.lat"), 7).alias("lat"), F.when(lon == 180.0, -180.0).otherwise(lon).alias("lon"), r(F.col("g.alt"), 3).alias("alt"))


@register("enu", _ECEF_SQL + f""", o AS (SELECT 6378137.0/sqrt(1-{geo.E2!r}*pow(sin(radians(48.0)),2)) AS nn), d AS (SELECT c_custkey, x-(nn+100)*cos(radians(48.0))*cos(radians(11.0)) AS dx, y-(nn+100)*cos(radians(48.0))*sin(radians(11.0)) AS dy, z-(nn*(1-{geo.E2!r})+100)*sin(radians(48.0)) AS dz FROM e, o)
 SELECT c_custkey, round(-sin(radians(11.0))*dx + cos(radians(11.0))*dy, 3) + 0.0 AS east, round(-sin(radians(48.0))*cos(radians(11.0))*dx - sin(radians(48.0))*sin(radians(11.0))*dy + cos(radians(48.0))*dz, 3) + 0.0 AS north, round(cos(radians(48.0))*cos(radians(11.0))*dx + cos(radians(48.0))*sin(radians(11.0))*dy + sin(radians(48.0))*dz, 3) + 0.0 AS up FROM d""")
def enu(spark, sf_dir):
    f = fixes(spark, sf_dir).withColumn("p", geo.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("alt"), 48.0, 11.0, 100.0))
    return f.select("c_custkey", *[r(F.col(f"p.{c}"), 3).alias(c) for c in ("east", "north", "up")])


@register("enu_ecef", _ECEF_SQL + "SELECT c_custkey, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z FROM e")
def enu_ecef(spark, sf_dir):
    f = fixes(spark, sf_dir).withColumn("p", geo.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("alt"), 48.0, 11.0, 100.0)).withColumn("q", geo.enu_to_ecef(F.col("p.east"), F.col("p.north"), F.col("p.up"), 48.0, 11.0, 100.0))
    return f.select("c_custkey", *[r(F.col(f"q.{c}"), 3).alias(c) for c in "xyz"])


E2, EP2 = repr(geo.E2), repr(geo.EP2)
_ZONE = "CASE WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 9 THEN 31 WHEN lat >= 72 AND lat < 84 AND lon >= 9 AND lon < 21 THEN 33 WHEN lat >= 72 AND lat < 84 AND lon >= 21 AND lon < 33 THEN 35 WHEN lat >= 72 AND lat < 84 AND lon >= 33 AND lon < 42 THEN 37 WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 ELSE CAST(floor((lon + 180) / 6) AS INT) + 1 END"


@register("utm", f"""WITH {FIX_SQL}, a AS (SELECT c_custkey, lat, radians(lat) AS p, radians(lon) AS l, {_ZONE} AS zone FROM fix),
b AS (SELECT *, 6378137.0/sqrt(1-{E2}*sin(p)*sin(p)) AS n, tan(p)*tan(p) AS t, {EP2}*cos(p)*cos(p) AS c, cos(p)*(l-radians((zone-1)*6-177)) AS a,
 6378137.0*((1-{E2}/4-3*pow({E2},2)/64-5*pow({E2},3)/256)*p-(3*{E2}/8+3*pow({E2},2)/32+45*pow({E2},3)/1024)*sin(2*p)+(15*pow({E2},2)/256+45*pow({E2},3)/1024)*sin(4*p)-(35*pow({E2},3)/3072)*sin(6*p)) AS m FROM a)
SELECT c_custkey, CAST(zone AS INTEGER) AS zone, substr('CDEFGHJKLMNPQRSTUVWX', least(CAST(floor((lat+80)/8) AS INT), 19)+1, 1) AS letter,
 round(500000+0.9996*n*(a+(1-t+c)*pow(a,3)/6+(5-18*t+t*t+72*c-58*{EP2})*pow(a,5)/120), 3) + 0.0 AS easting,
 round(0.9996*(m+n*tan(p)*(a*a/2+(5-t+9*c+4*c*c)*pow(a,4)/24+(61-58*t+t*t+600*c-330*{EP2})*pow(a,6)/720)) + CASE WHEN lat < 0 THEN 1e7 ELSE 0 END, 3) + 0.0 AS northing FROM b""")
def utm(spark, sf_dir):
    f = fixes(spark, sf_dir).withColumn("u", geo.geodetic_to_utm(F.col("lat"), F.col("lon")))
    return f.select("c_custkey", "u.zone", "u.letter", r(F.col("u.easting"), 3).alias("easting"), r(F.col("u.northing"), 3).alias("northing"))


@register("utm_inverse", f"WITH {FIX_SQL} SELECT c_custkey, round(lat + 1e-5/3, 5) + 0.0 AS lat, round(lon, 5) + 0.0 AS lon FROM fix")
def utm_inverse(spark, sf_dir):
    f = fixes(spark, sf_dir).withColumn("lat", F.col("lat") + 1e-5 / 3).withColumn("u", geo.geodetic_to_utm(F.col("lat"), F.col("lon"))).withColumn("g", geo.utm_to_geodetic(F.col("u.easting"), F.col("u.northing"), F.col("u.zone"), F.col("u.letter")))
    return f.select("c_custkey", r(F.col("g.lat"), 5).alias("lat"), r(F.col("g.lon"), 5).alias("lon"))


@register("hdop_noise", "SELECT p_partkey, round(pow(p_size / 10.0 * 3, 2), 6) + 0.0 AS horizontal, 25.0::DOUBLE AS vertical FROM part")
def hdop_noise(spark, sf_dir):
    n = geo.hdop_to_noise(F.col("p_size") / 10.0)
    return table(spark, sf_dir, "part").select("p_partkey", r(n[0], 6).alias("horizontal"), n[2].alias("vertical"))


@register("radar_xyz", f"SELECT {KEYED}, round(CAST(CAST(l_quantity*cos(radians(l_tax*100))*cos(radians(l_discount*900)) AS FLOAT) AS DOUBLE), 3) + 0.0 AS x, round(CAST(CAST(l_quantity*cos(radians(l_tax*100))*sin(radians(l_discount*900)) AS FLOAT) AS DOUBLE), 3) + 0.0 AS y, round(CAST(CAST(l_quantity*sin(radians(l_tax*100)) AS FLOAT) AS DOUBLE), 3) + 0.0 AS z FROM lineitem")
def radar_xyz(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("p", colour.radar_xyz(F.col("l_quantity"), F.col("l_discount") * 900, F.col("l_tax") * 100))
    return d.select(*KEYS, *[r(F.col(f"p.{c}").cast("double"), 3).alias(c) for c in "xyz"])


@register("colour_by_height", f"""WITH {KEYED_SQL}, t AS (SELECT *, (z + 5) / 10 AS t FROM p) SELECT {KEYED},
 CAST(trunc(greatest(0.0, least(1.0, 4*t-2))*255) AS SMALLINT) AS r, CAST(trunc(greatest(0.0, least(1.0, least(4*t, 4-4*t)))*255) AS SMALLINT) AS g, CAST(trunc(greatest(0.0, least(1.0, 2-4*t))*255) AS SMALLINT) AS b FROM t""")
def colour_by_height(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("c", colour.colour_by_height(F.col("z"), F.lit(-5.0), F.lit(5.0)))
    return p.select(*KEYS, "c.r", "c.g", "c.b")


def _sentences(spark, sf_dir) -> DataFrame:
    c = fixes(spark, sf_dir).repartition(TASKS, "c_custkey")  # millions of customers may be one row group of a small file, and would be one task's
    c = c.withColumn("a", F.abs("lat")).withColumn("o", F.abs("lon"))
    part = lambda v, w: F.concat(F.lpad(F.floor(v).cast("string"), w, "0"), F.lpad(F.format_string("%.6f", (v - F.floor(v)) * 60), 9, "0"))
    body = F.concat_ws(",", F.lit("GPGGA"), F.lit("120000"), part(F.col("a"), 2), F.when(F.col("lat") < 0, "S").otherwise("N"), part(F.col("o"), 3), F.when(F.col("lon") < 0, "W").otherwise("E"), F.lit("1"), F.lit("08"), F.lit("0.9"), F.format_string("%.2f", "alt"), F.lit("M"), F.lit("46.9"), F.lit("M"), F.lit(""), F.lit(""))
    summed = c.select("c_custkey", body.alias("body")).withColumn("sum", nmea.xor_of(F.col("body")))
    told = F.when(F.col("c_custkey") % 10 == 0, F.col("sum").bitwiseXOR(1)).otherwise(F.col("sum"))
    return summed.select("c_custkey", F.concat(F.lit("$"), "body", F.lit("*"), F.lpad(F.hex(told), 2, "0")).alias("value"))


@register("nmea_parse", f"WITH {FIX_SQL} SELECT c_custkey, 'GGA' AS kind, round(lat, 7) + 0.0 AS lat, round(lon, 7) + 0.0 AS lon, 8 AS satellites FROM fix WHERE c_custkey % 10 <> 0")
def nmea_parse(spark, sf_dir):
    """Every tenth sentence carries a wrong checksum and is dropped."""
    s = nmea.with_fix(_sentences(spark, sf_dir), alias="f")
    return s.select("c_custkey", "f.kind", r(F.col("f.lat"), 7).alias("lat"), r(F.col("f.lon"), 7).alias("lon"), "f.satellites")


@register("nmea_checksum", "SELECT c_custkey, c_custkey % 10 <> 0 AS good FROM customer")
def nmea_checksum(spark, sf_dir):
    return _sentences(spark, sf_dir).select("c_custkey", nmea.strip_checksum(F.col("value")).isNotNull().alias("good"))
