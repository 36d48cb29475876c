"""Queries on odometry, keyframes, matching and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.functions import se3
from tessera.operators import estimation, graphs, odometry, scans
from tessera.queries.adapters import MICROS, WHEEL_SQL, numbered, r, table, wheel

_LAG = """, d AS (SELECT *, {v} AS v, {w} AS w FROM wheel),
g AS (SELECT *, t - lag(t) OVER o AS dt, lag(v) OVER o AS pv, lag(w) OVER o AS pw FROM d WINDOW o AS (PARTITION BY user_id ORDER BY t)),
h AS (SELECT *, coalesce((w+pw)/2*dt, 0) AS turn FROM g), i AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS theta FROM h),
j AS (SELECT *, coalesce((v+pv)/2*dt*cos(theta-turn/2), 0) AS dx, coalesce((v+pv)/2*dt*sin(theta-turn/2), 0) AS dy FROM i)
SELECT event_id, round(sum(dx) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS x, round(sum(dy) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS y, round(theta, 6) + 0.0 AS theta FROM j"""


def _out(d):
    return d.select("event_id", r(F.col("x"), 4).alias("x"), r(F.col("y"), 4).alias("y"), r(F.col("theta"), 6).alias("theta"))


@register("wheel_diff", f"WITH {WHEEL_SQL}" + _LAG.format(v='("left" + "right")/2', w='("right" - "left")/0.5'))
def wheel_diff(spark, sf_dir):
    return _out(odometry.differential_drive(wheel(spark, sf_dir), 0.5, by=("user_id",)))


@register("wheel_ticks", f"WITH {WHEEL_SQL}, c AS (SELECT *, sum(round(\"left\"*1e6)) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS ticks FROM wheel), s AS (SELECT *, (ticks - lag(ticks) OVER o) * (2*pi()*0.1/1000) / (t - lag(t) OVER o) AS s FROM c WINDOW o AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, round(coalesce(s, lead(s) OVER (PARTITION BY user_id ORDER BY t)), 6) + 0.0 AS speed FROM s")
def wheel_ticks(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ticks = F.sum(F.round(F.col("left") * 1e6)).over(w)
    d = wheel(spark, sf_dir).withColumn("left", ticks).withColumn("right", F.col("left"))
    s = odometry.ticks_to_speeds(d, 1000, 0.1, by=("user_id",))
    return s.select("event_id", r(F.col("left"), 6).alias("speed"))


@register("ackermann", f"WITH {WHEEL_SQL}, a AS (SELECT *, \"left\" AS sp, \"right\" * 0.1 AS st FROM wheel)" + """,
g AS (SELECT *, t - lag(t) OVER o AS dt, (sp + lag(sp) OVER o)/2 AS v, (st + lag(st) OVER o)/2 AS s FROM a WINDOW o AS (PARTITION BY user_id ORDER BY t)),
h AS (SELECT *, coalesce(v*tan(s)/2.5*dt, 0) AS turn FROM g), i AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS theta FROM h),
j AS (SELECT *, coalesce(v*dt*cos(theta-turn/2), 0) AS dx, coalesce(v*dt*sin(theta-turn/2), 0) AS dy FROM i)
SELECT event_id, round(sum(dx) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS x, round(sum(dy) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS y, round(theta, 6) + 0.0 AS theta FROM j""")
def ackermann(spark, sf_dir):
    d = wheel(spark, sf_dir).withColumn("speed", F.col("left")).withColumn("steering", F.col("right") * 0.1)
    return _out(odometry.ackermann(d, 2.5, by=("user_id",)))


@register("adaptive_threshold", f"WITH {WHEEL_SQL}, l AS (SELECT user_id, event_id, list(\"left\" * 1e4) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM wheel) SELECT event_id, round(greatest(0.5, least(300.0, 3*list_reduce(v, lambda s, x: 0.8714159*s + (1-0.8714159::DOUBLE)*x, 2.0::DOUBLE))), 6) + 0.0 AS threshold FROM l")
def adaptive_threshold(spark, sf_dir):
    d = wheel(spark, sf_dir).select("user_id", "event_id", (F.col("left") * 1e4).alias("v"))
    return odometry.adaptive_threshold(d, ("user_id",), "event_id", "v", 2.0, 0.8714159, 0.5, 300.0).select("event_id", r(F.col("threshold"), 6).alias("threshold"))


def _poses(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey AS seq", "o_totalprice / 1000D AS x", "CAST(o_orderkey % 97 AS double) AS y", "0D AS z")


@register("keyframes", """WITH RECURSIVE p AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(o_totalprice/1000 AS DOUBLE) AS x, CAST(o_orderkey % 97 AS DOUBLE) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
r AS (SELECT c, k, x AS ax, y AS ay, i, true AS accepted FROM p WHERE i = 1 UNION ALL
 SELECT p.c, p.k, CASE WHEN sqrt((p.x-r.ax)*(p.x-r.ax)+(p.y-r.ay)*(p.y-r.ay)) >= 50.0 THEN p.x ELSE r.ax END, CASE WHEN sqrt((p.x-r.ax)*(p.x-r.ax)+(p.y-r.ay)*(p.y-r.ay)) >= 50.0 THEN p.y ELSE r.ay END, p.i, sqrt((p.x-r.ax)*(p.x-r.ax)+(p.y-r.ay)*(p.y-r.ay)) >= 50.0 FROM r JOIN p ON p.c = r.c AND p.i = r.i + 1)
SELECT k AS seq, accepted FROM r""")
def keyframes(spark, sf_dir):
    return odometry.keyframes(_poses(spark, sf_dir), 50.0, ("o_custkey",)).select("seq", "accepted")


@register("submaps", """WITH n AS (SELECT o_custkey, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
s AS (SELECT *, unnest(range(0, CAST(1 + ceil(greatest(0, n - 5) / 3.0) AS BIGINT))) AS submap FROM n)
SELECT o_custkey, CAST(submap AS INTEGER) AS submap, CAST(i - submap*3 AS INTEGER) AS "position", seq FROM s WHERE i >= submap*3 AND i < submap*3 + 5""")
def submaps(spark, sf_dir):
    return odometry.submaps(_poses(spark, sf_dir), 5, 2, ("o_custkey",)).select("o_custkey", "submap", "position", "seq")


def _imu(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id AS interval", f"{MICROS} / 3.6e9D AS t", "value / 1000D AS ax", "0.1D AS ay", "9.81D AS az", "0.01D AS wx", "-0.02D AS wy", "value / 1e5D AS wz")


@register("preintegration")
def preintegration(spark, sf_dir):
    return odometry.preintegrate(_imu(spark, sf_dir))


@register("planar_preintegration", f"""WITH e AS (SELECT user_id AS interval, epoch_us(ts)/3.6e9::DOUBLE AS t, value/1000::DOUBLE AS a, value/1e5::DOUBLE AS w FROM events),
g AS (SELECT *, t - lag(t) OVER o AS dt, (a + lag(a) OVER o)/2 AS ma, (w + lag(w) OVER o)/2 AS mw FROM e WINDOW o AS (PARTITION BY interval ORDER BY t)),
h AS (SELECT *, coalesce(sum(mw*dt) OVER (PARTITION BY interval ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS th FROM g),
i AS (SELECT *, coalesce(th - mw*dt, 0) AS was FROM h),
k AS (SELECT *, ma*cos(was) - 0.1*sin(was) AS ax, ma*sin(was) + 0.1*cos(was) AS ay FROM i),
l AS (SELECT *, coalesce(sum(ax*dt) OVER o, 0) AS vx, coalesce(sum(ay*dt) OVER o, 0) AS vy FROM k WINDOW o AS (PARTITION BY interval ORDER BY t ROWS UNBOUNDED PRECEDING))
SELECT interval, count(*) AS n, round(sum(dt), 4) + 0.0 AS duration, round(max_by(cos(th), t), 6) + 0.0 AS cosine, round(max_by(sin(th), t), 6) + 0.0 AS sine, round(max_by(vx, t), 4) + 0.0 AS vx, round(max_by(vy, t), 4) + 0.0 AS vy,
       round(sum((vx - ax*dt)*dt + ax*dt*dt/2), 2) + 0.0 AS px, round(sum((vy - ay*dt)*dt + ay*dt*dt/2), 2) + 0.0 AS py
FROM l GROUP BY interval HAVING count(*) > 1 AND min(dt) > 0""")
def planar_preintegration(spark, sf_dir):
    """Turns about the vertical only, whose products SQL can write as sums of angles."""
    imu = _imu(spark, sf_dir).withColumns({"az": F.lit(0.0), "wx": F.lit(0.0), "wy": F.lit(0.0)})
    p = odometry.preintegrate(imu)
    at = lambda c, i, d: r(F.col(c)[i], d)
    return p.select("interval", "n", r(F.col("duration"), 4).alias("duration"), at("rotation", 0, 6).alias("cosine"), at("rotation", 3, 6).alias("sine"), at("velocity", 0, 4).alias("vx"), at("velocity", 1, 4).alias("vy"), at("position", 0, 2).alias("px"), at("position", 1, 2).alias("py"))


def _steps(spark, sf_dir):
    """A motion in the plane for each order of a customer."""
    a = (F.col("o_orderkey") % 7) / 10.0
    turn = F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.col("o_totalprice") * 1.37e-5, F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.51234567), *[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)])
    return table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), turn.alias("step"))


@register("path_products", """WITH s AS (SELECT o_custkey, o_orderkey AS seq, (o_orderkey % 7) / 10.0::DOUBLE AS a, o_totalprice * 1.37e-5::DOUBLE AS d FROM orders),
h AS (SELECT *, sum(a) OVER (PARTITION BY o_custkey ORDER BY seq ROWS UNBOUNDED PRECEDING) AS th FROM s),
i AS (SELECT *, d*cos(th - a) - 0.51234567::DOUBLE*sin(th - a) AS dx, d*sin(th - a) + 0.51234567::DOUBLE*cos(th - a) AS dy FROM h)
SELECT seq, round(cos(th), 6) + 0.0 AS cosine, round(sin(th), 6) + 0.0 AS sine, round(sum(dx) OVER o, 5) + 0.0 AS x, round(sum(dy) OVER o, 5) + 0.0 AS y FROM i WINDOW o AS (PARTITION BY o_custkey ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def path_products(spark, sf_dir):
    """Poses as prefix products of rigid motions."""
    p = scans.prefix_products(_steps(spark, sf_dir), "step", ("o_custkey",), ("seq",), name="pose")
    at = lambda i, d: r(F.col("pose")[i], d)
    return p.select("seq", at(0, 6).alias("cosine"), at(4, 6).alias("sine"), at(3, 5).alias("x"), at(7, 5).alias("y"))


@register("deskew")
def deskew(spark, sf_dir):
    imu = _imu(spark, sf_dir).withColumnRenamed("interval", "frame")
    p = numbered(spark, sf_dir)
    span = imu.groupBy("frame").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    p = p.join(span, "frame").withColumn("t", F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("seq") / 1000).withColumn("ref_time", F.col("t0"))
    return odometry.deskew(p, imu)


def _shifted(spark, sf_dir):
    p = numbered(spark, sf_dir).select("frame", "seq", "x", "y", "z")
    return p, p.select("frame", "seq", (F.col("x") + 0.05).alias("x"), (F.col("y") - 0.05).alias("y"), (F.col("z") + 0.02).alias("z"))


@register("icp")
def icp(spark, sf_dir):
    return estimation.icp_frames(*_shifted(spark, sf_dir))


@register("icp_plane")
def icp_plane(spark, sf_dir):
    return estimation.icp_frames(*_shifted(spark, sf_dir), plane=True, normals_k=10)


@register("calibration", """SELECT c_nationkey AS rig, count(*) AS n, round(cos(c_nationkey / 10.0), 6) + 0.0 AS cosine, round(sin(c_nationkey / 10.0), 6) + 0.0 AS sine,
 round(c_nationkey / 5.0, 5) + 0.0 AS tx, round(-c_nationkey / 7.0, 5) + 0.0 AS ty, 0.25 AS tz FROM customer GROUP BY c_nationkey HAVING count(*) >= 3""")
def calibration(spark, sf_dir):
    """Planes that a lidar and a camera both see, planted with a known transform for each nation's rig, and found again."""
    k, g = F.col("c_custkey"), F.col("c_nationkey")
    raw = [F.sin(k * 1.0), F.cos(k * 2.0), F.sin(k * 3.0) + 0.3]
    length = F.sqrt(sum((v * v for v in raw[1:]), raw[0] * raw[0]))
    n = table(spark, sf_dir, "customer").select(g.alias("rig"), *[(v / length).alias(f"l{c}") for v, c in zip(raw, "xyz", strict=True)], (F.col("c_acctbal") / 1000).alias("ld"))
    cos, sin = F.cos(F.col("rig") / 10), F.sin(F.col("rig") / 10)
    n = n.withColumns({"cx": cos * F.col("lx") - sin * F.col("ly"), "cy": sin * F.col("lx") + cos * F.col("ly"), "cz": F.col("lz")})
    n = n.withColumn("cd", F.col("ld") + F.col("cx") * F.col("rig") / 5 - F.col("cy") * F.col("rig") / 7 + F.col("cz") * 0.25)
    m = F.col("transform")
    found = estimation.calibrate_rigs(n, ("rig",)).where("transform is not null")
    return found.select("rig", "n", r(m[0], 6).alias("cosine"), r(m[4], 6).alias("sine"), r(m[3], 5).alias("tx"), r(m[7], 5).alias("ty"), r(m[11], 5).alias("tz"))


@register("radar_odometry")
def radar_odometry(spark, sf_dir):
    p = numbered(spark, sf_dir).withColumn("session", F.floor(F.col("frame") / 10))
    return estimation.scan_odometry(p)


@register("kiss_icp")
def kiss_icp(spark, sf_dir):
    p = numbered(spark, sf_dir).withColumn("session", F.floor(F.col("frame") / 10))
    return estimation.kiss_odometry(p, voxel=4.0)


def _graph(spark, sf_dir):
    """A chain of poses a customer, with edges that disagree a little with them."""
    o = table(spark, sf_dir, "orders")
    q = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), (F.col("o_orderkey") % 7) / 20.0)
    nodes = o.select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), se3.from_quaternion(q, (F.col("o_totalprice") / 10000, F.lit(0.0), F.lit(0.0))).alias("transform"))
    from pyspark.sql import Window

    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    info = F.array(*[F.lit(200.0 if i == j else 0.0) for i in range(6) for j in range(6)])
    edges = o.select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("a"), nxt.alias("b"), se3.from_translation(1.0, 0.5, 0.0).alias("transform"), info.alias("information")).where("b is not null")
    return nodes, edges


@register("graph_cost", """WITH n AS (SELECT o_custkey AS graph, o_orderkey AS k, o_totalprice/10000 AS x, 2*atan2((o_orderkey % 7)/20.0, 1.0) AS th FROM orders),
e AS (SELECT graph, x, th, lead(x) OVER o AS x1, lead(th) OVER o AS th1, lead(k) OVER o AS k1 FROM n WINDOW o AS (PARTITION BY graph ORDER BY k)),
f AS (SELECT graph, cos(th)*(x1-x) - 1 AS ex, -sin(th)*(x1-x) - 0.5 AS ey, th1-th AS et FROM e WHERE k1 IS NOT NULL)
SELECT graph, round(sum(100*(ex*ex+ey*ey+et*et)), 3) + 0.0 AS cost, count(*) AS edges FROM f GROUP BY graph""")
def graph_cost(spark, sf_dir):
    return graphs.graph_cost(*_graph(spark, sf_dir)).select("graph", r(F.col("cost"), 3).alias("cost"), "edges")


@register("pose_graph")
def pose_graph(spark, sf_dir):
    return graphs.optimise(*_graph(spark, sf_dir))


@register("smoother")
def smoother(spark, sf_dir):
    return graphs.smooth(*_graph(spark, sf_dir), window=4)


@register("session_merge", "SELECT id FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT o_orderkey + 1 + (SELECT max(o_orderkey) FROM orders) FROM orders)")
def session_merge(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    one = {"nodes": nodes.select("id", "transform"), "edges": edges.select("a", "b", "transform", "information")}
    return graphs.merge_sessions(one, one, (1, 1, [0.0] * 16, [0.0] * 36))["nodes"].select("id")


def _bag(spark, sf_dir):
    """Each frame's points as one message of a bag."""
    p = numbered(spark, sf_dir)
    xyz = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))), lambda q: F.array(q.x, q.y, q.z))
    return p.groupBy("frame").agg(F.to_json(F.struct(xyz.alias("xyz"))).alias("data")).select(F.col("frame").alias("offset"), F.lit("/lidar/points").alias("topic"), F.col("frame").cast("double").alias("timestamp"), "data")


@register("session_run")
def session_run(spark, sf_dir):
    from tessera.plans.session import Session

    return Session(spark).run(_bag(spark, sf_dir)).tables["trajectory"]


@register("session_localize")
def session_localize(spark, sf_dir):
    from tessera.plans.session import Session

    base = numbered(spark, sf_dir).where("frame = 1").select("x", "y", "z")  # the fixed map is one scan
    return Session(spark).localise(_bag(spark, sf_dir), base)
