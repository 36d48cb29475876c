"""Queries on time: nearest, linear, all streams, overlap, pose lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.operators import sync
from tessera.queries.adapters import STREAM_SQL, r, stream, table

HOUR = 3600e6

_BOTH = f"""
WITH {STREAM_SQL},
s AS (SELECT * FROM stream WHERE stream = 'click'), q AS (SELECT * FROM stream WHERE stream = 'error'),
b AS (SELECT q.event_id, q.t, s.t AS t0, s.v AS v0, s.event_id AS e0 FROM q ASOF LEFT JOIN s ON q.t >= s.t),
a AS (SELECT q.event_id, s.t AS t1, s.v AS v1, s.event_id AS e1 FROM q ASOF LEFT JOIN s ON q.t <= s.t),
n AS (SELECT * FROM b JOIN a USING (event_id))
"""


@register("asof_nearest", _BOTH + "SELECT event_id, t, CASE WHEN t0 IS NULL THEN e1 WHEN t1 IS NULL THEN e0 WHEN t - t0 <= t1 - t THEN e0 ELSE e1 END AS sample_id, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t - t0 <= t1 - t THEN v0 ELSE v1 END AS sample_v FROM n")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    got = sync.nearest(s.where("stream = 'click'"), s.where("stream = 'error'"), width=HOUR)
    return got.select("event_id", "t", F.col("sample.event_id").alias("sample_id"), F.col("sample.v").alias("sample_v"))


@register("sync_linear", _BOTH + "SELECT event_id, t, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (CAST(t - t0 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE)) END, 6) + 0.0 AS v FROM n")
def sync_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    got = sync.linear(s.where("stream = 'click'"), s.where("stream = 'error'").drop("v"), width=HOUR)
    return got.select("event_id", "t", r(F.col("v"), 6).alias("v"))


_ALL_SQL = f"""
WITH {STREAM_SQL}, ref AS (SELECT t, event_id FROM stream WHERE stream = 'error'), names AS (SELECT DISTINCT stream FROM stream),
q AS (SELECT * FROM ref, names),
b AS (SELECT q.stream, q.t, s.t AS t0, s.v AS v0 FROM q ASOF LEFT JOIN stream s ON q.stream = s.stream AND q.t >= s.t),
a AS (SELECT q.stream, q.t, s.t AS t1, s.v AS v1 FROM q ASOF LEFT JOIN stream s ON q.stream = s.stream AND q.t <= s.t)
SELECT stream, t, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (CAST(t - t0 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE)) END, 6) + 0.0 AS v
FROM b JOIN a USING (stream, t)
"""


@register("sync_all_streams", _ALL_SQL)
def sync_all_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    return sync.synchronise(s.drop("event_id"), s.where("stream = 'error'"), width=24 * HOUR).select("stream", "t", r(F.col("v"), 6).alias("v"))


@register("stream_extents", f"WITH {STREAM_SQL} SELECT stream, min(t) AS \"start\", max(t) AS \"end\" FROM stream GROUP BY stream")
def stream_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.extents(stream(spark, sf_dir))


@register("sync_overlap", f"WITH {STREAM_SQL}, e AS (SELECT min(t) AS a, max(t) AS b FROM stream GROUP BY stream) SELECT max(a) AS \"start\", min(b) AS \"end\" FROM e HAVING count(*) >= 2 AND max(a) < min(b)")
def sync_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.temporal_overlap(stream(spark, sf_dir))


@register("time_offset", f"WITH {STREAM_SQL} SELECT event_id, t - 250000 AS t FROM stream")
def time_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).select("event_id", sync.apply_time_offset(F.col("t"), 250_000).alias("t"))


_POSE_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day FROM orders),
q AS (SELECT o_custkey, o_orderkey AS query, day + o_orderkey % 60 AS t FROM o)
SELECT q.query, min(p.o_orderkey) AS pose FROM q LEFT JOIN o p ON p.o_custkey = q.o_custkey AND q.t >= p.day AND q.t < p.day + 30 GROUP BY q.query
"""


@register("pose_at_timestamp", _POSE_SQL)
def pose_at_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = "CAST(datediff(CAST(o_orderdate AS date), DATE '1970-01-01') AS double)"
    o = table(spark, sf_dir, "orders")
    poses = o.selectExpr("o_custkey", "o_orderkey AS seq", f"{day} AS timestamp")
    asked = o.selectExpr("o_custkey", "o_orderkey AS query", f"{day} + o_orderkey % 60 AS t")
    return sync.pose_at(poses, asked, 30.0, by=("o_custkey",)).select("query", F.col("pose.seq").alias("pose"))
