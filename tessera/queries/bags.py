"""Queries on bag messages: topics, ranges, counts, payloads, fixes over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.queries.adapters import MICROS, table
from tessera.streaming import gps


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id AS offset", "event_type AS topic", f"{MICROS} AS timestamp", "props AS data")


@register("bag_topics", "SELECT DISTINCT event_type AS topic FROM events")
def bag_topics(spark, sf_dir):
    return _messages(spark, sf_dir).select("topic").distinct()


@register("bag_counts", "SELECT event_type AS topic, count(*) AS messages FROM events GROUP BY event_type")
def bag_counts(spark, sf_dir):
    from tessera.sources import bag

    return bag.topic_counts(_messages(spark, sf_dir))


@register("bag_range", "SELECT event_id AS \"offset\", event_type AS topic, epoch_us(ts) AS \"timestamp\" FROM events WHERE event_type IN ('click', 'view') AND epoch_us(ts) BETWEEN (SELECT min(epoch_us(ts)) + 3600000000 FROM events) AND (SELECT min(epoch_us(ts)) + 7200000000000 FROM events)")
def bag_range(spark, sf_dir):
    from tessera.sources import bag

    m = _messages(spark, sf_dir)
    first = m.agg(F.min("timestamp")).first()[0]
    return bag.read_messages(m, ["click", "view"], first + 3_600_000_000, first + 7_200_000_000_000).select("offset", "topic", "timestamp")


@register("bag_json", "SELECT event_type AS topic, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def bag_json(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("k", F.get_json_object("data", "$.k").cast("long"))
    return m.groupBy("topic").agg(F.sum("k").alias("k"))


def _fixes(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"{MICROS} / 1e6D AS t")


@register("gps_outage", """WITH RECURSIVE f AS (SELECT user_id, event_id, epoch_us(ts)/1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
 g AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY i) AS p FROM f), b AS (SELECT *, max(CASE WHEN t - p > 400000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS stale FROM g)
 SELECT event_id, stale = 0 AS used FROM b""")
def gps_outage(spark, sf_dir):
    return gps.outage_gate(_fixes(spark, sf_dir), 400_000.0, by=("user_id",), order=("t", "event_id")).select("event_id", "used")


@register("fix_age", "SELECT event_id, round(epoch_us(ts)/1e6 - lag(epoch_us(ts)/1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) + 0.0 AS age FROM events")
def fix_age(spark, sf_dir):
    return gps.fix_age(_fixes(spark, sf_dir), by=("user_id",), order=("t", "event_id")).select("event_id", (F.round("age", 3) + 0.0).alias("age"))


@register("ekf_track")
def ekf_track(spark, sf_dir):
    from tessera.streaming import ekf

    e = table(spark, sf_dir, "events").selectExpr("user_id AS vehicle", f"{MICROS} / 3.6e9D AS t", "CASE WHEN event_type = 'click' THEN 'position' ELSE 'imu' END AS kind", "array(value / 1000D, 0.1D, 9.81D) AS a", "array(0.01D, 0D, 0D) AS b")
    return ekf.track(e, by="vehicle")
