"""The driver's tables seen as sensor data, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column, digits: int) -> Column:
    """Rounded as the SQL rounds doubles, the nearest whole of c * 10^digits, half away from zero; with no negative zero. F.round goes by the shortest decimal of c, which may lie on the other side of a tie."""
    return F.round(c * F.lit(10.0**digits), 0) / F.lit(10.0**digits) + F.lit(0.0)


MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, t (microseconds), v, event_id."""
    return table(spark, sf_dir, "events").selectExpr("event_type AS stream", f"{MICROS} AS t", "value AS v", "event_id")


STREAM_SQL = "stream AS (SELECT event_type AS stream, epoch_us(ts) AS t, value AS v, event_id FROM events)"


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, seq (a struct in order of the rows), x, y, z."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS frame", "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq", "l_quantity - 25D AS x", "l_extendedprice / 1000D - 50D AS y", "l_discount * 100D - 5D AS z"
    )


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pts with seq counted from 1 in each frame, for kernels."""
    return pts(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("frame").orderBy("seq")))


PTS_SQL = (
    "pts AS (SELECT l_suppkey AS frame, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, "
    "CAST(l_quantity - 25 AS DOUBLE) AS x, CAST(l_extendedprice / 1000 - 50 AS DOUBLE) AS y, CAST(l_discount * 100 - 5 AS DOUBLE) AS z FROM lineitem)"
)


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 160 - 79 + c_acctbal / 1e5D AS lat", "CAST((c_custkey * 7) % 360 - 180 AS DOUBLE) AS lon", "c_acctbal / 10D AS alt")


FIX_SQL = "fix AS (SELECT c_custkey, CAST(c_custkey % 160 - 79 + c_acctbal / 1e5 AS DOUBLE) AS lat, CAST((c_custkey * 7) % 360 - 180 AS DOUBLE) AS lon, CAST(c_acctbal / 10 AS DOUBLE) AS alt FROM customer)"


def wheel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, t (seconds), left, right: slow, since the gaps are hours long."""
    return table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"{MICROS} / 1e6D AS t", "value * 1e-4D AS left", "value * 1e-4D + value * 1e-7D AS right")


WHEEL_SQL = "wheel AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value * 1e-4::DOUBLE AS \"left\", value * 1e-4::DOUBLE + value * 1e-7::DOUBLE AS \"right\" FROM events)"


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, row, col, v: parts as pixels of images 40 wide and 40 high."""
    return table(spark, sf_dir, "part").selectExpr("CAST(p_partkey div 1600 AS int) AS img", "CAST((p_partkey % 1600) div 40 AS int) AS row", "CAST(p_partkey % 40 AS int) AS col", "CAST(p_size AS double) AS v")
