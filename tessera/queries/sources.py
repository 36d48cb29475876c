"""Queries on byte and text formats: tables encoded frame by frame, and decoded by the sources."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.functions import geo, nmea, se3
from tessera.queries.adapters import FIX_SQL, MICROS, PTS_SQL, fixes, numbered, pts, r, table
from tessera.sources import binary, rtcm, text

_NUMBERED = PTS_SQL + ", num AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY seq) - 1 AS idx, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z FROM pts)"


def _packed(frames, layout, columns, by="frame", order="seq"):
    """(path, content): the rows of each frame as records of a layout; path is the frame."""

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order)
        records = np.zeros(len(t), np.dtype(layout))
        for (name, _), c in zip(layout, columns, strict=True):
            records[name] = t[c] if c else 0
        return pd.DataFrame({"path": [str(t[by].iloc[0])], "content": [records.tobytes()]})

    return frames.groupBy(by).applyInPandas(pack, "path string, content binary")


def _floats(*columns):
    return [r(F.col(c).cast("double"), 4).alias(c) for c in columns]


@register("source_velodyne", f"WITH {_NUMBERED} SELECT CAST(frame AS VARCHAR) AS path, idx, round(x::DOUBLE, 4) + 0.0 AS x, round(y::DOUBLE, 4) + 0.0 AS y, round(z::DOUBLE, 4) + 0.0 AS z, round(z::DOUBLE, 4) + 0.0 AS intensity FROM num")
def source_velodyne(spark, sf_dir):
    files = _packed(numbered(spark, sf_dir), binary.VELODYNE, ("x", "y", "z", "z"))
    return binary.parse(files, binary.VELODYNE, binary.velodyne).select("path", "idx", *_floats("x", "y", "z", "intensity"))


@register("source_ouster", f"WITH {_NUMBERED} SELECT CAST(frame AS VARCHAR) AS path, idx, round(x::DOUBLE, 4) + 0.0 AS x, round(y::DOUBLE, 4) + 0.0 AS ring FROM num")
def source_ouster(spark, sf_dir):
    files = _packed(numbered(spark, sf_dir), binary.OUSTER[8], ("x", "y", "z", None, None, None, "y", None))
    return binary.parse(files, binary.OUSTER[8], binary.ouster).select("path", "idx", *_floats("x", "ring"))


@register("source_imu", "SELECT CAST(user_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, epoch_us(ts)::DOUBLE AS \"timestamp\", round(CAST(value AS FLOAT)::DOUBLE, 4) + 0.0 AS ax FROM events")
def source_imu(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"CAST({MICROS} AS double) AS t", "value")
    files = _packed(e, binary.IMU, ("t", "value", None, None, None, None, None), by="user_id", order="event_id")
    return binary.parse(files, binary.IMU_ORIENTED, lambda d: binary.imu(d, False)).select("path", "idx", "timestamp", *_floats("ax"))


@register("source_radar", f"WITH {_NUMBERED}, f AS (SELECT frame, idx, CAST(abs(x) + 1 AS FLOAT)::DOUBLE AS d, CAST(y AS FLOAT)::DOUBLE AS a, CAST(z AS FLOAT)::DOUBLE AS e FROM num) SELECT CAST(frame AS VARCHAR) AS path, idx, round(d, 4) + 0.0 AS range, round(a, 4) + 0.0 AS azimuth, round(e, 4) + 0.0 AS velocity FROM f")
def source_radar(spark, sf_dir):
    p = numbered(spark, sf_dir).withColumn("d", F.abs(F.col("x").cast("float")) + 1)
    files = _packed(p, binary.RADAR, ("d", "y", None, "z", None))
    return binary.parse(files, binary.RADAR, binary.radar).select("path", "idx", *_floats("range", "azimuth", "velocity"))


def _framed(body: int, bits: int) -> bytes:
    data = body.to_bytes(bits // 8, "big")
    head = bytes([rtcm.PREAMBLE, len(data) >> 8, len(data) & 255]) + data
    return head + rtcm.crc24q(head).to_bytes(3, "big")


@register("source_rtcm", "SELECT s_suppkey AS path, 1005 AS message, s_suppkey % 4096 AS station, round(round(s_acctbal * 10000) / 10000, 4) + 0.0 AS x, round(-round(s_acctbal * 10000) / 10000, 4) + 0.0 AS y, CAST(s_nationkey AS DOUBLE) AS z FROM supplier")
def source_rtcm(spark, sf_dir):
    """A station message for each supplier, after a damaged copy of itself."""

    def build(batches):
        for t in batches:
            content = []
            for key, bal, nation in zip(t["s_suppkey"], t["s_acctbal"], t["s_nationkey"], strict=True):
                x = round(bal * 10000)
                body = 0
                for v, n in ((1005, 12), (int(key) % 4096, 12), (0, 6), (0, 4), (x, 38), (0, 2), (-x, 38), (0, 2), (int(nation) * 10000, 38)):
                    body = body << n | v & ((1 << n) - 1)
                good = _framed(body, 152)
                content.append(good[:-1] + bytes([good[-1] ^ 1]) + good)
            yield pd.DataFrame({"path": t["s_suppkey"].astype(str), "content": content})

    files = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey").mapInPandas(build, "path string, content binary")
    m = rtcm.parse(files)
    return m.select(F.col("path").cast("long").alias("path"), "message", F.col("station.station").cast("long").alias("station"), *[r(F.col(f"station.{c}"), 4).alias(c) for c in "xyz"])


@register("source_nmea_rmc", "SELECT o_orderkey % 86400 AS sec, round((o_orderkey % 90) + (o_orderkey % 60) / 60.0, 6) + 0.0 AS lat, round(-((o_orderkey % 180) + 0.5), 6) + 0.0 AS lon, o_orderkey % 3 <> 0 AS valid FROM orders")
def source_nmea_rmc(spark, sf_dir):
    """Recommended-minimum sentences with their checksums, one in three marked void."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 86400).alias("sec"), (F.col("o_orderkey") % 90).alias("d"), (F.col("o_orderkey") % 60).alias("m"), (F.col("o_orderkey") % 180).alias("w"), (F.col("o_orderkey") % 3).alias("s"))
    body = F.format_string("GPRMC,%02d%02d%02d.00,%s,%02d%02d.0000,N,%03d30.0000,W,022.4,084.4,230394,003.1,W", F.floor(F.col("sec") / 3600), F.floor(F.col("sec") / 60) % 60, F.col("sec") % 60, F.when(F.col("s") == 0, "V").otherwise("A"), "d", "m", "w")

    def summed(batches):
        for t in batches:
            sums = [format(int(np.bitwise_xor.reduce(np.frombuffer(b.encode(), np.uint8))), "02X") for b in t["body"]]
            yield pd.DataFrame({"value": [f"${b}*{c}" for b, c in zip(t["body"], sums, strict=True)], "sec": t["sec"]})

    lines = o.select(body.alias("body"), "sec").mapInPandas(summed, "value string, sec long")
    t = lambda a: F.substring("time", a, 2).cast("long")
    return text.parse_nmea(lines).select((t(1) * 3600 + t(3) * 60 + t(5)).alias("sec"), r(F.col("lat"), 6).alias("lat"), r(F.col("lon"), 6).alias("lon"), nmea.is_valid(F.col("status")).alias("valid"))


@register("fix_enu", f"WITH {FIX_SQL}, g AS (SELECT *, 6378137.0 AS a, 0.00669437999014131699613723 AS e2, CASE WHEN c_custkey % 2 = 0 THEN alt ELSE 0.0 END AS h FROM fix), n AS (SELECT *, a / sqrt(1 - e2 * sin(radians(lat)) * sin(radians(lat))) AS n FROM g), c AS (SELECT c_custkey, (n + h) * cos(radians(lat)) * cos(radians(lon)) - a AS x, (n + h) * cos(radians(lat)) * sin(radians(lon)) AS y, (n * (1 - e2) + h) * sin(radians(lat)) AS z FROM n) SELECT c_custkey, round(y, 3) + 0.0 AS e, round(z, 3) + 0.0 AS n, round(x, 3) + 0.0 AS u FROM c")
def fix_enu(spark, sf_dir):
    """Fixes of both kinds seen from the point at latitude and longitude 0."""
    kind = F.when(F.col("c_custkey") % 2 == 0, "GGA").otherwise("RMC")
    p = geo.fix_to_enu(kind, F.col("lat"), F.col("lon"), F.col("alt"), 0.0, 0.0)
    return fixes(spark, sf_dir).select("c_custkey", p.alias("p")).select("c_custkey", *[r(F.col(f"p.{c}"), 3).alias(c[0]) for c in ("east", "north", "up")])


@register("rotvec_quaternion", f"WITH {PTS_SQL}, a AS (SELECT frame, seq, x/25 AS x, y/50 AS y, z/5 AS z, sqrt(x/25*x/25 + y/50*y/50 + z/5*z/5) AS t FROM pts) SELECT round(sum(cos(t/2)), 4) + 0.0 AS w, round(sum(x*sin(t/2)/t), 4) + 0.0 AS x, round(sum(y*sin(t/2)/t), 4) + 0.0 AS y, round(sum(z*sin(t/2)/t), 4) + 0.0 AS z, frame FROM a WHERE t > 1e-9 GROUP BY frame")
def rotvec_quaternion(spark, sf_dir):
    v = F.array(F.col("x") / 25, F.col("y") / 50, F.col("z") / 5)
    q = numbered(spark, sf_dir).where("x <> 0 or y <> 0 or z <> 0").select("frame", se3.quaternion_from_rotvec(v).alias("q"))
    return q.groupBy("frame").agg(*[r(F.sum(F.col("q")[i]), 4).alias(c) for i, c in enumerate("wxyz")])


@register("source_bag", "SELECT event_type AS topic, epoch_us(ts)::DOUBLE AS \"timestamp\", CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'view') AND epoch_us(ts) >= (SELECT min(epoch_us(ts)) + 3600000000 FROM events)")
def source_bag(spark, sf_dir):
    """Events written as bags, read back in ranges of bytes, with topics and times tested on the heads of records."""
    from tessera.shared import new_path
    from tessera.sources import bag

    events = table(spark, sf_dir, "events").selectExpr("event_id AS offset", "event_type AS topic", f"CAST({MICROS} AS double) AS timestamp", "props AS data")
    path = new_path(spark, "bags")
    bag.write_parts(events, path)
    first = events.agg(F.min("timestamp")).first()[0]
    m = bag.read(spark, path, ["click", "view"], start=first + 3_600_000_000, split=1 << 20)
    return m.select("topic", "timestamp", F.get_json_object("data", "$.k").cast("long").alias("k"))


def _whole_frames(batches):
    """Lists of (frame, [n, 3] points) of rows frame, x, y, z that come frame by frame; a frame may begin in one batch and end in a later one."""
    last, held = None, []
    for b in batches:
        frame, xyz = b.column(0).to_numpy(), np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]).astype(np.float32)
        some = []
        for at, end in itertools.pairwise([0, *(np.flatnonzero(np.diff(frame)) + 1).tolist(), len(frame)]):
            if at == end:
                continue
            if held and frame[at] != last:
                some.append((last, np.concatenate(held)))
                held = []
            last = int(frame[at])
            held.append(xyz[at:end])
        if some:
            yield some
    if held:
        yield [(last, np.concatenate(held))]


def _as_files(files, path, suffix):
    """Each row (path, content) as a file of its own in a folder; the number of files."""
    from tessera.shared import file_system

    def run(batches):
        for b in batches:
            system, folder = file_system(path)
            system.create_dir(folder, recursive=True)
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with system.open_output_stream(f"{folder}/{name}{suffix}") as f:
                    f.write(content.as_py())
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["path"])

    return files.mapInArrow(run, "path string").count()


@register("source_livox", f"""WITH {_NUMBERED}, m AS (SELECT frame, idx, CAST(x * 1000 AS FLOAT) AS a, CAST(y * 1000 AS FLOAT) AS b, CAST(z * 1000 AS FLOAT) AS c, CAST(abs(x) * 1000 + 1 AS FLOAT)::DOUBLE / 1000 AS d, radians(CAST(y * 100 AS FLOAT)::DOUBLE / 100) AS zen, radians(CAST(z * 100 AS FLOAT)::DOUBLE / 100) AS az FROM num),
p AS (SELECT frame, idx, CASE frame % 3 WHEN 0 THEN a::DOUBLE / 1000 WHEN 1 THEN d * sin(zen) * cos(az) ELSE trunc(a) / 1000 END AS x, CASE frame % 3 WHEN 0 THEN b::DOUBLE / 1000 WHEN 1 THEN d * sin(zen) * sin(az) ELSE trunc(b) / 1000 END AS y, CASE frame % 3 WHEN 0 THEN c::DOUBLE / 1000 WHEN 1 THEN d * cos(zen) ELSE trunc(c) / 1000 END AS z FROM m)
SELECT frame AS file, idx // 21 AS frame, idx % 21 AS idx, round(CAST(x AS FLOAT)::DOUBLE, 3) + 0.0 AS x, round(CAST(y AS FLOAT)::DOUBLE, 3) + 0.0 AS y, round(CAST(z AS FLOAT)::DOUBLE, 3) + 0.0 AS z, round(CAST((idx % 256) / 255.0 AS FLOAT)::DOUBLE, 4) + 0.0 AS intensity FROM p""")
def source_livox(spark, sf_dir):
    """Recordings of the three kinds of points, in packages of seven points and frames of three packages, read from files in runs of frames."""
    import struct

    from tessera.shared import new_path
    from tessera.sources import livox

    def pack(frame: int, xyz: np.ndarray) -> bytes:
        kind, n = frame % 3, len(xyz)
        mm = xyz * np.float32(1000)
        light = (np.arange(n) % 256).astype(np.float32)
        if kind == 2:
            records = np.zeros(n, np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("i", "u1"), ("tag", "u1")]))
            for k, c in enumerate("xyz"):
                records[c] = np.trunc(mm[:, k])
            records["i"] = light
        else:
            records = np.zeros((n, 4), "<f4")
            if kind == 0:
                records[:, :3] = mm
            else:
                records[:, 0] = np.abs(xyz[:, 0]) * np.float32(1000) + np.float32(1)
                records[:, 1:3] = xyz[:, 1:] * np.float32(100)
            records[:, 3] = light
        parts = [livox.SIGNATURE + bytes([1, 1, 0, 0]) + bytes(8) + bytes([1, 0]) + bytes(livox.DEVICE_V1)]
        at = len(parts[0])
        for f in range(0, n, 21):
            body = b""
            for p in range(f, min(f + 21, n), 7):
                raw = records[p : min(p + 7, f + 21, n)].tobytes()
                body += bytes([0, kind, 0]) + struct.pack("<QI", 0, 0) + struct.pack("<I", livox.PACKAGE_V1 + len(raw)) + raw
            parts.append(struct.pack("<QQQ", at, at + livox.FRAME + len(body), f) + body)
            at += len(parts[-1])
        return b"".join(parts)

    def packed(batches):
        for some in _whole_frames(batches):
            names = [str(frame) for frame, _ in some]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pack(*f) for f in some], pa.binary())], names=["path", "content"])

    path = new_path(spark, "livox")
    rows = pts(spark, sf_dir).repartition("frame").sortWithinPartitions("frame", "seq").select("frame", "x", "y", "z")
    _as_files(rows.mapInArrow(packed, "path string, content binary"), path, ".lvx")
    p = livox.read(spark, path, split=1 << 16)
    file = F.substring_index(F.substring_index("path", "/", -1), ".", 1).cast("long")
    return p.select(file.alias("file"), "frame", "idx", *[r(F.col(c).cast("double"), 3).alias(c) for c in "xyz"], r(F.col("intensity").cast("double"), 4).alias("intensity"))


_MSM_SQL = """WITH c AS (SELECT c_custkey AS k, 299792.458::DOUBLE AS ms, 299792458.0::DOUBLE / 1575420000.0::DOUBLE AS wave FROM customer),
rough AS (SELECT *, k % 200 + CASE WHEN k % 2 = 0 THEN 0 ELSE (k * 7) % 1024 / 1024.0::DOUBLE END AS a, k % 100 + 60 + CASE WHEN k % 2 = 0 THEN 0 ELSE (k * 11) % 1024 / 1024.0::DOUBLE END AS b FROM c),
cell AS (SELECT *, unnest([0, 1, 2]) AS cell, unnest([a, a, b]) AS rough, unnest([k % 1024, k * 3 % 1024, k * 5 % 1024]) AS part, unnest([k % 1000 - 500, k * 3 % 1000 - 500, k * 5 % 1000 - 500]) AS fine, unnest([k % 5000 - 2500, k * 3 % 5000 - 2500, k * 5 % 5000 - 2500]) AS phase FROM rough)
SELECT k AS path, CASE WHEN k % 2 = 0 THEN 1074 ELSE 1127 END AS message, CASE WHEN k % 2 = 0 THEN 'GPS' ELSE 'BEIDOU' END AS system, k % 4096 AS station, k AS epoch,
  CAST(9223372036854775808::HUGEINT + (1::HUGEINT << CAST(62 - k % 63 AS INT)) AS VARCHAR) AS satellites, 2147483648 + (1::BIGINT << CAST(30 - k % 31 AS INT)) AS signals, cell,
  round(CASE WHEN k % 2 = 0 THEN (rough + part / 1024.0::DOUBLE) * ms ELSE (rough + fine / 536870912.0::DOUBLE) * ms END, 3) + 0.0 AS range,
  CASE WHEN k % 2 = 1 THEN round(rough * ms / wave + phase / 16777216.0::DOUBLE, 3) + 0.0 END AS phase FROM cell"""


@register("source_msm", _MSM_SQL)
def source_msm(spark, sf_dir):
    """An observation message a customer, MSM4 or MSM7, of two satellites and two signals with three of the four cells; a damaged copy stands before it."""

    def build(batches):
        for t in batches:
            content = []
            for k in t["c_custkey"].tolist():
                seven = k % 2
                fields = [(1127 if seven else 1074, 12), (k % 4096, 12), (k, 30), (0, 16), (1 << 63 | 1 << 62 - k % 63, 64), (1 << 31 | 1 << 30 - k % 31, 32), (0b1101, 4), (k % 200, 8), (k % 100 + 60, 8)]
                if seven:
                    fields += [(k * 7 % 1024, 10), (k * 11 % 1024, 10), *[(k * m % 1000 - 500, 20) for m in (1, 3, 5)], *[(k * m % 5000 - 2500, 24) for m in (1, 3, 5)]]
                else:
                    fields += [(k * m % 1024, 10) for m in (1, 3, 5)]
                body = bits = 0
                for v, n in fields:
                    body, bits = body << n | v & ((1 << n) - 1), bits + n
                pad = -bits % 8
                good = _framed(body << pad, bits + pad)
                content.append(good[:-1] + bytes([good[-1] ^ 1]) + good)
            yield pd.DataFrame({"path": t["c_custkey"].astype(str), "content": content})

    m = rtcm.parse(table(spark, sf_dir, "customer").select("c_custkey").mapInPandas(build, "path string, content binary"))
    cells = m.select(F.col("path").cast("long").alias("path"), "message", "msm.*", F.posexplode("msm.ranges").alias("cell", "_range"))
    return cells.select("path", "message", "system", F.col("station").cast("long").alias("station"), "epoch", "satellites", "signals", "cell", r(F.col("_range"), 3).alias("range"), r(F.get("phases", "cell"), 3).alias("phase"))
