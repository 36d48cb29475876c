"""Formats: bytes made here, read back through Spark."""

import struct

import numpy as np
import pytest

from tessera.errors import BagError, SensorError
from tessera.sources import bag, binary, livox, rtcm, text


def test_binary_layouts(spark, tmp_path):
    v = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "v.bin").write_bytes(v.tobytes())
    got = binary.read_velodyne(spark, str(tmp_path / "v.bin")).orderBy("idx").toPandas()
    assert np.allclose(got[["x", "y", "z", "intensity"]], v)
    assert len(binary.ouster(v.tobytes())) == 3 and binary.ouster(v.tobytes()).dtype.names == ("x", "y", "z", "intensity")
    wide = np.random.default_rng(0).random((3, 8)).astype("<f4")
    assert len(binary.ouster(wide.tobytes())) == 3 and len(binary.ouster(wide.tobytes(), 4)) == 6
    assert len(binary.ouster(b"")) == 0
    with pytest.raises(SensorError):
        binary.velodyne(b"123")


def test_imu_prefers_the_short_record(spark, tmp_path):
    r = np.zeros(4, np.dtype(binary.IMU))
    r["timestamp"] = np.arange(4)
    (tmp_path / "i.bin").write_bytes(r.tobytes())
    got = binary.read_imu(spark, str(tmp_path / "i.bin")).toPandas()
    assert got.timestamp.tolist() == [0, 1, 2, 3] and got.qw.isna().all()
    assert len(binary.imu(np.zeros(1, np.dtype(binary.IMU_ORIENTED)).tobytes())) == 1
    assert len(binary.imu(np.zeros(2, np.dtype(binary.IMU_ORIENTED)).tobytes())) == 3


def test_radar(spark, tmp_path):
    r = np.arange(20, dtype="<f4").reshape(4, 5)
    (tmp_path / "r.bin").write_bytes(r.tobytes())
    assert binary.read_radar(spark, str(tmp_path / "r.bin")).count() == 4
    with pytest.raises(SensorError):
        binary.radar(b"1234")


def lvx(points: bytes, kind: int) -> bytes:
    head = livox.SIGNATURE + bytes([1, 1, 0, 0]) + struct.pack("<I", 0) + bytes(4) + bytes([1, 0])
    package = bytes([0, kind, 0]) + struct.pack("<QI", 0, 0) + struct.pack("<I", livox.PACKAGE_V1 + len(points)) + points
    at = len(head) + livox.DEVICE_V1
    return head + bytes(livox.DEVICE_V1) + struct.pack("<QQQ", at, at + livox.FRAME + len(package), 0) + package


def test_livox(spark, tmp_path):
    data = lvx(struct.pack("<4f", 1000, 2000, 3000, 255), 0)
    (tmp_path / "a.lvx").write_bytes(data)
    got = livox.read(spark, str(tmp_path / "a.lvx")).toPandas()
    assert np.allclose(got[["x", "y", "z", "intensity"]], [[1, 2, 3, 1]])
    assert np.allclose(livox.decode(lvx(struct.pack("<iiibb", 1000, 0, -1000, -1, 0), 2)), [[1, 0, -1, 1]])
    assert np.allclose(livox.decode(lvx(struct.pack("<4f", 1000, 9000, 0, 0), 1)), [[1, 0, 0, 0]], atol=1e-6)
    assert len(livox.decode(lvx(b"", 9))) == 0
    with pytest.raises(SensorError):
        livox.decode(b"x" * 40)


def rtcm_frame(payload: bytes) -> bytes:
    f = bytes([rtcm.PREAMBLE, len(payload) >> 8, len(payload) & 255]) + payload
    return f + rtcm.crc24q(f).to_bytes(3, "big")


def bits(*pairs) -> bytes:
    v = n = 0
    for value, width in pairs:
        v, n = v << width | value & ((1 << width) - 1), n + width
    pad = -n % 8
    return (v << pad).to_bytes((n + pad) // 8, "big")


def test_rtcm(spark, tmp_path):
    station = bits((1005, 12), (7, 12), (0, 6), (0, 4), (10000, 38), (0, 2), (-20000, 38), (0, 2), (30000, 38))
    msm = bits((1074, 12), (7, 12), (5, 30), (0, 1), (0, 3), (0, 7), (0, 2), (0, 3), (1 << 63 | 1, 64), (1 << 31, 32), (1, 1), (1, 1), (70, 8), (71, 8), (512, 10), (0, 10))
    good, bad = rtcm_frame(station), bytearray(rtcm_frame(station))
    bad[-1] ^= 1
    (tmp_path / "a.rtcm").write_bytes(b"junk" + good + bytes(bad) + rtcm_frame(msm) + good[:10])
    rows = rtcm.read(spark, str(tmp_path / "a.rtcm")).orderBy("offset").collect()
    assert [r.message for r in rows] == [1005, 1074]
    assert rows[0].station.x == pytest.approx(1.0) and rows[0].station.y == pytest.approx(-2.0) and rows[0].station.station == 7
    assert rows[1].msm.satellites == str(1 << 63 | 1)
    assert rows[1].msm.ranges == pytest.approx([70.5 * rtcm.LIGHT_MS, 71 * rtcm.LIGHT_MS])
    assert rtcm.crc24q(b"") == 0
    folder = tmp_path / "arriving"
    folder.mkdir()
    (folder / "a.rtcm").write_bytes(good + rtcm_frame(msm))
    q = rtcm.read_stream(spark, str(folder)).writeStream.format("memory").queryName("rtcm_messages").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.message for r in spark.table("rtcm_messages").collect()) == [1005, 1074]


def test_bag(spark, tmp_path):
    p = str(tmp_path / "a.sbag")
    with bag.Writer(p) as w:
        w.write("/b", 2.0, {"k": 1})
        w.write("/a", 1.0, {"xyz": np.eye(2)})
        with pytest.raises(SensorError):
            w.write("", 0, {})
    with pytest.raises(BagError):
        w.write("/a", 0, {})
    t = bag.read(spark, p)
    assert [r.topic for r in t.orderBy("offset").collect()] == ["/b", "/a"]
    assert bag.read_messages(t, "/a", 0.5, 1.0).count() == 1 and bag.read_messages(t, start=1.5).count() == 1
    q = str(tmp_path / "b.sbag")
    bag.write(t, q)
    assert bag.read(spark, q).select("topic", "timestamp", "data").exceptAll(t.select("topic", "timestamp", "data")).count() == 0
    raw = open(p, "rb").read()
    assert len(list(bag.messages(raw[:-10]))) == 1
    with pytest.raises(BagError):
        list(bag.messages(b"nothing"))


@pytest.mark.parametrize("colours", [False, True])
def test_clouds_as_text(spark, tmp_path, colours):
    rows = [(0, 1.0, 2.0, 3.0, 255, 0, 7), (1, -1.5, 0.0, 0.25, 1, 2, 3)]
    c = spark.createDataFrame(rows, "seq long, x double, y double, z double, r short, g short, b short")
    c = c if colours else c.drop("r", "g", "b")
    for write, read, name in ((text.write_pcd, text.read_pcd, "c.pcd"), (text.write_ply, text.read_ply, "c.ply")):
        write(c, str(tmp_path / name))
        assert sorted(read(spark, str(tmp_path / name)).collect()) == sorted(c.collect())
    (tmp_path / "b.pcd").write_text("FIELDS x y z\nDATA binary\n")
    with pytest.raises(SensorError):
        text.read_pcd(spark, str(tmp_path / "b.pcd"))


def test_poses(spark, tmp_path):
    p = spark.createDataFrame([(0.0, 1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0), (0.1, 4.0, 5.0, 6.0, 1.0, 0.0, 0.0, 0.0)], text.POSE)
    text.write_poses_csv(p, str(tmp_path / "p.csv"), 0.2)
    got, d = text.read_poses_csv(spark, str(tmp_path / "p.csv"))
    assert d == 0.2 and sorted(got.collect()) == sorted(p.collect())
    text.write_poses_yaml(p, str(tmp_path / "p.yaml"), 0.3)
    got, d = text.read_poses_yaml(spark, str(tmp_path / "p.yaml"))
    assert d == 0.3 and sorted(got.collect()) == sorted(p.collect())


def test_nmea(spark, tmp_path):
    (tmp_path / "n.txt").write_text("$GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,*47\nnoise\n$GPRMC,123519,A,4807.038,S,01131.000,W,022.4,084.4,230394,003.1,W\n$GPGGA,1,2*00\n$GPXXX,1\n")
    got = text.read_nmea(spark, str(tmp_path / "n.txt")).collect()
    assert [r.kind for r in got] == ["GGA", "RMC"]
    assert got[0].lat == pytest.approx(48.1173) and got[0].altitude == 545.4
    assert got[1].lat == pytest.approx(-48.1173) and got[1].lon == pytest.approx(-11.516666667) and got[1].status == "A"


def test_a_sentence_is_parsed_once_and_by_many_tasks(spark, data):
    """Dropping lines without a fix must not parse them again, and one small file must not make one task."""
    from tessera.queries import geometry

    found = geometry.nmea_parse(spark, data)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("GPGGA, 120000") == 1 and plan.count("StartsWith(") == 1
    assert found.rdd.getNumPartitions() == geometry.TASKS


def test_checksums(spark):
    from pyspark.sql import functions as F

    from tessera.functions import nmea

    def plain(s):
        body, star, told = s.removeprefix("$").rpartition("*")
        if not star:
            return told
        if not told[:2] or not all(c in "0123456789abcdefABCDEF" for c in told[:2]):
            return None
        x = 0
        for c in body:
            x ^= ord(c)
        return body if x == int(told[:2], 16) else None

    lines = ["$A,b*23", "$AB*3", "$AB*03", "$AB*03xyz", "$AB*04", "$AB*", "$AB*g1", "AB*03", "$$AB*27", "$A*B*29", "$A*B*2A", "$", "", "$AB", "$a\u00e9*88", "$a\nb*09", "$O*4f", "*00", "$*0"]
    rows = spark.createDataFrame([(s,) for s in lines], "value string").select("value", nmea.strip_checksum(F.col("value")).alias("body")).collect()
    assert {r.value: r.body for r in rows} == {s: plain(s) for s in lines}
    assert sum(r.body is not None for r in rows) >= 9


def recording(frames, kind, version=1):
    """A recording of frames of packages of raw points."""
    device, head = (livox.DEVICE_V1, livox.PACKAGE_V1) if version < 2 else (livox.DEVICE_V2, livox.PACKAGE_V2)
    out = livox.SIGNATURE + bytes([version, 1, 0, 0]) + bytes(8) + bytes([2, 0]) + bytes(2 * device)
    for packages in frames:
        body = b"".join(bytes([0, kind]) + bytes(head - 6) + struct.pack("<I", head + len(p)) + p for p in packages)
        out += struct.pack("<QQQ", len(out), len(out) + livox.FRAME + len(body), 0) + body
    return out


@pytest.mark.parametrize(("kind", "version"), [(0, 1), (2, 1), (0, 2)])
def test_livox_in_runs_of_frames(spark, tmp_path, kind, version):
    """Runs of one frame, some or all give what decoding the whole gives; a cut-off frame gives its whole packages."""
    rng = np.random.default_rng(kind)
    frames = [[rng.integers(0, 100, 14 * 16 * int(rng.integers(0, 3)), np.uint8).tobytes() if kind == 2 else rng.uniform(0, 100, 4 * int(rng.integers(0, 9))).astype("<f4").tobytes() for _ in range(rng.integers(0, 4))] for _ in range(25)]
    data = recording(frames, kind, version)
    (tmp_path / "a.lvx").write_bytes(data)
    (tmp_path / "b.lvx").write_bytes(data[:-20])
    for split in (1, 1500, 1 << 20):
        got = livox.read(spark, str(tmp_path / "*.lvx"), split=split).orderBy("path", "frame", "idx").toPandas()
        for name, raw in (("a", data), ("b", data[:-20])):
            own = got[got.path.str.endswith(f"{name}.lvx")]
            assert np.allclose(own[["x", "y", "z", "intensity"]].to_numpy(), livox.decode(raw).astype(np.float32), equal_nan=True)
            assert own.frame.max() <= 24 and (own.groupby("frame").idx.max() + 1 == own.groupby("frame").size()).all()


def mixed_recording(seed: int, frames: int) -> tuple[bytes, list[np.ndarray]]:
    """A recording whose frames mix kinds (one unknown), partial last points and packages without points; and the points of each frame, taken package by package."""
    rng = np.random.default_rng(seed)
    out = livox.SIGNATURE + bytes([1, 1, 0, 0]) + bytes(8) + bytes([2, 0]) + bytes(2 * livox.DEVICE_V1)
    want = []
    for k in range(frames):
        body, got = b"", [np.zeros((0, 4))]
        for _ in range(rng.integers(0, 5)):
            kind = int(rng.choice([0, 1, 2, 7]))
            raw = rng.uniform(0, 100, 4 * int(rng.integers(0, 6))).astype("<f4").tobytes() + bytes(int(rng.integers(0, 5)))
            got.append(livox.points(raw, kind))
            body += bytes([0, kind]) + bytes(livox.PACKAGE_V1 - 6) + struct.pack("<I", livox.PACKAGE_V1 + len(raw)) + raw
        if k % 7 == 3:
            body += bytes(livox.PACKAGE_V1 + 32)  # a package of length 0 ends the frame
        out += struct.pack("<QQQ", len(out), len(out) + livox.FRAME + len(body), k) + body
        want.append(np.concatenate(got))
    return out, want


def test_livox_packages_are_decoded_together(spark, tmp_path, monkeypatch):
    """A decoding a kind and not one a package, in the order of packages; many small files are read by a fixed number of tasks."""
    files = [mixed_recording(seed, 30) for seed in range(20)]
    for k, (data, _) in enumerate(files):
        (tmp_path / f"{k}.lvx").write_bytes(data)
    for split in (200, 1 << 20):
        read = livox.read(spark, str(tmp_path), split=split)
        assert read.rdd.getNumPartitions() == max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        got = read.orderBy("path", "frame", "idx").toPandas()
        for k, (_, want) in enumerate(files):
            own = got[got.path.str.endswith(f"/{k}.lvx")]
            assert own.frame.tolist() == [f for f, w in enumerate(want) for _ in w] and own.idx.tolist() == [i for w in want for i in range(len(w))]
            assert np.allclose(own[["x", "y", "z", "intensity"]].to_numpy(), np.concatenate(want).astype(np.float32), equal_nan=True)
    calls, plain = [], livox.points
    monkeypatch.setattr(livox, "points", lambda *a: calls.append(a) or plain(*a))
    assert np.allclose(livox.decode(files[0][0]), np.concatenate(files[0][1]), equal_nan=True)
    assert len(calls) <= 3


def test_frames_that_go_over_batches():
    import pyarrow as pa

    from tessera.queries.sources import _whole_frames

    frame = np.repeat([5, 2, 9, 4], [3, 1, 7, 2])
    rows = pa.RecordBatch.from_arrays([pa.array(frame), *[pa.array(np.arange(13.0) + c) for c in range(3)]], names=["frame", "x", "y", "z"])
    for size in (1, 2, 5, 13):
        got = [f for some in _whole_frames(rows.slice(at, size) for at in range(0, 13, size)) for f in some]
        assert [f for f, _ in got] == [5, 2, 9, 4] and np.array_equal(np.concatenate([x for _, x in got])[:, 0], np.arange(13))
        assert [len(x) for _, x in got] == [3, 1, 7, 2]
    assert not list(_whole_frames(iter([rows.slice(0, 0)])))


def plain_observations(payload: bytes, kind: int):
    """Bit by bit."""
    b = rtcm.Bits(payload)
    out = {"station": None, "epoch": None, "satellites": 0, "signals": 0, "ranges": [], "phases": []}
    try:
        b.take(12)
        out["station"] = b.take(12)
        out["epoch"] = b.take(30)
        b.take(16)
        sats, sigs = b.take(64), b.take(32)
        out["satellites"], out["signals"] = sats, sigs
        ns, ng = sats.bit_count(), sigs.bit_count()
        used = [i // ng for i in range(ns * ng) if b.take(1)]
        whole = [b.take(8) for _ in range(ns)]
        if kind % 10 == 7:
            rough = [w + b.take(10) / 1024 for w in whole]
            fine = [b.signed(20) * 2.0**-29 for _ in used]
            phase = [b.signed(24) * 2.0**-24 for _ in used]
            out["ranges"] = [(rough[s] + f) * rtcm.LIGHT_MS for s, f in zip(used, fine, strict=True)]
            out["phases"] = [rough[s] * rtcm.LIGHT_MS / rtcm.L1_WAVE + f for s, f in zip(used, phase, strict=True)]
        else:
            part = [b.take(10) / 1024 for _ in used]
            out["ranges"] = [(whole[s] + p) * rtcm.LIGHT_MS for s, p in zip(used, part, strict=True)]
    except EOFError:
        pass
    return out


def test_observations_many_at_once():
    """Random masks and bits, of every length, of all systems and kinds."""
    rng = np.random.default_rng(4)
    payloads, kinds = [], []
    for i in range(400):
        kind = int(rng.choice([1074, 1077, 1085, 1096, 1097, 1124, 1127]))
        sats, sigs = (int(sum(1 << int(k) for k in rng.choice(n, rng.integers(0, m), replace=False))) for n, m in ((64, 9), (32, 5)))
        head = bits((kind, 12), (i, 12), (i * 1000, 30), (0, 16), (sats, 64), (sigs, 32))
        raw = head + rng.integers(0, 256, int(rng.integers(0, 400)), np.uint8).tobytes()
        payloads.append(raw[: int(rng.integers(2, len(raw)))] if i % 3 == 0 else raw)
        kinds.append(kind)
    got = rtcm.observations(payloads, kinds)
    for p, k, g in zip(payloads, kinds, got, strict=True):
        want = plain_observations(p, k)
        assert (g["station"], g["epoch"], int(g["satellites"]), g["signals"]) == (want["station"], want["epoch"], want["satellites"], want["signals"])
        assert g["ranges"] == pytest.approx(want["ranges"]) and g["phases"] == pytest.approx(want["phases"])
    assert rtcm.observations([], []) == [] and sum(bool(g["ranges"]) for g in got) > 100


def test_checksum_by_table():
    def plain(data):
        crc = 0
        for b in data:
            crc ^= b << 16
            for _ in range(8):
                crc <<= 1
                if crc & 0x1000000:
                    crc ^= rtcm.POLYNOMIAL
        return crc & 0xFFFFFF

    data = np.random.default_rng(0).integers(0, 256, 300, np.uint8).tobytes()
    assert all(rtcm.crc24q(data[:n]) == plain(data[:n]) for n in (0, 1, 2, 17, 300))


@pytest.mark.parametrize("read", ["pcd", "ply"])
def test_clouds_in_splits(spark, tmp_path, read):
    """Splits of a few lines, headers of 100 lines, several files kept apart, blank lines, faces after the vertices, a colour in one file only."""
    rng = np.random.default_rng(6)
    want = {}
    for name, n, colour in (("a", 300, True), ("b", 70, False), ("c", 0, False)):
        p = np.round(rng.uniform(-9, 9, (n, 3)), 3)
        body = [" ".join(map(str, r)) + (" 1 2 3" if colour else "") for r in p.tolist()]
        extra = [f"comment line {i}" if read == "ply" else f"# line {i}" for i in range(100)]
        if read == "ply":
            head = ["ply", "format ascii 1.0", *extra, f"element vertex {n}", *[f"property float {c}" for c in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue") if colour], "element face 1", "property list uchar int vertex_indices", "end_header"]
            body.append("3 0 1 2")
        else:
            head = [*extra, "FIELDS x y z" + " r g b" * colour, f"POINTS {n}", "DATA ascii"]
            body += ["", " "]
        (tmp_path / f"{name}.{read}").write_text(("\r\n" if name == "b" else "\n").join(head + body) + "\n")
        want[name] = p
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        f = text.read_pcd if read == "pcd" else text.read_ply
        got = f(spark, str(tmp_path), with_path=True)
        assert got.columns == ["path", "seq", "x", "y", "z"]
        got = got.toPandas()
        for name, p in want.items():
            own = got[got.path.str.endswith(f"{name}.{read}")].sort_values("seq")
            assert own.seq.tolist() == list(range(len(p))) and np.allclose(own[["x", "y", "z"]].to_numpy().reshape(-1, 3), p)
        one = f(spark, str(tmp_path / f"a.{read}"))
        assert one.columns == ["seq", "x", "y", "z", "r", "g", "b"] and one.rdd.getNumPartitions() > 3 and one.where("b = 3").count() == 300
        with pytest.raises(SensorError, match="several"):
            f(spark, str(tmp_path))
        (tmp_path / "a.txt").write_text("no header\nat all\n")
        with pytest.raises(SensorError, match="header"):
            f(spark, str(tmp_path / "a.txt"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
